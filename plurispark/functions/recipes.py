"""Rendering recipe templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubled brace, placeholder, plain run, or a stray brace (always an error).
_TOKEN = r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"


def render_recipe(template: Column, inputs: Column, decisions: Column, output: Column) -> Column:
    """Substitute a template's placeholders.

    *inputs* is an ordered ``array<struct<name,path>>``, *decisions* a string
    map. Gives ``struct<recipe, errors>``: a recipe is NULL when any
    placeholder is unknown, undeclared or carries a format spec, and errors
    then lists each offending token in text order.
    """
    by_name = F.map_from_entries(inputs)

    def value(token: Column) -> Column:
        key = F.regexp_extract(token, r"^\{(?:inputs|decisions)\.([^{}:!]+)\}$", 1)
        return (
            F.when(token == "{{", F.lit("{"))
            .when(token == "}}", F.lit("}"))
            .when(~token.rlike(r"^[{}]"), token)
            .when(token == "{output}", output)
            .when(token == "{inputs}", F.array_join(F.transform(inputs, lambda i: i["path"]), " "))
            .when(F.startswith(token, F.lit("{inputs.")), F.try_element_at(by_name, key))
            .when(F.startswith(token, F.lit("{decisions.")), F.try_element_at(decisions, key))
        )

    tokens = F.regexp_extract_all(template, F.lit(_TOKEN), F.lit(1))
    parts = F.transform(tokens, lambda t: F.struct(t.alias("token"), value(t).alias("text")))
    errors = F.transform(F.filter(parts, lambda p: p["text"].isNull()), lambda p: p["token"])
    recipe = F.when(
        F.size(errors) == 0, F.array_join(F.transform(parts, lambda p: p["text"]), "")
    )
    return F.struct(recipe.alias("recipe"), errors.alias("errors"))
