"""Evaluating one analysis in every universe with a single pass over the data.

A universe picks one option per decision. A *keep* decision's options each keep
some rows; a *value* decision's options each compute the measured value. Rows
are never multiplied by universes: they are first aggregated into cells, one per
combination of the options that keep them, and universes then read the cells.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.session import broadcast_if_small, small


@dataclass(frozen=True)
class Keep:
    """A decision whose options each keep the rows their predicate holds for."""

    decision: str
    options: Mapping[str, Column]


@dataclass(frozen=True)
class Value:
    """A decision whose options each compute the measured value."""

    decision: str
    options: Mapping[str, Column]


@dataclass(frozen=True)
class Measure:
    """``count``, ``sum``, ``min``, ``max`` or ``avg`` of a column or a value decision."""

    kind: str
    of: Column | Value | None = None


#: Measure kind to the partial aggregates it is folded from.
_PARTIALS = {
    "count": ("count",),
    "sum": ("sum",),
    "min": ("min",),
    "max": ("max",),
    "avg": ("sum", "count"),
}
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_AGAIN = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _kept(keep: Keep, prefix: str) -> Column:
    """The options that keep a row, as an array, from its flag columns."""
    flags = [F.when(F.col(f"{prefix}{i}"), F.lit(o)) for i, o in enumerate(keep.options)]
    return F.array_compact(F.array(*flags))


def unknown_choices(universes: DataFrame, declared: Sequence[Keep | Value]) -> DataFrame:
    """``universe_id, decision, option`` of every choice that nobody declared; a missing choice has a NULL option."""
    known = F.array(*[
        F.struct(F.lit(d.decision).alias("decision"), F.array(*[F.lit(o) for o in d.options]).alias("options")) for d in declared
    ])
    asked = universes.select("universe_id", F.coalesce("decisions", F.create_map().cast("map<string,string>")).alias("_d"))
    wrong = asked.select("universe_id", F.explode(known).alias("_k"), "_d").select(
        "universe_id", F.col("_k.decision").alias("decision"), F.try_element_at("_d", F.col("_k.decision")).alias("option"), F.col("_k.options").alias("_o"),
    ).where(~F.coalesce(F.array_contains("_o", F.col("option")), F.lit(False))).drop("_o")
    names = F.array(*[F.lit(d.decision) for d in declared])
    extra = asked.select("universe_id", F.explode("_d").alias("decision", "option")).where(~F.array_contains(names, F.col("decision")))
    return wrong.union(extra)


def multiverse(
    data: DataFrame,
    universes: DataFrame,
    keeps: Sequence[Keep],
    measures: Mapping[str, Measure],
    by: Sequence[str] = (),
) -> DataFrame:
    """Evaluate *measures* per universe (and per *by* group).

    *universes* has ``universe_id`` and ``decisions map<string,string>``. One
    partial and one final aggregation run over the data; what follows works on
    cells, at most ``groups * 2**options`` rows. Without *by*, a universe that
    keeps no row is still reported, with a count of zero. A universe without a
    declared option for one of these decisions is not evaluated; see
    :func:`unknown_choices`. Only options that some universe takes are expanded.
    """
    values = list({m.of.decision: m.of for m in measures.values() if isinstance(m.of, Value)}.values())

    position = {value.decision: v for v, value in enumerate(values)}

    flags = [
        F.coalesce(p, F.lit(False)).alias(f"_k{k}_{i}")
        for k, keep in enumerate(keeps)
        for i, p in enumerate(keep.options.values())
    ]
    names = [f"_k{k}_{i}" for k, keep in enumerate(keeps) for i in range(len(keep.options))]

    partials: list[Column] = []
    inputs: list[Column] = []
    folds: list[Column] = []
    for m, (name, measure) in enumerate(measures.items()):
        options = list(measure.of.options.values()) if isinstance(measure.of, Value) else [
            measure.of if measure.of is not None else F.lit(1)
        ]
        for o, column in enumerate(options):
            inputs.append(column.alias(f"_v{m}_{o}"))
            for kind in _PARTIALS[measure.kind]:
                partials.append(_FIRST[kind](f"_v{m}_{o}").alias(f"_p{m}_{o}_{kind}"))

    declared = [*keeps, *values]
    valid = functools.reduce(
        lambda a, b: a & b,
        (F.coalesce(F.col("decisions")[d.decision].isin(*d.options), F.lit(False)) for d in declared), F.lit(True))
    chosen = universes.where(valid).select("universe_id", *[F.col("decisions")[d.decision].alias(f"_d_{d.decision}") for d in declared])

    narrow = data.select(*by, *flags, *inputs)
    if names:  # a row no option keeps takes part in no universe
        for k, keep in enumerate(keeps):
            narrow = narrow.where(
                functools.reduce(lambda a, b: a | b, (F.col(f"_k{k}_{i}") for i in range(len(keep.options))))
            )
    cells = narrow.groupBy(*by, *names).agg(*partials)

    # Cells become arms decision by decision; after each, only prefixes of choices that occur stay,
    # so there are never more arms for a cell than there are distinct choices.
    choices = chosen.drop("universe_id").distinct()
    hint = F.broadcast if declared and small(choices) else lambda df: df

    def occurring(rows: DataFrame, upto: int) -> DataFrame:
        prefix = [f"_d_{d.decision}" for d in declared[:upto]]
        return rows.join(hint(choices.select(*prefix).distinct()), prefix, "left_semi")

    for k, keep in enumerate(keeps):
        cells = occurring(cells.withColumn(f"_d_{keep.decision}", F.explode(_kept(keep, f"_k{k}_"))), k + 1)
    for v, value in enumerate(values):
        arms = [
            F.struct(
                F.lit(option).alias("option"),
                *[
                    F.col(f"_p{m}_{o}_{kind}").alias(f"_f{m}_{kind}")
                    for m, measure in enumerate(measures.values())
                    if isinstance(measure.of, Value) and measure.of.decision == value.decision
                    for kind in _PARTIALS[measure.kind]
                ],
            )
            for o, option in enumerate(value.options)
        ]
        cells = cells.withColumn(f"_a{v}", F.explode(F.array(*arms)))
        cells = occurring(cells.withColumn(f"_d_{value.decision}", F.col(f"_a{v}.option")), len(keeps) + v + 1)
    for m, measure in enumerate(measures.values()):
        for kind in _PARTIALS[measure.kind]:
            source = (
                F.col(f"_a{position[measure.of.decision]}._f{m}_{kind}")
                if isinstance(measure.of, Value)
                else F.col(f"_p{m}_0_{kind}")
            )
            folds.append(_AGAIN[kind](source).alias(f"_r{m}_{kind}"))
    decisions = [d.decision for d in (*keeps, *values)]
    arms = cells.groupBy(*by, *[f"_d_{d}" for d in decisions]).agg(*folds)

    joined = chosen.join(arms, [f"_d_{d}" for d in decisions], "inner" if by else "left")

    columns: list[Column] = []
    for m, (name, measure) in enumerate(measures.items()):
        if measure.kind == "avg":
            column = F.try_divide(F.col(f"_r{m}_sum"), F.col(f"_r{m}_count"))
        else:
            column = F.col(f"_r{m}_{measure.kind}")
        if measure.kind == "count":
            column = F.coalesce(column, F.lit(0))
        columns.append(column.alias(name))
    return joined.select("universe_id", *by, *columns)


# --- recipes: user code with declared inputs and decisions -------------------


class RecipeError(ValueError):
    """A recipe asked for something its declaration does not name."""


class Declared(Mapping):
    """Read-only mapping that refuses names outside a recipe's declaration."""

    def __init__(self, kind: str, values: Mapping):
        self._kind, self._values = kind, dict(values)

    def __getitem__(self, name):
        if name not in self._values:
            raise RecipeError(f"undeclared {self._kind} `{name}`; declared: {', '.join(sorted(self._values)) or 'none'}")
        return self._values[name]

    def __iter__(self):
        return iter(self._values)

    def __len__(self):
        return len(self._values)


@dataclass(frozen=True)
class Recipe:
    """A function from input DataFrames and decision Columns to one output DataFrame."""

    function: Callable
    inputs: tuple[str, ...]
    decisions: tuple[str, ...]
    format: str
    name: str = field(default="")


def recipe(inputs: Sequence[str] = (), decisions: Sequence[str] = (), format: str = "parquet"):
    """Declare a recipe. The function gets ``(inputs, decisions)`` and must keep ``arm_id``."""

    def wrap(function: Callable) -> Recipe:
        return Recipe(function, tuple(inputs), tuple(decisions), format, function.__name__)

    return wrap


#: Arms are literals of the plan; more of them run as further plans of this size.
ARMS_PER_PLAN = 256


def run_recipe(what: Recipe, tables: Mapping[str, DataFrame], universes: DataFrame) -> DataFrame:
    """Run *what* for every universe, once per distinct choice of its own decisions.

    Universes that differ only in decisions the recipe does not declare share an
    *arm*. Each input carries ``arm_id`` and its decision columns, added by
    exploding a literal array; the recipe groups by ``arm_id``. Arms beyond
    ``ARMS_PER_PLAN`` are evaluated in further plans and unioned, so any number
    of universes gives whole results.
    """
    missing = [n for n in what.inputs if n not in tables]
    if missing:
        raise RecipeError(f"no table for the declared inputs: {', '.join(sorted(missing))}")
    choice = F.to_json(F.array(*[F.col("decisions")[d] for d in what.decisions])) if what.decisions else F.lit("[]")
    keyed = universes.select("universe_id", "decisions", choice.alias("arm_id"))
    # Distinct choices are options per declared decision multiplied, not data.
    arms = keyed.groupBy("arm_id").agg(
        *[F.first(F.col("decisions")[d]).alias(d) for d in what.decisions]
    ).orderBy("arm_id").toLocalIterator()

    results: list[DataFrame] = []
    batch: list = []

    def evaluate(rows: list) -> DataFrame:
        literal = F.array(*[
            F.struct(F.lit(r["arm_id"]).alias("arm_id"),
                     *[F.lit(r[d]).alias(d) for d in what.decisions]) for r in rows
        ])
        frames = {
            n: tables[n].withColumn("_arm", F.explode(literal)).withColumn("arm_id", F.col("_arm.arm_id"))
            for n in what.inputs
        }
        columns = {d: F.col(f"_arm.{d}") for d in what.decisions}
        return what.function(Declared("input", frames), Declared("decision", columns))

    for row in arms:
        batch.append(row)
        if len(batch) == ARMS_PER_PLAN:
            results.append(evaluate(batch))
            batch = []
    if batch:
        results.append(evaluate(batch))
    if not results:
        raise RecipeError("no universe to run in")
    made = functools.reduce(DataFrame.unionByName, results)
    if "arm_id" not in made.columns:
        raise RecipeError(f"recipe `{what.name}` dropped arm_id")
    return broadcast_if_small(keyed.select("universe_id", "arm_id")).join(made, "arm_id").drop("arm_id")


def batch_recipe(function: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """Wrap pandas code as a per-batch step of a recipe.

    The function maps one Arrow batch (a bounded piece of one partition) to rows,
    typically partial sums keyed by ``arm_id``, which the recipe then combines
    with a Spark aggregation; no universe is ever gathered into one frame.
    """

    def apply(df: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield function(batch)

        return df.mapInPandas(run, schema)

    return apply
