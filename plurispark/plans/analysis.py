"""Registered queries: multiverse evaluation and the spec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurispark.functions import hashing, recipes
from plurispark.operators import multiverse as mv
from plurispark.plans.registry import DERIVED, query, register, table

# --- the flagship analysis ---------------------------------------------------

_OPTIONS = {
    "date_cut": ("none", "recent"),
    "price_model": ("gross", "net"),
    "returns": ("keep", "drop"),
}
_TEMPLATE = "summarise --cut {decisions.date_cut} --price {decisions.price_model} --returns {decisions.returns} {inputs} > {output}"

#: The universes come from the tables: regions (five) give the returns and price
#: options and nations (twenty-five) the cut, so several universes share an arm.
DERIVED["analysis_universes"] = """
SELECT 'u' || cast(n_nationkey AS string) AS universe_id,
       CASE WHEN n_nationkey % 2 = 0 THEN 'none' ELSE 'recent' END AS date_cut,
       CASE WHEN n_regionkey < 2 THEN 'gross' ELSE 'net' END AS price_model,
       CASE WHEN n_regionkey IN (0, 3) THEN 'keep' ELSE 'drop' END AS returns
FROM nation"""


def decisions_map(names) -> F.Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])


def analysis_universes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "analysis_universes").select(
        "universe_id", decisions_map(_OPTIONS).alias("decisions")
    )


def flagship(spark: SparkSession, folder: str, by: tuple[str, ...] = (), universes: DataFrame | None = None) -> DataFrame:
    """Count, revenue and mean quantity of line items in every universe, with its identity."""
    items = table(spark, folder, "lineitem")
    universes = analysis_universes(spark, folder) if universes is None else universes
    price = mv.Value("price_model", {
        "gross": F.col("l_extendedprice"),
        "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
    })
    result = mv.multiverse(
        items,
        universes,
        keeps=[
            mv.Keep("date_cut", {"none": F.lit(True), "recent": F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")}),
            mv.Keep("returns", {"keep": F.lit(True), "drop": F.col("l_returnflag") != "R"}),
        ],
        measures={
            "n": mv.Measure("count"),
            "revenue": mv.Measure("sum", price),
            "avg_qty": mv.Measure("avg", F.col("l_quantity")),
        },
        by=by,
    )
    if by:
        return result.select("universe_id", *by, "n", F.round("revenue", 2).alias("revenue"), F.round("avg_qty", 6).alias("avg_qty"))
    output = F.concat(F.lit("results/"), F.col("universe_id"), F.lit("/summary.json"))
    inputs = F.array(F.struct(F.lit("items").alias("name"), F.lit("data/lineitem.parquet").alias("path")))
    rendered = recipes.render_recipe(F.lit(_TEMPLATE), inputs, F.col("decisions"), output)["recipe"]
    identity = universes.select(
        "universe_id",
        hashing.definition_version(rendered, F.col("decisions"), F.lit("json")).alias("definition_version"),
    )
    return identity.join(result, "universe_id").select(
        "universe_id", "definition_version", "n",
        F.round("revenue", 2).alias("revenue"), F.round("avg_qty", 6).alias("avg_qty"),
    )


_ARMS_SQL = """
FROM analysis_universes u JOIN lineitem l
  ON (u.date_cut = 'none' OR l.l_shipdate >= TIMESTAMP '1998-01-01 00:00:00')
 AND (u.returns = 'keep' OR l.l_returnflag <> 'R')"""
_MEASURES_SQL = """count(*) AS n,
round(sum(CASE WHEN u.price_model = 'net' THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END), 2) AS revenue,
round(avg(l_quantity), 6) AS avg_qty"""


@register("multiverse", f"""
SELECT u.universe_id,
  'sha256:' || sha256('recipe' || chr(0) || cast(strlen(recipe) AS string) || chr(0) || recipe ||
    'decisions' || chr(0) || cast(strlen(decisions) AS string) || chr(0) || decisions ||
    'format' || chr(0) || '4' || chr(0) || 'json') AS definition_version, n, revenue, avg_qty
FROM (SELECT universe_id,
  'summarise --cut ' || date_cut || ' --price ' || price_model || ' --returns ' || returns ||
  ' data/lineitem.parquet > results/' || universe_id || '/summary.json' AS recipe,
  '{{"date_cut":"' || date_cut || '","price_model":"' || price_model || '","returns":"' || returns || '"}}' AS decisions
  FROM analysis_universes) d
JOIN (SELECT u.universe_id, {_MEASURES_SQL} {_ARMS_SQL} GROUP BY u.universe_id) u USING (universe_id)""")
def multiverse_query(spark, folder):
    return flagship(spark, folder)


#: Parts as universes: most name an option nobody declared, or leave one out.
@register("unknown_choices", """
WITH u AS (SELECT p_partkey AS universe_id, CASE WHEN p_size < 40 THEN 'recent' ELSE 'late' END AS date_cut, CASE WHEN p_type <> 'PROMO' THEN 'keep' END AS returns, CASE WHEN p_brand = 'Brand#1' THEN p_type END AS extra FROM part)
SELECT universe_id, 'date_cut' AS decision, date_cut AS option FROM u WHERE date_cut = 'late'
UNION ALL SELECT universe_id, 'returns', NULL FROM u WHERE returns IS NULL UNION ALL SELECT universe_id, 'extra', extra FROM u WHERE extra IS NOT NULL""")
def unknown_choices(spark, folder):
    part = table(spark, folder, "part")
    given = F.create_map(
        F.lit("date_cut"), F.when(F.col("p_size") < 40, "recent").otherwise("late"), F.lit("returns"), F.when(F.col("p_type") != "PROMO", "keep"),
        F.lit("extra"), F.when(F.col("p_brand") == "Brand#1", F.col("p_type")))
    universes = part.select(F.col("p_partkey").alias("universe_id"), F.map_filter(given, lambda k, v: v.isNotNull()).alias("decisions"))
    return mv.unknown_choices(universes, [mv.Keep("date_cut", {"none": F.lit(True), "recent": F.lit(True)}), mv.Keep("returns", {"keep": F.lit(True), "drop": F.lit(True)})])


@register("multiverse_by_status", f"""
SELECT u.universe_id, l.l_linestatus, {_MEASURES_SQL} {_ARMS_SQL} GROUP BY u.universe_id, l.l_linestatus""")
def multiverse_by_status(spark, folder):
    return flagship(spark, folder, by=("l_linestatus",))


@mv.recipe(inputs=["items"], decisions=["date_cut", "returns"], format="parquet")
def spread(inputs, decisions):
    """Distinct parts and the largest price: not foldable from sums, so run per arm."""
    items = inputs["items"]
    kept = items.where(
        ((decisions["date_cut"] == "none") | (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
        & ((decisions["returns"] == "keep") | (F.col("l_returnflag") != "R"))
    )
    return kept.groupBy("arm_id").agg(
        F.countDistinct("l_partkey").alias("parts"), F.max("l_extendedprice").alias("top_price")
    )


@register("recipe_run", f"""
SELECT u.universe_id, count(DISTINCT l.l_partkey) AS parts, max(l.l_extendedprice) AS top_price
{_ARMS_SQL} GROUP BY u.universe_id""")
def recipe_run(spark, folder):
    items = table(spark, folder, "lineitem").select("l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    return mv.run_recipe(spread, {"items": items}, analysis_universes(spark, folder))
