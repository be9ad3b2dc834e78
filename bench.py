"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores. Every
query is evaluated in full into a sink that keeps nothing; after one warm-up of
the engine, the best of ``BENCH_REPEAT`` runs (default 1) counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from plurispark.plans import QUERIES
from plurispark.plans.analysis import decisions_map, flagship
from plurispark.session import build_session

HEADLINE = (
    "multiverse", "multiverse_by_status", "recipe_run", "definition_version", "canonical_json", "tree_digest",
    "distinct_inputs_digest", "resolve_inputs", "classify", "status_counts", "last_writer", "closure", "task_order",
    "would_run", "settle", "run_rollup", "prov_edges", "match_offer", "admit", "latest_attempt", "stderr_tail",
    "explain_denials", "fold_warnings", "coalesce_bursts", "cited_papers",
)


def universes(spark, n: int):
    """*n* universes over the flagship's eight choices."""
    i = F.col("id")
    named = spark.range(n).select(
        F.concat(F.lit("u"), i.cast("string")).alias("universe_id"),
        F.when(i % 2 == 0, "none").otherwise("recent").alias("date_cut"),
        F.when(F.floor(i / 2) % 2 == 0, "gross").otherwise("net").alias("price_model"),
        F.when(F.floor(i / 4) % 2 == 0, "keep").otherwise("drop").alias("returns"),
    )
    return named.select("universe_id", decisions_map(("date_cut", "price_model", "returns")).alias("decisions"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    cases = {name: QUERIES[name] for name in HEADLINE}
    for n in (1, 8, 64):
        cases[f"multiverse_{n}"] = lambda s, d, n=n: flagship(s, d, by=("l_linestatus",), universes=universes(s, n))
    only = sys.argv[1:]
    cases = {k: v for k, v in cases.items() if not only or k in only}

    def run(query) -> float:
        began = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run(QUERIES["multiverse"])
    took = {name: round(min(run(q) for _ in range(repeat)), 3) for name, q in cases.items()}
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
