"""Disk that staged tables hold: what stays, and what goes when it is no longer read."""

import json
import time
from pathlib import Path

from pyspark.sql import functions as F

from plurispark import session
from plurispark.llm import perplexity
from plurispark.operators import graph, provenance as prov, status
from plurispark.session import discard, stage, stage_split


def _shuffle_bytes(spark) -> int:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data"))


def _rows(spark, folder: Path) -> int:
    # each table by itself: an emptied one has another schema
    return sum(spark.read.parquet(str(p)).count() for p in {f.parent for f in folder.rglob("*.parquet")})


def test_staging_leaves_no_shuffle_files(spark):
    before = _shuffle_bytes(spark)
    table = stage(spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).count())
    yes, no = stage_split(table.repartition(3).withColumn("odd", F.pmod("h", F.lit(2)) == 1), "odd")
    for _ in range(50):
        if _shuffle_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_bytes(spark) <= before
    assert yes.count() + no.count() == table.count() == 200_000


def test_a_discarded_table_is_empty_and_no_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    kept, gone = stage(spark.range(7)), stage(spark.range(100))
    yes, no = stage_split(spark.range(11).withColumn("low", F.col("id") < 4), "low")
    discard(gone, no, None, spark.range(3))
    discard(gone)
    assert _rows(spark, tmp_path) == 7 + 4
    assert kept.count() == 7 and yes.count() == 4


def test_an_order_keeps_only_what_later_rounds_read(spark, tmp_path, monkeypatch):
    """A ladder of 12 rungs with 10 nodes each: each node needs two of the rung before."""
    n, rungs = 10, 12
    rows = [("u", f"{r}-{i}", f"{r - 1}-{(i + k) % n}") for r in range(1, rungs) for i in range(n) for k in (0, 1)]
    edges = spark.createDataFrame(rows, "universe_id string, output_id string, dep_output_id string")
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    placed, stuck = graph.levels(edges, edges.select("universe_id", "output_id"))
    held = _rows(spark, tmp_path)
    assert {(r["output_id"], r["level"]) for r in placed.collect()} == {(f"{r}-{i}", r) for r in range(rungs) for i in range(n)}
    assert stuck.count() == 0
    assert held <= 2 * n * rungs  # the nodes, and those of the last rounds once more


def test_settling_makes_its_inputs_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(x):
        made.add(1)
        return x

    n = 20
    tasks = spark.createDataFrame([("u", f"t{i}", "d", "e") for i in range(n)], "universe_id string, output_id string, definition_version string, env_version string")
    inputs = spark.createDataFrame([("u", f"t{i}", f"t{i - 1}", f"t{i - 1}") for i in range(1, n)], "universe_id string, output_id string, raw string, produced_by string")
    inputs = inputs.withColumn("input_name", name.asNondeterministic()("raw")).withColumn("current_version", F.lit(None).cast("string")).drop("raw")
    manifests = tasks.withColumn("data_version", F.concat(F.lit("v-"), "output_id"))
    recorded = spark.createDataFrame([("u", f"t{i}", f"t{i - 1}", f"v-t{i - 1}") for i in range(1, n)], "universe_id string, output_id string, input_name string, version string")
    attempts = tasks.select("universe_id", "output_id", F.lit(True).alias("ok"), F.lit("new").alias("new_version"))
    rows = status.settle(tasks, inputs, manifests, attempts, recorded=recorded).collect()
    assert {(r["output_id"], r["outcome"]) for r in rows} == {(f"t{i}", "current") for i in range(n)}
    assert made.value == n - 1


def test_a_document_is_dealt_from_written_tables(spark):
    """Nothing that made entities and references is left in the plan of the fragments, and no reference is dealt there."""
    one = spark.range(3).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"))
    entities = prov.entity(one.distinct(), F.col("id"), ["Thing"], name=prov.json_text(F.col("id")))
    edges = prov.edge(one, F.col("id"), "next", F.lit("a0")).unionByName(prov.edge(one, F.col("id"), "next", F.lit("a1")))
    fragments = prov.document(entities, edges)
    assert "repartition" not in fragments._jdf.queryExecution().optimizedPlan().toString().lower()
    text = "".join(r["before"] + r["text"] + r["after"] for r in fragments.sort("id", "key", "ord").collect())
    graph_ = {o["@id"]: o for o in json.loads(text)["@graph"]}
    assert [x["@id"] for x in graph_["a2"]["next"]] == ["a0", "a1"] and graph_["a1"]["name"] == "a1"


def test_training_leaves_no_table_but_the_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    texts = spark.createDataFrame([(f"a b c d{i} e f{i % 3}",) for i in range(50)], "text string")
    model = perplexity.train(texts)
    assert model.values.count() == _rows(spark, tmp_path) > 0
