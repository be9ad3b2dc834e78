"""The pipeline's stages on the smallest tables, each against its own operator's promise."""

import corpus_pipeline
import pytest
from plurispark.llm import near
from plurispark.llm.common import read

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, read(spark, FOLDER, "documents")
    out["documents"] = docs
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        step(spark, docs, FOLDER).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_every_stage_but_the_last_returns_documents(stages):
    for name, df in stages.items():
        if name != "packing":
            assert df.columns == stages["documents"].columns
            assert df.dtypes == stages["documents"].dtypes


def test_near_copies_are_gone_and_one_of_each_group_stays(spark, stages):
    groups = near.jaccard_join(stages["line_dedup"], 5, 80).collect()
    assert ids(stages["jaccard_join"]) == {g.component_id for g in groups}
    again = near.jaccard_join(stages["jaccard_join"], 5, 80).collect()
    assert all(g.doc_id == g.component_id for g in again)


def test_leaky_documents_are_gone(spark, stages):
    items = [r.text for r in read(spark, FOLDER, "benchmark").collect()]
    before = {r.doc_id: r.text for r in stages["jaccard_join"].collect()}
    left = ids(stages["decontamination"])
    leaky = {i for i, t in before.items() if any(x in t for x in items)}
    assert leaky and not leaky & left
    assert len(before) - len(left) <= 2 * len(leaky)


def test_clean_documents_come_through(spark, stages):
    labels = read(spark, FOLDER, "labels").where("quality = 1 AND toxic = 0")
    clean = ids(stages["documents"].join(labels, "doc_id").where("n_chars > 500"))
    assert len(clean & ids(stages["quality_rules"])) >= 0.98 * len(clean)
    assert ids(stages["packing"]) == ids(stages["decontamination"])


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).groupBy().sum("length").first() == stages["packing"].groupBy().sum("length").first()


def test_rows_with_nulls_and_no_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, None, "en", None, 3), (2, "", None, "s", None), (None, "w " * 30, None, None, 1), (3, "a b c " * 9, "en", "s", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, FOLDER)
        docs.collect()


def test_rows_of_one_id_and_rows_without_one(spark):
    items = [r.text for r in read(spark, FOLDER, "benchmark").collect()]
    item = max(items, key=len)
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(80))
    rows = [(1, text(1), "en", "s", 1), (2, text(1) + " more", "en", "s", 1), (2, text(2), "en", "s", 1), (None, text(3) + " " + item, "en", "s", 1), (None, text(4), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.jaccard_join(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(1, rows[0][1]), (2, rows[2][1]), (0, rows[3][1]), (0, rows[4][1])])
    clean = corpus_pipeline.decontamination(spark, docs, FOLDER)
    assert clean.columns == docs.columns
    assert sorted(r.text for r in clean.collect()) == sorted(r[1] for r in rows if item not in r[1])
