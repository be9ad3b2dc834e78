"""From raw documents to packed sequences: five stages, each written and read again.

Quality rules drop rejected documents; line dedup cuts boilerplate lines; the Jaccard
join keeps the smallest id of each group of near copies; decontamination drops
documents that leak a benchmark item; what is left is packed into sequences.
All but the last return the columns of ``documents``; where a text changes, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurispark.llm import leaks, lines, near, packing, quality
from plurispark.llm.common import read
from plurispark.session import is_empty, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their host share."""
    judged = quality.quality_rules(docs, carry=["lang", "source", "n_chars"])
    return _documents(judged.where("kept").withColumn("text", F.col("text_left")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their host's boilerplate lines."""
    return _documents(lines.line_dedup(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, which names the group.

    Documents without an id or without words link with nothing and stay; of several rows of one id
    those go whose own text has a copy under a smaller id.
    """
    groups = near.jaccard_join(docs, n=5, percent=80, by_row=True)
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy"), F.col("text_key").alias("_key")).distinct()
    same = (docs["doc_id"] == F.col("_copy")) & (near.text_key(docs["text"]) == F.col("_key"))
    return docs.join(copies, same, "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; rows without an id are searched under a key of their own."""
    items = read(spark, sf_dir, "benchmark")

    def clean(rows: DataFrame, id: str) -> DataFrame:
        found = leaks.find_leaks(rows, items, id=id).select(F.col(id).alias("_leaky")).distinct()
        return rows.join(found, rows[id] == F.col("_leaky"), "left_anti").select(*COLUMNS)

    unnamed = docs.where("doc_id IS NULL")
    if is_empty(unnamed):
        return clean(docs, "doc_id")
    keyed = stage(unnamed.withColumn("_row", F.monotonically_increasing_id()))  # written, so that a row keeps its key
    return clean(docs.where("doc_id IS NOT NULL"), "doc_id").unionByName(clean(keyed, "_row"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
    ("decontamination", decontamination), ("packing", packed),
]
#: SQL has no tokenizer; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
