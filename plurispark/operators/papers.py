"""Cited papers: which revision is read, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.functions.records import arxiv_id, arxiv_pdf, normal_doi


def arxiv_revision(citations: DataFrame) -> DataFrame:
    """``doi, version, pdf_url`` per cited arXiv paper: unpinned wins, else the newest revision."""
    cited = citations.where(arxiv_id(F.col("doi")).isNotNull()).select(normal_doi(F.col("doi")).alias("doi"), "version")
    pinned = F.when(F.col("version") > 0, F.col("version"))
    newest = cited.groupBy("doi").agg(F.bool_or(pinned.isNull()).alias("_latest"), F.max(pinned).alias("_v")).select(
        "doi", F.when(~F.col("_latest"), F.col("_v")).alias("version")
    )
    return newest.withColumn("pdf_url", arxiv_pdf(F.col("doi"), F.col("version")))


def preferred_paper(cache: DataFrame) -> DataFrame:
    """One cached paper per DOI: the last unversioned one, else the first listed.

    ``pos`` is the place in the cache's listing.
    """
    rows = cache.where("doi IS NOT NULL").withColumn("doi", normal_doi(F.col("doi")))
    columns = [c for c in rows.columns if c != "doi"]
    unversioned = F.col("version").isNull()
    rank = F.struct(unversioned.alias("u"), F.when(unversioned, F.col("pos")).otherwise(-F.col("pos")).alias("p"))
    return rows.groupBy("doi").agg(F.max_by(F.struct(*columns), rank).alias("_p")).select("doi", "_p.*")


def cited_papers(citations: DataFrame, cache: DataFrame) -> DataFrame:
    """``doi, title, authors, pdf_url`` of every cited paper that can be named or read.

    A cached paper answers as a whole; otherwise an arXiv DOI gives its PDF.
    """
    asked = citations.where("doi IS NOT NULL").select(normal_doi(F.col("doi")).alias("doi")).distinct()
    cached = preferred_paper(cache).select(
        "doi", "title", F.array_join("authors", ", ").alias("authors"), F.col("pdf_path").alias("_pdf"), F.lit(True).alias("_cached")
    ).join(asked, "doi", "left_semi")
    computed = arxiv_revision(citations).select("doi", "pdf_url")
    return computed.join(cached, "doi", "full_outer").select(
        "doi", "title", F.nullif("authors", F.lit("")).alias("authors"),
        F.when(F.col("_cached").isNotNull(), F.col("_pdf")).otherwise(F.col("pdf_url")).alias("pdf_url"),
    )
