"""How queries are registered, and how input tables are derived from the driver tables.

Input tables are derived with SQL that reads the same in Spark and in the
oracle's database, so a registered query and its oracle start from equal rows.
"""

from __future__ import annotations

import functools
import importlib
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from plurispark.session import fit_partitions

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Derived tables by name: portable SELECT texts over driver tables or each other.
DERIVED: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; an oracle may name derived tables like any other table."""

    def wrap(function):
        @functools.wraps(function)
        def run(spark, folder):
            fit_partitions(spark, folder)
            return function(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_derived(oracle)
        return function

    return wrap


def _needed(sql: str, found: dict[str, None]) -> dict[str, None]:
    for name, text in DERIVED.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(text, found)
            found[name] = None
    return found


def with_derived(sql: str, given: Iterable[str] = ()) -> str:
    """Prefix *sql* with the common table expressions of the derived tables it names.

    Names in *given* already stand for a table and are left alone.
    """
    names = list(_needed(sql, dict.fromkeys(given)))[len(list(given)):]
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({DERIVED[n]})" for n in names)
    recursive = re.match(r"\s*WITH\s+RECURSIVE\s+", sql, re.I)
    plain = re.match(r"\s*WITH\s+", sql, re.I)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {sql[recursive.end():]}"
    if plain:
        return f"WITH {ctes}, {sql[plain.end():]}"
    return f"WITH {ctes} {sql}"


def table(spark: SparkSession, folder: str, name: str, given: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A driver table, or a derived one; *given* replaces derived tables it builds on."""
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    return query(spark, folder, f"SELECT * FROM {name}", given)


def query(spark: SparkSession, folder: str, sql: str, given: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run portable SQL over the driver and derived tables."""
    given = given or {}
    text = with_derived(sql, tuple(given))
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    for name, df in given.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


for _area in ("analysis", "identity", "outputs", "graphs", "provenance", "allocations", "runs", "streams"):
    importlib.import_module(f"plurispark.plans.{_area}")
