"""Every registered query against its oracle on the smallest tables."""

import pytest

from oracle import compare, database
from plurispark.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

#: Conditions the smallest tables happen not to meet.
MAY_BE_EMPTY = {"unusable_workers", "unresolved_inputs", "find_cycles", "foreign_writes", "missing_formats", "non_default_groups",
                "lock_audit", "settle_blockers", "shared_capacity", "match_offer", "duplicate_universes", "lineage"}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_oracle(spark, con, name):
    problem, _, _ = compare(spark, con, FOLDER, name)
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY), problem


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["universe_id", "definition_version", "n", "revenue", "avg_qty"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_follow_the_tables(spark, tmp_path, monkeypatch):
    from plurispark import session

    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "region.parquet"))
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file())
    monkeypatch.setattr(session, "PART_BYTES", 100)
    session.fit_partitions(spark, str(tmp_path))
    assert spark.conf.get(session._INITIAL) == str(-(-size // 100)) and size > 800
    monkeypatch.undo()
    session.fit_partitions(spark, str(tmp_path))
    assert spark.conf.get(session._INITIAL, None) is None
