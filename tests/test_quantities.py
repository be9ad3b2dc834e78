"""Quantities, scheduler states and per-node GPUs, case by case."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plurispark.functions import quantities as q
from plurispark.functions import records
from plurispark.operators import compute

GIB = 1024**3


def values(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


#: Units of recipes by what they multiply: k is decimal, a trailing i makes it binary.
DECIMAL = {"k": 1, "M": 2, "G": 3, "T": 4}


def recipe_sizes():
    """Amounts in every unit, whole and with a fraction that still gives whole bytes."""
    for letter, power in DECIMAL.items():
        for amount in ("3", "7.5", "0.125"):
            for binary in (False, True):
                unit = letter.upper() + "i" if binary else letter
                size = Decimal(amount) * (1024 if binary else 1000) ** power
                if size == int(size):
                    yield f"{amount}{unit}" + ("B" if power % 2 or not binary else ""), int(size)


def test_recipe_memory(spark):
    good = dict(recipe_sizes())
    assert len(good) > 15
    assert values(spark, q.recipe_memory_bytes, list(good)) == [Decimal(v) for v in good.values()]
    bad = ["0MB", "0.0005kB", "73", "12m", " ", "2e2B", "5mb", None]
    assert values(spark, q.recipe_memory_bytes, bad) == [None] * len(bad)


def test_offer_memory_is_binary_throughout(spark):
    power = {"K": 1, "M": 2, "G": 3, "T": 4}
    cases = {f"{n}{u}{tail}": n * 1024**p for u, p in power.items() for n in (2, 96) for tail in ("B", "iB")}
    cases |= {k.lower(): v for k, v in cases.items()} | {"3": 3 * GIB, "2.25": 9 * GIB // 4}
    assert values(spark, q.offer_memory_bytes, list(cases)) == [Decimal(v) for v in cases.values()]
    assert values(spark, q.offer_memory_bytes, ["inf", "00", "-3", "2IB", "0.7B", "6K"]) == [None] * 6
    assert values(spark, q.offer_memory_bytes, ["0.000000000931322574615478515625"]) == [Decimal(1)]
    assert values(spark, q.offer_memory_bytes, ["0.000000000931322574615478515625000000000000000001"]) == [None]


def test_durations(spark):
    parts = (("d", 86400), ("h", 3600), ("m", 60), ("s", 1))
    cases = {}
    for mask in range(1, 16):
        used = [(u, f, 2 * i + mask) for i, (u, f) in enumerate(parts) if mask >> i & 1]
        cases["".join(f"{n}{u}" for u, _, n in used)] = sum(n * f for _, f, n in used)
    assert values(spark, q.duration_seconds, list(cases)) == list(cases.values())
    assert values(spark, q.duration_seconds, [" ", "0m", "2.5m", "9s4m", "6h7", None]) == [None] * 6


@pytest.mark.parametrize("size", [1, GIB // 2, 8 * GIB, 2**80 + 1])
def test_exact_gib(spark, size):
    whole, rest = divmod(size, GIB)
    want = f"{whole}.{rest * 5**30:030d}".rstrip("0").rstrip(".")
    text = spark.range(1).select(q.gib(F.lit(str(size)).cast("decimal(38,0)")).alias("g")).first()["g"]
    assert text == want
    assert values(spark, q.offer_memory_bytes, [text]) == [Decimal(size)]


def test_accelerators(spark):
    got = values(spark, q.accelerator, ["A100:4", "gpu", "count:2", "name", "A100:0", "A100:2+", "", "A.1-x_2:10"])
    assert [tuple(g) if g else None for g in got] == [("A100", 4), ("gpu", 1), None, None, None, None, None, ("A.1-x_2", 10)]


def test_task_requests(spark):
    cases = [
        (None, (1, 0, None, 0)), ({"cpus": "4.0", "memory": "1Gi"}, (4, 0, Decimal(GIB), 0)), ({"cpus": "0.5"}, (None, 0, None, 1)),
        ({"cpus": "0"}, (0, 0, None, 1)), ({"gpus": "-1"}, (1, None, None, 1)), ({"memory": "16"}, (1, 0, None, 1)),
        ({"time_limit": "1h", "disk": "1", "ram": "2"}, (1, 0, None, 2)),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m map<string,string>")
    rows = df.select("i", q.task_request(F.col("m")).alias("r")).orderBy("i").collect()
    assert [(r["r"]["cpus"], r["r"]["gpus"], r["r"]["memory_bytes"], len(r["r"]["errors"])) for r in rows] == [w for _, w in cases]


def test_job_phases(spark):
    states = {"CANCELLED by 7": "ended", "OUT_OF_MEMORY+": "ended", "RUNNING": "active", "SUSPENDED": "pending", "RESIZING": "pending",
              "COMPLETING": "stopping", "": "unknown", "  ": "unknown", "running": "unknown", None: "unknown"}
    assert values(spark, records.job_phase, list(states)) == list(states.values())


def gpu_cases():
    """Per-node entries built from their parts, with what a reader should make of them: (text, count, type)."""
    for lead in ("gres/gpu", "gres:gpu", "gpu"):
        yield f"TresPerNode={lead}:3", 3, "GPU"
        for kind in ("h200", "l4", "5080"):
            yield f"TresPerNode={lead}:{kind}:6", 6, kind
        for broken in ("some", "h200/x:1", "2.25", "h200:"):
            yield f"TresPerNode={lead}:{broken}", None, None
    yield "TresPerNode=gres/gpu:h200:1,gres/gpu:l4:5", 6, "GPU"  # types differ
    yield "TresPerNode=gres/gpu:2,gres/gpu:l4:2", None, None  # with and without a type
    yield "Gres=gpu:l4:7", 7, "l4"
    yield "Gres=(null)", 0, None
    for key in ("ReqTRES", "TRES"):
        yield f"{key}=cpu=36,mem=90G,node=3", 0, None
        yield f"{key}=cpu=36,mem=90G,node=3,gres/gpu=9", None, None  # a total says nothing about one node
    yield "", None, None


def record(*extra, **changed):
    """One controller record as text: a field a line in a fixed order, the comment on a line of its own."""
    fields = {"JobId": "77", "JobName": "work-b", "UserId": "root(0)", "JobState": "RUNNING", "NumNodes": "3", "CPUs/Task": "12", "MinMemoryNode": "30G",
              "SubmitTime": "2031-02-03T04:05:06", "Reason": "None"} | changed
    return "\n".join([*(f"{k}={v}" for k, v in fields.items()), "Comment=a note with x=1", *extra]) + "\n"


def test_controller_records(spark):
    cases = list(gpu_cases())
    plain = "TRES=cpu=36,mem=90G,node=3"
    unknown = [record(plain, **c) for c in ({"MinMemoryNode": "0"}, {"MinMemoryNode": "0M"}, {"MinMemoryNode": "much"}, {"CPUs/Task": "0"})]
    refused = [record(plain) * 2, "no record"]
    texts = [record(t) for t, _, _ in cases] + unknown + refused
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = compute.normalise_allocations(df).orderBy("i").collect()
    for row, (text, count, name) in zip(rows, cases):
        assert (row["gpus"], row["gpu_name"], row["evidence"]) == (count, name, "unknown" if count is None else "requested"), text
        assert (row["comment"], row["uid"], row["phase"], row["num_nodes"], row["reason"]) == ("a note with x=1", "0", "active", 3, "")
        assert row["errors"] == []
    assert (rows[0]["cpus"], rows[0]["memory_bytes"]) == (12, Decimal(30 * GIB))
    for row in rows[len(cases) : len(cases) + len(unknown)]:
        assert (row["cpus"], row["memory_bytes"], row["gpus"], row["evidence"]) == (None, None, None, "unknown")
    assert [len(r["errors"]) for r in rows[-2:]] == [1, 1]


def test_latest_attempt_takes_the_first_of_equal_times(spark):
    rows = [("1", "n", "u", "c", "RUNNING", "2026-01-02", 1), ("1", "n", "u", "c", "COMPLETED", "2026-01-02", 2), ("1", "n", "u", "c", "FAILED", "2026-01-01", 3),
            ("2", "n", "u", "c", "FAILED", "2026-01-01", 4), ("3", "n", "u", "other", "FAILED", "2026-01-01", 5)]
    history = spark.createDataFrame(rows, "job_id string, job_name string, uid string, comment string, state string, submit_time string, seq int")
    ids = spark.createDataFrame([(str(i), "n", "u", "c") for i in (1, 2, 3)], "job_id string, job_name string, uid string, comment string")
    got = {r["job_id"]: (r["state"], r["phase"]) for r in compute.latest_attempt(history, ids).collect()}
    assert got == {"1": ("RUNNING", "unknown"), "2": ("FAILED", "ended"), "3": (None, "unknown")}


def test_admission_needs_one_worker_and_one_gpu_budget(spark):
    workers = spark.createDataFrame([("a", 4.0, 8.0, 0.0), ("b", 8.0, 4.0, 2.0), ("c", 8.0, 16.0, 4.0), ("d", float("nan"), 1.0, 0.0), ("e", 2.5, 1.0, None)],
                                    "worker_id string, cpu double, memory double, gpu double")
    tasks = spark.createDataFrame([(1, 4, 8, 0), (2, 9, 1, 0), (3, 8, 4, 1), (4, 8, 5, 1), (5, 1, None, 3), (6, 8, 17, 0)], "t int, cpus int, memory_bytes long, gpus int")
    got = {r["t"]: (r["admitted"], r["reserve_gpu"]) for r in compute.admit(tasks, workers, ["t"]).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (False, None), 4: (True, 4.0), 5: (True, 4.0), 6: (False, None)}
    good, bad = compute.shared_capacity(workers)
    assert good.count() == 3 and {r["worker_id"] for r in bad.collect()} == {"d", "e"}


def test_amounts_are_matched_once(spark, capsys):
    texts = ["1.5", "0.5kb", "1.", ".5", "1.5.2", "5K", "5 KB", "2KiB", "1.50MB", "3B", "B", "", "1e3", "KB1", "1.000", "7.5B", "١B", "1B\n", "2GBB", None]
    df = spark.createDataFrame([(x,) for x in texts], "c string").select("c", q.offer_memory_bytes(F.col("c")).cast("string").alias("o"), q.recipe_memory_bytes(F.col("c")).cast("string").alias("r"))
    got = {r["c"]: (r["o"], r["r"]) for r in df.collect()}
    some = {"1.5": (str(3 * 2**29), None), "0.5kb": ("512", None), "5K": (None, "5000"), "5 KB": (None, "5000"), "2KiB": ("2048", "2048"), "1.50MB": (str(3 * 2**19), "1500000"), "3B": ("3", "3"), "1.000": (str(2**30), None)}
    assert got == {x: some.get(x, (None, None)) for x in texts}
    capsys.readouterr()
    df.explain()
    assert "regexp_extract" not in capsys.readouterr().out.lower()
