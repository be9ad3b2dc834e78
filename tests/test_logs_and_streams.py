"""Logs, denials, tails, bursts and sinks against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plurispark.operators import logs, papers
from plurispark.streaming import events as ev


def one(spark, text, function):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("v")).first()["v"]


def test_warnings_fold_their_continuations(spark):
    log = "  orphan\nResolved 3\nwarning: first \n  more of it\n + pkg==1.0\n\tand a tab\r\nprogress\n  still the first\n   \nwarning:second\x0bwarning: third   end"
    assert one(spark, log, logs.fold_warnings) == ["first more of it and a tab still the first", "second", "third end"]
    assert one(spark, "nothing here", logs.fold_warnings) == []


def test_tail_keeps_exactly_the_last_bytes(spark):
    rng = random.Random(3)
    whole, rows = {}, []
    for task, n in (("hot", 400), ("small", 3), ("empty", 1), ("exact", 2)):
        chunks = [rng.randbytes(rng.choice([0, 1, 5, 40, 90])) for _ in range(n)]
        if task == "exact":
            chunks = [b"x" * 32, b"y" * 32]
        if task == "empty":
            chunks = [b""]
        whole[task] = b"".join(chunks)
        rows += [(task, i, c) for i, c in enumerate(chunks)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "task string, seq long, data binary").repartition(6)
    got = {r["task"]: bytes(r["tail"]) for r in logs.stderr_tail(df, limit=64).collect()}
    assert got == {t: b[-64:] for t, b in whole.items() if b}
    text = spark.createDataFrame([(b"ok \xff\xc3",)], "b binary").select(logs.tail_text(F.col("b")).alias("t")).first()["t"]
    assert text.startswith("ok ") and "�" in text


DENIALS = {
    "bash: line 1: /usr/bin/id: Permission denied": ("/usr/bin/id", "tool"),
    "bash: line 1: id: command not found": ("/usr/bin/id", "tool"),
    "PermissionError: [Errno 13] Permission denied: '/elsewhere.fits'": ("/elsewhere.fits", "data"),
    "PermissionError: [Errno 13] Permission denied: 'spec.yaml'": ("/proj/spec.yaml", "write"),
    "PermissionError: [Errno 13] Permission denied: '/inputs/catalog.csv'": ("/inputs/catalog.csv", "write"),
    "PermissionError: [Errno 13] Permission denied: '/proj/results/out.csv'": None,
    "FileNotFoundError: [Errno 2] No such file: '/nope/missing.txt'": None,
    "Traceback: ValueError: bad fit": None,
    "sandbox: /proj/.venv/bin/tool: denied": None,
    "PermissionError: '/proj/results/out.csv'\nOSError: 'spec.yaml'": ("/proj/spec.yaml", "write"),
}


def test_denials(spark):
    runs = spark.createDataFrame([(str(i), "p", t + "\n") for i, t in enumerate(DENIALS)], "task string, policy_id string, text string")
    facts = spark.createDataFrame(
        [("/usr/bin/id", True, True), ("/elsewhere.fits", True, False), ("/proj/spec.yaml", True, False), ("/inputs/catalog.csv", True, False),
         ("/proj/results/out.csv", True, False), ("/proj/.venv/bin/tool", True, True)], "path string, is_file boolean, executable boolean")
    roots = spark.createDataFrame(
        [("p", "read", "/proj"), ("p", "read", "/inputs"), ("p", "read", "/usr"), ("p", "write", "/scratch"), ("p", "write", "/proj/results"),
         ("p", "execute", "/proj/.venv/bin")], "policy_id string, tier string, root string")
    tools = spark.createDataFrame([("id", "/usr/bin/id")], "name string, path string")
    got = {int(r["task"]): (r["path"], r["kind"]) for r in logs.explain_denials(runs, facts, roots, "/proj", tools=tools).collect()}
    assert got == {i: w for i, w in enumerate(DENIALS.values()) if w}


T0 = datetime(2026, 1, 1)


def brute(times, gap):
    runs = []
    for t in sorted(times):
        if runs and t - runs[-1][1] <= gap:
            runs[-1] = (runs[-1][0], t, runs[-1][2] + 1)
        else:
            runs.append((t, t, 1))
    return runs


def test_bursts_across_buckets(spark):
    rng = random.Random(9)
    times = {"tie": [0, 199, 200 + 199, 399 + 201], "lone": [5], "hot": sorted(rng.sample(range(200_000), 900))}
    rows = [(k, T0 + timedelta(milliseconds=t)) for k, ts in times.items() for t in ts]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = ev.sessions(df, ["k"], F.lit(200_000), bucket_us=1_000_000).collect()
    want = {(k, T0 + timedelta(milliseconds=a), T0 + timedelta(milliseconds=b), n) for k, ts in times.items() for a, b, n in brute(ts, 200)}
    assert {tuple(r) for r in got} == want
    windows = df.groupBy("k", F.session_window("ts", "200 milliseconds")).count()
    assert windows.count() == len(want)  # the stream's operator merges at exactly the gap, too


def test_sinks_survive_a_replay(spark, tmp_path):
    sink = ev.ResultsSink(str(tmp_path / "results"), ["k"], "n")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    second = spark.createDataFrame([("a", 0, "late")], "k string, n int, v string")
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        sink(batch, number)
    assert {(r["k"], r["v"]) for r in sink.read(spark).collect()} == {("a", "late"), ("b", "z")}

    tails = ev.TailSink(str(tmp_path / "tails"), limit=4)
    a = spark.createDataFrame([("t", 0, b"abc"), ("t", 1, b"de")], "task string, seq long, data binary")
    b = spark.createDataFrame([("t", 2, b"f"), ("u", 0, b"zz")], "task string, seq long, data binary")
    for batch, number in ((a, 0), (b, 1), (b, 1)):
        tails(batch, number)
    assert {(r["task"], bytes(r["tail"])) for r in tails.read(spark, 1).collect()} == {("t", b"cdef"), ("u", b"zz")}


def test_completion(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("on time", at(0), "returned"), ("on time", at(9), "done"), ("early", at(3), "done"), ("early", at(5), "returned"),
            ("late", at(0), "returned"), ("late", at(11), "done"), ("never", at(0), "returned"), ("running", at(0), "output")]
    df = spark.createDataFrame(rows, "task string, ts timestamp, kind string")
    assert {r["task"]: r["complete"] for r in ev.completion_batch(df).collect()} == {"on time": True, "early": True, "late": False, "never": False}


def test_completion_stream_shares_state(spark, tmp_path, monkeypatch):
    """Batch after batch, with tasks that share a group of state, the stream says what its batch twin says."""
    monkeypatch.setattr(ev, "COMPLETION_GROUPS", 3)
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(f"t{i}", at(i % 5), "returned") for i in range(20)] + [("early", at(3), "done"), (None, at(4), "returned"), ("t0", at(1), "output")],
        [(f"t{i}", at(i % 5 + i), "done") for i in range(0, 20, 2)] + [("early", at(5), "returned"), ("t3", at(4), "returned"), (None, at(5), "done")],
        [("far", at(10_000), "done")],
        [("further", at(20_000), "done")],
    ]
    schema = "task string, ts timestamp, kind string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ev.completion(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), deadline_s=10)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
        if i == 0:
            assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
    got = [tuple(r) for r in spark.read.schema("task string, complete boolean").parquet(str(tmp_path / "out")).collect()]
    want = [tuple(r) for r in ev.completion_batch(spark.createDataFrame(sum(batches, []), schema), 10).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want) and {c for _, c in got} == {True, False}


def test_papers(spark):
    cited = spark.createDataFrame(
        [("a", " 10.48550/arXiv.2401.01234", 1), ("b", "10.48550/ARXIV.2401.01234", 3), ("a", "10.48550/arXiv.hep-th/9901001", None),
         ("a", "10.48550/arXiv.hep-th/9901001", 2), ("a", "10.1093/MNRAS/stv1198", None), ("a", "10.1/absent", None), ("a", "10.48550/arXiv.bad", 1)],
        "analysis_id string, doi string, version int")
    cache = spark.createDataFrame(
        [(0, "10.1093/mnras/STV1198", 2, "pinned", ["A"], "p2"), (1, "10.1093/mnras/stv1198", None, "open", ["A", "B"], "p0"),
         (2, "10.48550/arXiv.2401.01234", 1, "first", [], "p1"), (3, "10.48550/arXiv.2401.01234", 2, "second", [], "p3"), (4, "10.9/uncited", None, "x", [], "y")],
        "pos int, doi string, version int, title string, authors array<string>, pdf_path string")
    got = {r["doi"]: (r["title"], r["authors"], r["pdf_url"]) for r in papers.cited_papers(cited, cache).collect()}
    assert got == {
        "10.1093/mnras/stv1198": ("open", "A, B", "p0"), "10.48550/arxiv.2401.01234": ("first", None, "p1"),
        "10.48550/arxiv.hep-th/9901001": (None, None, "https://arxiv.org/pdf/hep-th/9901001"),
    }
    revision = {r["doi"]: r["pdf_url"] for r in papers.arxiv_revision(cited).collect()}
    assert revision["10.48550/arxiv.2401.01234"].endswith("2401.01234v3")
