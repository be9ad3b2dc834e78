"""The classification rule, predicted and settled runs, and graphs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from plurispark.operators import graph, history, spec, status

TASKS = "universe_id string, output_id string, definition_version string, env_version string"
INPUTS = "universe_id string, output_id string, input_name string, ord int, path string, produced_by string, current_version string"
MADE = "universe_id string, output_id string, definition_version string, env_version string, data_version string, input_versions map<string,string>"
KEY = ["universe_id", "output_id"]

#: manifest?, definition now, env now, inputs now, foreign write, expected status, kind, input
CASES = {
    "never made": (False, "code", "env", {}, False, "stale", "missing", None),
    "unchanged": (True, "code", "env", {"catalog": "cat"}, False, "current", None, None),
    "definition drift": (True, "other", "env", {"catalog": "cat"}, False, "stale", "definition", None),
    "input drift": (True, "code", "env", {"catalog": "new"}, False, "stale", "input", "catalog"),
    "input added": (True, "code", "env", {"catalog": "cat", "extra": "x"}, False, "stale", "declaration", "extra"),
    "input dropped": (True, "code", "env", {}, False, "stale", "declaration", "catalog"),
    "will be remade": (True, "code", "env", {"catalog": None}, False, "stale", "input", "catalog"),
    "env drift": (True, "code", "env2", {"catalog": "cat"}, False, "behind", "behind", None),
    "stale and env": (True, "other", "env2", {"catalog": "cat"}, False, "stale", "definition", None),
    "foreign write": (True, "code", "env", {"catalog": "cat"}, True, "stale", "foreign", None),
    "definition and foreign": (True, "other", "env", {"catalog": "cat"}, True, "stale", "definition", None),
    "foreign and env": (True, "code", "env2", {"catalog": "cat"}, True, "stale", "foreign", None),
}


def test_truth_table(spark):
    tasks = spark.createDataFrame([("u", n, c[1], c[2]) for n, c in CASES.items()], TASKS)
    inputs = spark.createDataFrame(
        [("u", n, i, o, "p", None, v) for n, c in CASES.items() for o, (i, v) in enumerate(c[3].items())], INPUTS
    )
    made = spark.createDataFrame([("u", n, "code", "env", "data", {"catalog": "cat"}) for n, c in CASES.items() if c[0]], MADE)
    foreign = spark.createDataFrame([("u", n, "abcdef0123", "tweak", "Ada", "2026-01-02") for n, c in CASES.items() if c[4]],
                                    "universe_id string, output_id string, sha string, subject string, author string, date string")
    got = {r["output_id"]: r for r in status.classify(tasks, inputs, made, foreign).collect()}
    assert {n: (r["status"], r["reason_kind"], r["reason_input"]) for n, r in got.items()} == {n: c[5:] for n, c in CASES.items()}
    assert got["foreign write"]["why"].startswith('last changed by abcdef0 ("tweak", Ada, 2026-01-02) rather than its run record')
    assert got["input drift"]["why"] == "the input `catalog` changed" and got["unchanged"]["why"] == ""


def test_first_changed_input_is_the_first_declared(spark):
    tasks = spark.createDataFrame([("u", "o", "c", "e")], TASKS)
    made = spark.createDataFrame([("u", "o", "c", "e", "d", {"z": "1", "a": "1"})], MADE)
    inputs = spark.createDataFrame([("u", "o", "a", 1, "p", None, "2"), ("u", "o", "z", 0, "p", None, "2")], INPUTS)
    assert status.classify(tasks, inputs, made).first()["reason_input"] == "z"


def random_project(seed):
    """A random acyclic project: tasks, inputs, manifests, attempts as plain rows."""
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(14)]
    tasks, inputs, made, attempts = [], [], [], []
    for u in ("a", "b"):
        for i, n in enumerate(names):
            deps = [d for d in names[:i] if rng.random() < 0.2]
            tasks.append((u, n, "d", "e"))
            rows = [(u, n, f"i{d}", o, f"r/{d}", d, None) for o, d in enumerate(deps)]
            if rng.random() < 0.4:
                rows.append((u, n, "file", 9, f"f{rng.randrange(4)}", None, None))
            inputs += rows
            if rng.random() < 0.9:
                recorded = {r[2]: (f"v{u}{r[5]}" if r[5] else r[4]) for r in rows}
                if rows and rng.random() < 0.05:
                    recorded[rows[0][2]] = "old"
                made.append((u, n, "d" if rng.random() < 0.93 else "x", "e" if rng.random() < 0.8 else "x", f"v{u}{n}", recorded))
            attempts.append((u, n, rng.random() < 0.85, f"v{u}{n}" if rng.random() < 0.5 else f"n{u}{n}"))
    return tasks, inputs, made, attempts


FILES = {"f0": "f0", "f1": "f1", "f2": None}  # f3 is absent, f2 was never fetched


def rule(made, definition, env, now):
    if made is None or made[2] != definition:
        return "stale"
    if set(now) ^ set(made[5]) or any(v is None or v != made[5][k] for k, v in now.items()):
        return "stale"
    return "current" if made[3] == env else "behind"


def walk(tasks, inputs, made, refresh):
    by, running, out = {m[:2]: m for m in made}, set(), {}
    for u, n, d, e in tasks:
        now = {}
        for r in inputs:
            if r[:2] == (u, n):
                up = (u, r[5])
                now[r[2]] = (None if up in running else by[up][4] if up in by else None) if r[5] else FILES.get(r[4])
        out[u, n] = rule(by.get((u, n)), d, e, now)
        if out[u, n] == "stale" or (refresh and out[u, n] == "behind"):
            running.add((u, n))
    return out


def real_run(tasks, inputs, made, attempts, refresh):
    by, tried, out = {m[:2]: m for m in made}, {a[:2]: a for a in attempts}, {}
    for u, n, d, e in tasks:
        mine = [r for r in inputs if r[:2] == (u, n)]
        absent = sorted({r[5] for r in mine if r[5] and out[u, r[5]][0] not in ("ok", "current", "behind")})
        if absent:
            out[u, n] = ("blocked", None, absent[0], len(absent))
            continue
        now = {r[2]: out[u, r[5]][1] if r[5] else FILES.get(r[4]) for r in mine}
        verdict = rule(by.get((u, n)), d, e, now)
        if verdict == "stale" or (refresh and verdict == "behind"):
            ok = tried[u, n][2]
            out[u, n] = ("ok" if ok else "failed", tried[u, n][3] if ok else None, None, 0)
        else:
            out[u, n] = (verdict, by[u, n][4], None, 0)
    return out


@pytest.mark.parametrize("seed,refresh", [(1, False), (2, True)])
def test_predictions_and_runs_equal_a_topological_walk(spark, seed, refresh):
    tasks, inputs, made, attempts = random_project(seed)
    t, i, m = spark.createDataFrame(tasks, TASKS), spark.createDataFrame(inputs, INPUTS), spark.createDataFrame(made, MADE)
    files = spark.createDataFrame(list(FILES.items()), "path string, data_version string")
    got = status.would_run(t, i, m, files, refresh=refresh).collect()
    assert {(r["universe_id"], r["output_id"]): r["status"] for r in got} == walk(tasks, inputs, made, refresh)

    live = status.predicted_inputs(i, m, files).withColumn("current_version", F.when(F.col("produced_by").isNull(), F.col("current_version")))
    a = spark.createDataFrame(attempts, "universe_id string, output_id string, ok boolean, new_version string")
    done = status.settle(t, live, m, a, refresh=refresh).collect()
    assert {(r["universe_id"], r["output_id"]): (r["outcome"], r["data_version"], r["blocked_by"], r["n_blocking"]) for r in done} == real_run(
        tasks, inputs, made, attempts, refresh
    )


def test_predictions_meet_inputs_and_records_once(spark, monkeypatch):
    """Below a running task: an input without a record is undeclared, one without a name moves nothing, others moved."""
    calls, beside = [], status._beside
    monkeypatch.setattr(status, "_beside", lambda *a: calls.append(1) or beside(*a))
    names = ["top", "new", "unnamed", "moved", "far"]
    t = spark.createDataFrame([("u", n, "d", "e") for n in names], TASKS)
    m = spark.createDataFrame([("u", n, "old" if n == "top" else "d", "e", f"v-{n}", {"a": "v-top"} if n == "moved" else {"b": "v-moved"} if n == "far" else {}) for n in names], MADE)
    i = spark.createDataFrame(
        [("u", "new", "a", 0, "p", "top", None), ("u", "unnamed", None, 0, "p", "top", None), ("u", "moved", "a", 0, "p", "top", None),
         ("u", "far", "b", 0, "p", "moved", None)], INPUTS)
    files = spark.createDataFrame([], "path string, data_version string")
    got = {r["output_id"]: (r["reason_kind"], r["reason_input"]) for r in status.would_run(t, i, m, files).collect()}
    assert got == {"top": ("definition", None), "new": ("declaration", "a"), "unnamed": (None, None), "moved": ("input", "a"), "far": ("input", "b")}
    assert len(calls) == 1


EDGES = "universe_id string, output_id string, dep_output_id string"


def test_closure_order_and_cycles(spark):
    edges = [("u", "report", "fit"), ("u", "report", "mask"), ("u", "fit", "raw"), ("u", "mask", "raw"), ("v", "report", "fit")]
    tasks = spark.createDataFrame([(u, o, "", "") for u, o, _ in edges] + [("u", "alone", "", "")], TASKS)
    df = spark.createDataFrame(edges, EDGES)
    got = graph.closure(df, spark.createDataFrame([("u", "fit")], "universe_id string, output_id string"))
    assert {tuple(r) for r in got.collect()} == {("u", "fit"), ("u", "raw")}
    order = {(r["universe_id"], r["output_id"]): r["level"] for r in graph.task_order(df, tasks).collect()}
    assert order == {("u", "raw"): 0, ("u", "alone"): 0, ("v", "fit"): 0, ("u", "fit"): 1, ("u", "mask"): 1, ("v", "report"): 1, ("u", "report"): 2}

    tangled = spark.createDataFrame(edges + [("u", "raw", "fit"), ("u", "x", "report"), ("v", "fit", "fit")], EDGES)
    assert {tuple(r) for r in graph.find_cycles(tangled, tasks).collect()} == {("u", "raw"), ("u", "fit"), ("v", "fit")}
    with pytest.raises(ValueError, match="cycle: u/fit, u/raw"):
        graph.task_order(tangled, tasks)
    placed, stuck = graph.levels(tangled, tasks)
    assert {tuple(r) for r in stuck.collect()} == {("u", "raw"), ("u", "fit"), ("u", "mask"), ("u", "report"), ("u", "x"), ("v", "fit"), ("v", "report")}


def test_long_chains_fold_their_rounds(spark):
    edges = spark.createDataFrame([("u", f"t{i + 1:02}", f"t{i:02}") for i in range(20)], EDGES)
    start = spark.createDataFrame([("u", "t20")], "universe_id string, output_id string")
    assert graph.closure(edges, start).count() == 21
    assert graph.dependents(edges, start).count() == 1


def test_foreign_writes_compare_whole_subjects(spark):
    writes = spark.createDataFrame(
        [("base", "a", "1", "[DATALAD RUNCMD] a [base]"), ("base", "b", "2", "[DATALAD RUNCMD] b [other]"), ("base", "c", "3", None)],
        "universe_id string, output_id string, sha string, subject string",
    )
    tasks = spark.createDataFrame([("base", x, "", "") for x in "abcd"], TASKS)
    assert {r["output_id"] for r in history.foreign_writes(tasks, writes).collect()} == {"b", "c"}


def test_targets(spark):
    tasks = spark.createDataFrame([("base", "fit", "", ""), ("alt", "fit", "", ""), ("base", "report", "", "")], TASKS)
    targets = spark.createDataFrame([(0, "report"), (1, "fit"), (2, "alt/fit"), (3, "typo"), (4, "nowhere/fit")], "pos int, target string")
    matched, unmatched = spec.resolve_targets(tasks, targets)
    assert [(r["pos"], r["universe_id"]) for r in matched.orderBy("pos", "universe_id").collect()] == [(0, "base"), (1, "alt"), (1, "base"), (2, "alt")]
    assert {r["target"] for r in unmatched.collect()} == {"typo", "nowhere/fit"}


def test_counts_keep_zeros_and_reports_flag_failures(spark):
    df = spark.createDataFrame([("current",), ("current",)], "status string")
    assert tuple(status.status_counts(df).first()) == (2, 0, 0)
    report = status.run_report(spark.createDataFrame([("failed",), ("current",)], "outcome string")).first()
    assert (report["failed"], report["ok"], report["up_to_date"]) == (1, False, False)


def test_inputs_meet_their_records_once_when_settling(spark, monkeypatch):
    met = []
    beside = status._beside
    monkeypatch.setattr(status, "_beside", lambda *a: met.append(a) or beside(*a))
    tasks = spark.createDataFrame([("u", "a", "d", "e"), ("u", "b", "d", "e")], TASKS)
    inputs = spark.createDataFrame([("u", "b", "x", 0, "p", "a", None), ("u", "a", "f", 0, "q", None, "1")], INPUTS)
    made = spark.createDataFrame([("u", "a", "d", "e", "va", {"f": "1"}), ("u", "b", "d", "e", "vb", {"x": "va"})], MADE)
    tries = spark.createDataFrame([("u", "a", True, "na"), ("u", "b", True, "nb")], "universe_id string, output_id string, ok boolean, new_version string")
    done = {r["output_id"]: (r["outcome"], r["data_version"]) for r in status.settle(tasks, inputs, made, tries).collect()}
    assert done == {"a": ("current", "va"), "b": ("current", "vb")} and len(met) == 1
