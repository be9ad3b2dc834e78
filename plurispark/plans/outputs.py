"""Registered queries: spec expansion, classification, history and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plurispark.functions import records
from plurispark.operators import history, spec, status
from plurispark.plans.registry import DERIVED, register, table
from plurispark.session import shared_folder
from plurispark.sources import changelog

KEY = ["universe_id", "output_id"]

# --- the spec ------------------------------------------------------------------

#: A region is a project; its nations are the universes and its customers' analyses the outputs.
DERIVED["project_universes"] = """
SELECT n_regionkey AS project, 'u' || cast(n_nationkey AS string) AS universe_id, n_name || '.yaml' AS source_file,
       CASE WHEN n_nationkey % 2 = 0 THEN 'mcmc' ELSE 'nested' END AS method,
       CASE WHEN n_nationkey % 3 = 0 THEN 'low' ELSE 'high' END AS cut
FROM nation"""
DERIVED["project_outputs"] = """
SELECT n_regionkey AS project, 'c' || cast(c_custkey AS string) AS output_id, c_mktsegment AS segment,
       CASE WHEN c_acctbal >= 0 THEN 'fit ' || c_name END AS command,
       c_mktsegment <> 'FURNITURE' AS active,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'cut' ELSE 'method' END AS decision,
       CASE WHEN c_acctbal < 9000 THEN 'csv' WHEN c_acctbal < 9500 THEN '' END AS format
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@register("expand_tasks", """
SELECT o.project, u.universe_id, o.output_id, o.command, o.decision || '=' || CASE o.decision WHEN 'cut' THEN u.cut ELSE u.method END AS chosen
FROM project_outputs o JOIN project_universes u ON o.project = u.project
WHERE o.active AND o.command IS NOT NULL""")
def expand_tasks(spark, folder):
    universes = table(spark, folder, "project_universes").select(
        "project", "universe_id",
        F.create_map(F.lit("method"), "method", F.lit("cut"), "cut").alias("decisions"),
    )
    outputs = table(spark, folder, "project_outputs").withColumn("decisions", F.array("decision"))
    tasks = spec.expand_tasks(universes, outputs, on=["project"])
    chosen = F.array_join(F.transform(F.map_entries("decisions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return tasks.select("project", "universe_id", "output_id", "command", chosen.alias("chosen"))


#: Orders need their parts (made by other tasks when the part is small) or a supplier's data.
DERIVED["spec_tasks"] = """
SELECT 'base' AS universe_id, 'o' || cast(l_orderkey AS string) AS output_id, 'csv' AS format,
       CASE WHEN l_returnflag = 'R' THEN 's' || cast(l_suppkey AS string) ELSE 'p' || cast(l_partkey AS string) END AS input
FROM lineitem GROUP BY l_orderkey, CASE WHEN l_returnflag = 'R' THEN 's' || cast(l_suppkey AS string) ELSE 'p' || cast(l_partkey AS string) END"""
DERIVED["spec_parts"] = "SELECT 'base' AS universe_id, 'p' || cast(p_partkey AS string) AS output_id, 'h5' AS format FROM part WHERE p_size < 45"
DERIVED["spec_sources"] = """
SELECT 's' || cast(s_suppkey AS string) AS input_id,
       CASE WHEN s_acctbal < 0 THEN '/archive/' || s_name ELSE 'data/' || s_name END AS source FROM supplier WHERE s_nationkey <> 3"""


def _spec(spark, folder):
    orders = table(spark, folder, "spec_tasks").withColumn("inputs", F.array("input")).drop("input")
    parts = table(spark, folder, "spec_parts").withColumn("inputs", F.array().cast("array<string>"))
    return spec.resolve_inputs(orders.unionByName(parts), table(spark, folder, "spec_sources"), "/proj")


_RESOLVED = """
SELECT t.universe_id, t.output_id, t.input AS input_name, p.output_id AS produced_by,
  CASE WHEN p.output_id IS NOT NULL THEN '/proj/results/base/' || p.output_id || '.h5'
       WHEN starts_with(s.source, '/') THEN s.source ELSE '/proj/' || s.source END AS path
FROM spec_tasks t LEFT JOIN spec_parts p ON p.output_id = t.input LEFT JOIN spec_sources s ON s.input_id = t.input"""


@register("resolve_inputs", f"SELECT * FROM ({_RESOLVED}) WHERE path IS NOT NULL")
def resolve_inputs(spark, folder):
    return _spec(spark, folder)[0].drop("ord")


@register("unresolved_inputs", f"SELECT universe_id, output_id, input_name FROM ({_RESOLVED}) WHERE path IS NULL")
def unresolved_inputs(spark, folder):
    return _spec(spark, folder)[1]


#: Every order is a target: asked for in all universes, in one, or by an id nobody declares.
DERIVED["target_tasks"] = """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'alternative' ELSE 'baseline' END AS universe_id, 'c' || cast(o_custkey AS string) AS output_id
FROM orders GROUP BY CASE WHEN o_orderstatus = 'F' THEN 'alternative' ELSE 'baseline' END, o_custkey"""
DERIVED["targets"] = """
SELECT o_orderkey AS pos, CASE WHEN o_orderpriority = '1-URGENT' THEN 'baseline/' WHEN o_orderpriority = '5-LOW' THEN 'nowhere/' ELSE '' END ||
       'c' || cast(o_custkey AS string) AS target FROM orders"""
_MATCHED = """targets g JOIN target_tasks t ON t.output_id = split_part(g.target, '/', -1)
  AND (NOT contains(g.target, '/') OR split_part(g.target, '/', 1) = t.universe_id)"""


@register("resolve_targets", f"SELECT g.pos, g.target, t.universe_id, t.output_id FROM {_MATCHED}")
def resolve_targets(spark, folder):
    return spec.resolve_targets(table(spark, folder, "target_tasks"), table(spark, folder, "targets"))[0]


@register("unmatched_targets", f"SELECT pos, target FROM targets WHERE pos NOT IN (SELECT g.pos FROM {_MATCHED})")
def unmatched_targets(spark, folder):
    return spec.resolve_targets(table(spark, folder, "target_tasks"), table(spark, folder, "targets"))[1]


@register("duplicate_universes", """
SELECT project, universe_id, source_file, n FROM (SELECT c_nationkey AS project, c_mktsegment AS universe_id, c_name AS source_file, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n
  FROM customer) q WHERE n > 1""")
def duplicate_universes(spark, folder):
    files = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("universe_id"), F.col("c_name").alias("source_file")
    )
    return spec.duplicate_universes(files, on=["project"])


@register("missing_formats", "SELECT output_id FROM project_outputs WHERE active AND command IS NOT NULL AND coalesce(format, '') = ''")
def missing_formats(spark, folder):
    return spec.missing_formats(table(spark, folder, "project_outputs"))


@register("unknown_keys", """
SELECT p_partkey, array_to_string([e FOR e IN [CASE WHEN p_brand = 'Brand#10' THEN 'disk' END, CASE WHEN p_type = 'LARGE' THEN 'ram' END] IF e IS NOT NULL], ',') AS unknown
FROM part""")
def unknown_keys(spark, folder):
    given = F.map_from_arrays(
        F.array(F.lit("cpus"), F.when(F.col("p_type") == "LARGE", "ram").otherwise("memory"),
                F.when(F.col("p_brand") == "Brand#10", "disk").otherwise("gpus")),
        F.array(F.lit("1"), F.lit("2"), F.lit("3")),
    )
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(spec.unknown_keys(given, ("cpus", "memory", "gpus")), ",").alias("unknown")
    )


# --- classification ------------------------------------------------------------

#: Orders are tasks and their parts the inputs; manifests are an earlier state of the same orders.
DERIVED["status_tasks"] = """
SELECT 'c' || cast(o_custkey AS string) AS universe_id, 'o' || cast(o_orderkey AS string) AS output_id,
       'def-' || o_orderpriority AS definition_version, 'env-2' AS env_version FROM orders"""
DERIVED["status_manifests"] = """
SELECT 'c' || cast(o_custkey AS string) AS universe_id, 'o' || cast(o_orderkey AS string) AS output_id,
       CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'def-old' ELSE 'def-' || o_orderpriority END AS definition_version,
       CASE WHEN o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'env-1' ELSE 'env-2' END AS env_version,
       'v' || cast(o_orderkey AS string) AS data_version
FROM orders WHERE o_totalprice >= 50000"""
DERIVED["status_lines"] = """
SELECT 'c' || cast(o_custkey AS string) AS universe_id, 'o' || cast(l_orderkey AS string) AS output_id, 'p' || cast(l_partkey AS string) AS input_name,
       min(l_linenumber) AS ord, max(l_suppkey) AS supp, min(l_quantity) AS low, max(l_quantity) AS high, max(l_tax) AS tax
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_partkey"""
DERIVED["status_inputs"] = """
SELECT universe_id, output_id, input_name, ord, CASE WHEN high < 50 THEN 'v' || cast(supp AS string) END AS current_version FROM status_lines"""
DERIVED["status_recorded"] = """
SELECT universe_id, output_id, input_name, CASE WHEN tax >= 0.08 THEN 'old' ELSE 'v' || cast(supp AS string) END AS version
FROM status_lines WHERE low > 1
UNION ALL SELECT 'c' || cast(o_custkey AS string), 'o' || cast(o_orderkey AS string), 'dropped', 'x' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice > 400000"""
DERIVED["status_foreign"] = """
SELECT 'c' || cast(o_custkey AS string) AS universe_id, 'o' || cast(o_orderkey AS string) AS output_id, 'abcdef0' || cast(o_orderkey AS string) AS sha,
       'tweak ' || o_orderpriority AS subject, 'customer ' || cast(o_custkey AS string) AS author, cast(cast(o_orderdate AS date) AS string) AS date
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000"""

_VERDICTS = """
SELECT universe_id, output_id, CASE WHEN kind IN ('current', 'behind') THEN kind ELSE 'stale' END AS status,
  nullif(kind, 'current') AS reason_kind, CASE kind WHEN 'declaration' THEN diff WHEN 'input' THEN moved END AS reason_input,
  CASE kind WHEN 'missing' THEN 'no manifest — it has never been materialized' WHEN 'definition' THEN 'the recipe or its decisions changed'
    WHEN 'declaration' THEN 'the output no longer declares the same inputs (`' || diff || '`)' WHEN 'input' THEN 'the input `' || moved || '` changed'
    WHEN 'foreign' THEN 'last changed by ' || substr(sha, 1, 7) || ' ("' || subject || '", ' || author || ', ' || date || ') rather than its run record, so the manifest no longer describes these bytes — the next run remakes it; inspect first with `git show ' || substr(sha, 1, 7) || '`'
    WHEN 'behind' THEN 'made under an earlier environment' ELSE '' END AS why, data_version
FROM (SELECT t.*, m.data_version, d.diff, c.moved, f.sha, f.subject, f.author, f.date,
  CASE WHEN m.output_id IS NULL THEN 'missing' WHEN m.definition_version <> t.definition_version THEN 'definition'
       WHEN d.diff IS NOT NULL THEN 'declaration' WHEN c.moved IS NOT NULL THEN 'input' WHEN f.sha IS NOT NULL THEN 'foreign'
       WHEN m.env_version <> t.env_version THEN 'behind' ELSE 'current' END AS kind
  FROM status_tasks t LEFT JOIN status_manifests m USING (universe_id, output_id)
  LEFT JOIN (SELECT universe_id, output_id, min(input_name) AS diff FROM
     ((SELECT universe_id, output_id, input_name FROM status_inputs EXCEPT SELECT universe_id, output_id, input_name FROM status_recorded) UNION ALL
      (SELECT universe_id, output_id, input_name FROM status_recorded EXCEPT SELECT universe_id, output_id, input_name FROM status_inputs)) GROUP BY ALL) d USING (universe_id, output_id)
  LEFT JOIN (SELECT i.universe_id, i.output_id, arg_min(i.input_name, lpad(cast(ord AS string), 9, '0') || i.input_name) AS moved
     FROM status_inputs i JOIN status_recorded r USING (universe_id, output_id, input_name)
     WHERE i.current_version IS NULL OR i.current_version <> r.version GROUP BY ALL) c USING (universe_id, output_id)
  LEFT JOIN status_foreign f USING (universe_id, output_id))"""


def verdicts(spark, folder):
    t = {n: table(spark, folder, f"status_{n}") for n in ("tasks", "inputs", "manifests", "foreign", "recorded")}
    return status.classify(t["tasks"], t["inputs"], t["manifests"], t["foreign"], t["recorded"])


@register("classify", _VERDICTS)
def classify(spark, folder):
    return verdicts(spark, folder)


@register("status_counts", f"""
SELECT universe_id, count(*) FILTER (status = 'current') AS current, count(*) FILTER (status = 'behind') AS behind, count(*) FILTER (status = 'stale') AS stale
FROM ({_VERDICTS}) GROUP BY universe_id""")
def status_counts(spark, folder):
    return status.status_counts(verdicts(spark, folder), by=["universe_id"])


@register("check_report", f"""
SELECT universe_id || '/' || output_id AS output, CASE WHEN status = 'stale' THEN 'planned' ELSE status END AS list, why FROM ({_VERDICTS})""")
def check_report(spark, folder):
    return status.check_report(verdicts(spark, folder))


@register("remake", f"SELECT universe_id, output_id, status IN ('stale', 'behind') AS refreshed, status = 'stale' AS plain FROM ({_VERDICTS})")
def remake(spark, folder):
    s = F.col("status")
    return verdicts(spark, folder).select(*KEY, records.remake(s, True).alias("refreshed"), records.remake(s, False).alias("plain"))


@register("declared_diff", """
SELECT *, 'declared' AS side FROM (SELECT universe_id, output_id, input_name FROM status_inputs EXCEPT SELECT universe_id, output_id, input_name FROM status_recorded)
UNION ALL SELECT *, 'recorded' FROM (SELECT universe_id, output_id, input_name FROM status_recorded EXCEPT SELECT universe_id, output_id, input_name FROM status_inputs)""")
def declared_diff(spark, folder):
    return spec.declared_diff_rows(
        table(spark, folder, "status_inputs"), table(spark, folder, "status_recorded"), [*KEY, "input_name"]
    )


@register("orphan_manifests", """
SELECT universe_id, output_id, data_version FROM status_manifests m
WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal >= 0 AND 'o' || cast(o.o_orderkey AS string) = m.output_id)""")
def orphan_manifests(spark, folder):
    kept = table(spark, folder, "orders").join(
        table(spark, folder, "customer").where("c_acctbal >= 0"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("universe_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("output_id"),
    )
    return status.orphan_manifests(table(spark, folder, "status_manifests"), kept).select(*KEY, "data_version")


@register("environment_drift", """
SELECT universe_id, output_id, env_version, 'env-2' AS current_env FROM status_manifests WHERE env_version <> 'env-2'""")
def environment_drift(spark, folder):
    now = table(spark, folder, "status_tasks").select(*KEY, "env_version")
    then = table(spark, folder, "status_manifests").select(*KEY, "env_version")
    return status.environment_drift(then, now, KEY)


#: Orders as executions: exit codes, environments before and after, and what was found.
DERIVED["executions"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 0 END AS exit_code, 'env-' || o_orderstatus AS env,
       CASE WHEN o_totalprice > 450000 THEN 'env-moved' ELSE 'env-' || o_orderstatus END AS env_before,
       CASE WHEN o_totalprice < 20000 THEN 'env-moved' ELSE 'env-' || o_orderstatus END AS env_after,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'directory' WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN NULL ELSE 'file' END AS found,
       o_orderpriority <> '2-HIGH' OR o_orderstatus <> 'F' AS recordable, o_custkey FROM orders"""
_OUTCOMES = """
SELECT o_orderkey, o_custkey, CASE WHEN env_before <> env THEN 'environment moved before the run' WHEN exit_code <> 0 THEN 'the recipe exited ' || cast(exit_code AS string)
  WHEN env_after <> env THEN 'environment moved during the run' WHEN found = 'directory' THEN 'the recipe exited 0 but left a directory'
  WHEN found IS NULL THEN 'the recipe exited 0 but left nothing' WHEN NOT recordable THEN 'the output could not be recorded' ELSE '' END AS reason
FROM executions"""


def _outcomes(spark, folder):
    columns = [F.col(c) for c in ("exit_code", "env", "env_before", "env_after", "found", "recordable")]
    return table(spark, folder, "executions").select("o_orderkey", "o_custkey", status.task_outcome(*columns).alias("r")).select(
        "o_orderkey", "o_custkey", "r.outcome", "r.reason"
    )


@register("task_outcome", f"SELECT o_orderkey, CASE WHEN reason = '' THEN 'ok' ELSE 'failed' END AS outcome, reason FROM ({_OUTCOMES})")
def task_outcome(spark, folder):
    return _outcomes(spark, folder).drop("o_custkey")


@register("usable", f"SELECT o_orderkey, reason = '' AS usable FROM ({_OUTCOMES})")
def usable(spark, folder):
    return _outcomes(spark, folder).select("o_orderkey", records.usable(F.col("outcome")).alias("usable"))


@register("run_report", f"""
SELECT o_custkey, count(*) FILTER (reason = '') AS made, cast(0 AS bigint) AS current, cast(0 AS bigint) AS behind, count(*) FILTER (reason <> '') AS failed,
  cast(0 AS bigint) AS blocked, count(*) FILTER (reason <> '') = 0 AS ok, false AS up_to_date FROM ({_OUTCOMES}) GROUP BY o_custkey""")
def run_report(spark, folder):
    return status.run_report(_outcomes(spark, folder), by=["o_custkey"])


#: A customer is a project with a published document; orders carry the finishing times.
DERIVED["publications"] = """
SELECT 'c' || cast(c_custkey AS string) AS universe_id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'MIT' END AS license, c_acctbal > 0 AS present,
       c_acctbal > 500 AS readable, CASE WHEN c_nationkey < 5 THEN '1999-01-01' ELSE newest END AS published
FROM customer LEFT JOIN (SELECT o_custkey, cast(cast(max(o_orderdate) AS date) AS string) AS newest FROM orders GROUP BY o_custkey) q ON o_custkey = c_custkey"""
DERIVED["finished_manifests"] = """
SELECT 'c' || cast(o_custkey AS string) AS universe_id, 'o' || cast(o_orderkey AS string) AS output_id,
       CASE WHEN o_totalprice > 2000 THEN cast(cast(o_orderdate AS date) AS string) ELSE '' END AS finished_at FROM orders"""


@register("publication_lag", """
SELECT universe_id, CASE WHEN license IS NULL AND present THEN 'no longer maintained' WHEN license IS NULL THEN 'not maintained'
  WHEN NOT present THEN 'to be created' WHEN NOT readable THEN 'unreadable'
  WHEN newest IS NOT NULL AND published IS DISTINCT FROM newest THEN 'behind' ELSE 'up to date' END AS state
FROM publications LEFT JOIN (SELECT universe_id, max(nullif(finished_at, '')) AS newest FROM finished_manifests GROUP BY universe_id) USING (universe_id)""")
def publication_lag(spark, folder):
    return status.publication_lag(
        table(spark, folder, "finished_manifests"), table(spark, folder, "publications"), ["universe_id"]
    )


# --- files ---------------------------------------------------------------------

@register("external_inputs", """
SELECT DISTINCT CASE WHEN starts_with(path, '/proj/') THEN substr(path, 7) ELSE path END AS declared, starts_with(path, '/proj/') AS in_tree
FROM page_paths WHERE NOT path LIKE '%.csv'""")
def external_inputs(spark, folder):
    inputs = table(spark, folder, "page_paths").withColumn(
        "produced_by", F.when(F.endswith("path", F.lit(".csv")), F.lit("other"))
    )
    return status.external_inputs(inputs, "/proj")


#: Files beside outputs: payloads in any format, sidecars, temporaries, and longer ids.
DERIVED["result_files"] = """
SELECT 'results/c' || cast(o_custkey AS string) || '/' || CASE
  WHEN o_orderpriority = '1-URGENT' THEN 'o' || cast(o_orderkey AS string) || '.tar.gz'
  WHEN o_orderpriority = '2-HIGH' THEN '.o' || cast(o_orderkey AS string) || '.manifest.json'
  WHEN o_orderpriority = '3-MEDIUM' THEN '.o' || cast(o_orderkey AS string) || '.manifest.json.tmp'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'o' || cast(o_orderkey AS string) || 'b.csv'
  ELSE 'o' || cast(o_orderkey AS string) END AS path FROM orders"""


@register("owned_files", """
SELECT 'c' || cast(o_custkey AS string) AS universe_id, 'o' || cast(o_orderkey AS string) AS output_id, f.path,
  CASE WHEN contains(f.path, '/.') THEN 'manifest' ELSE 'payload' END AS kind
FROM (SELECT *, regexp_extract(path, 'o([0-9]+)', 1) AS n FROM result_files) f JOIN orders ON f.n = cast(o_orderkey AS string)
WHERE starts_with(f.path, 'results/c' || cast(o_custkey AS string) || '/o' || cast(o_orderkey AS string) || '.')
   OR starts_with(f.path, 'results/c' || cast(o_custkey AS string) || '/.o' || cast(o_orderkey AS string) || '.manifest.json')""")
def owned_files(spark, folder):
    tasks = table(spark, folder, "status_tasks").select(
        *KEY, F.concat(F.lit("results/"), "universe_id", F.lit("/"), "output_id", F.lit(".csv")).alias("output_path")
    )
    return status.owned_files(tasks, table(spark, folder, "result_files"))


# --- history -------------------------------------------------------------------

#: Events are commits: an error is a hand edit, anything else the user's own run record.
DERIVED["commits"] = """
SELECT event_id AS seq, 'sha' || cast(event_id AS string) AS sha,
       CASE WHEN event_type = 'error' THEN 'tweak colors' ELSE '[DATALAD RUNCMD] c' || cast(user_id AS string) || ' [base]' END AS subject,
       'user ' || cast(user_id AS string) AS author, cast(cast(ts AS date) AS string) AS date FROM events"""
DERIVED["commit_paths"] = """
SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'error') THEN 'results/base/.c' || cast(user_id AS string) || '.manifest.json'
  ELSE 'results/base/c' || cast(user_id AS string) || '.csv' END AS path FROM events"""
DERIVED["write_groups"] = """
SELECT 'base' AS universe_id, 'c' || cast(c_custkey AS string) AS output_id, 'results/base/c' || cast(c_custkey AS string) || '.csv' AS path FROM customer
UNION ALL SELECT 'base', 'c' || cast(c_custkey AS string), 'results/base/.c' || cast(c_custkey AS string) || '.manifest.json' FROM customer"""
_LAST = """SELECT 'base' AS universe_id, 'c' || cast(user_id AS string) AS output_id, c.* FROM
  (SELECT user_id, max(event_id) AS seq FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id) JOIN commits c USING (seq)"""


def _last(spark, folder):
    return history.last_writer(*[table(spark, folder, n) for n in ("commits", "commit_paths", "write_groups")], KEY)


@register("last_writer", _LAST)
def last_writer(spark, folder):
    return _last(spark, folder)


@register("change_log_round_trip", f"SELECT universe_id, output_id, sha, subject, author, date FROM ({_LAST})")
def change_log_round_trip(spark, folder):
    """The change log written as a tool prints it, read back, and asked for the last writers."""
    commits, touched, groups = (table(spark, folder, n) for n in ("commits", "commit_paths", "write_groups"))
    record = F.concat_ws("\u0000", "sha", "subject", "author", F.lit(""), "date")
    text = commits.join(touched, "seq").select(F.concat(record, F.lit("\n"), "path").alias("value"), "seq")
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    text.sort(F.col("seq").desc()).select("value").write.text(path)
    found = history.last_writer(*changelog.read_change_log(spark, path), groups, KEY)
    return found.select(*KEY, "sha", "subject", "author", "date")


@register("foreign_writes", f"SELECT * FROM ({_LAST}) WHERE subject = 'tweak colors'")
def foreign_writes(spark, folder):
    tasks = table(spark, folder, "write_groups").select(*KEY).distinct()
    return history.foreign_writes(tasks, _last(spark, folder))


#: Raw log lines as a version-control tool prints them, some of them cut short.
DERIVED["log_lines"] = """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'broken' ELSE 'h' || cast(event_id AS string) || chr(0) || props || chr(0) || 'user ' ||
  cast(user_id AS string) || chr(0) || 'u' || cast(user_id AS string) || '@example.org' || chr(0) || cast(cast(ts AS date) AS string) END AS line FROM events"""


@register("parse_commits", """
SELECT event_id, 'h' || cast(event_id AS string) AS sha, props AS subject, 'user ' || cast(user_id AS string) AS author,
  'u' || cast(user_id AS string) || '@example.org' AS email, strftime(ts, '%Y-%m-%d') AS date FROM events WHERE event_type <> 'signup'""")
def parse_commits(spark, folder):
    return changelog.parse_commits(table(spark, folder, "log_lines"), "line")


#: Orders as commit messages; urgent ones are ordinary commits, low ones broken records.
DERIVED["messages"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Update notes' ELSE
  '[DATALAD RUNCMD] o' || cast(o_orderkey AS string) || ' [c' || cast(o_custkey AS string) || ']' || chr(10) || chr(10) ||
  '=== Do not change lines below ===' || chr(10) ||
  CASE WHEN o_orderpriority = '5-LOW' THEN '{broken' ELSE '{"chain": [], "cmd": "make ' || o_orderpriority || '", "dsid": "d' || cast(o_custkey AS string) ||
    '", "exit": 0,' || chr(10) || ' "inputs": ["data/a.csv"], "outputs": ["results/o' || cast(o_orderkey AS string) || '.csv"], "pwd": "."}' END ||
  chr(10) || '^^^ Do not change lines above ^^^' END AS message FROM orders"""


@register("run_ledger", """
SELECT o_orderkey, 'o' || cast(o_orderkey AS string) AS output_id, 'c' || cast(o_custkey AS string) AS universe_id, 'make ' || o_orderpriority AS cmd,
  'd' || cast(o_custkey AS string) AS dsid, 0 AS exit, 'data/a.csv' AS inputs, 'results/o' || cast(o_orderkey AS string) || '.csv' AS outputs
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def run_ledger(spark, folder):
    return history.run_ledger(table(spark, folder, "messages")).select(
        "o_orderkey", "output_id", "universe_id", "cmd", "dsid", "exit",
        F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"),
    )
