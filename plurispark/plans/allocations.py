"""Registered queries: scheduler accounting, allocations, offers and workers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurispark.functions import records
from plurispark.operators import compute
from plurispark.plans.registry import DERIVED, register, table

# Orders are job attempts of their customer's allocation.
_STATE = """CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'CANCELLED by 1000' WHEN o_orderstatus = 'F' THEN 'COMPLETED'
  WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'OUT_OF_MEMORY+' WHEN o_orderstatus = 'O' THEN 'RUNNING'
  WHEN o_orderpriority = '1-URGENT' THEN 'SUSPENDED' WHEN o_orderpriority = '2-HIGH' THEN 'COMPLETING' WHEN o_orderpriority = '3-MEDIUM' THEN 'PENDING'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'STRANGE' END"""
_ID = "CASE WHEN o_totalprice < 10000 THEN cast(o_custkey AS string) || '.batch' ELSE cast(o_custkey AS string) END"
DERIVED["job_states"] = f"SELECT o_orderkey, {_STATE} AS state FROM orders"
DERIVED["live_lines"] = f"""
SELECT o_orderkey, CASE WHEN o_totalprice > 480000 THEN 'slurm_load_jobs error' ELSE {_ID} || '|' ||
  CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE 'job-c' || cast(o_custkey AS string) END || '   |1000|' || {_STATE} || '|kind=work|token=' || o_orderpriority END AS line
FROM orders"""
DERIVED["history_lines"] = f"""
SELECT o_orderkey AS seq, {_ID} || '|job-c' || cast(o_custkey AS string) || '|' || CASE WHEN o_orderpriority = '5-LOW' THEN '1001' ELSE '1000' END || '|' || {_STATE} || '|' ||
  cast(cast(o_orderdate AS date) AS string) || CASE WHEN o_totalprice > 480000 THEN '' ELSE '|token=c' || cast(o_custkey AS string) END AS line
FROM orders"""


@register("job_phase", """
SELECT o_orderkey, CASE WHEN state IN ('CANCELLED by 1000', 'COMPLETED', 'OUT_OF_MEMORY+') THEN 'ended' WHEN state = 'RUNNING' THEN 'active'
  WHEN state IN ('SUSPENDED', 'PENDING') THEN 'pending' WHEN state = 'COMPLETING' THEN 'stopping' ELSE 'unknown' END AS phase FROM job_states""")
def job_phase(spark, folder):
    return table(spark, folder, "job_states").select("o_orderkey", records.job_phase(F.col("state")).alias("phase"))


@register("parse_job_rows", """
SELECT o_orderkey, trim(split_part(line, '|', 1)) AS job_id, trim(split_part(line, '|', 2)) AS job_name, '1000' AS uid, split_part(line, '|', 4) AS state,
  split_part(line, '|', 5) || '|' || split_part(line, '|', 6) AS comment
FROM live_lines WHERE contains(line, '|') AND NOT contains(split_part(line, '|', 1), '.') AND starts_with(split_part(line, '|', 2), 'job-')""")
def parse_job_rows(spark, folder):
    return compute.parse_job_rows(table(spark, folder, "live_lines"), "live", "job-")[0]


def _history(spark, folder):
    return compute.parse_job_rows(table(spark, folder, "history_lines"), "history", "job-")


@register("discover", """
SELECT 'live' AS authority, count(*) FILTER (contains(line, '|') AND NOT contains(split_part(line, '|', 1), '.') AND starts_with(split_part(line, '|', 2), 'job-')) AS rows,
  count(*) FILTER (NOT contains(line, '|')) AS errors FROM live_lines
UNION ALL SELECT 'accounting', count(*) FILTER (contains(line, 'token=') AND NOT contains(split_part(line, '|', 1), '.')), count(*) FILTER (NOT contains(line, 'token=')) FROM history_lines""")
def discover(spark, folder):
    live = compute.parse_job_rows(table(spark, folder, "live_lines"), "live", "job-")
    good, bad = compute.discover({"live": live, "accounting": _history(spark, folder)})
    rows = good.select("authority", F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(
        bad.select("authority", F.lit(0).alias("g"), F.lit(1).alias("b"))
    )
    return rows.groupBy("authority").agg(F.sum("g").alias("rows"), F.sum("b").alias("errors"))


#: Whose allocations are asked about: customers, with the comment their jobs must carry.
DERIVED["identities"] = """
SELECT cast(c_custkey AS string) AS job_id, 'job-c' || cast(c_custkey AS string) AS job_name, '1000' AS uid,
  'token=' || CASE WHEN c_mktsegment = 'FURNITURE' THEN 'x' ELSE 'c' END || cast(c_custkey AS string) AS comment FROM customer"""
_ATTEMPTS = """SELECT seq, split_part(line, '|', 1) AS job_id, split_part(line, '|', 2) AS job_name, split_part(line, '|', 3) AS uid, split_part(line, '|', 4) AS state,
  split_part(line, '|', 5) AS submit_time, split_part(line, '|', 6) AS comment FROM history_lines WHERE contains(line, 'token=') AND NOT contains(split_part(line, '|', 1), '.')"""


@register("latest_attempt", f"""
WITH a AS ({_ATTEMPTS}), b AS (SELECT *, row_number() OVER (PARTITION BY job_id, job_name, uid, comment ORDER BY submit_time DESC, seq) AS r FROM a)
SELECT job_id, job_name, uid, comment, b.state, b.submit_time,
  CASE WHEN regexp_matches(b.state, '^(COMPLETED|CANCELLED|OUT_OF_MEMORY)') THEN 'ended' ELSE 'unknown' END AS phase,
  CASE WHEN b.r IS NULL THEN 'not verifiable in accounting' WHEN regexp_matches(b.state, '^(COMPLETED|CANCELLED|OUT_OF_MEMORY)') THEN '' ELSE 'accounting is not terminal' END AS reason
FROM identities i LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (job_id, job_name, uid, comment)""")
def latest_attempt(spark, folder):
    return compute.latest_attempt(_history(spark, folder)[0], table(spark, folder, "identities"))


@register("verify_job_identity", f"""
WITH a AS ({_ATTEMPTS})
SELECT seq, EXISTS (SELECT 1 FROM identities i WHERE i.job_id = a.job_id AND i.job_name = a.job_name AND i.uid = a.uid AND i.comment = a.comment) AS ours
FROM a WHERE job_id IN (SELECT job_id FROM identities)""")
def verify_job_identity(spark, folder):
    ours, wrong = compute.verify_job_identity(_history(spark, folder)[0], table(spark, folder, "identities"))
    return ours.select("seq", F.lit(True).alias("ours")).unionByName(wrong.select("seq", F.lit(False).alias("ours")))


#: Orders as controller records, with every way a GPU can be stated or left unknown.
DERIVED["details"] = f"""
SELECT o_orderkey, CASE WHEN o_totalprice > 490000 THEN 'no such job' ELSE 'JobId=' || cast(o_orderkey AS string) || ' JobName=job-c' || cast(o_custkey AS string) || ' UserId=alice(1000) JobState=' || {_STATE} || chr(10) ||
  '   Comment=kind=work CPUs/Task=9 ' || chr(10) || '   NumNodes=' || cast(o_custkey % 3 AS string) || ' CPUs/Task=1 CPUs/Task=' || cast(1 + o_custkey % 64 AS string) || ' MinMemoryNode=' || CASE WHEN o_orderstatus = 'F' THEN '480G' WHEN o_orderstatus = 'O' THEN '2048' ELSE '0' END ||
  CASE o_orderpriority WHEN '1-URGENT' THEN ' TresPerNode=gres/gpu:a100:2,gres:gpu:v100:2' WHEN '2-HIGH' THEN ' Gres=gpu:a100:2' WHEN '3-MEDIUM' THEN ' Gres=(null)'
    WHEN '4-NOT SPECIFIED' THEN ' ReqTRES=cpu=512,mem=960G,node=2' ELSE ' ReqTRES=cpu=512,mem=960G,node=2,gres/gpu=8' END || ' Reason=None' || chr(10) END AS text FROM orders"""


@register("normalise_allocations", f"""
SELECT o_orderkey, CASE WHEN text = 'no such job' THEN 'not exactly one allocation record' ELSE '' END AS errors,
  CASE WHEN text = 'no such job' THEN '' ELSE cast(o_orderkey AS string) END AS job_id, CASE WHEN text = 'no such job' THEN '' ELSE '1000' END AS uid,
  CASE WHEN text = 'no such job' THEN '' ELSE 'kind=work CPUs/Task=9' END AS comment,
  CASE WHEN text <> 'no such job' THEN nullif(o_custkey % 3, 0) END AS num_nodes,
  CASE WHEN known THEN 1 + o_custkey % 64 END AS cpus,
  CASE WHEN known THEN CASE WHEN o_orderstatus = 'F' THEN 515396075520 ELSE 2147483648 END END AS memory_bytes,
  CASE WHEN known THEN CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 2 ELSE 0 END END AS gpus,
  CASE WHEN known THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'GPU' WHEN '2-HIGH' THEN 'a100' END END AS gpu_name,
  CASE WHEN known THEN 'requested' ELSE 'unknown' END AS evidence
FROM (SELECT *, text <> 'no such job' AND o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS known FROM details JOIN orders USING (o_orderkey))""".replace(
    "o_custkey % 3, 0) END", "o_custkey % 3, 0) END").replace("THEN 4 WHEN '2-HIGH' THEN 2 ELSE 0 END", "THEN cast(4 AS bigint) WHEN '2-HIGH' THEN 2 ELSE 0 END"))
def normalise_allocations(spark, folder):
    rows = compute.normalise_allocations(table(spark, folder, "details"))
    return rows.select(
        "o_orderkey", F.array_join("errors", ";").alias("errors"), "job_id", "uid", "comment", F.col("num_nodes").cast("long").alias("num_nodes"),
        F.col("cpus").cast("long").alias("cpus"), F.col("memory_bytes").cast("long").alias("memory_bytes"), "gpus", "gpu_name", "evidence",
    )


# --- names and readiness -------------------------------------------------------

#: Orders as allocations named after the part of a day; a name may be taken more than once.
DERIVED["snapshots"] = """
SELECT 'id' || cast(o_orderkey AS string) AS id, 'c' || cast(o_custkey AS string) AS name,
  CASE WHEN o_orderstatus = 'F' THEN 'ended' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'active' ELSE 'ended' END AS phase,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 400000 THEN NULL ELSE 1 + o_custkey % 4 END AS num_nodes FROM orders"""
DERIVED["asked_names"] = "SELECT 'c' || cast(c_custkey AS string) AS name FROM customer"


@register("resolve_name", """
SELECT name, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN n = 1 THEN id END AS id, n
FROM (SELECT a.name, count(DISTINCT s.id) AS n, min(s.id) AS id FROM asked_names a LEFT JOIN snapshots s ON s.name = a.name AND s.phase <> 'ended' GROUP BY a.name)""")
def resolve_name(spark, folder):
    return compute.resolve_name(table(spark, folder, "snapshots"), table(spark, folder, "asked_names"))


@register("ambiguous_ids", """
SELECT name, id FROM snapshots WHERE phase <> 'ended' AND name IN (SELECT name FROM snapshots WHERE phase <> 'ended' GROUP BY name HAVING count(DISTINCT id) > 1)
  AND name IN (SELECT name FROM asked_names)""")
def ambiguous_ids(spark, folder):
    return compute.ambiguous_ids(table(spark, folder, "snapshots"), table(spark, folder, "asked_names"))


#: Line items are workers that reported to the allocation of their order.
DERIVED["reported"] = "SELECT 'id' || cast(l_orderkey AS string) AS id, l_linenumber FROM lineitem"


@register("ready", """
SELECT s.id, coalesce(w.n, 0) AS workers, coalesce(coalesce(w.n, 0) >= s.num_nodes, false) AND s.phase = 'active' AS ready
FROM snapshots s LEFT JOIN (SELECT id, count(*) AS n FROM reported GROUP BY id) w USING (id)""")
def ready(spark, folder):
    return compute.ready(table(spark, folder, "snapshots"), table(spark, folder, "reported"))


# --- requests, offers, workers -------------------------------------------------

#: Parts as typed-in requests.
DERIVED["raw_requests"] = """
SELECT 'p' || cast(p_partkey AS string) AS request_id, CASE WHEN p_size < 3 THEN '0' ELSE cast(p_size AS string) END || CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN '+' ELSE '' END AS cpus,
  CASE WHEN p_type = 'LARGE' THEN '8192MB+' WHEN p_type = 'PROMO' THEN cast(p_size AS string) || 'GiB+' WHEN p_brand = 'Brand#6' THEN 'nan' ELSE cast(p_size AS string) END AS memory,
  CASE WHEN p_brand = 'Brand#1' THEN 'A100:2' WHEN p_brand = 'Brand#2' THEN 'gpu' WHEN p_brand = 'Brand#3' THEN '0' WHEN p_brand = 'Brand#4' THEN 'count:2' END AS gpus,
  CASE WHEN p_brand = 'Brand#5' THEN '2' END AS num_nodes, CASE WHEN p_size % 2 = 0 THEN cast(p_size AS string) || 'm' WHEN p_size = 49 THEN '1h30' END AS time,
  CASE WHEN p_brand = 'Brand#8' THEN 'fast' WHEN p_brand = 'Brand#9' THEN 'batch' END AS startup FROM part"""


@register("normalise_requests", """
SELECT request_id, CASE WHEN cpus NOT IN ('0', '0+') THEN cast(replace(cpus, '+', '') AS integer) END AS cpus, ends_with(cpus, '+') AS min_cpus,
  CASE WHEN memory LIKE '8192MB%' THEN '8589934592' WHEN memory <> 'nan' THEN cast(cast(replace(replace(memory, 'GiB', ''), '+', '') AS bigint) * 1073741824 AS string) END AS memory_bytes,
  ends_with(memory, '+') AS min_memory, CASE gpus WHEN 'A100:2' THEN 'A100' WHEN 'gpu' THEN 'gpu' END AS accel_name, CASE gpus WHEN 'A100:2' THEN 2 WHEN 'gpu' THEN 1 END AS accel_count,
  cast(coalesce(num_nodes, '1') AS integer) AS num_nodes, CASE WHEN time <> '1h30' THEN cast(replace(time, 'm', '') AS bigint) * 60 END AS seconds, startup,
  array_to_string([e FOR e IN [CASE WHEN cpus IN ('0', '0+') THEN 'cpus must be a positive integer' END, CASE WHEN memory = 'nan' THEN 'memory must be positive and whole bytes' END,
    CASE WHEN gpus = 'count:2' THEN 'accelerators must be NAME[:COUNT]' END, CASE WHEN time = '1h30' THEN 'time must be a positive duration' END,
    CASE WHEN startup = 'batch' THEN 'startup can only be fast' END] IF e IS NOT NULL], ';') AS errors FROM raw_requests""")
def normalise_requests(spark, folder):
    rows = compute.normalise_requests(table(spark, folder, "raw_requests"))
    return rows.withColumn("errors", F.array_join("errors", ";")).withColumn("memory_bytes", F.col("memory_bytes").cast("string"))


#: Suppliers are the catalogue: shapes of many sizes, some with accelerators.
DERIVED["offers"] = """
SELECT cast(s_suppkey AS integer) AS position, s_name AS name, s_nationkey * 2 AS cpus, cast(s_nationkey * 2 AS bigint) * 1073741824 AS memory_bytes,
  CASE WHEN s_acctbal > 7000 THEN 'a100' WHEN s_acctbal > 5000 THEN 'L4' END AS accel_name, CASE WHEN s_acctbal > 7000 THEN 2 WHEN s_acctbal > 5000 THEN 1 END AS accel_count,
  1 + s_nationkey % 3 AS max_nodes, CASE WHEN s_acctbal > 1000 THEN cast(s_nationkey AS bigint) * 120 END AS max_s, CASE WHEN s_acctbal < 3000 THEN 'fast' ELSE 'batch' END AS startup FROM supplier"""
DERIVED["typed_requests"] = """
SELECT 'o' || cast(o_orderkey AS string) AS request_id, cast(4 + o_custkey % 5 AS integer) AS cpus, o_orderstatus <> 'F' AS min_cpus, cast(4 + o_custkey % 5 AS bigint) * 1073741824 AS memory_bytes, o_orderstatus = 'P' AS min_memory,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'A100' WHEN '2-HIGH' THEN 'GPU' WHEN '3-MEDIUM' THEN 'v100' END AS accel_name, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 1 END AS accel_count,
  CASE WHEN o_totalprice > 400000 THEN 2 ELSE 1 END AS num_nodes, CASE WHEN o_totalprice < 200000 THEN cast(1800 AS bigint) END AS seconds, CASE WHEN o_totalprice > 300000 THEN 'fast' END AS startup FROM orders"""


@register("match_offer", """
SELECT r.request_id, min(o.position) AS position, arg_min(o.name, o.position) AS offer, CASE WHEN min(o.position) IS NULL THEN 'no configured offer matches this resource request' END AS reason
FROM typed_requests r LEFT JOIN offers o ON r.num_nodes <= o.max_nodes AND (r.startup IS NULL OR r.startup = o.startup) AND (r.seconds IS NULL OR o.max_s IS NULL OR r.seconds <= o.max_s)
  AND CASE WHEN r.min_cpus THEN o.cpus >= r.cpus ELSE o.cpus = r.cpus END AND CASE WHEN r.min_memory THEN o.memory_bytes >= r.memory_bytes ELSE o.memory_bytes = r.memory_bytes END
  AND CASE WHEN r.accel_name IS NULL THEN o.accel_name IS NULL ELSE o.accel_name IS NOT NULL AND o.accel_count = r.accel_count AND (lower(r.accel_name) = 'gpu' OR lower(r.accel_name) = lower(o.accel_name)) END
GROUP BY r.request_id""")
def match_offer(spark, folder):
    return compute.match_offer(table(spark, folder, "typed_requests"), table(spark, folder, "offers"))


#: Suppliers are also workers; a few advertise nothing usable.
DERIVED["workers"] = """
SELECT s_name AS worker_id, CASE WHEN s_acctbal < -500 THEN 0.5e0 ELSE cast(s_nationkey * 2 AS double) END AS cpu, cast(s_nationkey AS double) * 1e9 AS memory,
  CASE WHEN s_acctbal > 8000 THEN 4e0 WHEN s_acctbal > 6000 THEN 2e0 END AS gpu FROM supplier"""
DERIVED["placed_tasks"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity AS integer) AS cpus, CASE WHEN l_returnflag <> 'N' THEN cast(l_quantity AS bigint) * 400000000 END AS memory_bytes,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 4 WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS gpus FROM lineitem"""
_CAPS = "caps AS (SELECT DISTINCT cpu, memory, coalesce(gpu, 0) AS gpu FROM workers WHERE cpu > 0 AND cpu = floor(cpu) AND memory > 0)"


@register("shared_capacity", f"WITH {_CAPS} SELECT * FROM caps")
def shared_capacity(spark, folder):
    return compute.shared_capacity(table(spark, folder, "workers"))[0]


@register("unusable_workers", "SELECT worker_id FROM workers WHERE NOT (cpu > 0 AND cpu = floor(cpu) AND memory > 0)")
def unusable_workers(spark, folder):
    return compute.shared_capacity(table(spark, folder, "workers"))[1].select("worker_id")


@register("admit", f"""
WITH {_CAPS}, shapes AS (SELECT DISTINCT cpus, memory_bytes, gpus FROM placed_tasks),
 fits AS (SELECT s.*, min(c.gpu) AS low, max(c.gpu) AS high FROM shapes s LEFT JOIN caps c ON c.cpu >= s.cpus AND c.memory >= coalesce(s.memory_bytes, 0) AND c.gpu >= s.gpus GROUP BY ALL)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, low IS NOT NULL AND NOT (t.gpus > 0 AND low <> high) AS admitted,
  CASE WHEN t.gpus > 0 AND low = high THEN low END AS reserve_gpu,
  CASE WHEN low IS NULL THEN 'no worker can satisfy the request' WHEN t.gpus > 0 AND low <> high THEN 'matching workers differ in GPU budget' ELSE '' END AS error
FROM placed_tasks t JOIN fits f ON t.cpus = f.cpus AND t.memory_bytes IS NOT DISTINCT FROM f.memory_bytes AND t.gpus = f.gpus""")
def admit(spark, folder):
    return compute.admit(
        table(spark, folder, "placed_tasks"), table(spark, folder, "workers"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    )


@register("whole_worker", f"""
WITH {_CAPS} SELECT CASE WHEN ok THEN c1 END AS cpu, CASE WHEN ok THEN m1 END AS memory, CASE WHEN ok THEN g1 END AS gpu,
  CASE WHEN n = 0 THEN 'no workers available' WHEN c1 <> c2 OR m1 <> m2 THEN 'whole-worker probes need identical CPU and memory budgets' WHEN g1 <> g2 THEN 'matching workers differ in GPU budget' ELSE '' END AS error
FROM (SELECT *, n > 0 AND c1 = c2 AND m1 = m2 AND g1 = g2 AS ok FROM (SELECT count(*) AS n, min(cpu) AS c1, max(cpu) AS c2, min(memory) AS m1, max(memory) AS m2, min(gpu) AS g1, max(gpu) AS g2 FROM caps))""")
def whole_worker(spark, folder):
    return compute.whole_worker(table(spark, folder, "workers"))
