"""Registered queries: run logs, denials, audits and cited papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurispark.functions import records
from plurispark.operators import audit, logs, papers
from plurispark.plans.registry import DERIVED, register, table

# --- logs ----------------------------------------------------------------------

#: Documents as error streams: sentences become continuation lines, lines become warnings.
DERIVED["warning_logs"] = """
SELECT doc_id, CASE WHEN lang = 'fr' THEN '  orphan' || chr(10) ELSE '' END || 'warning: ' || replace(replace(text, '. ', chr(10) || '  then '), chr(10) || 'E', chr(10) || 'warning: E') AS log FROM documents"""


@register("fold_warnings", """
WITH lines AS (SELECT doc_id, unnest(string_split_regex(log, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS line, generate_subscripts(string_split_regex(log, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), 1) AS i FROM warning_logs),
 marked AS (SELECT *, sum(CASE WHEN starts_with(line, 'warning:') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM lines
   WHERE starts_with(line, 'warning:') OR ((starts_with(line, '  ') OR starts_with(line, chr(9))) AND trim(line) <> '')),
 folded AS (SELECT doc_id, island, string_agg(trim(CASE WHEN starts_with(line, 'warning:') THEN substr(line, 9) ELSE line END), ' ' ORDER BY i) AS text FROM marked WHERE island > 0 GROUP BY doc_id, island)
SELECT doc_id, island - 1 AS pos, text FROM folded""".replace("\\\\", "\\").replace("SELECT doc_id, island - 1", "SELECT doc_id, cast(island - 1 AS integer)"))
def fold_warnings(spark, folder):
    return table(spark, folder, "warning_logs").select("doc_id", F.posexplode(logs.fold_warnings(F.col("log"))).alias("pos", "text"))


_AFTER = "coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@register("stderr_tail", f"""
WITH a AS (SELECT source, doc_id, hex(encode(text)) AS h, strlen(text) AS n, {_AFTER} AS after FROM documents),
 k AS (SELECT source, doc_id, CASE WHEN n > 65536 - after THEN substr(h, cast((n - (65536 - after)) * 2 + 1 AS bigint)) ELSE h END AS h FROM a WHERE after < 65536)
SELECT source, sha256(string_agg(h, '' ORDER BY doc_id)) AS digest FROM k GROUP BY source""")
def stderr_tail(spark, folder):
    chunks = table(spark, folder, "documents").select("source", F.col("doc_id").alias("seq"), F.col("text").alias("data"))
    return logs.stderr_tail(chunks, keys=["source"]).select("source", F.sha2(F.hex("tail"), 256).alias("digest"))


#: Documents as logs of failed runs; each run's policy is its source.
DERIVED["run_logs"] = """
SELECT doc_id AS task, source AS policy_id, text || chr(10) || CASE
  WHEN lang = 'en' THEN 'PermissionError: [Errno 13] Permission denied: ''/data/' || source || '/' || cast(doc_id AS string) || '.csv''' || chr(10) || 'bash: line 1: /usr/bin/' || lang || ': Permission denied'
  WHEN lang = 'fr' THEN 'sh: tool' || source || ': command not found' || chr(10) || 'OSError: [Errno 18] Invalid cross-device link: "results/' || source || '/x.csv"'
  WHEN lang = 'de' THEN 'sandbox: /opt/' || source || ': denied' || chr(10) || 'FileNotFoundError: no such file ''/nope/' || source || ''''
  ELSE 'PermissionError: ''notes/' || source || '.md''' END AS text FROM documents"""
DERIVED["path_facts"] = """
SELECT DISTINCT '/data/' || source || '/' || cast(doc_id AS string) || '.csv' AS path, true AS is_file, false AS executable FROM documents WHERE n_chars > 300
UNION ALL SELECT DISTINCT '/usr/bin/' || lang, true, true FROM documents
UNION ALL SELECT DISTINCT '/proj/results/' || source || '/x.csv', true, false FROM documents
UNION ALL SELECT DISTINCT '/opt/' || source, true, false FROM documents
UNION ALL SELECT DISTINCT '/usr/local/tool' || source, true, true FROM documents WHERE source LIKE 'src1%'
UNION ALL SELECT DISTINCT '/proj/notes/' || source || '.md', true, false FROM documents"""
DERIVED["policy_roots"] = """
SELECT DISTINCT source AS policy_id, 'read' AS tier, '/proj' AS root FROM documents
UNION ALL SELECT DISTINCT source, 'read', '/data/src1' FROM documents UNION ALL SELECT DISTINCT source, 'write', '/proj/results/src2' FROM documents
UNION ALL SELECT DISTINCT source, 'write', '/data/src3' FROM documents UNION ALL SELECT DISTINCT source, 'execute', '/usr/bin/en' FROM documents WHERE source LIKE 'src1%'
UNION ALL SELECT DISTINCT source, 'execute', '/opt/' || source FROM documents WHERE source LIKE '%5'"""
DERIVED["host_tools"] = "SELECT DISTINCT 'tool' || source AS name, '/usr/local/tool' || source AS path FROM documents"
_FOUND = r"""[p FOR p IN list_concat(list_concat(
  regexp_extract_all(text, '(?:PermissionError|FileNotFoundError|OSError).*?[''"]([^''"]+)[''"]', 1), regexp_extract_all(text, 'sandbox: (\S+): ', 1)), list_concat(
  regexp_extract_all(text, '(?:bash|sh)(?::\s*line [0-9]+)?: ([^\s:]+): (?:Permission denied|Operation not permitted|command not found)', 1),
  regexp_extract_all(text, 'Invalid cross-device link.*?[''"]([^''"]+)[''"]', 1))) ]"""
_FOUND_ROWS = f"""found AS (SELECT task, policy_id, raw, min(i) AS ord FROM (SELECT task, policy_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS i
  FROM (SELECT task, policy_id, {_FOUND} AS l FROM run_logs)) GROUP BY task, policy_id, raw)"""


@register("ordered_candidates", f"WITH {_FOUND_ROWS} SELECT task, raw, row_number() OVER (PARTITION BY task ORDER BY ord) - 1 AS place FROM found")
def ordered_candidates(spark, folder):
    return table(spark, folder, "run_logs").select(
        "task", F.posexplode(logs.ordered_candidates(F.col("text"))).alias("place", "raw")
    ).withColumn("place", F.col("place").cast("long"))


@register("explain_denials", f"""
WITH {_FOUND_ROWS}, placed AS (SELECT f.*, CASE WHEN starts_with(raw, '/') THEN raw ELSE '/proj/' || raw END AS path FROM found f),
 solved AS (SELECT p.task, p.policy_id, p.ord, coalesce(a.path, b.path) AS path, coalesce(a.is_file, b.is_file) AS is_file, coalesce(a.executable, b.executable) AS executable
   FROM placed p LEFT JOIN path_facts a ON a.path = p.path LEFT JOIN host_tools t ON a.path IS NULL AND NOT starts_with(p.raw, '/') AND t.name = p.raw LEFT JOIN path_facts b ON b.path = t.path),
 tiers AS (SELECT *, {', '.join(f"EXISTS (SELECT 1 FROM policy_roots r WHERE r.policy_id = solved.policy_id AND r.tier = '{t}' AND (solved.path = r.root OR starts_with(solved.path, r.root || '/'))) AS g_{t}" for t in ('read', 'write', 'execute'))} FROM solved WHERE path IS NOT NULL),
 kinds AS (SELECT *, CASE WHEN executable AND is_file OR starts_with(path, '/opt/') OR starts_with(path, '/usr/bin/') THEN CASE WHEN NOT g_execute THEN 'tool' END
   WHEN g_write THEN NULL WHEN g_read THEN 'write' ELSE 'data' END AS kind FROM tiers)
SELECT task, arg_min(path, ord) AS path, arg_min(kind, ord) AS kind FROM kinds WHERE kind IS NOT NULL GROUP BY task""")
def explain_denials(spark, folder):
    t = {n: table(spark, folder, n) for n in ("run_logs", "path_facts", "policy_roots", "host_tools")}
    return logs.explain_denials(t["run_logs"], t["path_facts"], t["policy_roots"], "/proj", tools=t["host_tools"])


# --- audits --------------------------------------------------------------------

#: Parts are locked packages of supplier projects.
DERIVED["lock_packages"] = """
SELECT 'j' || cast(p_size AS string) AS project_id, replace(p_name, ' ', '_') || CASE WHEN p_brand = 'Brand#1' THEN '' ELSE '-' || p_brand END AS name, p_partkey,
  CASE p_type WHEN 'ECONOMY' THEN 'path' WHEN 'PROMO' THEN 'editable' WHEN 'SMALL' THEN 'virtual' WHEN 'LARGE' THEN 'directory' ELSE 'registry' END AS kind,
  p_size > 10 AS has_sdist, CASE WHEN p_retailprice > 950 THEN 0 ELSE 2 END AS n_wheels FROM part"""
DERIVED["lock_projects"] = """
SELECT 'j' || cast(s_suppkey AS string) AS project_id, CASE WHEN s_nationkey < 12 THEN 'Small.RING' ELSE 'red-widget' END AS name, s_nationkey FROM supplier"""


@register("lock_audit", """
SELECT project_id, name, finding FROM (SELECT p.project_id, p.name, CASE WHEN kind IN ('path', 'directory', 'editable') THEN
    CASE WHEN lower(regexp_replace(p.name, '[-_.]+', '-', 'g')) <> lower(regexp_replace(j.name, '[-_.]+', '-', 'g')) THEN 'refused:' || kind END
  WHEN kind = 'registry' AND has_sdist AND n_wheels = 0 THEN 'sdist_built' END AS finding FROM lock_packages p JOIN lock_projects j USING (project_id)) WHERE finding IS NOT NULL""")
def lock_audit(spark, folder):
    packages = table(spark, folder, "lock_packages").withColumn("source", F.create_map(F.col("kind"), F.lit("x")))
    return audit.lock_audit(packages, table(spark, folder, "lock_projects"))


@register("non_default_groups", """
SELECT project_id, unnest(CASE WHEN s_nationkey % 3 = 0 THEN ['docs', 'test'] WHEN s_nationkey % 3 = 1 THEN ['test'] ELSE [] END) AS "group" FROM lock_projects""")
def non_default_groups(spark, folder):
    third = F.col("s_nationkey") % 3
    projects = table(spark, folder, "lock_projects").select(
        "project_id", F.array(F.lit("dev"), F.lit("docs"), F.lit("test")).alias("groups"),
        F.when(third == 1, F.array(F.lit("dev"), F.lit("docs"))).when(third == 2, F.array(F.lit("all"))).alias("default_groups"),
    )
    return audit.non_default_groups(projects)


# --- papers --------------------------------------------------------------------

#: Line items cite papers by part; parts are also the paper cache.
DERIVED["citations"] = """
SELECT cast(l_orderkey AS string) AS analysis_id, CASE WHEN l_returnflag = 'N' THEN '10.1/Absent' || cast(l_partkey AS string) ELSE ' 10.48550/arXiv.' ||
  CASE WHEN l_partkey < 500 THEN 'hep-th/' || lpad(cast(l_partkey AS string), 7, '0') ELSE '2401.' || lpad(cast(l_partkey AS string), 5, '0') END END AS doi,
  CASE WHEN l_quantity < 50 THEN l_linenumber - 1 END AS version FROM lineitem"""
_REVISIONS = """
SELECT doi, CASE WHEN NOT latest THEN v END AS version, 'https://arxiv.org/pdf/' || substr(doi, 16) || CASE WHEN latest THEN '' ELSE 'v' || cast(v AS string) END AS pdf_url
FROM (SELECT lower(trim(doi)) AS doi, bool_or(version IS NULL OR version <= 0) AS latest, max(version) AS v FROM citations WHERE doi LIKE '%arXiv%' GROUP BY 1)"""


@register("arxiv_revision", _REVISIONS)
def arxiv_revision(spark, folder):
    return papers.arxiv_revision(table(spark, folder, "citations"))


@register("arxiv_pdf", """
SELECT DISTINCT doi, version, CASE WHEN doi LIKE '%arXiv%' THEN 'https://arxiv.org/pdf/' || substr(lower(trim(doi)), 16) || CASE WHEN version > 0 THEN 'v' || cast(version AS string) ELSE '' END END AS pdf_url FROM citations""")
def arxiv_pdf(spark, folder):
    return table(spark, folder, "citations").select("doi", "version").distinct().withColumn(
        "pdf_url", records.arxiv_pdf(F.col("doi"), F.col("version"))
    )


#: Orders are cached papers of their customer, some without a version.
DERIVED["paper_cache"] = """
SELECT o_orderkey AS pos, '10.48550/ARXIV.2401.' || lpad(cast(o_custkey AS string), 5, '0') AS doi, CASE WHEN o_totalprice > 30000 THEN o_custkey END AS version,
  'title ' || cast(o_orderkey AS string) AS title, CASE WHEN o_custkey < 1000 THEN cast(o_orderkey AS string) || '.pdf' END AS pdf_path FROM orders"""
_PREFERRED = """
SELECT lower(doi) AS doi, pos, version, title, pdf_path FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY version IS NULL DESC, CASE WHEN version IS NULL THEN -pos ELSE pos END) AS r FROM paper_cache) WHERE r = 1"""


@register("preferred_paper", _PREFERRED)
def preferred_paper(spark, folder):
    return papers.preferred_paper(table(spark, folder, "paper_cache"))


@register("cited_papers", f"""
WITH c AS (SELECT * FROM ({_PREFERRED}) WHERE doi IN (SELECT lower(trim(doi)) FROM citations)), a AS ({_REVISIONS})
SELECT coalesce(c.doi, a.doi) AS doi, c.title, CASE WHEN c.doi IS NOT NULL THEN 'A, ' || c.title END AS authors, CASE WHEN c.doi IS NOT NULL THEN c.pdf_path ELSE a.pdf_url END AS pdf_url
FROM a FULL JOIN c ON a.doi = c.doi""")
def cited_papers(spark, folder):
    cache = table(spark, folder, "paper_cache").withColumn("authors", F.array(F.lit("A"), F.col("title")))
    return papers.cited_papers(table(spark, folder, "citations"), cache)
