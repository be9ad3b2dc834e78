"""Registered queries: digests, paths, recipes and quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurispark.functions import hashing, paths, quantities, recipes, records
from plurispark.operators import containment, digests
from plurispark.plans.analysis import decisions_map
from plurispark.plans.registry import DERIVED, query, register, table


def framed(label: str, expr: str) -> str:
    """The oracle's spelling of one framed field."""
    return f"'{label}' || chr(0) || cast(strlen({expr}) AS string) || chr(0) || {expr}"


# --- digests -------------------------------------------------------------------

@register("framed_sha256", f"""
SELECT p_partkey, sha256({framed('name', 'p_name')} || {framed('brand', 'p_brand')}) AS digest FROM part""")
def framed_sha256(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        hashing.framed_sha256(("name", F.col("p_name")), ("brand", F.col("p_brand"))).alias("digest"),
    )


_ESCAPED = r"""array_to_string(list_transform(regexp_extract_all({0}, '(?s).'), lambda c:
  CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r'
       WHEN c = chr(9) THEN '\t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
       WHEN unicode(c) > 65535 THEN printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024)
       ELSE printf('\u%04x', unicode(c)) END), '')"""


@register("canonical_json", f"""
SELECT doc_id, sha256('{{"lang":"' || lang || '","source":"' || source || '","text":"' || {_ESCAPED.format('text')} || '"}}') AS digest
FROM documents""")
def canonical_json(spark, folder):
    docs = table(spark, folder, "documents")
    shuffled = F.create_map(F.lit("text"), "text", F.lit("lang"), "lang", F.lit("source"), "source")
    return docs.select("doc_id", F.sha2(hashing.canonical_json(shuffled), 256).alias("digest"))


@register("definition_version", f"""
SELECT p_partkey, 'sha256:' || sha256({framed('recipe', 'p_name')} ||
  {framed('decisions', "('{{\"brand\":\"' || p_brand || '\",\"type\":\"' || p_type || '\"}}')").replace('{{', '{').replace('}}', '}')} ||
  {framed('format', 'p_type')}) AS definition_version FROM part""")
def definition_version(spark, folder):
    decisions = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand")
    return table(spark, folder, "part").select(
        "p_partkey",
        hashing.definition_version(F.col("p_name"), decisions, F.col("p_type")).alias("definition_version"),
    )


#: A part stands for one project's environment: lock, interpreter pin, two settings, maybe an image.
DERIVED["environments"] = """
SELECT p_partkey AS project, 'version = 1' || chr(10) || '# ' || p_name AS lock_text, '3.' || cast(p_size AS string) AS pin,
       '["' || p_brand || '"]' AS default_groups,
       CASE WHEN p_type = 'PROMO' THEN 'true' END AS no_build,
       CASE WHEN p_size > 25 THEN '{"base":"' || p_type || '"}' END AS image
FROM part"""
_SETTINGS = """('{"config-settings":null,"default-groups":' || default_groups ||
  ',"no-binary":null,"no-binary-package":null,"no-build":' || coalesce(no_build, 'null') ||
  ',"no-build-isolation":null,"no-build-isolation-package":null,"no-build-package":null}')"""


@register("env_version", f"""
SELECT project, 'sha256:' || sha256({framed('uv.lock', 'lock_text')} || {framed('python-version', 'pin')} ||
  {framed('install-settings', _SETTINGS)} || {framed('image', "coalesce(image, 'null')")}) AS env_version
FROM environments""")
def env_version(spark, folder):
    settings = F.create_map(F.lit("default-groups"), "default_groups", F.lit("no-build"), "no_build")
    return table(spark, folder, "environments").select(
        "project",
        hashing.env_version(hashing.utf8(F.col("lock_text")), F.col("pin"), settings, F.col("image")).alias("env_version"),
    )


@register("file_digest", "SELECT page_id, 'sha256:' || sha256(html) AS data_version FROM pages")
def file_digest(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", hashing.file_digest(F.col("html")).alias("data_version")
    )


#: A conversation is a folder and each of its turns a file.
DERIVED["turn_files"] = """
SELECT 'conv/' || cast(conv_id AS string) AS dir, role || '/' || cast(turn AS string) || '.txt' AS path, text AS content
FROM conversations"""


@register("tree_digest", """
SELECT dir, 'sha256:' || sha256('dir:' || string_agg('path:' || path || chr(0) || 'data:' || content || chr(0), '' ORDER BY path)) AS data_version
FROM turn_files GROUP BY dir""")
def tree_digest(spark, folder):
    return digests.tree_digest(table(spark, folder, "turn_files"))


#: Line items read the page their part number falls on: many tasks share each file.
DERIVED["page_files"] = "SELECT 'data/' || cast(page_id AS string) || '.html' AS path, html AS content FROM pages"
DERIVED["page_inputs"] = """
SELECT l_orderkey, l_partkey, 'data/' || cast(l_suppkey AS string) || '.html' AS path
FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey"""


@register("distinct_inputs_digest", """
SELECT i.l_orderkey, i.l_partkey, i.path, 'sha256:' || sha256(f.content) AS current_version
FROM page_inputs i LEFT JOIN page_files f USING (path)""")
def distinct_inputs_digest(spark, folder):
    return digests.distinct_input_digests(
        table(spark, folder, "page_inputs"), table(spark, folder, "page_files")
    )


_UUID = """regexp_replace(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) ||
  CASE WHEN substr({h}, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr({h}, 17, 1) IN ('1','5','9','d') THEN '9'
       WHEN substr({h}, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr({h}, 18, 15),
  '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')"""


@register("stable_uuid", f"""
WITH ns AS (SELECT o_orderkey, o_custkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('project-' || cast(o_custkey AS string))) AS h FROM orders),
 spaces AS (SELECT *, {_UUID.format(h='h')} AS space FROM ns),
 names AS (SELECT *, sha1(from_hex(replace(space, '-', '')) || encode('action/o' || cast(o_orderkey AS string))) AS g FROM spaces)
SELECT o_orderkey, 'urn:uuid:' || {_UUID.format(h='g')} AS id FROM names""")
def stable_uuid(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        hashing.stable_uuid(
            F.concat(F.lit("project-"), F.col("o_custkey").cast("string")),
            F.concat(F.lit("action/o"), F.col("o_orderkey").cast("string")),
        ).alias("id"),
    )


#: Documents as files of a clone: one source was never fetched and holds references only.
DERIVED["doc_files"] = """
SELECT doc_id, source || '/' || cast(doc_id AS string) || '.txt' AS path,
       CASE WHEN source = 'src7' THEN '/annex/objects/SHA256E-s' || cast(n_chars AS string) || '--' || cast(doc_id AS string)
            WHEN source = 'src3' THEN 'see /annex/objects/' || text ELSE text END AS content
FROM documents"""


@register("is_pointer", """
SELECT doc_id, strlen(content) <= 32768 AND starts_with(content, '/annex/objects/') AS pointer FROM doc_files""")
def is_pointer(spark, folder):
    return table(spark, folder, "doc_files").select(
        "doc_id", records.is_pointer(F.col("content"), F.octet_length("content")).alias("pointer")
    )


# --- stored keys ---------------------------------------------------------------

#: Storage lines as the storage tool prints them: some paths hold a tab, some keys no digest.
DERIVED["storage_lines"] = """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'a' || chr(9) || url WHEN page_id % 7 = 3 THEN '' ELSE url END || chr(9) ||
  CASE WHEN url LIKE '%.net/%' THEN 'MD5E-s' || cast(length(html) AS string) || '--x.html'
       WHEN url LIKE '%.org/%' THEN 'SHA256E-s' || cast(length(html) AS string) || '--0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef.html'
       WHEN page_id % 11 = 0 THEN ''
       ELSE 'SHA256-s' || cast(length(html) AS string) || '--fedcba9876543210fedcba9876543210fedcba9876543210fedcba9876543210' END AS line
FROM pages"""


@register("parse_storage_keys", r"""
SELECT page_id, regexp_extract(line, '(?s)^(.+)\t([^\t]+)$', 1) AS path, regexp_extract(line, '(?s)^(.+)\t([^\t]+)$', 2) AS key
FROM storage_lines WHERE regexp_matches(line, '(?s)^(.+)\t([^\t]+)$')""")
def parse_storage_keys(spark, folder):
    from plurispark.sources.changelog import parse_storage_keys as parse

    return parse(table(spark, folder, "storage_lines"), "line")


@register("key_integrity", r"""
SELECT page_id, nullif(regexp_extract(k, '^\w+-s([0-9]+)', 1), '') AS size,
       nullif(regexp_extract(k, '(?s)^SHA256E?-s[0-9]+--([0-9a-f]{64})(\..*)?$', 1), '') AS sha256
FROM (SELECT page_id, split_part(line, chr(9), -1) AS k FROM storage_lines)""")
def key_integrity(spark, folder):
    found = records.key_integrity(F.substring_index("line", "\t", -1))
    return table(spark, folder, "storage_lines").select("page_id", found.alias("k")).select("page_id", "k.size", "k.sha256")


# --- paths ---------------------------------------------------------------------

#: Page addresses as file paths, half of them inside the project.
DERIVED["page_paths"] = """
SELECT page_id, CASE WHEN url LIKE 'https://%' THEN '/proj/' ELSE '/data/' END ||
       CASE WHEN p LIKE '%/' THEN substr(p, 1, length(p) - 1) ELSE p END ||
       CASE WHEN page_id % 6 = 0 THEN '.tar.gz' WHEN page_id % 6 = 1 THEN '.csv' WHEN page_id % 6 = 2 THEN '/.python-version'
            WHEN page_id % 6 = 3 THEN '.h5' WHEN page_id % 6 = 4 THEN '/README.md' ELSE '' END AS path
FROM (SELECT page_id, url, split_part(split_part(replace(replace(url, 'https://', ''), 'http://', ''), '?', 1), '#', 1) AS p FROM pages) q"""
DERIVED["page_roots"] = """
SELECT DISTINCT '/proj/' || split_part(replace(url, 'https://', ''), '/', 1) AS root
FROM pages WHERE url LIKE 'https://%.example.org/%' OR url LIKE 'https://%.example.com/en/%'"""


@register("media_type", """
SELECT page_id, CASE WHEN path LIKE '%.csv' THEN 'text/csv' WHEN path LIKE '%/.python-version' THEN 'text/plain'
  WHEN path LIKE '%.h5' THEN 'application/x-hdf5' WHEN path LIKE '%.md' THEN 'text/markdown' ELSE '' END AS media_type
FROM page_paths""")
def media_type(spark, folder):
    return table(spark, folder, "page_paths").select("page_id", paths.media_type(F.col("path")).alias("media_type"))


@register("sidecar_path", r"""
SELECT page_id, regexp_extract(path, '^(.*/)[^/]*$', 1) || '.' || split_part(split_part(path, '/', -1), '.', 1) || '.manifest.json' AS sidecar
FROM page_paths""")
def sidecar_path(spark, folder):
    return table(spark, folder, "page_paths").select("page_id", paths.sidecar_path(F.col("path")).alias("sidecar"))


@register("declared_path", """
SELECT page_id, CASE WHEN starts_with(path, '/proj/') THEN substr(path, 7) ELSE path END AS declared FROM page_paths""")
def declared_path(spark, folder):
    return table(spark, folder, "page_paths").select(
        "page_id", paths.declared_path(F.lit("/proj"), F.col("path")).alias("declared")
    )


@register("ancestors", """
SELECT page_id, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS ancestor
FROM (SELECT page_id, path, unnest(range(2, len(string_split(path, '/')) + 1)) AS i FROM page_paths)""")
def ancestors(spark, folder):
    return containment.exploded_ancestors(table(spark, folder, "page_paths")).select("page_id", "ancestor")


@register("under_any_root", """
SELECT DISTINCT path FROM page_paths p
WHERE EXISTS (SELECT 1 FROM page_roots r WHERE p.path = r.root OR starts_with(p.path, r.root || '/'))""")
def under_any_root(spark, folder):
    return containment.under_any_root(table(spark, folder, "page_paths"), table(spark, folder, "page_roots"))


#: Orders as outputs, some with ids or formats no path can be composed from.
DERIVED["artefacts"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN '..' ELSE 'c' || cast(o_custkey AS string) END AS universe,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'o.' || cast(o_orderkey AS string)
            WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'o/' || cast(o_orderkey AS string)
            ELSE 'o' || cast(o_orderkey AS string) END AS output,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN '.csv' WHEN o_orderpriority = '1-URGENT' THEN 'tar.gz' ELSE 'csv' END AS fmt
FROM orders"""


@register("artifact_path", """
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN '/proj/results/' || universe || '/' || output || '.' || fmt END AS path
FROM (SELECT *, CASE WHEN universe IN ('', '.', '..') OR contains(universe, '/') OR contains(universe, '\\') THEN 'universe'
                     WHEN output IN ('', '.', '..') OR contains(output, '/') OR contains(output, '\\') THEN 'output'
                     WHEN contains(output, '.') THEN 'dot'
                     WHEN fmt = '' OR contains(fmt, '/') OR contains(fmt, '\\') OR starts_with(fmt, '.') THEN 'format' END AS error
      FROM artefacts)""".replace("\\\\", "\\"))
def artifact_path(spark, folder):
    error = paths.artifact_path_error(F.col("universe"), F.col("output"), F.col("fmt"))
    path = paths.artifact_path(F.lit("/proj"), F.col("universe"), F.col("output"), F.col("fmt"))
    return table(spark, folder, "artefacts").select(
        "o_orderkey", error.alias("error"), F.when(error.isNull(), path).alias("path")
    )


# --- recipes -------------------------------------------------------------------

#: Parts as outputs with recipe templates; one type refers to what it does not declare.
DERIVED["templates"] = """
SELECT p_partkey, p_name, p_brand, p_type,
       CASE WHEN p_type = 'ECONOMY' THEN 'fit {inputs.catalog} --brand {decisions.brand} -o {output}'
            WHEN p_type = 'PROMO' THEN 'join {inputs} > {output} # {{literal}}'
            WHEN p_type = 'SMALL' THEN 'fit {inputs.absent} {output:>8}'
            ELSE 'cp {inputs.mask} {output}' END AS template
FROM part"""


@register("render_recipe", """
SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN NULL ELSE
  replace(replace(replace(replace(replace(replace(replace(template, '{{', chr(1)), '}}', chr(2)),
    '{inputs.catalog}', 'data/' || p_name), '{inputs.mask}', 'data/mask'), '{inputs}', 'data/' || p_name || ' data/mask'),
    '{decisions.brand}', p_brand), '{output}', 'results/base/p' || cast(p_partkey AS string) || '.csv') END AS raw,
  CASE WHEN p_type = 'SMALL' THEN '{inputs.absent} {output:>8}' ELSE '' END AS errors
FROM templates""".replace("END AS raw", "END AS recipe").replace(
    "replace(replace(replace(replace(replace(replace(replace(template", "replace(replace(replace(replace(replace(replace(replace(replace(replace(template", 1
).replace("'.csv') END", "'.csv'), chr(1), '{'), chr(2), '}') END"))
def render_recipe(spark, folder):
    entry = lambda name, path: F.struct(F.lit(name).alias("name"), path.alias("path"))
    inputs = F.array(entry("catalog", F.concat(F.lit("data/"), F.col("p_name"))), entry("mask", F.lit("data/mask")))
    output = F.concat(F.lit("results/base/p"), F.col("p_partkey").cast("string"), F.lit(".csv"))
    decisions = F.create_map(F.lit("brand"), F.col("p_brand"))
    return table(spark, folder, "templates").select(
        "p_partkey", recipes.render_recipe(F.col("template"), inputs, decisions, output).alias("r")
    ).select("p_partkey", "r.recipe", F.array_join("r.errors", " ").alias("errors"))


@register("pep503", """
SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '_.-') || '__' || p_brand, '[-_.]+', '-', 'g')) AS name FROM part""")
def pep503(spark, folder):
    raw = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_.-")), F.lit("__"), F.col("p_brand"))
    return table(spark, folder, "part").select("p_partkey", records.pep503(raw).alias("name"))


# --- quantities ----------------------------------------------------------------

#: Line items as quantity texts: hundredths and whole numbers in many units.
DERIVED["amounts"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       cast(cast(l_quantity AS bigint) AS string) || CASE WHEN l_returnflag = 'R' THEN '.5' WHEN l_linestatus = 'O' THEN '.25' ELSE '' END AS amount,
       CASE WHEN l_returnflag = 'A' THEN 'Mi' WHEN l_returnflag = 'N' THEN ' GB' WHEN l_linestatus = 'F' THEN 'kB' ELSE 'B' END AS unit,
       CASE WHEN l_linestatus = 'O' THEN cast(l_linenumber AS string) || 'h' ELSE '' END || cast(cast(l_quantity AS bigint) AS string) ||
         CASE WHEN l_returnflag = 'R' THEN '' ELSE 'm' END AS duration
FROM lineitem"""
_COUNTED = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_SCALED = "cast(amount AS decimal(38,2)) * {0}"


@register("recipe_memory_bytes", f"""
SELECT {_COUNTED}, amount || unit AS text,
  CASE WHEN b = floor(b) AND b > 0 THEN cast(cast(b AS decimal(38,0)) AS string) END AS bytes
FROM (SELECT *, {_SCALED.format("CASE unit WHEN 'Mi' THEN 1048576 WHEN ' GB' THEN 1000000000 WHEN 'kB' THEN 1000 ELSE 1 END")} AS b FROM amounts)""")
def recipe_memory_bytes(spark, folder):
    text = F.concat("amount", "unit")
    return table(spark, folder, "amounts").select(
        *_COUNTED.split(", "), text.alias("text"), quantities.recipe_memory_bytes(text).cast("string").alias("bytes")
    )


@register("offer_memory_bytes", f"""
SELECT {_COUNTED}, CASE WHEN b = floor(b) AND b > 0 THEN cast(cast(b AS decimal(38,0)) AS string) END AS bytes
FROM (SELECT *, {_SCALED.format("CASE unit WHEN ' GB' THEN 1073741824 WHEN 'kB' THEN 1024 WHEN 'B' THEN 1 END")} AS b FROM amounts)""")
def offer_memory_bytes(spark, folder):
    text = F.concat("amount", F.trim("unit"))
    return table(spark, folder, "amounts").select(
        *_COUNTED.split(", "), quantities.offer_memory_bytes(text).cast("string").alias("bytes")
    )


@register("whole_bytes", f"""
SELECT {_COUNTED}, CASE WHEN b = floor(b) THEN cast(cast(b AS decimal(38,0)) AS string) END AS bytes
FROM (SELECT *, cast(amount AS decimal(38,2)) * 1208925819614629174706176 AS b FROM amounts)""")
def whole_bytes(spark, folder):
    unit = F.lit(str(2**80)).cast("decimal(38,0)")
    return table(spark, folder, "amounts").select(
        *_COUNTED.split(", "), quantities.whole_bytes(F.col("amount"), unit).cast("string").alias("bytes")
    )


@register("duration_seconds", rf"""
SELECT {_COUNTED}, duration, CASE WHEN ends_with(duration, 'm') THEN
  coalesce(cast(nullif(regexp_extract(duration, '([0-9]+)h', 1), '') AS bigint), 0) * 3600 +
  cast(regexp_extract(duration, '([0-9]+)m', 1) AS bigint) * 60 END AS seconds FROM amounts""")
def duration_seconds(spark, folder):
    return table(spark, folder, "amounts").select(
        *_COUNTED.split(", "), "duration", quantities.duration_seconds(F.col("duration")).alias("seconds")
    )


@register("gib", """
SELECT o_orderkey, rtrim(rtrim(cast(whole AS string) || '.' || lpad(cast(rest * 931322574615478515625 AS string), 30, '0'), '0'), '.') AS gib
FROM (SELECT o_orderkey, b // 1073741824 AS whole, cast(b % 1073741824 AS decimal(38,0)) AS rest
      FROM (SELECT o_orderkey, (o_orderkey + 1) * 123456789 AS b FROM orders))""")
def gib(spark, folder):
    amount = (F.col("o_orderkey") + 1) * 123456789
    return table(spark, folder, "orders").select("o_orderkey", quantities.gib(amount).alias("gib"))


#: Parts as recipe resource declarations, good and bad.
DERIVED["declarations"] = """
SELECT p_partkey, CASE WHEN p_size < 5 THEN '0.5' WHEN p_size > 45 THEN '4.0' ELSE cast(p_size AS string) END AS cpus,
       CASE WHEN p_type = 'LARGE' THEN '16' WHEN p_type = 'SMALL' THEN '1.5GiB' WHEN p_type = 'PROMO' THEN '8GB' ELSE cast(p_size AS string) || 'Gi' END AS memory,
       CASE WHEN p_brand = 'Brand#7' THEN '-1' WHEN p_brand = 'Brand#8' THEN '2' ELSE '0' END AS gpus,
       CASE WHEN p_brand = 'Brand#9' THEN '1h' END AS time_limit, CASE WHEN p_brand = 'Brand#10' THEN '10Gi' END AS disk
FROM part"""


@register("task_request", """
SELECT p_partkey,
  CASE cpus WHEN '0.5' THEN NULL WHEN '4.0' THEN 4 ELSE try_cast(cpus AS integer) END AS cpus,
  CASE gpus WHEN '-1' THEN NULL ELSE cast(gpus AS integer) END AS gpus,
  CASE memory WHEN '16' THEN NULL WHEN '1.5GiB' THEN '1610612736' WHEN '8GB' THEN '8000000000'
       ELSE cast(cast(replace(memory, 'Gi', '') AS bigint) * 1073741824 AS string) END AS memory_bytes,
  array_to_string([e FOR e IN [
    CASE WHEN time_limit IS NOT NULL THEN 'time_limit is not supported' END,
    CASE WHEN disk IS NOT NULL THEN 'unsupported: disk' END,
    CASE WHEN cpus = '0.5' THEN 'cpus must be a positive whole number' END,
    CASE WHEN gpus = '-1' THEN 'gpus must be a whole number' END,
    CASE WHEN memory = '16' THEN 'memory must be whole bytes with a unit' END] IF e IS NOT NULL], '; ') AS errors
FROM declarations""")
def task_request(spark, folder):
    given = F.map_filter(decisions_map(("cpus", "memory", "gpus", "time_limit", "disk")), lambda k, v: v.isNotNull())
    return table(spark, folder, "declarations").select(
        "p_partkey", quantities.task_request(given).alias("r")
    ).select("p_partkey", "r.cpus", "r.gpus", F.col("r.memory_bytes").cast("string").alias("memory_bytes"),
             F.array_join("r.errors", "; ").alias("errors"))


@register("accelerator_matches", """
SELECT p_partkey, wanted, offered, CASE WHEN good THEN n END AS count, coalesce(good AND n = m AND (w IN ('gpu', lower(p_type))), false) AS fits
FROM (SELECT p_partkey, p_type, wanted, offered, split_part(lower(wanted), ':', 1) AS w, n, m,
             NOT starts_with(wanted, 'name') AND n > 0 AS good
      FROM (SELECT p_partkey, p_type, p_size,
                   CASE WHEN p_brand = 'Brand#1' THEN 'GPU:' || cast(p_size AS string) WHEN p_brand = 'Brand#2' THEN 'name:2'
                        WHEN p_brand = 'Brand#3' THEN p_type ELSE p_type || ':' || cast(p_size % 5 AS string) END AS wanted,
                   lower(p_type) || ':' || cast(p_size AS string) AS offered,
                   CASE WHEN p_brand = 'Brand#1' THEN p_size WHEN p_brand = 'Brand#2' THEN 2 WHEN p_brand = 'Brand#3' THEN 1 ELSE p_size % 5 END AS n,
                   p_size AS m FROM part))""")
def accelerator_matches(spark, folder):
    size = F.col("p_size").cast("string")
    wanted = (
        F.when(F.col("p_brand") == "Brand#1", F.concat(F.lit("GPU:"), size))
        .when(F.col("p_brand") == "Brand#2", F.lit("name:2"))
        .when(F.col("p_brand") == "Brand#3", F.col("p_type"))
        .otherwise(F.concat("p_type", F.lit(":"), (F.col("p_size") % 5).cast("string")))
    )
    offered = F.concat(F.lower("p_type"), F.lit(":"), size)
    a, b = quantities.accelerator(wanted), quantities.accelerator(offered)
    return table(spark, folder, "part").select(
        "p_partkey", wanted.alias("wanted"), offered.alias("offered"), a["count"].alias("count"),
        quantities.accelerator_matches(a, b).alias("fits"),
    )
