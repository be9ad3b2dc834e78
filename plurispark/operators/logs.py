"""Reading run logs: warnings, bounded tails, blocked paths and why they were blocked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurispark.functions.paths import parent
from plurispark.operators.containment import exploded_ancestors, root_form

#: Fixed value: every character a text's lines end at, carriage return and line feed as one.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"

#: Fixed value: the tail of a run's error stream that is kept.
TAIL_BYTES = 64 * 1024

#: How a blocked path shows in an error stream, most specific first.
PYTHON_ERROR = r"""(?:PermissionError|FileNotFoundError|OSError).*?['"]([^'"]+)['"]"""
SHELL_ERROR = (
    r"(?:bash|sh)(?::\s*line [0-9]+)?: ([^\s:]+): "
    r"(?:Permission denied|Operation not permitted|command not found)"
)
RENAME_ERROR = r"""Invalid cross-device link.*?['"]([^'"]+)['"]"""
#: Folders whose contents are taken for programs.
PROGRAM_FOLDERS = ("/bin", "/sbin", "/Library/TeX", "/opt")


def fold_warnings(log: Column) -> Column:
    """A log's warnings as an array of texts, continuation lines folded in.

    A warning starts ``warning:``; a later line indented by a tab or two spaces
    continues the latest warning, whatever lies between. The log is one text, so
    this needs no shuffle and no window.
    """
    # A mark of two characters that the texts cannot hold: their own NULs are followed by another character.
    nul, mark = "\u0000\u0001", "\u0000\u0002"
    log = F.replace(log, F.lit("\u0000"), F.lit(nul))
    start = lambda line: F.startswith(line, F.lit("warning:"))
    more = lambda line: (F.startswith(line, F.lit("  ")) | F.startswith(line, F.lit("\t"))) & (_strip(line) != "")
    lines = F.filter(F.split(log, LINE_ENDS), lambda line: start(line) | more(line))
    marked = F.transform(lines, lambda line: F.when(
        start(line), F.concat(F.lit(mark), _strip(F.substring(line, F.lit(9), F.length(line))))
    ).otherwise(F.concat(F.lit(" "), _strip(line))))
    # What precedes the first mark continues nothing.
    return F.transform(
        F.filter(F.split(F.array_join(marked, ""), mark), lambda _, i: i > 0), lambda w: F.replace(w, F.lit(nul), F.lit("\u0000")))


#: Fixed value: every character that counts as white space at the ends of a line.
BLANKS = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


#: Pieces a task's log is split into before its tail is cut.
SALTS = 64


def stderr_tail(chunks: DataFrame, limit: int = TAIL_BYTES, keys: Sequence[str] = ("task",)) -> DataFrame:
    """The last *limit* bytes per task of ``seq, data`` chunks, as binary ``tail``.

    A chunk followed by *limit* bytes within any subset of its log is followed by
    at least as many in the whole log. So each log is first cut within salted
    pieces, and only what is left (at most ``SALTS * limit`` bytes) meets in one
    place, where the chunk on the boundary is cut inside.
    """
    keys = list(keys)
    size = F.octet_length("data")

    def after(*by: str) -> Column:
        later = Window.partitionBy(*by).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(later), F.lit(0))

    rows = chunks.select(*keys, "seq", F.col("data").cast("binary").alias("data")).where(size > 0)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)))
    left = salted.withColumn("_after", after(*keys, "_salt")).where(F.col("_after") < limit).drop("_salt", "_after")
    kept = left.withColumn("_after", after(*keys)).where(F.col("_after") < limit)
    room = (F.lit(limit) - F.col("_after")).cast("int")
    piece = F.when(size > room, F.substring("data", size - room + 1, room)).otherwise(F.col("data"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.hex(piece).alias("data"))))
    return kept.groupBy(*keys).agg(ordered.alias("_c")).select(
        *keys, F.unhex(F.array_join(F.transform("_c", lambda c: c["data"]), "")).alias("tail")
    )


def tail_text(tail: Column) -> Column:
    """A tail as text, bytes that are not text replaced."""
    return F.make_valid_utf8(tail.cast("string"))


def ordered_candidates(log: Column, launcher: str = "sandbox") -> Column:
    """Path-like strings of a log, pattern by pattern, each where first seen.

    *launcher* is the name under which the sandbox reports a denied start.
    """
    patterns = (PYTHON_ERROR, rf"{launcher}: (\S+): ", SHELL_ERROR, RENAME_ERROR)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(log, F.lit(p), F.lit(1)) for p in patterns]))


def _grants(paths: DataFrame, policy_roots: DataFrame) -> DataFrame:
    """``policy_id, path, read, write, execute``: which tiers hold each path."""
    roots = policy_roots.select("policy_id", "tier", root_form(F.col("root")).alias("ancestor"))
    asked = paths.select("policy_id", "path").distinct()
    held = exploded_ancestors(asked).join(roots.where("ancestor <> '/'"), ["policy_id", "ancestor"]).select("policy_id", "path", "tier")
    everywhere = asked.where(F.startswith("path", F.lit("/"))).join(roots.where("ancestor = '/'"), "policy_id").select("policy_id", "path", "tier")
    held = held.union(everywhere)
    return held.groupBy("policy_id", "path").agg(*[
        F.bool_or(F.col("tier") == t).alias(t) for t in ("read", "write", "execute")
    ])


def explain_denials(
    logs: DataFrame, path_facts: DataFrame, policy_roots: DataFrame, cwd: str, launcher: str = "sandbox",
    tools: DataFrame | None = None,
) -> DataFrame:
    """The first confirmed denial per run of ``task, policy_id, text``: ``path, kind``.

    A candidate must exist (``path_facts``) and must not be granted. A program
    counts as a ``tool`` unless execution is granted; other paths are passed over
    when writable, are a ``write`` when only readable, else ``data``. Relative
    names are tried under *cwd*, then as tools of the host (``name, path``).
    """
    found = logs.select("task", "policy_id", F.posexplode(ordered_candidates(F.col("text"), launcher)).alias("ord", "raw"))
    absolute = F.startswith("raw", F.lit("/"))
    facts = path_facts.select("path", "is_file", "executable")
    placed = found.withColumn("path", F.when(absolute, F.col("raw")).otherwise(F.concat(F.lit(f"{cwd}/"), F.col("raw"))))
    real = placed.join(facts, "path")
    if tools is not None:
        hosts = tools.select(F.col("name").alias("raw"), F.col("path").alias("_tool"))
        bare = placed.where(~absolute).join(facts.select("path"), "path", "left_anti").drop("path").join(hosts, "raw")
        real = real.unionByName(bare.withColumnRenamed("_tool", "path").join(facts, "path"))
    rows = real.join(_grants(real, policy_roots), ["policy_id", "path"], "left")
    granted = {t: F.coalesce(t, F.lit(False)) for t in ("read", "write", "execute")}
    program = (F.col("is_file") & F.col("executable"))
    for folder in PROGRAM_FOLDERS:
        program = program | F.endswith(parent(F.col("path")), F.lit(folder))
    kind = (
        F.when(program, F.when(~granted["execute"], "tool"))
        .when(granted["write"], F.lit(None))
        .when(granted["read"], "write").otherwise("data")
    )
    denied = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    return denied.groupBy("task").agg(F.min(F.struct("ord", "path", "kind")).alias("_d")).select("task", "_d.path", "_d.kind")
