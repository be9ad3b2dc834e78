"""Expressions over the records that tools leave behind: keys, states, subjects, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plurispark.functions.quantities import GIB


def pep503(c: Column) -> Column:
    """A distribution name in its normalised spelling."""
    return F.lower(F.regexp_replace(c, "[-_.]+", "-"))


# --- stored files -------------------------------------------------------------

#: How an unfetched file announces itself, and the size it cannot exceed.
POINTER_PREFIX = "/annex/objects/"
POINTER_MAX_BYTES = 32 * 1024


def is_pointer(content: Column, length: Column) -> Column:
    """Whether bytes are a reference to content held elsewhere rather than content."""
    head = F.substring(content.cast("binary"), 1, len(POINTER_PREFIX))
    return (length <= POINTER_MAX_BYTES) & (head == F.unhex(F.lit(POINTER_PREFIX.encode().hex())))


def key_integrity(key: Column) -> Column:
    """``struct<size,sha256>`` as a storage key states them; texts, NULL when unstated.

    Only SHA-256 backends state a digest; any other backend states a size alone.
    """
    full = r"(?s)^SHA256E?-s([0-9]+)--([0-9a-f]{64})(?:\..*)?\z"
    digest = F.nullif(F.regexp_extract(key, full, 2), F.lit(""))
    size = F.nullif(F.regexp_extract(key, r"^\w+-s([0-9]+)", 1), F.lit(""))
    return F.struct(size.alias("size"), digest.alias("sha256"))


# --- run records ---------------------------------------------------------------

#: The third-party run-record format.
RUN_MARKER = "[DATALAD RUNCMD]"
RUN_BLOCK = r"(?s)=== Do not change lines below ===\n(.*?)\n\^\^\^ Do not change lines above \^\^\^"


def run_subject(universe: Column, output: Column) -> Column:
    """The subject line of one output's own run record."""
    return F.concat(F.lit(f"{RUN_MARKER} "), output, F.lit(" ["), universe, F.lit("]"))


def remake(status: Column, refresh: bool | Column) -> Column:
    """Stale always, behind only when a refresh is asked for."""
    asked = refresh if isinstance(refresh, Column) else F.lit(refresh)
    return (status == "stale") | (asked & (status == "behind"))


def usable(status: Column) -> Column:
    """Whether dependents may build on a task that ended in this status."""
    return status.isin("ok", "current", "behind")


# --- scheduler states ----------------------------------------------------------

#: Native job states by phase.
PHASES = {
    "ended": (
        "BOOT_FAIL", "CANCELLED", "COMPLETED", "DEADLINE", "FAILED", "NODE_FAIL",
        "OUT_OF_MEMORY", "PREEMPTED", "REVOKED", "SPECIAL_EXIT", "TIMEOUT",
    ),
    "pending": (
        "PENDING", "CONFIGURING", "REQUEUED", "REQUEUE_FED", "REQUEUE_HOLD", "RESIZING", "SUSPENDED",
    ),
    "active": ("RUNNING",),
    "stopping": ("COMPLETING",),
}


def job_phase(state: Column) -> Column:
    """The phase of a native state: its first word without trailing ``+``; else unknown."""
    word = F.rtrim(F.regexp_extract(state, r"^\s*(\S+)", 1), F.lit("+"))
    phase = F.lit("unknown")
    for name, states in PHASES.items():
        phase = F.when(word.isin(*states), F.lit(name)).otherwise(phase)
    return phase


def let(value: Column, body) -> Column:
    """*body* of *value*, which is evaluated once however often *body* uses it."""
    return F.transform(F.array(value), body)[0]


def per_node_gpus(fields: Column) -> Column:
    """``struct<name,count>`` of GPUs on each node, NULL when the record cannot say.

    Unknown, absent and zero are three answers: a malformed entry, or untyped
    and typed counts side by side, is unknown; only a record that lists its
    resources without a GPU proves zero. Aggregate totals are never divided.
    """
    pattern = r"^gpu(?::([A-Za-z0-9][A-Za-z0-9_.-]*))?[:=]([0-9]+)\z"

    def read(gpus: Column) -> Column:
        names = F.array_distinct(F.transform(
            gpus, lambda e: F.coalesce(F.nullif(F.regexp_extract(e, pattern, 1), F.lit("")), F.lit("GPU"))
        ))
        total = F.aggregate(
            gpus, F.lit(0).cast("long"), lambda acc, e: acc + F.regexp_extract(e, pattern, 2).try_cast("long")
        )

        def judge(found: Column) -> Column:
            mixed = F.array_contains(found, "GPU") & (F.size(found) > 1)
            name = F.when(F.size(found) == 1, found[0]).otherwise(F.lit("GPU"))
            return F.when(~mixed, F.struct(name.alias("name"), total.alias("count")))

        return F.when(F.forall(gpus, lambda e: e.rlike(pattern)), let(names, judge))

    def gpu_entries(entries: Column) -> Column:
        return F.filter(entries, lambda e: F.startswith(e, F.lit("gpu")))

    def get(key: str) -> Column:
        return F.coalesce(F.try_element_at(fields, F.lit(key)), F.lit(""))

    none = F.struct(F.lit("GPU").alias("name"), F.lit(0).cast("long").alias("count"))
    per_node = F.transform(
        F.split(get("TresPerNode"), ","),
        lambda e: F.regexp_replace(F.regexp_replace(e, "^gres/", ""), "^gres:", ""),
    )
    stated = F.coalesce(*[
        F.when(~get(k).isin("", "(null)", "N/A"), get(k)) for k in ("ReqTRES", "AllocTRES", "TRES")
    ])

    def complete(totals: Column) -> Column:
        return (
            F.forall(totals, lambda e: F.contains(e, F.lit("=")))
            & F.exists(totals, lambda e: F.startswith(e, F.lit("cpu=")))
            & ~F.exists(totals, lambda e: F.startswith(e, F.lit("gres/gpu")))
        )

    def without_gpus() -> Column:
        listed = F.coalesce(let(F.split(stated, ","), complete), F.lit(False))
        return F.when(get("Gres").isin("(null)", "N/A", "none") | listed, none)

    def with_gres(gres: Column) -> Column:
        return F.when(F.size(gres) > 0, read(gres)).otherwise(without_gpus())

    def with_node(node: Column) -> Column:
        return F.when(F.size(node) > 0, read(node)).otherwise(
            let(gpu_entries(F.split(get("Gres"), ",")), with_gres)
        )

    return let(gpu_entries(per_node), with_node)


def node_memory_bytes(c: Column) -> Column:
    """A scheduler's per-node memory: bare numbers are MiB, units are binary; NULL unless positive."""
    pattern = r"^([0-9]+)([KMGT]?)\z"
    amount = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("decimal(38,0)")
    unit = F.regexp_extract(c, pattern, 2)
    scale = (
        F.when(unit == "K", F.lit(1024)).when(unit == "G", F.lit(GIB)).when(unit == "T", F.lit(1024**4))
        .otherwise(F.lit(1024**2))
    )
    return F.when(amount > 0, F.try_multiply(amount, scale.cast("decimal(38,0)")).cast("decimal(38,0)"))


# --- citations -----------------------------------------------------------------

#: The identifier forms an arXiv DOI may carry.
ARXIV_PREFIX = "10.48550/arxiv."
ARXIV_ID = r"^(?:[0-9]{4}\.[0-9]{4,5}|[a-z][a-z-]*(?:\.[a-z][a-z-]*)?/[0-9]{7})\z"


def normal_doi(doi: Column) -> Column:
    return F.lower(F.trim(doi))


def arxiv_id(doi: Column) -> Column:
    """The identifier inside an arXiv DOI, NULL for any other DOI."""
    key = normal_doi(doi)
    rest = F.substring(key, F.lit(len(ARXIV_PREFIX) + 1), F.length(key))
    return F.when(F.startswith(key, F.lit(ARXIV_PREFIX)) & rest.rlike(ARXIV_ID), rest)


def arxiv_pdf(doi: Column, version: Column) -> Column:
    """The PDF address of an arXiv DOI; no version reads the latest."""
    pinned = F.when(version > 0, F.concat(F.lit("v"), version.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id(doi), F.coalesce(pinned, F.lit("")))
