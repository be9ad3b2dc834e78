"""Scheduler accounting and resource matching over raw job records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.functions import quantities as q
from plurispark.functions.records import job_phase, let, node_memory_bytes, per_node_gpus
from plurispark.session import broadcast_if_small

#: Fixed value: the shape of an allocation's name.
NAME = r"[a-z](?:[a-z0-9-]{0,61}[a-z0-9])?"

_FIELDS = {
    "live": ("job_id", "job_name", "uid", "state", "comment"),
    "history": ("job_id", "job_name", "uid", "state", "submit_time", "comment"),
}


def _errors(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that hold, as an array."""
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in checks]), lambda e: e.isNotNull())


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` by the ``errors`` column."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


# --- raw job records -----------------------------------------------------------


def parse_job_rows(lines: DataFrame, kind: str, name_prefix: str, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """``(jobs, bad)`` of pipe-separated records; the comment keeps later separators.

    A wrong number of fields is an error. Rows with a non-numeric id are other
    kinds of record and are skipped, as are live jobs not named by us.
    """
    names = _FIELDS[kind]
    parts = F.split(F.col(column), "[|]", len(names))
    rest = [c for c in lines.columns if c != column]
    present = lines.where(F.trim(F.col(column)) != "").withColumn("_p", parts)
    bad = present.where(F.size("_p") != len(names)).select(
        *rest, F.col(column), F.array(F.lit("unrecognized allocation record")).alias("errors")
    )
    jobs = present.where(F.size("_p") == len(names)).select(
        *rest, *[F.trim(F.col("_p")[i]).alias(n) for i, n in enumerate(names)]
    ).where(F.col("job_id").rlike(r"^[0-9]+\z"))
    if kind == "live":
        jobs = jobs.where(F.col("job_name").rlike(rf"^{name_prefix}{NAME}\z"))
    return jobs, bad


def parse_job_detail(text: Column) -> Column:
    """``struct<fields map, errors>`` of one controller record.

    The comment stands on its own line and is taken whole before the other
    tokens are split, so its text cannot pose as a field; of a repeated key the
    last value counts. ``UID`` is the number inside ``UserId``.
    """
    pattern = r"(?:^|\s)([A-Za-z][A-Za-z0-9_/:]*)=(\S*)"

    def read(rows: Column) -> Column:
        headers = F.size(F.filter(rows, lambda r: F.startswith(r, F.lit("JobId="))))
        comments = F.filter(rows, lambda r: F.startswith(r, F.lit("Comment=")))
        body = F.array_join(F.filter(rows, lambda r: ~F.startswith(r, F.lit("Comment="))), " ")
        comment = F.when(
            F.size(comments) == 1, F.substring(comments[0], F.lit(9), F.length(comments[0]))
        ).otherwise(F.lit(""))

        def tokens(both: Column) -> Column:
            keys = both["keys"]
            pairs = F.zip_with(keys, both["values"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))
            return F.filter(
                pairs,
                lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
                & ~e["key"].isin("Comment", "UID"),
            )

        def fields(last: Column) -> Column:
            user = F.filter(last, lambda e: e["key"] == "UserId")
            owner = F.regexp_extract(F.get(user, F.lit(0))["value"], r"(?s)^.*\(([0-9]+)\)\z", 1)
            return F.map_from_entries(F.concat(last, F.array(
                F.struct(F.lit("Comment").alias("key"), comment.alias("value")),
                F.struct(F.lit("UID").alias("key"), F.coalesce(owner, F.lit("")).alias("value")),
            )))

        both = let(body, lambda b: F.struct(
            F.regexp_extract_all(b, F.lit(pattern), F.lit(1)).alias("keys"),
            F.regexp_extract_all(b, F.lit(pattern), F.lit(2)).alias("values"),
        ))
        return F.struct(
            let(let(both, tokens), fields).alias("fields"),
            _errors((headers != 1, "not exactly one allocation record")).alias("errors"),
        )

    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda r: F.trim(r))
    return let(F.filter(lines, lambda r: r != ""), read)


def normalise_allocations(details: DataFrame, column: str = "text") -> DataFrame:
    """Typed columns and ``errors`` for controller records.

    ``evidence`` is ``requested`` only when cpus, memory and GPUs are all known:
    an unknown part leaves the whole shape unknown.
    """
    rest = [c for c in details.columns if c != column]
    parsed = details.select(*rest, parse_job_detail(F.col(column)).alias("_d")).select(*rest, "_d.fields", "_d.errors")

    def get(key: str) -> Column:
        return F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit(""))

    def count(key: str) -> Column:
        number = F.when(get(key).rlike(r"^[0-9]+\z"), get(key)).try_cast("int")
        return F.when(number > 0, number)

    typed = parsed.select(
        *rest, "errors", get("JobId").alias("job_id"), get("JobName").alias("job_name"), get("UID").alias("uid"),
        get("Comment").alias("comment"), get("JobState").alias("state"), job_phase(get("JobState")).alias("phase"),
        count("NumNodes").alias("num_nodes"), count("CPUs/Task").alias("cpus"),
        node_memory_bytes(get("MinMemoryNode")).alias("memory_bytes"), per_node_gpus(F.col("fields")).alias("_g"),
        F.replace(get("Reason"), F.lit("None"), F.lit("")).alias("reason"),
    )
    known = F.col("cpus").isNotNull() & F.col("memory_bytes").isNotNull() & F.col("_g").isNotNull()
    return typed.select(
        *[c for c in typed.columns if c not in ("_g", "cpus", "memory_bytes")],
        *[F.when(known, F.col(c)).alias(c) for c in ("cpus", "memory_bytes")],
        F.when(known, F.col("_g.count")).alias("gpus"),
        F.when(known & (F.col("_g.count") > 0), F.col("_g.name")).alias("gpu_name"),
        F.when(known, "requested").otherwise("unknown").alias("evidence"),
    )


IDENTITY = ["job_id", "job_name", "uid", "comment"]


def verify_job_identity(jobs: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(verified, mismatched)``: a job is ours when id, name, owner and comment all agree."""
    ours = jobs.join(identities.select(*IDENTITY), IDENTITY, "left_semi")
    wrong = jobs.join(identities.select("job_id"), "job_id", "left_semi").join(identities.select(*IDENTITY), IDENTITY, "left_anti")
    return ours, wrong


def latest_attempt(history: DataFrame, identities: DataFrame) -> DataFrame:
    """Each identity's phase by its latest submission; of equal times the first listed.

    An attempt that is not terminal, or no verified attempt at all, is unknown,
    never ended: absence from the queue proves nothing.
    """
    newest = F.max_by(F.struct("state", "submit_time"), F.struct("submit_time", -F.col("seq")))
    tried = history.groupBy(*IDENTITY).agg(newest.alias("_a"))
    rows = identities.select(*IDENTITY).distinct().join(tried, IDENTITY, "left")
    phase = job_phase(F.col("_a.state"))
    ended = F.col("_a").isNotNull() & (phase == "ended")
    return rows.select(
        *IDENTITY, F.col("_a.state").alias("state"), F.col("_a.submit_time").alias("submit_time"),
        F.when(ended, "ended").otherwise("unknown").alias("phase"),
        F.when(F.col("_a").isNull(), "not verifiable in accounting").when(~ended, "accounting is not terminal").otherwise("").alias("reason"),
    )


def discover(authorities: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """``(allocations, errors)`` of all authorities, each row naming its authority.

    Each authority gives its good and its bad rows; a partial failure stays visible.
    """
    good = bad = None
    for name, (rows, errors) in authorities.items():
        rows = rows.withColumn("authority", F.lit(name))
        errors = errors.withColumn("authority", F.lit(name))
        good = rows if good is None else good.unionByName(rows, allowMissingColumns=True)
        bad = errors if bad is None else bad.unionByName(errors, allowMissingColumns=True)
    return good, bad


def resolve_name(snapshots: DataFrame, names: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``name, outcome, id, n`` for asked names: found, none, ambiguous, or incomplete discovery.

    Only allocations that have not ended count. Any authority that failed makes
    every name undecidable. The ids of ambiguous names are in
    :func:`ambiguous_ids`, one row each.
    """
    current = snapshots.where(F.col("phase") != "ended").groupBy("name").agg(
        F.countDistinct("id").alias("n"), F.min("id").alias("id")
    )
    incomplete = F.lit(errors is not None and bool(errors.head(1)))
    n = F.coalesce("n", F.lit(0))
    outcome = (
        F.when(incomplete, "incomplete").when(n == 0, "none").when(n > 1, "ambiguous").otherwise("found")
    )
    return names.select("name").distinct().join(current, "name", "left").select(
        "name", outcome.alias("outcome"), F.when(outcome == "found", F.col("id")).alias("id"), n.alias("n")
    )


def ambiguous_ids(snapshots: DataFrame, names: DataFrame) -> DataFrame:
    """The ids that share an ambiguous name."""
    current = snapshots.where(F.col("phase") != "ended").select("name", "id").distinct()
    shared = current.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return current.join(shared.join(names.select("name").distinct(), "name"), "name", "left_semi")


def ready(snapshots: DataFrame, workers: DataFrame) -> DataFrame:
    """Whether each active allocation has as many workers as nodes; unknown nodes are never ready."""
    seen = workers.groupBy("id").agg(F.count(F.lit(1)).alias("workers"))
    rows = snapshots.join(seen, "id", "left").withColumn("workers", F.coalesce("workers", F.lit(0)))
    enough = F.coalesce(F.col("workers") >= F.col("num_nodes"), F.lit(False)) & (F.col("phase") == "active")
    return rows.select("id", "workers", enough.alias("ready"))


# --- requests, offers and workers ----------------------------------------------


def normalise_requests(raw: DataFrame) -> DataFrame:
    """Typed request columns and ``errors`` from ``request_id, cpus, memory, gpus, num_nodes, time, startup`` texts.

    A trailing ``+`` asks for a minimum; no GPUs, or ``0``, asks for none.
    """

    def bare(name: str) -> Column:
        return F.regexp_replace(name, r"\+\z", "")

    def count(c: Column) -> Column:
        return F.when(c.rlike(r"^[1-9][0-9]*\z"), c).try_cast("int")

    cpus, memory = count(bare("cpus")), q.offer_memory_bytes(bare("memory"))
    nodes = count(F.coalesce("num_nodes", F.lit("1")))
    seconds = q.duration_seconds(F.col("time"))
    wants = F.col("gpus").isNotNull() & (F.col("gpus") != "0")
    accel = F.when(wants, q.accelerator(F.col("gpus")))
    errors = _errors(
        (cpus.isNull(), "cpus must be a positive integer"),
        (memory.isNull(), "memory must be positive and whole bytes"),
        (nodes.isNull(), "num_nodes must be a positive integer"),
        (wants & accel.isNull(), "accelerators must be NAME[:COUNT]"),
        (F.col("time").isNotNull() & seconds.isNull(), "time must be a positive duration"),
        (F.col("startup").isNotNull() & (F.col("startup") != "fast"), "startup can only be fast"),
    )
    return raw.select(
        "request_id", cpus.alias("cpus"), F.endswith("cpus", F.lit("+")).alias("min_cpus"), memory.alias("memory_bytes"),
        F.endswith("memory", F.lit("+")).alias("min_memory"), accel["name"].alias("accel_name"), accel["count"].alias("accel_count"),
        nodes.alias("num_nodes"), seconds.alias("seconds"), "startup", errors.alias("errors"),
    )


_SHAPE = ["cpus", "min_cpus", "memory_bytes", "min_memory", "accel_name", "accel_count", "num_nodes", "seconds", "startup"]


def match_offer(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """Each request's first fitting offer by position; ``offer`` is NULL when none fits.

    Requests are reduced to distinct shapes first. Shapes and offers meet on
    accelerator type and count (an offer also answers under the generic name),
    the other terms are conditions of that join, and only the smallest position
    per shape is kept.
    """
    keyed = requests.withColumn("_shape", F.to_json(F.struct(*_SHAPE)))
    shapes = keyed.select("_shape", *_SHAPE).distinct()
    wanted = F.when(F.col("accel_name").isNull(), F.lit("")).otherwise(
        F.concat(F.lower("accel_name"), F.lit(":"), F.col("accel_count").cast("string"))
    )
    kinds = F.when(F.col("accel_name").isNull(), F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(
        F.array(F.lower("accel_name"), F.lit("gpu")), lambda n: F.concat(n, F.lit(":"), F.col("accel_count").cast("string"))
    )))
    shelf = offers.select(
        F.explode(kinds).alias("_key"), "position", "name", F.col("cpus").alias("o_cpus"), F.col("memory_bytes").alias("o_memory"),
        "max_nodes", "max_s", F.col("startup").alias("o_startup"),
    )
    fits = (
        (F.col("num_nodes") <= F.col("max_nodes"))
        & (F.col("startup").isNull() | (F.col("startup") == F.col("o_startup")))
        & (F.col("seconds").isNull() | F.col("max_s").isNull() | (F.col("seconds") <= F.col("max_s")))
        & F.when(F.col("min_cpus"), F.col("o_cpus") >= F.col("cpus")).otherwise(F.col("o_cpus") == F.col("cpus"))
        & F.when(F.col("min_memory"), F.col("o_memory") >= F.col("memory_bytes")).otherwise(F.col("o_memory") == F.col("memory_bytes"))
    )
    best = (
        shapes.withColumn("_key", wanted).join(broadcast_if_small(shelf), "_key").where(fits)
        .groupBy("_shape").agg(F.min(F.struct("position", "name")).alias("_o"))
    )
    return keyed.join(best, "_shape", "left").select(
        "request_id", F.col("_o.position").alias("position"), F.col("_o.name").alias("offer"),
        F.when(F.col("_o").isNull(), F.lit("no configured offer matches this resource request")).alias("reason"),
    )


def shared_capacity(workers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(capacities, bad)``: the distinct budgets, and workers that do not state whole ones.

    CPU and memory must be positive, GPUs may be absent, which is none.
    """

    def whole(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")) & (c == F.floor(c)), F.lit(False))

    gpu = F.coalesce("gpu", F.lit(0.0))
    good = whole(F.col("cpu")) & (F.col("cpu") > 0) & whole(F.col("memory")) & (F.col("memory") > 0) & whole(gpu) & (gpu >= 0)
    rows = workers.withColumn("gpu", gpu)
    return rows.where(good).select("cpu", "memory", "gpu").distinct(), rows.where(~good)


def admit(tasks: DataFrame, workers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether each task (``cpus, memory_bytes, gpus``) fits on one single worker.

    ``reserve_gpu`` is the whole GPU budget a GPU task takes, which must be the
    same on every worker that fits. Distinct requests meet distinct budgets on
    the GPU level a budget can serve; the rest are conditions of that join.
    """
    capacities, _ = shared_capacity(workers)
    shape = ["cpus", "memory_bytes", "gpus"]
    keyed = tasks.select(*keys, *shape, F.concat_ws("/", "cpus", F.coalesce(F.col("memory_bytes").cast("string"), F.lit("")), "gpus").alias("_shape"))
    shapes = keyed.select("_shape", *shape).distinct()
    levels = shapes.select("gpus").distinct()
    served = capacities.withColumn("gpus", F.explode(F.sequence(F.lit(0), F.col("gpu").cast("int")))).join(levels, "gpus", "left_semi")
    found = (
        shapes.join(served, "gpus")
        .where((F.col("cpu") >= F.col("cpus")) & (F.col("memory") >= F.coalesce(F.col("memory_bytes").cast("double"), F.lit(0.0))))
        .groupBy("_shape").agg(F.min("gpu").alias("_low"), F.max("gpu").alias("_high"))
    )
    fits = F.col("_low").isNotNull()
    mixed = fits & (F.col("gpus") > 0) & (F.col("_low") != F.col("_high"))
    return keyed.join(found, "_shape", "left").select(
        *keys, (fits & ~mixed).alias("admitted"),
        F.when(fits & ~mixed & (F.col("gpus") > 0), F.col("_low")).alias("reserve_gpu"),
        F.when(~fits, "no worker can satisfy the request").when(mixed, "matching workers differ in GPU budget").otherwise("").alias("error"),
    )


def whole_worker(workers: DataFrame) -> DataFrame:
    """What a whole-worker probe reserves: one CPU, memory and GPU budget, or an error."""
    capacities, _ = shared_capacity(workers)
    seen = capacities.agg(
        F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{f.__name__}_{c}") for c in ("cpu", "memory", "gpu") for f in (F.min, F.max)]
    )

    def differs(c: str) -> Column:
        return F.col(f"_min_{c}") != F.col(f"_max_{c}")

    error = (
        F.when(F.col("_n") == 0, "no workers available")
        .when(differs("cpu") | differs("memory"), "whole-worker probes need identical CPU and memory budgets")
        .when(differs("gpu"), "matching workers differ in GPU budget").otherwise("")
    )
    return seen.select(*[F.when(error == "", F.col(f"_min_{c}")).alias(c) for c in ("cpu", "memory", "gpu")], error.alias("error"))
