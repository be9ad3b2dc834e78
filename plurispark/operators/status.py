"""What every output is, relative to its project as it now stands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.functions.paths import MANIFEST_SUFFIX, base_name, declared_path, parent
from plurispark.functions.records import remake, usable
from plurispark.operators import graph
from plurispark.operators.graph import BY
from plurispark.session import discard, stage

KEY = ["universe_id", "output_id"]

# The sentences a report prints.
WHY_MISSING = "no manifest — it has never been materialized"
WHY_DEFINITION = "the recipe or its decisions changed"
WHY_DECLARATION = "the output no longer declares the same inputs (`%s`)"
WHY_INPUT = "the input `%s` changed"
WHY_FOREIGN = (
    'last changed by %s ("%s", %s, %s) rather than its run record, so the manifest no longer '
    "describes these bytes — the next run remakes it; inspect first with `git show %s`"
)
WHY_BEHIND = "made under an earlier environment"


def recorded_inputs(manifests: DataFrame) -> DataFrame:
    """A manifest's input versions as rows ``universe_id, output_id, input_name, version``."""
    return manifests.select(*KEY, F.explode("input_versions").alias("input_name", "version"))


def _beside(task_inputs: DataFrame, recorded: DataFrame, *columns: str) -> DataFrame:
    """Inputs (with *columns*) and their records, met on (task, name): this spreads a task with very many inputs."""
    now = task_inputs.select(*KEY, "input_name", *columns, "current_version", F.lit(True).alias("_now"))
    then = recorded.select(*KEY, "input_name", F.col("version").alias("_version"), F.lit(True).alias("_then"))
    return now.join(then, ["output_id", "input_name", "universe_id"], "full_outer")


def _one_sided() -> Column:
    """Whether only one side of :func:`_beside` has this name."""
    return F.col("_now").isNull() | F.col("_then").isNull()


def _input_changes(both: DataFrame, moves: bool) -> DataFrame:
    """Per task: the smallest name only one side has, and the first declared input that moved.

    Only two values per task survive the combined aggregation.
    """
    one_sided = _one_sided()
    moved = ~one_sided & (F.col("current_version").isNull() | ~F.col("current_version").eqNullSafe(F.col("_version")))
    if not moves:
        moved = F.lit(False)
    return (
        both.where(one_sided | moved)
        .groupBy(*BY)
        .agg(
            F.min(F.when(one_sided, F.col("input_name"))).alias("_undeclared"),
            F.min(F.when(moved, F.struct("ord" if moves else F.lit(0).alias("ord"), "input_name"))).alias("_moved"),
        )
    )


def classify(
    tasks: DataFrame,
    task_inputs: DataFrame,
    manifests: DataFrame,
    foreign: DataFrame | None = None,
    recorded: DataFrame | None = None,
) -> DataFrame:
    """``status, reason_kind, reason_input, why`` per task.

    Precedence: missing, definition, declaration, input, foreign, behind,
    current. A current version of NULL means "will change". *recorded* defaults
    to the manifests' ``input_versions``. A ``data_version`` column of the
    manifests is carried along.
    """
    recorded = recorded_inputs(manifests) if recorded is None else recorded
    return _verdicts(tasks, _input_changes(_beside(task_inputs, recorded, "ord"), True), manifests, foreign)


def _verdicts(tasks: DataFrame, changes: DataFrame, manifests: DataFrame, foreign: DataFrame | None) -> DataFrame:
    carried = ["data_version"] if "data_version" in manifests.columns else []
    made = manifests.select(
        *KEY, F.col("definition_version").alias("_definition"), F.col("env_version").alias("_env"),
        F.lit(True).alias("_made"), *carried,
    )
    rows = (
        tasks.select(*KEY, "definition_version", "env_version")
        .join(made, BY, "left")
        .join(changes, BY, "left")
    )
    if foreign is None:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(f"_f_{c}") for c in ("sha", "subject", "author", "date")])
    else:
        rows = rows.join(
            foreign.select(*KEY, *[F.col(c).alias(f"_f_{c}") for c in ("sha", "subject", "author", "date")]), KEY, "left"
        )

    kind = (
        F.when(F.col("_made").isNull(), "missing")
        .when(~F.col("_definition").eqNullSafe(F.col("definition_version")), "definition")
        .when(F.col("_undeclared").isNotNull(), "declaration")
        .when(F.col("_moved").isNotNull(), "input")
        .when(F.col("_f_sha").isNotNull(), "foreign")
        .when(~F.col("_env").eqNullSafe(F.col("env_version")), "behind")
        .otherwise("current")
    )
    name = F.when(F.col("_kind") == "declaration", F.col("_undeclared")).when(
        F.col("_kind") == "input", F.col("_moved.input_name")
    )
    short = F.substring("_f_sha", 1, 7)
    why = (
        F.when(F.col("_kind") == "missing", F.lit(WHY_MISSING))
        .when(F.col("_kind") == "definition", F.lit(WHY_DEFINITION))
        .when(F.col("_kind") == "declaration", F.format_string(WHY_DECLARATION, F.col("_undeclared")))
        .when(F.col("_kind") == "input", F.format_string(WHY_INPUT, F.col("_moved.input_name")))
        .when(F.col("_kind") == "foreign", F.format_string(WHY_FOREIGN, short, "_f_subject", "_f_author", "_f_date", short))
        .when(F.col("_kind") == "behind", F.lit(WHY_BEHIND))
        .otherwise(F.lit(""))
    )
    status = F.when(F.col("_kind").isin("current", "behind"), F.col("_kind")).otherwise(F.lit("stale"))
    return rows.withColumn("_kind", kind).select(
        *KEY,
        status.alias("status"),
        F.when(F.col("_kind") != "current", F.col("_kind")).alias("reason_kind"),
        name.alias("reason_input"),
        why.alias("why"),
        *carried,
    )


# --- what a run would do -------------------------------------------------------


def predicted_inputs(
    task_inputs: DataFrame, manifests: DataFrame, files: DataFrame, running: DataFrame | None = None
) -> DataFrame:
    """Each input's version as it can be known before anything runs.

    A produced input answers with its producer's *recorded* digest, NULL when the
    producer will run or was never made; a declared one with its file's version
    (``path, data_version``), NULL when absent or not fetched. ``unfetched`` marks
    the latter (a file that is there but has no version).
    """
    columns = [*KEY, "input_name", "ord", "path", "produced_by"]
    rows = task_inputs.select(*columns)
    # Two branches, so that no join meets the NULL producers of declared inputs.
    made = manifests.select("universe_id", F.col("output_id").alias("produced_by"), F.col("data_version").alias("current_version"))
    if running is not None:
        runs = running.select("universe_id", F.col("output_id").alias("produced_by"))
        made = made.join(runs, ["produced_by", "universe_id"], "left_anti")
    produced = rows.where("produced_by IS NOT NULL").join(made, ["produced_by", "universe_id"], "left").select(
        *columns, "current_version", F.lit(False).alias("unfetched")
    )
    known = files.select("path", F.col("data_version").alias("current_version"), F.lit(True).alias("_there"))
    declared = rows.where("produced_by IS NULL").join(known, "path", "left").select(
        *columns, "current_version", (F.col("_there").isNotNull() & F.col("current_version").isNull()).alias("unfetched")
    )
    return produced.unionByName(declared)


def edges_of(task_inputs: DataFrame) -> DataFrame:
    return task_inputs.where("produced_by IS NOT NULL").select(*KEY, F.col("produced_by").alias("dep_output_id")).distinct()


def would_run(
    tasks: DataFrame,
    task_inputs: DataFrame,
    manifests: DataFrame,
    files: DataFrame,
    foreign: DataFrame | None = None,
    refresh: bool = False,
    recorded: DataFrame | None = None,
) -> DataFrame:
    """Every task's verdict when upstreams that would run are taken to change.

    A NULL input can only turn a task stale, so the walk needs no order: what
    needs remaking on its own is found first and everything downstream of it is
    reached over the edges. Inputs meet their records once; what the inputs of running
    producers add to a task's changes is one more aggregate.
    """
    recorded = recorded_inputs(manifests) if recorded is None else recorded
    both = _beside(predicted_inputs(task_inputs, manifests, files), recorded, "ord")
    changes = stage(_input_changes(both, True))
    alone = _verdicts(tasks, changes, manifests, foreign)
    seeds = stage(alone.where(remake(F.col("status"), refresh)).select(*KEY))
    running = graph.dependents(edges_of(task_inputs), seeds).select("universe_id", F.col("output_id").alias("produced_by"))
    # An input without a record is undeclared already, which comes before any that moved; one without a name meets no record.
    below = task_inputs.where("produced_by IS NOT NULL AND input_name IS NOT NULL").join(
        running, ["universe_id", "produced_by"], "left_semi"
    ).groupBy(*KEY).agg(F.min(F.struct("ord", "input_name")).alias("_moved"))
    changes = changes.unionByName(below, allowMissingColumns=True).groupBy(*KEY).agg(
        F.min("_undeclared").alias("_undeclared"), F.min("_moved").alias("_moved"))
    verdicts = _verdicts(tasks, changes, manifests, foreign)
    return verdicts.withColumn("would_run", remake(F.col("status"), refresh))


def settle(
    tasks: DataFrame,
    task_inputs: DataFrame,
    manifests: DataFrame,
    attempts: DataFrame,
    foreign: DataFrame | None = None,
    refresh: bool = False,
    recorded: DataFrame | None = None,
) -> DataFrame:
    """What a real run makes of each task: ``outcome`` and the resulting ``data_version``.

    Level by level, a task whose upstreams did not all end usable is blocked;
    otherwise it is classified with live digests, so a byte-identical rebuild
    stops the cascade. *attempts* says what executing a task gives: ``ok`` and
    ``new_version``. ``blocked_by`` is the first upstream that did not finish and
    ``n_blocking`` their number; :func:`blockers` names them all.
    """
    recorded = recorded_inputs(manifests) if recorded is None else recorded

    # What no upstream can change is settled once: the verdict on everything but
    # input versions, and each input beside its recorded version, which are met and written once.
    # The order is taken from there too, so what the inputs are made from is read once.
    # A name that both sides have is not looked at again, nor the versions of an input nobody produces.
    changed = F.col("_now") & F.col("produced_by").isNull() & (
        F.col("current_version").isNull() | ~F.col("current_version").eqNullSafe(F.col("_version")))
    both = stage(_beside(task_inputs, recorded, "produced_by").select(
        *KEY, "_now", "_then", F.when(_one_sided(), F.col("input_name")).alias("input_name"), "produced_by",
        F.when(F.col("produced_by").isNotNull(), F.col("_version")).alias("version"), F.coalesce(changed, F.lit(False)).alias("_changed"),
    ))
    beside = both.where("_now")
    ranked = graph.task_order(edges_of(beside), tasks)
    depth = ranked.agg(F.max("level")).first()[0]
    drifted = beside.where("_changed").select(*KEY).distinct().withColumn("_drifted", F.lit(True))
    base = _verdicts(tasks, _input_changes(both, False), manifests, foreign)
    todo = stage(
        base.drop("why", "reason_kind", "reason_input").join(drifted, BY, "left")
        .withColumn("status", F.when(F.col("_drifted"), "stale").otherwise(F.col("status"))).drop("_drifted")
        .join(attempts.select(*KEY, "ok", "new_version"), BY, "left").join(ranked, BY)
    )
    inputs = stage(
        beside.where("produced_by IS NOT NULL").select(*KEY, "produced_by", "version").join(ranked, BY)
        .sortWithinPartitions("level")  # a level reads its own pages
    )
    discard(both)

    settled: DataFrame | None = None
    for level in range(0, (depth if depth is not None else -1) + 1):
        here = todo.where(F.col("level") == level)
        if settled is None:
            rows = here.select(
                "*", F.lit(None).cast("string").alias("blocked_by"), F.lit(0).cast("long").alias("n_blocking"),
                F.lit(False).alias("_moved"),
            )
        else:
            before = settled.select(
                "universe_id", F.col("output_id").alias("produced_by"), F.col("outcome").alias("_up"),
                F.col("data_version").alias("_live"),
            )
            mine = inputs.where(F.col("level") == level).join(before, ["produced_by", "universe_id"], "left")
            unmet = ~F.coalesce(usable(F.col("_up")), F.lit(False))
            moved = F.col("_live").isNull() | ~F.col("_live").eqNullSafe(F.col("version"))
            # An input that neither blocks nor moved adds nothing to its task.
            seen = mine.where(unmet | moved).groupBy(*BY).agg(
                F.min(F.when(unmet, F.col("produced_by"))).alias("blocked_by"),
                F.countDistinct(F.when(unmet, F.col("produced_by"))).alias("n_blocking"),
                F.bool_or(moved).alias("_moved"),
            )
            rows = here.join(seen, BY, "left")
        blocked = F.coalesce("n_blocking", F.lit(0)) > 0
        status = F.when(F.coalesce("_moved", F.lit(False)), "stale").otherwise(F.col("status"))
        runs = remake(status, refresh)
        good = F.coalesce("ok", F.lit(False))
        rows = stage(rows.select(
            *KEY,
            F.when(blocked, "blocked").when(runs & good, "ok").when(runs, "failed").otherwise(status).alias("outcome"),
            F.when(blocked, None).when(runs & good, F.col("new_version")).when(~runs, F.col("data_version")).alias("data_version"),
            "blocked_by", F.coalesce("n_blocking", F.lit(0)).alias("n_blocking"),
        ))
        settled = rows if settled is None else settled.unionByName(rows)
        if (level + 1) % graph.FOLD == 0:  # the next plans read one table again, however many levels there were
            settled = stage(settled)
    if settled is None:
        raise ValueError("no task to settle")
    return settled


def blockers(task_inputs: DataFrame, settled: DataFrame) -> DataFrame:
    """Every upstream that blocks a blocked task: ``universe_id, output_id, blocked_by``."""
    outcomes = settled.select(*KEY, "outcome")
    # Only blocked tasks' inputs are compared with each other, where the join has put them.
    held = task_inputs.where("produced_by IS NOT NULL").select(*KEY, "produced_by").join(
        outcomes.where("outcome = 'blocked'").select(*KEY), BY, "left_semi").distinct()
    above = outcomes.select("universe_id", F.col("output_id").alias("produced_by"), F.col("outcome").alias("_up"))
    return held.join(above, ["produced_by", "universe_id"], "left").where(
        ~F.coalesce(usable(F.col("_up")), F.lit(False))).select(*KEY, F.col("produced_by").alias("blocked_by"))


def task_outcome(exit_code: Column, env: Column, env_before: Column, env_after: Column, found: Column, recordable: Column) -> Column:
    """``struct<outcome,reason>`` of one execution, its checks in the order a worker makes them."""
    reason = (
        F.when(~env_before.eqNullSafe(env), F.lit("environment moved before the run"))
        .when(exit_code != 0, F.concat(F.lit("the recipe exited "), exit_code.cast("string")))
        .when(~env_after.eqNullSafe(env), F.lit("environment moved during the run"))
        .when(found == "directory", F.lit("the recipe exited 0 but left a directory"))
        .when(F.coalesce(found, F.lit("")) != "file", F.lit("the recipe exited 0 but left nothing"))
        .when(~F.coalesce(recordable, F.lit(False)), F.lit("the output could not be recorded"))
        .otherwise(F.lit(""))
    )
    return F.struct(F.when(reason == "", "ok").otherwise("failed").alias("outcome"), reason.alias("reason"))


# --- files and environments ----------------------------------------------------


def orphan_manifests(manifests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Recorded outputs the spec no longer declares."""
    return manifests.join(tasks.select(*KEY), KEY, "left_anti")


def external_inputs(task_inputs: DataFrame, root: str) -> DataFrame:
    """Distinct inputs nobody produces: ``declared, in_tree``; in-tree ones can be fetched."""
    path = F.col("path")
    return (
        task_inputs.where("produced_by IS NULL").select("path").distinct()
        .select(
            declared_path(F.lit(root), path).alias("declared"),
            F.startswith(path, F.lit(root.rstrip("/") + "/")).alias("in_tree"),
        )
    )


def owned_files(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Files a task owns: ``<id>.*`` and ``.<id>.manifest.json*`` beside it, as ``kind``.

    The id is compared whole, up to the first dot, so a sibling or a longer id
    is never claimed.
    """
    name = base_name(F.col("path"))
    of_manifest = F.regexp_extract(name, r"^\.([^.]+)" + MANIFEST_SUFFIX.replace(".", r"\."), 1)
    placed = files.select(
        "path", parent(F.col("path")).alias("_dir"),
        F.when(of_manifest != "", of_manifest).when(F.instr(name, ".") > 1, F.substring_index(name, ".", 1)).alias("output_id"),
        F.when(of_manifest != "", "manifest").otherwise("payload").alias("kind"),
    )
    owners = tasks.select(*KEY, parent(F.col("output_path")).alias("_dir"))
    return placed.join(owners, ["_dir", "output_id"]).select(*KEY, "path", "kind")


def environment_drift(task_env: DataFrame, current_env: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tasks whose environment is not the one in force now."""
    return task_env.join(current_env.withColumnRenamed("env_version", "current_env"), list(on)).where(
        ~F.col("env_version").eqNullSafe(F.col("current_env"))
    )


# --- reports -------------------------------------------------------------------


def status_counts(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many outputs are in each state, states with none included."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("current", "behind", "stale")]
    return verdicts.groupBy(*by).agg(*counts)


def check_report(verdicts: DataFrame, refresh: bool = False) -> DataFrame:
    """Each output with the list a check puts it on: planned, behind or current."""
    status = F.col("status")
    return verdicts.select(
        F.concat_ws("/", *KEY).alias("output"),
        F.when(remake(status, refresh), "planned").when(status == "behind", "behind").otherwise("current").alias("list"),
        "why",
    )


def run_report(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per outcome and the two flags: ``ok`` (nothing failed or blocked), ``up_to_date``."""
    kinds = ("made", "current", "behind", "failed", "blocked")
    outcome = F.when(F.col("outcome") == "ok", "made").otherwise(F.col("outcome"))
    counted = outcomes.select(*by, outcome.alias("outcome")).groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    )
    ok = (F.col("failed") == 0) & (F.col("blocked") == 0)
    return counted.select("*", ok.alias("ok"), (ok & (F.col("made") == 0)).alias("up_to_date"))


def publication_lag(manifests: DataFrame, documents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Where each project's published document stands, in one of six states.

    *documents* has ``license``, ``present``, ``readable`` and ``published`` (the
    document's date) per project. The document must carry the newest
    ``finished_at`` of the manifests; a date off in either direction lags.
    """
    newest = manifests.groupBy(*on).agg(F.max(F.nullif("finished_at", F.lit(""))).alias("newest"))
    unlicensed = F.coalesce("license", F.lit("")) == ""
    state = (
        F.when(unlicensed & F.col("present"), "no longer maintained")
        .when(unlicensed, "not maintained")
        .when(~F.col("present"), "to be created")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("newest").isNotNull() & ~F.col("published").eqNullSafe(F.col("newest")), "behind")
        .otherwise("up to date")
    )
    return documents.join(newest, list(on), "left").select(*on, state.alias("state"))
