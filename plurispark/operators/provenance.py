"""Provenance as entity and edge tables, and their JSON-LD export.

Entities are ``id, types array<string>, props map<string,string>`` (values are
JSON texts), edges ``src, predicate, dst, ord``. Each kind of entity is one
select over the tables that know it, so all kinds run in one job.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurispark.functions import hashing, paths
from plurispark.functions.records import is_pointer, key_integrity
from plurispark.session import ranked, stage

KEY = ["universe_id", "output_id"]

#: The files that pin what a run installed.
ENVIRONMENT = ("pyproject.toml", "uv.lock", ".python-version")

#: The profiles a published document conforms to.
PROFILES = (
    ("https://w3id.org/ro/wfrun/process/0.5", "Process Run Crate", "0.5"),
    ("https://w3id.org/ro/wfrun/workflow/0.5", "Workflow Run Crate", "0.5"),
    ("https://w3id.org/ro/wfrun/provenance/0.5", "Provenance Run Crate", "0.5"),
    ("https://w3id.org/workflowhub/workflow-ro-crate/1.0", "Workflow RO-Crate", "1.0"),
)
#: Terms of the vocabulary.
WORKFLOW_PROFILE = "https://bioschemas.org/profiles/ComputationalWorkflow/1.0-RELEASE"
COMPLETED = "http://schema.org/CompletedActionStatus"
DOCKER_IMAGE = "https://w3id.org/ro/terms/workflow-run#DockerImage"


@dataclass(frozen=True)
class Project:
    """What is known about one project apart from its tables."""

    dataset_id: str
    title: str
    license: str
    root: str = ""
    spec_file: str = "analysis.yaml"
    description: str = ""
    language_id: str = "#language"
    language: str = "analysis specification"
    language_url: str = ""
    language_full_name: str = ""
    engine: str = "engine"
    engine_page: str = ""
    run_label: str = "run"


# --- roll-ups ------------------------------------------------------------------


def run_rollup(manifests: DataFrame) -> DataFrame:
    """One row per run (``git_sha``): first and last instant, members, first member's engine.

    The instants range over both started and finished times, empty ones aside.
    """
    times = (F.nullif("started_at", F.lit("")), F.nullif("finished_at", F.lit("")))
    first = F.min(F.struct(*KEY, "lc_version"))
    return (
        manifests.groupBy("git_sha")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min(F.least(*times)).alias("start_time"),
            F.max(F.greatest(*times)).alias("end_time"),
            first.alias("_first"),
        )
        .select("git_sha", "members", "start_time", "end_time", "_first.universe_id", "_first.output_id", "_first.lc_version")
    )


def people(writes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct writers by email, else by author, in the order they are first seen.

    ``person_id`` is a mail address or ``#person-<n>``, *n* being the number of
    people seen before.
    """
    key = F.coalesce(F.nullif("email", F.lit("")), F.col("author"))
    named = writes.where(F.coalesce(key, F.lit("")) != "").select(
        key.alias("person_key"), "author", F.coalesce("email", F.lit("")).alias("email"), *order
    )
    seen = named.groupBy("person_key").agg(F.min(F.struct(*order, "author", "email")).alias("_s")).select(
        "person_key", *[F.col(f"_s.{c}").alias(c) for c in (*order, "author", "email")]
    )
    placed = ranked(seen, [*order, "person_key"], "_n")
    local = F.concat(F.lit("#person-"), F.col("_n").cast("string"))
    return placed.select(
        "person_key", "author", "email",
        F.when(F.col("email") != "", F.concat(F.lit("mailto:"), "email")).otherwise(local).alias("person_id"),
    )


def parameters(tasks: DataFrame) -> DataFrame:
    """The distinct decision names of all tasks."""
    return tasks.select(F.explode(F.map_keys("decisions")).alias("decision")).distinct()


def single_remote(manifests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``remote``: the one distinct non-empty remote, empty when there is none or several."""
    remote = F.nullif("git_remote", F.lit(""))
    low, high = F.min(remote), F.max(remote)
    return manifests.groupBy(*by).agg(F.when(low == high, low).otherwise(F.lit("")).alias("remote"))


def step_positions(outputs: DataFrame) -> DataFrame:
    """Each distinct output's place in sorted order, from zero."""
    return ranked(outputs.select("output_id").distinct(), ["output_id"], "position")


def file_integrity(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``path, content_size, sha256`` (texts) per file.

    A stored file answers from its key; any other from its bytes, unless they
    are a reference to content that is not there.
    """
    known = keys.groupBy("path").agg(F.min("key").alias("_key"))
    stated = key_integrity(F.col("_key"))
    plain = F.col("content").isNotNull() & ~is_pointer(F.col("content"), F.octet_length("content"))
    # Digests are taken where the bytes are read; only they travel to the join.
    own = files.select(
        "path", F.when(plain, F.octet_length("content").cast("string")).alias("_size"),
        F.when(plain, F.sha2(F.col("content").cast("binary"), 256)).alias("_sha"),
    )
    stored = F.col("_key").isNotNull()
    return own.join(known, "path", "left").select(
        "path",
        F.when(stored, stated["size"]).otherwise(F.col("_size")).alias("content_size"),
        F.when(stored, stated["sha256"]).otherwise(F.col("_sha")).alias("sha256"),
    )


# --- entities and edges --------------------------------------------------------


def json_text(c: Column) -> Column:
    """A string column as a JSON text; NULL stays NULL."""
    # Inside the list's brackets the text begins and ends with a quote, so nothing else is trimmed.
    return F.when(c.isNotNull(), F.btrim(F.to_json(F.array(c)), F.lit("[]")))


def entity(df: DataFrame, id: Column, types: Sequence[str], **props: Column | str | None) -> DataFrame:
    """Rows of one kind of entity; properties that are NULL are left out."""
    texts: list[Column] = []
    for name, value in props.items():
        if value is None:
            continue
        texts += [F.lit(name), json_text(F.lit(value)) if isinstance(value, str) else value]
    table = F.create_map(*texts) if texts else F.create_map().cast("map<string,string>")
    return df.select(
        id.alias("id"), F.array(*[F.lit(t) for t in types]).alias("types"),
        F.map_filter(table, lambda k, v: v.isNotNull()).alias("props"),
    )


def edge(df: DataFrame, src: Column, predicate: str, dst: Column, ord: Column | None = None) -> DataFrame:
    """Rows of one kind of reference; *ord* is the place in the source's list, as a sortable text."""
    return df.select(
        src.alias("src"), F.lit(predicate).alias("predicate"), dst.alias("dst"),
        (F.lit("") if ord is None else ord.cast("string")).alias("ord"),
    ).where("src IS NOT NULL AND dst IS NOT NULL")


def edges_of(df: DataFrame, *kinds: tuple[Column, str, Column, Column | None]) -> DataFrame:
    """Rows of several kinds of reference (source, predicate, target, place) in one pass over *df*."""
    rows = [
        F.struct(src.alias("src"), F.lit(predicate).alias("predicate"), dst.alias("dst"), (F.lit("") if ord is None else ord.cast("string")).alias("ord"))
        for src, predicate, dst, ord in kinds
    ]
    return df.select(F.inline(F.array(*rows))).where("src IS NOT NULL AND dst IS NOT NULL")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _j(*parts: Column | str) -> Column:
    return json_text(_text(*parts))


def provenance(
    project: Project,
    tasks: DataFrame,
    task_inputs: DataFrame,
    manifests: DataFrame,
    writes: DataFrame,
    files: DataFrame,
    spec_write: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(entities, edges)`` of one project.

    *tasks* has ``output_path`` and ``decisions``; *manifests* the recorded runs of
    outputs; *writes* the last write per task (``sha, author, email``); *files* the
    repository's ``path, content_size, sha256`` (see :func:`file_integrity`);
    *spec_write* the last write of the spec file.
    """
    entities: list[DataFrame] = []
    shared: list[DataFrame] = []
    edges: list[DataFrame] = []
    spark = tasks.sparkSession
    one = spark.range(1)
    u, o = F.col("universe_id"), F.col("output_id")
    root = F.lit(project.root)

    def uri(*kind: Column | str) -> Column:
        return hashing.stable_uuid(F.lit(project.dataset_id), _text(*kind))

    sha = F.col("git_sha")
    made = (
        manifests.select(*KEY, "recipe", "data_version", "git_sha", "lc_version", "started_at", "finished_at", "decisions", "image")
        .join(tasks.select(*KEY, "output_path"), KEY)
        .join(writes.select(*KEY, "author", "email"), KEY, "left")
        .withColumn("_file", paths.declared_path(root, F.col("output_path")))
        .withColumn("_sidecar", paths.declared_path(root, paths.sidecar_path(F.col("output_path"))))
        .withColumn("_action", uri("action/", u, "/", o))
        .withColumn("_run", uri("run/", sha))
        .withColumn("person_key", F.coalesce(F.nullif("email", F.lit("")), F.col("author")))
        .drop("output_path")
    )
    made = stage(made)  # a dozen kinds read it; ids are digests, taken only here
    remote_row = single_remote(manifests).first()
    remote = remote_row["remote"] if remote_row else ""
    version = spec_write["sha"][:7] if spec_write else None
    workflow = F.lit(project.spec_file)
    with_integrity = files.select("path", "content_size", "sha256")

    def file_entities(df: DataFrame, path: Column, types: Sequence[str] = ("File",), **props) -> DataFrame:
        """File entities with type, size and checksum, by path; one row per path."""
        named = df.withColumn("_path", path).join(with_integrity.withColumnRenamed("path", "_path"), "_path", "left")
        return entity(
            named.withColumn("_media", paths.media_type(F.col("_path"))), F.col("_path"), types,
            encodingFormat=json_text(F.nullif(F.col("_media"), F.lit(""))),
            contentSize=json_text(F.col("content_size")), sha256=json_text(F.col("sha256")), **props,
        )

    # language, workflow, parameters
    entities.append(entity(one, F.lit(project.language_id), ["ComputerLanguage"], name=project.language,
                           alternateName=project.language_full_name or None, url=project.language_url or None))
    entities.append(entity(
        one, workflow, ["File", "SoftwareSourceCode", "ComputationalWorkflow", "HowTo"], name=project.title,
        encodingFormat="application/yaml", description=project.description or None, url=remote or None,
        version=version, dateCreated=spec_write["date"] if spec_write else None,
    ))
    edges.append(edge(one, workflow, "conformsTo", F.lit(WORKFLOW_PROFILE)))
    edges.append(edge(one, workflow, "programmingLanguage", F.lit(project.language_id)))
    names = parameters(tasks)
    parameter = _text("#param-", F.col("decision"))
    entities.append(entity(names, parameter, ["FormalParameter"], name=_j(F.col("decision")), additionalType="Text"))
    edges.append(edge(names, workflow, "input", parameter, F.col("decision")))

    # tools and steps
    steps = step_positions(tasks)
    tool = _text(f"{remote}#tool/", o) if remote else uri("tool/", o)
    step = _text("#step-", o)
    entities.append(entity(steps, tool, ["SoftwareApplication"], name=_j(o), description=_j("recipe behind `", o, "`"),
                           url=remote or None, softwareVersion=version))
    entities.append(entity(steps, step, ["HowToStep"], position=F.col("position").cast("string")))
    place = F.lpad(F.col("position").cast("string"), 19, "0")
    edges.append(edges_of(steps, (step, "workExample", tool, None), (workflow, "step", step, place), (workflow, "hasPart", tool, place)))

    # environment files, universes, readme
    pinned = with_integrity.where(F.col("path").isin(*ENVIRONMENT, "README.md") | F.col("path").rlike(r"^universes/[^/]+\.yaml\z"))
    shared.append(file_entities(pinned.select("path"), F.col("path")))
    edges.append(edge(pinned.where("path = 'README.md'"), F.lit("README.md"), "about", F.lit("./")))

    # outputs and their manifests
    shared.append(file_entities(
        made, F.col("_file"), name=_j(o, " (universe ", u, ")"),
        description=_j("output `", o, "` as made in universe `", u, "`"), version=json_text(F.col("data_version")),
    ))
    shared.append(file_entities(made, F.col("_sidecar")))

    # external inputs
    outside = (
        task_inputs.where("produced_by IS NULL").join(made.select(*KEY), KEY, "left_semi")
        .select("path").distinct().withColumn("_declared", paths.declared_path(root, F.col("path")))
    )
    in_tree = ~F.startswith("_declared", F.lit("/"))
    external_id = F.when(in_tree, F.col("_declared")).otherwise(_text("file://", F.col("_declared")))
    named = outside.join(with_integrity.withColumnRenamed("path", "_declared"), "_declared", "left")
    shared.append(entity(
        named, external_id, ["File"], name=json_text(F.col("_declared")),
        encodingFormat=json_text(F.nullif(paths.media_type(F.col("_declared")), F.lit(""))),
        contentSize=F.when(in_tree, json_text(F.col("content_size"))), sha256=F.when(in_tree, json_text(F.col("sha256"))),
    ))

    # people: the spec's writer first, then the writers of outputs in order
    seen = made.select(F.lit(1).alias("_turn"), *KEY, "author", "email")
    if spec_write:
        author, email = (F.lit(spec_write[c]).cast("string").alias(c) for c in ("author", "email"))
        blank = F.lit("")
        seen = one.select(F.lit(0).alias("_turn"), *[blank.alias(c) for c in KEY], author, email).unionByName(seen)
    persons = stage(people(seen, ["_turn", *KEY]))
    entities.append(entity(persons, F.col("person_id"), ["Person"], name=json_text(F.col("author")), email=json_text(F.col("email"))))
    edges.append(edge(persons, F.lit("./"), "author", F.col("person_id"), F.col("person_id")))
    person_of = persons.select("person_key", "person_id")
    if spec_write:
        creator = persons.where(F.col("person_key") == (spec_write["email"] or spec_write["author"]))
        edges.append(edge(creator, workflow, "creator", F.col("person_id")))

    # actions, decision values, controls
    action = F.col("_action")
    order = F.concat(u, F.lit("\u0000"), o)
    entities.append(entity(
        made, action, ["CreateAction"], name=_j("run of `", o, "` in universe `", u, "`"), description=json_text(F.col("recipe")),
        actionStatus=COMPLETED, startTime=json_text(F.nullif("started_at", F.lit(""))), endTime=json_text(F.nullif("finished_at", F.lit(""))),
    ))
    edges.append(edge(made.select("_action", "person_key").join(person_of, "person_key"), action, "agent", F.col("person_id")))
    edges.append(action_objects(made, task_inputs, tasks, files, root).select(
        F.col("_action").alias("src"), F.lit("object").alias("predicate"), "dst", "ord"
    ))
    values = made.select(*KEY, F.explode("decisions").alias("decision", "value"))
    value = _text("#value-", u, "-", o, "-", F.col("decision"))
    entities.append(entity(values, value, ["PropertyValue"], name=json_text(F.col("decision")), value=json_text(F.col("value"))))
    edges.append(edge(values.join(names, "decision", "left_semi"), value, "exampleOfWork", parameter))
    control = _text("#control-", u, "-", o)
    entities.append(entity(made, control, ["ControlAction"], name=_j("control of `", o, "` in universe `", u, "`")))

    # runs and engines
    runs = run_rollup(made.select("git_sha", "started_at", "finished_at", *KEY, "lc_version"))
    runs = stage(runs.withColumn("_run", uri("run/", sha)))  # no filter of its readers goes back to all that was made
    short = F.when(sha == "", F.lit("unknown commit")).otherwise(F.substring(sha, 1, 7))
    run = F.col("_run")
    organize = _text("#organize-", F.when(sha == "", F.lit("unknown")).otherwise(F.substring(sha, 1, 7)))
    local_engine = F.lit(f"#{project.engine}")
    engine = F.when(F.coalesce("lc_version", F.lit("")) == "", local_engine).otherwise(
        _text(project.engine_page, F.col("lc_version"), "/") if project.engine_page else local_engine
    )
    entities.append(entity(
        runs, run, ["CreateAction"], name=_j(f"{project.run_label} at ", short),
        description=_j("a run that began at commit ", F.when(sha == "", F.lit("(unrecorded)")).otherwise(sha)),
        actionStatus=COMPLETED, startTime=json_text(F.col("start_time")), endTime=json_text(F.col("end_time")),
    ))
    shared.append(entity(runs, organize, ["OrganizeAction"], name=_j("schedule of the run of ", short)))
    shared.append(entity(runs, engine, ["SoftwareApplication"], name=project.engine,
                           softwareVersion=json_text(F.nullif("lc_version", F.lit(""))),
                           url=F.when(engine != local_engine, json_text(engine))))
    agents = runs.select(*KEY, "_run").join(made.select(*KEY, "person_key"), KEY).join(person_of, "person_key")
    edges.append(edge(agents, run, "agent", F.col("person_id")))
    edges.append(edges_of(
        runs, (run, "instrument", workflow, None), (organize, "instrument", engine, None), (organize, "result", run, None),
        (F.lit("./"), "mentions", run, F.concat(F.lit("1"), sha)),
    ))
    file, sidecar = F.col("_file"), F.col("_sidecar")
    edges.append(edges_of(
        made, (file, "subjectOf", sidecar, None), (sidecar, "about", file, None),
        (action, "instrument", tool, None), (action, "result", file, None), (action, "containerImage", F.col("image.archive"), None),
        (F.lit("./"), "mentions", action, F.concat(F.lit("0"), order)),
        (control, "instrument", step, None), (control, "object", action, None),
        (run, "result", file, order), (organize, "object", control, order),
    ))

    # images
    images = made.where("image IS NOT NULL").select(F.col("image.archive").alias("archive"), "image.tag", F.col("image.id").alias("image_id"))
    tag = F.coalesce("tag", F.lit(""))
    shared.append(entity(
        images, F.coalesce("archive", F.lit("")), ["File", "ContainerImage"],
        name=json_text(F.when(tag != "", tag).otherwise(F.col("archive"))), tag=json_text(tag), encodingFormat="application/x-tar",
        sha256=json_text(F.nullif(F.regexp_extract("image_id", r"(?s)^sha256:(.*)\z", 1), F.lit(""))),
    ))
    edges.append(edge(images.select("archive").distinct(), F.col("archive"), "additionalType", F.lit(DOCKER_IMAGE)))

    # profiles, licence, root
    for place_, (profile, name, number) in enumerate(PROFILES):
        entities.append(entity(one, F.lit(profile), ["CreativeWork"], name=f"{name} {number}", version=number))
        edges.append(edge(one, F.lit("./"), "conformsTo", F.lit(profile), F.lit(place_)))
    licence_file = with_integrity.where(F.col("path") == project.license)
    if licence_file.head(1):
        licence = F.lit(project.license)
        shared.append(file_entities(licence_file.select("path"), F.col("path")))
    else:
        is_url = project.license.startswith(("http://", "https://"))
        licence = F.lit(project.license if is_url else "#license")
        entities.append(entity(one, licence, ["CreativeWork"], name=project.license))
    edges += [edge(one, F.lit("./"), "license", licence), edge(one, workflow, "license", licence)]
    newest = made.agg(F.max(F.nullif("finished_at", F.lit(""))).alias("newest"))
    fallback = (spec_write or {}).get("date") or "1970-01-01"
    entities.append(entity(
        newest, F.lit("./"), ["Dataset"], name=project.title,
        description=project.description or f"Analysis `{project.title}`.",
        datePublished=json_text(F.coalesce("newest", F.lit(fallback))),
    ))

    # Other ids are unique by construction; a file, engine or image may be known
    # to several kinds and is kept once, under its fullest description.
    described = (
        functools.reduce(DataFrame.unionByName, shared).withColumn("_size", F.size("props"))
        .groupBy("id").agg(F.max(F.struct("_size", "types", F.sort_array(F.map_entries("props")).alias("props"))).alias("_e"))
        .select("id", "_e.types", F.map_from_entries("_e.props").alias("props"))
    )
    return functools.reduce(DataFrame.unionByName, entities, described), functools.reduce(DataFrame.unionByName, edges)


def action_objects(
    made: DataFrame, task_inputs: DataFrame, tasks: DataFrame, files: DataFrame, root: Column
) -> DataFrame:
    """What each action consumed: environment files, inputs by name, recorded decisions.

    *made* carries ``_action``, ``_file`` and ``decisions``. A produced input counts
    only when its producer was made; ``ord`` sorts the three groups.
    """
    here = files.where(F.col("path").isin(*ENVIRONMENT)).select("path")
    position = F.array_position(F.array(*[F.lit(e) for e in ENVIRONMENT]), F.col("path"))
    pinned = F.explode(F.array(*[F.lit(e) for e in ENVIRONMENT])).alias("path")
    environment = made.select("_action", pinned).join(here, "path", "left_semi").select(
        "_action", F.col("path").alias("dst"), F.concat(F.lit("0"), position.cast("string")).alias("ord")
    )

    inputs = task_inputs.select(*KEY, "input_name", "path", "produced_by").join(made.select(*KEY, "_action"), KEY)
    producers = made.select("universe_id", F.col("output_id").alias("produced_by"), F.col("_file").alias("_upstream"))
    declared = paths.declared_path(root, F.col("path"))
    external = F.when(F.startswith(declared, F.lit("/")), F.concat(F.lit("file://"), declared)).otherwise(declared)
    named = F.concat(F.lit("1"), F.col("input_name")).alias("ord")
    outside = inputs.where("produced_by IS NULL").select("_action", external.alias("dst"), named)
    upstream = inputs.where("produced_by IS NOT NULL").join(producers, ["universe_id", "produced_by"]).select(
        "_action", F.col("_upstream").alias("dst"), named
    )

    decided = made.select(*KEY, "_action", F.explode(F.map_keys("decisions")).alias("decision")).select(
        "_action", _text("#value-", F.col("universe_id"), "-", F.col("output_id"), "-", F.col("decision")).alias("dst"),
        F.concat(F.lit("2"), F.col("decision")).alias("ord"),
    )
    return environment.unionByName(outside).unionByName(upstream).unionByName(decided)


# --- export --------------------------------------------------------------------

#: The format of the exported document.
CRATE = "https://w3id.org/ro/crate/1.1"
CONTEXTS = (f"{CRATE}/context", "https://w3id.org/ro/terms/workflow-run")
DESCRIPTOR = "ro-crate-metadata.json"
#: References are dealt in so many turns, so disk holds this part of them besides what is written.
SHARES = 4


def with_root(entities: DataFrame, edges: DataFrame, spec_file: str) -> tuple[DataFrame, DataFrame]:
    """Add what makes entities a document: its descriptor, and the root's main entity and parts (every file)."""
    one = entities.sparkSession.range(1)
    about = entity(one, F.lit(DESCRIPTOR), ["CreativeWork"])
    files = entities.where(F.array_contains("types", "File")).select("id")  # repeated references are dropped with all others
    links = [
        edge(one, F.lit(DESCRIPTOR), "about", F.lit("./")), edge(one, F.lit(DESCRIPTOR), "conformsTo", F.lit(CRATE)),
        edge(one, F.lit("./"), "mainEntity", F.lit(spec_file)), edge(files, F.lit("./"), "hasPart", F.col("id"), F.col("id")),
    ]
    return entities.unionByName(about), functools.reduce(DataFrame.unionByName, links, edges)


def document(entities: DataFrame, edges: DataFrame, spec_file: str = "analysis.yaml") -> DataFrame:
    """The whole JSON-LD document as fragments ``id, key, ord, before, text, after``.

    In the order of ``id, key, ord`` the fragments (``before``, ``text`` and ``after`` of each)
    are the document: one object for each id, its keys sorted, a single
    reference as itself and several as a list in order. A reference is a
    fragment of its own, so nothing ever holds a list, however long. Nothing
    reads the clock.

    References and ids are dealt once, by id, one share of the ids after another: there each object finds its head, its tail and the ends of its
    lists. Only the lists of the root and the workflow, which name every file and step, are spread over all tasks.
    """
    # Both are made once and written: what made them leaves no shuffle files while references are dealt.
    entities, edges = with_root(stage(entities), edges, spec_file)
    edges = stage(edges)
    types = F.when(F.size("types") == 1, json_text(F.col("types")[0])).otherwise(F.to_json("types"))
    literals = entities.select(
        "id", F.explode(F.map_concat(F.create_map(F.lit("@type"), types), F.col("props"))).alias("key", "value"),
    ).select("id", "key", F.lit("").alias("ord"), F.concat(F.lit(","), json_text(F.col("key")), F.lit(":")).alias("before"), F.col("value").alias("text"), F.lit("").alias("after"))
    place = F.concat("ord", F.lit("\u0000"), "dst")
    hub = F.coalesce(F.col("id").isin("./", spec_file), F.lit(False))
    ord = F.when(F.col("dst").isNotNull(), F.col("ord")).alias("ord")
    given = edges.where("src IS NOT NULL").select(F.col("src").alias("id"), F.col("predicate").alias("key"), ord, "dst")
    blank = F.lit("")

    def reference(first: Column, last: Column) -> Column:
        opening = F.concat(F.lit(","), json_text(F.col("key")), F.lit(":"), F.when(last, F.lit("")).otherwise(F.lit("[")))
        return F.struct(
            F.col("key").alias("key"), place.alias("ord"), F.when(first, opening).otherwise(F.lit(",")).alias("before"),
            F.concat(F.lit('{"@id":'), json_text(F.col("dst")), F.lit("}")).alias("text"),
            F.when(last & ~first, F.lit("]")).otherwise(blank).alias("after"),
        )

    def bounds() -> tuple[Column, Column]:
        name = F.concat(F.lit('"@id":'), json_text(F.col("id")))
        opening = F.when(F.col("id") == DESCRIPTOR, F.lit("{")).otherwise(F.lit(",{"))
        return (
            F.struct(blank.alias("key"), blank.alias("ord"), opening.alias("before"), name.alias("text"), blank.alias("after")),
            F.struct(F.lit("\uffff").alias("key"), blank.alias("ord"), blank.alias("before"), blank.alias("text"), F.lit("}").alias("after")),
        )

    head, tail = bounds()
    spread = given.where(hub).distinct()
    ends = spread.groupBy("id", "key").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    listed = spread.join(F.broadcast(ends), ["id", "key"]).select(  # one row for each predicate of two ids
        "id", reference(place == F.col("_lo"), place == F.col("_hi")).alias("f")).select("id", "f.*")
    hubs = entities.select("id").where(hub).union(given.where(hub).select("id")).distinct().select("id", F.inline(F.array(head, tail)))

    ids = entities.select("id").where(~hub).select("id", *[F.lit(None).cast("string").alias(c) for c in ("key", "ord", "dst")])
    dealt = given.where(~hub).unionByName(ids)
    of = Window.partitionBy("id").orderBy("key", place)
    before, after, lower = F.lag("key").over(of), F.lead("key").over(of), F.lag(place).over(of)
    numbered = ("*", F.row_number().over(of).alias("_i"), before.alias("_before"), after.alias("_after"), lower.alias("_lower"))
    listed_own = F.col("key").isNotNull()
    # References without a place come before the others and open or close no list.
    first = place.isNotNull() & (~F.col("_before").eqNullSafe(F.col("key")) | F.col("_lower").isNull())
    last = place.isNotNull() & ~F.col("_after").eqNullSafe(F.col("key"))
    pieces = F.array(F.when(F.col("_i") == 1, head), F.when(listed_own, reference(first, last)), F.when(F.col("_after").isNull(), tail))

    def objects(share: DataFrame) -> DataFrame:
        return share.repartition("id").distinct().select(*numbered).select("id", F.inline(F.array_compact(pieces)))

    shares = [dealt.where(F.pmod(F.xxhash64("id"), F.lit(SHARES)) == i) for i in range(SHARES)]
    written = [stage(objects(share)) for share in shares]

    one = entities.sparkSession.range(1)
    context = ",".join(f'"{c}"' for c in CONTEXTS)
    start = one.select(blank.alias("id"), blank.alias("key"), blank.alias("ord"), F.lit('{"@context":[').alias("before"), F.lit(context).alias("text"), F.lit('],"@graph":[').alias("after"))
    end = one.select(F.lit("\uffff").alias("id"), blank.alias("key"), blank.alias("ord"), blank.alias("before"), blank.alias("text"), F.lit("]}").alias("after"))
    # The descriptor comes first: its place is before every other id.
    rows = functools.reduce(DataFrame.unionByName, [literals, *written, listed, hubs, start, end])
    return rows.select(F.when(F.col("id") == DESCRIPTOR, F.lit("\u0001")).otherwise(F.col("id")).alias("id"), "key", "ord", "before", "text", "after")


def write_document(fragments: DataFrame, path: str) -> None:
    """Range-sort the fragments and write them as text; the files in name order are the document."""
    ordered = fragments.sort("id", "key", "ord")
    ordered.select(F.concat("before", "text", "after")).write.mode("overwrite").option("lineSep", "\n").text(path)
