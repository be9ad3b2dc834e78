"""Provenance documents, sidecars, artefacts and recipes."""

import json

import pytest
from pyspark.sql import functions as F

from plurispark.operators import multiverse as mv
from plurispark.operators import provenance as prov
from plurispark.sources import changelog, sidecars, tables

MANIFEST = {
    "schema_version": 1, "output_id": "fit", "universe_id": "base", "recipe": "make", "definition_version": "d", "env_version": "e",
    "data_version": "v", "decisions": {"method": "mcmc"}, "input_versions": {"catalog": "c"}, "git_sha": "abc", "git_remote": "", "lc_version": "1",
    "hermeticity": {"mechanism": "none", "fs": "", "network": "", "landlock_abi": None, "exec_allowlist_version": 1},
}


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


def test_sidecars_are_read_leniently(spark, tmp_path):
    results = tmp_path / "results"
    put(results / "base", ".fit.manifest.json", MANIFEST)
    put(results / "base", ".more.manifest.json", {**MANIFEST, "output_id": "more", "unknown": [1], "finished_at": "t", "image": {"tag": "x"}})
    put(results / "alt" / "deep", ".deep.manifest.json", {**MANIFEST, "output_id": "deep"})
    put(results / "base", ".array.manifest.json", [MANIFEST])
    put(results / "base", ".text.manifest.json", b"{not json")
    put(results / "base", ".bytes.manifest.json", b'{"output_id": "\xff\xfe"}')
    put(results / "base", ".short.manifest.json", {k: v for k, v in MANIFEST.items() if k != "recipe"})
    put(results / "base", ".empty.manifest.json", b"")
    put(results / "base", ".other.json", MANIFEST)
    got = {r["output_id"]: r for r in sidecars.read_manifests(spark, str(tmp_path)).collect()}
    assert set(got) == {"fit", "more", "deep"}
    assert (got["fit"]["started_at"], got["fit"]["image"], got["fit"]["decisions"]) == ("", None, {"method": "mcmc"})
    assert got["more"]["finished_at"] == "t" and got["more"]["image"]["tag"] == "x"
    assert sidecars.read_manifests(spark, str(tmp_path / "nowhere")).count() == 0


def test_sidecars_round_trip(spark, tmp_path):
    put(tmp_path / "results" / "base", ".fit.manifest.json", MANIFEST)
    read = sidecars.read_manifests(spark, str(tmp_path)).drop("path")
    sidecars.write_manifests(read, str(tmp_path / "copy"))
    text = (tmp_path / "copy" / "results" / "base" / ".fit.manifest.json").read_text()
    assert text.startswith('{\n  "schema_version": 1,\n') and text.endswith("}\n")
    assert not list((tmp_path / "copy" / "results" / "base").glob("*.tmp"))
    assert sidecars.read_manifests(spark, str(tmp_path / "copy")).drop("path").collect() == read.collect()


def test_an_output_is_one_file_and_siblings_stay(spark, tmp_path):
    folder = tmp_path / "results" / "base"
    for name in ("fit.tar.gz", "fit.csv", "fitter.csv", ".fit.manifest.json"):
        put(folder, name, b"old")
    rows = spark.createDataFrame([("base", "fit", "h5", b"new"), ("alt", "fit", "csv", b"other")], "universe_id string, output_id string, format string, content binary")
    sidecars.write_artifacts(rows, str(tmp_path))
    assert sorted(p.name for p in folder.iterdir()) == [".fit.manifest.json", "fit.h5", "fitter.csv"]
    assert (folder / "fit.h5").read_bytes() == b"new"
    files = {r["path"].rsplit("/results/", 1)[1] for r in tables.read_files(spark, str(tmp_path)).collect()}
    assert files == {"base/.fit.manifest.json", "base/fit.h5", "base/fitter.csv", "alt/fit.csv"}


def test_result_tables_replace_only_their_own(spark, tmp_path):
    ddl = "universe_id string, output_id string, v int"
    tables.sink_results(spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], ddl), str(tmp_path))
    tables.sink_results(spark.createDataFrame([("a", "x", 3)], ddl), str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "results")).collect()
    assert {(r["output_id"], r["v"]) for r in got} == {("x", 3), ("y", 2)}


def test_change_logs(spark, tmp_path):
    (tmp_path / "log").write_text("h2\0newer\0Bo\0\x002026-01-02\n\nb.txt\na.txt\nh1\0subject | x\0Ada\0ada@example.org\x002026-01-01\na.txt\nh0\0no paths\0Ada\0\x002026-01-01\n")
    commits, touched = changelog.read_change_log(spark, str(tmp_path / "log"))
    assert sorted(tuple(r) for r in commits.collect()) == [
        (0, "h0", "no paths", "Ada", "", "2026-01-01"), (1, "h1", "subject | x", "Ada", "ada@example.org", "2026-01-01"), (2, "h2", "newer", "Bo", "", "2026-01-02")]
    assert sorted(tuple(r) for r in touched.collect()) == [(1, "a.txt"), (2, "a.txt"), (2, "b.txt")]
    commits, touched = changelog.read_change_log(spark, str(tmp_path / "absent"))
    assert commits.count() == touched.count() == 0


@pytest.fixture(scope="module")
def project(spark):
    keys = [(u, o) for u in ("alt", "base") for o in ("first", "second")]
    tasks = spark.createDataFrame([(u, o, f"/p/results/{u}/{o}.csv", {"method": "alpha"}) for u, o in keys], "universe_id string, output_id string, output_path string, decisions map<string,string>")
    inputs = spark.createDataFrame(
        [(u, "first", "catalog", "/p/data/catalog.csv", None) for u in ("alt", "base")] + [(u, "second", "first", f"/p/results/{u}/first.csv", "first") for u in ("alt", "base")]
        + [("base", "second", "sky", "/far/sky.fits", None)], "universe_id string, output_id string, input_name string, path string, produced_by string")
    made = spark.createDataFrame(
        [(u, o, f"make {o}", f"v{u}{o}", {"method": "alpha", "gone": 'a "b"'}, "abcdef0123", "https://example.org/r", "0.4.2", "", f"2026-08-19T10:0{i}:00.000+00:00", None) for i, (u, o) in enumerate(keys)],
        "universe_id string, output_id string, recipe string, data_version string, decisions map<string,string>, git_sha string, git_remote string, lc_version string, "
        "started_at string, finished_at string, image struct<tag:string,id:string,archive:string,arch:string>")
    writes = spark.createDataFrame([(u, o, "Ada Lovelace", "ada@example.org") for u, o in keys], "universe_id string, output_id string, author string, email string")
    files = spark.createDataFrame([("uv.lock", "1", "aa"), ("data/catalog.csv", "2", "bb"), ("README.md", "3", "cc")], "path string, content_size string, sha256 string")
    about = prov.Project("4b7b5c1e-0000-4000-8000-000000000000", "demo", "MIT", root="/p", engine="maker", engine_page="https://example.org/maker/")
    return lambda: prov.provenance(about, tasks, inputs, made, writes, files)


def test_document_describes_the_project_and_is_deterministic(project):
    def render(seed):
        fragments = [df.orderBy(F.rand(seed)) for df in project()]
        rows = prov.document(*fragments).collect()
        return "".join(r["before"] + r["text"] + r["after"] for r in sorted(rows, key=lambda r: (r["id"], r["key"], r["ord"])))

    once = render(1)
    assert once == render(2)
    whole = json.loads(once)
    assert whole["@context"] == list(prov.CONTEXTS)
    assert whole["@graph"][0] == {"@id": prov.DESCRIPTOR, "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": prov.CRATE}}
    graph = {e["@id"]: e for e in whole["@graph"]}
    assert len(graph) == len(whole["@graph"])
    assert graph["./"]["mainEntity"] == {"@id": "analysis.yaml"}
    files = sorted(i for i, e in graph.items() if "File" in (e["@type"] if isinstance(e["@type"], list) else [e["@type"]]))
    assert [p["@id"] for p in graph["./"]["hasPart"]] == files
    root, first = graph["./"], graph["results/base/first.csv"]
    assert root["datePublished"] == "2026-08-19T10:03:00.000+00:00" and root["author"] == {"@id": "mailto:ada@example.org"}
    assert root["license"] == {"@id": "#license"} and graph["#license"]["name"] == "MIT"
    assert len(root["mentions"]) == 5 and len(root["conformsTo"]) == 4
    assert first["@type"] == "File" and first["version"] == "vbasefirst" and first["subjectOf"] == {"@id": "results/base/.first.manifest.json"}
    assert [s["@id"] for s in graph["analysis.yaml"]["step"]] == ["#step-first", "#step-second"] and graph["#step-second"]["position"] == 1
    action = next(e for e in graph.values() if e["@type"] == "CreateAction" and e["name"] == "run of `second` in universe `base`")
    assert [o["@id"] for o in action["object"]] == ["uv.lock", "results/base/first.csv", "file:///far/sky.fits", "#value-base-second-gone", "#value-base-second-method"]
    assert "startTime" not in action and action["instrument"] == {"@id": "https://example.org/r#tool/second"}
    assert "exampleOfWork" not in graph["#value-base-second-gone"] and graph["#value-base-second-gone"]["value"] == 'a "b"'
    assert graph["data/catalog.csv"]["sha256"] == "bb" and "sha256" not in graph["file:///far/sky.fits"]
    assert graph["#organize-abcdef0"]["instrument"] == {"@id": "https://example.org/maker/0.4.2/"}
    referred = {r["@id"] for e in graph.values() for v in e.values() for r in (v if isinstance(v, list) else [v]) if isinstance(r, dict)}
    assert referred - set(graph) == {prov.WORKFLOW_PROFILE, prov.CRATE}


def test_references_take_no_digest_again(project):
    """Ids are stored with what was made and with the runs, so no filter of a reference computes them once more for each row."""
    plan = project()[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "_run" in plan and "sha1(" not in plan


def test_json_texts_keep_brackets_and_quotes(spark):
    texts = ["[a]", "]", "[", "", 'a "b"', "\\", "é\n[", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", prov.json_text(F.col("t")).alias("j")).orderBy("i").collect()
    assert [None if r["j"] is None else json.loads(r["j"]) for r in got] == texts


def test_single_remote(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), ("b", "x"), ("b", "y"), ("c", "")], "k string, git_remote string")
    assert {r["k"]: r["remote"] for r in prov.single_remote(df, ["k"]).collect()} == {"a": "x", "b": "", "c": ""}


def test_multiverse_equals_one_run_per_universe(spark):
    data = spark.createDataFrame([(i % 3, float(i), None if i % 5 == 0 else i % 2 == 0) for i in range(40)], "g int, x double, flag boolean")
    universes = spark.createDataFrame([(f"{c}-{v}", {"cut": c, "scale": v}) for c in ("all", "flagged", "none") for v in ("one", "ten")], "universe_id string, decisions map<string,string>")
    predicates = {"all": F.lit(True), "flagged": F.col("flag"), "none": F.lit(False)}
    scales = {"one": F.col("x"), "ten": F.col("x") * 10}
    scale = mv.Value("scale", scales)
    measures = {"n": mv.Measure("count"), "total": mv.Measure("sum", scale), "low": mv.Measure("min", scale), "top": mv.Measure("max", F.col("x")), "mean": mv.Measure("avg", scale)}
    got = {r["universe_id"]: tuple(r)[1:] for r in mv.multiverse(data, universes, [mv.Keep("cut", predicates)], measures).collect()}
    for c, p in predicates.items():
        for v, s in scales.items():
            want = data.where(p).agg(F.count("*"), F.sum(s), F.min(s), F.max("x"), F.avg(s)).first()
            assert got[f"{c}-{v}"] == tuple(want)
    grouped = mv.multiverse(data, universes, [mv.Keep("cut", predicates)], measures, by=["g"])
    assert grouped.count() == 12


def test_recipes_may_only_use_what_they_declare(spark):
    data = {"items": spark.range(5)}
    universes = spark.createDataFrame([(f"u{i}", {"cut": str(i % 2), "other": str(i)}) for i in range(6)], "universe_id string, decisions map<string,string>")

    @mv.recipe(inputs=["items"], decisions=["cut"])
    def good(inputs, decisions):
        return inputs["items"].where(F.col("id") >= decisions["cut"].cast("int") * 3).groupBy("arm_id").count()

    @mv.recipe(inputs=["items"], decisions=["cut"])
    def bad(inputs, decisions):
        return inputs["items"].where(decisions["other"] == "1")

    assert {r["universe_id"]: r["count"] for r in mv.run_recipe(good, data, universes).collect()} == {f"u{i}": 5 if i % 2 == 0 else 2 for i in range(6)}
    with pytest.raises(mv.RecipeError, match="undeclared decision `other`"):
        mv.run_recipe(bad, data, universes)
    with pytest.raises(mv.RecipeError, match="no table"):
        mv.run_recipe(good, {}, universes)


def test_arms_beyond_one_plan_are_all_evaluated(spark, monkeypatch):
    monkeypatch.setattr(mv, "ARMS_PER_PLAN", 3)
    universes = spark.createDataFrame([(f"u{i}", {"k": str(i)}) for i in range(8)], "universe_id string, decisions map<string,string>")

    @mv.recipe(inputs=["items"], decisions=["k"])
    def at_least(inputs, decisions):
        return inputs["items"].where(F.col("id") >= decisions["k"].cast("int")).groupBy("arm_id").count()

    assert {r["universe_id"]: r["count"] for r in mv.run_recipe(at_least, {"items": spark.range(8)}, universes).collect()} == {f"u{i}": 8 - i for i in range(8)}


def test_batch_recipes_stream_through_pandas(spark):
    double = mv.batch_recipe(lambda pdf: pdf.assign(id=pdf["id"] * 2), "id long")
    assert double(spark.range(10)).agg(F.sum("id")).first()[0] == 90


def test_references_of_a_document_are_dealt_once(spark, capsys):
    entities = spark.createDataFrame([("./", ["Dataset"], {}), ("a", ["File"], {"name": '"a"'}), ("b", ["Thing"], {}), (None, ["Thing"], {})], "id string, types array<string>, props map<string,string>")
    refs = [("a", "one", "b", ""), ("a", "one", "b", ""), ("a", "some", "x", "2"), ("a", "some", "y", "1"), ("a", "some", "y", "1"), ("only", "one", "a", ""), ("./", "some", "z", "2"), ("./", "some", "y", "1"), ("./", "some", "z", "2")]
    found = prov.document(entities, spark.createDataFrame(refs, "src string, predicate string, dst string, ord string"))
    rows = [tuple(r) for r in found.collect()]
    text = "".join("".join(r[3:]) for r in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])) if r[0] is not None)
    graph = {e["@id"]: e for e in json.loads(text)["@graph"]}
    assert graph["a"] == {"@id": "a", "@type": "File", "name": "a", "one": {"@id": "b"}, "some": [{"@id": "y"}, {"@id": "x"}]}
    assert graph["only"] == {"@id": "only", "one": {"@id": "a"}} and graph["b"] == {"@id": "b", "@type": "Thing"}
    assert graph["./"]["some"] == [{"@id": "y"}, {"@id": "z"}] and graph["./"]["hasPart"] == {"@id": "a"}
    assert len(rows) == len(set(rows))
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(") <= 10  # in the first and the final plan
