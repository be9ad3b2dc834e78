"""Digests and texts against Python's own hashlib, json and uuid."""

import hashlib
import json
import random
import uuid

from pyspark.sql import functions as F

from plurispark.functions import hashing, paths, recipes, records
from plurispark.operators import digests


def frame(label, data):
    return label.encode() + b"\0" + str(len(data)).encode() + b"\0" + data


def test_canonical_json_is_pythons(spark):
    maps = [
        {"b": "1", "a": "x"}, {}, {"ü": 'quote " back \\ slash'}, {"k": "\n\t\r\b\f\x01\x7f"}, {"emoji": "😀é "},
        {"z": "", "a\u0000b": "\\u000a literal", "é": "mixed ascii ünd ☃"},
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    got = {r["i"]: r["j"] for r in df.select("i", hashing.canonical_json(F.col("m")).alias("j")).collect()}
    for i, m in enumerate(maps):
        assert got[i] == json.dumps(m, sort_keys=True, separators=(",", ":"))


def test_definition_version_moves_with_each_part_and_not_with_map_order(spark):
    def digest(recipe, decisions, fmt):
        row = spark.createDataFrame([(recipe, decisions, fmt)], "r string, d map<string,string>, f string")
        return row.select(hashing.definition_version(F.col("r"), F.col("d"), F.col("f")).alias("v")).first()["v"]

    base = digest("make é", {"a": "1", "b": "2"}, "csv")
    want = hashlib.sha256(frame("recipe", "make é".encode()) + frame("decisions", b'{"a":"1","b":"2"}') + frame("format", b"csv"))
    assert base == f"sha256:{want.hexdigest()}"
    assert base == digest("make é", {"b": "2", "a": "1"}, "csv")
    others = {digest("make", {"a": "1", "b": "2"}, "csv"), digest("make é", {"a": "2", "b": "1"}, "csv"), digest("make é", {"a": "1", "b": "2"}, "h5")}
    assert base not in others and len(others) == 3
    # A boundary cannot shift between fields.
    assert digest("ab", {}, "c") != digest("a", {}, "bc")


def test_env_version_covers_unset_settings_and_null_image(spark):
    row = spark.createDataFrame([(b"lock", b"3.12", {"no-build": "true"}, None)], "l binary, p binary, s map<string,string>, i string")
    got = row.select(hashing.env_version(F.col("l"), F.col("p"), F.col("s"), F.col("i")).alias("v")).first()["v"]
    settings = json.dumps({k: True if k == "no-build" else None for k in hashing.INSTALL_SETTINGS}, sort_keys=True, separators=(",", ":"))
    want = frame("uv.lock", b"lock") + frame("python-version", b"3.12") + frame("install-settings", settings.encode()) + frame("image", b"null")
    assert got == f"sha256:{hashlib.sha256(want).hexdigest()}"


def test_stable_uuid(spark):
    dsid, kind = "4b7b5c1e-0000-4000-8000-000000000000", "action/baseline/first"
    got = spark.range(1).select(hashing.stable_uuid(F.lit(dsid), F.lit(kind)).alias("u")).first()["u"]
    assert got == f"urn:uuid:{uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, dsid), kind)}"


def tree(files):
    h = hashlib.sha256(b"dir:")
    for path, content in sorted(files.items()):
        h.update(b"path:" + path.encode() + b"\0data:" + content + b"\0")
    return f"sha256:{h.hexdigest()}"


def test_tree_digest_streams_whole_folders(spark, monkeypatch):
    monkeypatch.setattr(digests, "PIECE_BYTES", 7)
    rng = random.Random(5)
    folders = {
        f"d{i}": {f"sub/{j % 3}/f{j}.é": rng.randbytes(rng.choice([0, 1, 6, 7, 8, 30])) for j in range(i * 4 + 1)} for i in range(6)
    }
    folders["renamed"] = {"b": b"x"}
    folders["original"] = {"a": b"x"}
    folders["unfetched"] = {"a": b"x", "b": b"/annex/objects/SHA256E-s1--00"}
    rows = [(d, p, c) for d, files in folders.items() for p, c in files.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "dir string, path string, content binary").repartition(5)
    got = {r["dir"]: r["data_version"] for r in digests.tree_digest(df).collect()}
    assert got.pop("unfetched") is None
    assert got == {d: tree(f) for d, f in folders.items() if d != "unfetched"}
    assert got["renamed"] != got["original"] != f"sha256:{hashlib.sha256(b'x').hexdigest()}"


def test_pointer_is_a_prefix_and_small(spark):
    rows = [(0, b"/annex/objects/x"), (1, b"see /annex/objects/x"), (2, b"/annex/objects/" + b"x" * 40000), (3, b"")]
    df = spark.createDataFrame(rows, "i int, c binary")
    got = {r["i"]: r["p"] for r in df.select("i", records.is_pointer(F.col("c"), F.octet_length("c")).alias("p")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}


def test_key_integrity(spark):
    digest = "ab" * 32
    keys = [f"SHA256E-s12--{digest}.txt", f"SHA256-s7--{digest}", "MD5E-s3--ff.csv", "WORM--x", f"SHA256E-s12--{digest}txt"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [tuple(r["v"]) for r in df.select(records.key_integrity(F.col("k")).alias("v")).collect()]
    assert got == [("12", digest), ("7", digest), ("3", None), (None, None), ("12", None)]


def test_paths(spark):
    df = spark.createDataFrame([("/r/a/x.tar.gz",), ("x.csv",), ("/r/.python-version",), ("/q/uv.lock",), ("/r/noext",)], "p string")
    got = df.select(
        paths.sidecar_path(F.col("p")).alias("s"), paths.declared_path(F.lit("/r"), F.col("p")).alias("d"),
        paths.media_type(F.col("p")).alias("m"), paths.ancestors(F.col("p")).alias("a"), paths.parent(F.col("p")).alias("f"),
    ).collect()
    assert [r["s"] for r in got][:2] == ["/r/a/.x.manifest.json", ".x.manifest.json"]
    assert [r["d"] for r in got] == ["a/x.tar.gz", "x.csv", ".python-version", "/q/uv.lock", "noext"]
    assert [r["m"] for r in got] == ["", "text/csv", "text/plain", "application/toml", ""]
    assert got[0]["a"] == ["/r/a/x.tar.gz", "/r/a", "/r"] and got[1]["a"] == ["x.csv"]
    assert [r["f"] for r in got] == ["/r/a", "", "/r", "/q", "/r"]


def test_render_recipe(spark):
    cases = {
        "fit {inputs.cat} {inputs} -m {decisions.m} {output} {{x}}": ("fit data/c data/c data/m -m mcmc out.csv {x}", []),
        "{inputs.no}": (None, ["{inputs.no}"]), "{output:>8} {decisions.q}": (None, ["{output:>8}", "{decisions.q}"]),
        "lone } brace": (None, ["}"]), "plain": ("plain", []),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    item = lambda n, p: F.struct(F.lit(n).alias("name"), F.lit(p).alias("path"))
    made = recipes.render_recipe(F.col("t"), F.array(item("cat", "data/c"), item("mask", "data/m")), F.create_map(F.lit("m"), F.lit("mcmc")), F.lit("out.csv"))
    for row in df.select("t", made.alias("r")).collect():
        assert (row["r"]["recipe"], row["r"]["errors"]) == cases[row["t"]]
