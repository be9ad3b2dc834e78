"""The Merkle manifest against a tree built in one go."""

import hashlib
import random
import zlib

import pytest

from plurispark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _group string, _node string, _at int, root string, leaf string"


def rows():
    r = random.Random(3)
    out = [(i, "line\n" * r.randint(0, 4) + f"text {i}", "en", r.choice(["a", "b", "ä", "Z", None]), i, "c", "c", 1, "c", "c") for i in range(90)]
    out += [(200 + i, f"one\nof {i}", None, f"site{i}", None, None, None, None, None, None) for i in range(11)]
    out += [(None, "no id\n", "fr", "a", 4, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    out += [(300, "", "", "", 0, None, None, None, None, None), (301, "x" * 200_000 + "\n\r\n", "en", "b", None, None, None, None, None, None), (302, None, "en", "b", 1, None, None, None, None, None)]
    return out + [out[5], out[5], (5, "another\ntext", "en", out[5][3], 1, None, None, None, None, None)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """The root, and of each leaf its steps: place and siblings."""
    paths, of = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        runs = [range(k, min(k + 3, len(leaves))) for k in range(0, len(leaves), 3)]
        for run in runs:
            for k in run:
                for leaf in of[k]:
                    paths[leaf].append((k - run[0], [leaves[j] for j in run if j != k]))
        leaves, of = [sha("".join(leaves[k] for k in run)) for run in runs], [[x for k in run for x in of[k]] for run in runs]
    return leaves[0], paths


def brute(table):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in table:
        now = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            now = text.replace("\n", "")
        leaf, after = (sha(frame((doc_id, source, lang, n_chars, t))) for t in (text, now))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, after, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {name: tree([x[2] for x in sorted(groups[name])]) for name in names}
    root, above = tree([made[name][0] for name in names])
    out = []
    for name, upper in zip(names, above):
        for (_, _, leaf, after, doc_id), path in zip(sorted(groups[name]), made[name][1]):
            siblings, folded = "", after
            for place, others in path + upper:
                siblings += "".join(others)
                folded = sha("".join(others[:place]) + folded + "".join(others[place:]))
            out.append((doc_id, leaf, made[name][0], root, sha(siblings), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, height):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = merkle.document_manifest(docs, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows())


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_small_tables(spark, n):
    docs = spark.createDataFrame(rows()[:n], SCHEMA)
    assert sorted((tuple(r) for r in merkle.document_manifest(docs).collect()), key=str) == brute(rows()[:n])


def test_empty_table(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100])
def test_witnesses_grow_with_the_sequence(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    root, paths = tree([x.hex() for x in leaves])
    frontier = merkle.Frontier()
    for i, leaf in enumerate(leaves):
        frontier.append(leaf)
        assert all(bytes(w) == b"" or merkle.fold(leaves[k], bytes(w)) for k, w in enumerate(frontier.witness))
        assert max(len(nodes) for nodes in frontier.open) < 3 and len(frontier.witness) == i + 1
    assert frontier.close().hex() == root
    for leaf, witness, path in zip(leaves, frontier.witness, paths):
        assert merkle.fold(leaf, bytes(witness)).hex() == root
        assert [(p, [o.hex() for o in others]) for p, others in merkle.steps(bytes(witness))] == path
