"""Substring dedup by subtrees against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from plurispark.llm import subtrees

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, _text string, _key string, owner int, news int, gone string"


def texts():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(200)] + ["ÄÖ", "naïve", "Σ", "x" * 90]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(150), prose(40), prose(13)
    out = [None, "", " \t\n", "one", prose(12), line, line + " end", "\x0b" + line.replace(" ", "\n\t"), base, base, base.upper(), prose(9000)]
    for k in range(8):
        w = base.split(" ")
        for _ in range(k):
            w[r.randrange(len(w))] = f"edit{k}"
        out.append("  ".join(w))
    out += [prose(r.randint(0, 30)) + "\n" + passage + " " + prose(r.randint(0, 30)) for _ in range(12)]
    out += [passage + " " + prose(20) for _ in range(3)] + [prose(20) + " " + passage for _ in range(3)]
    out += ["same words " * 40, "same words " * 30 + "end", "a " * 60, "a " * 25, "b " + "a " * 13, prose(5000) + " " + base + " " + prose(3)]
    out += [passage[: len(passage) // 2], passage + " " + base, passage + "x " + base[1:]]
    return out


def rows():
    t = texts()
    out = [(i, x, "clash", "clash", 1, 2, "c") for i, x in enumerate(t)]
    r = random.Random(4)
    r.shuffle(out)
    return out + [(None, t[8], None, None, None, None, None), (None, "only " + t[8], None, None, None, None, None), (None, None, None, None, None, None, None), out[3], (t.index(t[8]), t[8] + " tail", *out[0][2:]), (7, t[20], *out[0][2:])]


def brute(table, window=13):
    split = [(i, WORD.findall(t or "")) for i, t, *_ in table]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), sum(k - 1 not in gone for k in gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "least"), [(8, 16), (100_000, 1), (30, 2)])
def test_subtree_dedup(spark, share, least):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = subtrees.subtree_dedup(docs, with_kept=True, share=share, least=least)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "kept"]
    want = [(*r[:5], None if r[0] is None else r[5]) for r in brute(rows())]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_small_batches_give_the_same(spark, monkeypatch):
    for name in ("FLUSH_WORDS", "FLUSH_ANCHORS", "FLUSH_SUFFIXES", "_CHUNK"):
        monkeypatch.setattr(subtrees, name, 50)
    got = subtrees.subtree_dedup(spark.createDataFrame(rows(), SCHEMA).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((r[:5] for r in brute(rows())), key=str)


@pytest.mark.parametrize("table", [[], [(1, "short", "", "", 1, 1, "")], [(None, None, "", "", 1, 1, "")]])
def test_nothing_to_remove(spark, table):
    got = subtrees.subtree_dedup(spark.createDataFrame(table, SCHEMA)).collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.n_spans) for r in got] == [(i, len(WORD.findall(t or "")), 0, 0) for i, t, *_ in table]


def test_frequent_prefixes_are_those_over_their_share(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over a " + " ".join(f"w{k}{j}" for j in range(13))) for k in range(40)], "_rank int, _text string")
    found = subtrees.frequent_prefixes(docs, parts=2, share=20, least=1)
    assert {k: len(v) for k, v in found.items()} == {7: 1, 10: 0}


def test_subtree_and_its_deep_nodes():
    r = np.random.default_rng(1)
    words = r.integers(0, 2, (300, 6)).astype(np.uint64)
    prefix = r.integers(0, 3, 300).astype(np.uint64)
    order, depth = subtrees.subtree(prefix, words, 7)
    leaves = [(int(prefix[i]), *map(int, words[i])) for i in order]
    assert sorted(order.tolist()) == list(range(300)) and leaves == sorted(leaves)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    assert depth.tolist() == [0] + [0 if (n := shared(a, b)) == 0 else n + 6 for a, b in zip(leaves, leaves[1:])]
    for deep in (7, 10, 13):
        first, size = subtrees.deep_nodes(depth, deep)
        groups = {}
        for leaf in leaves:
            groups.setdefault(leaf[: deep - 6], []).append(leaf)
        assert [leaves[a : a + n] for a, n in zip(first, size)] == [g for _, g in sorted(groups.items()) if len(g) > 1]
