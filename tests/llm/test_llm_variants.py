"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plurispark.llm import variants

SCHEMA = "doc_id long, text string, word string, n int, code int, reduced string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def texts():
    r = random.Random(13)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 11))) for _ in range(25)] + ["Straßen", "ÉCOLIERS", "aaaaaaaa", "aaaaaaab", "abababab", "q" * 700, "q" * 699 + "é"]

    def typo(w):
        k, c = r.randrange(len(w)), r.choice("abcdeéz")
        return r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w])

    out = [None, "", " . ", "short one", "Wordless, WORDLESS; wordlessİnother"]
    for _ in range(150):
        w = r.choice(base)
        out.append(" ".join([w] * r.randint(1, 40) + [typo(w) for _ in range(4)] + [typo(typo(w)) for _ in range(2)]) + "1x " + r.choice(base).upper() + "-tail")
    return out


def rows():
    out = [(i, t, "clash", 1, 2, "clash") for i, t in enumerate(texts())]
    return out + [(None, texts()[9], None, None, None, None), (None, None, None, None, None, None), out[8], out[8], (8, "another text wordless", "", 1, 1, "")]


def counts(table):
    total = Counter()
    for i, t, *_ in table:
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(total):
    out = []
    form = {}
    for w, n in total.items():
        near = [(-m, x.encode(), x) for x, m in total.items() if one_edit(w, x)]
        best = min(near, default=(0, b"", None))
        form[w] = (best[2], -best[0]) if -best[0] >= 10 * n and near else (None, None)
        out.append((w, n, len(near)))
    def root(w):
        while form[w][0]:
            w = form[w][0]
        return w
    return sorted((w, form[w][0], root(w), n, k, form[w][1]) for w, n, k in out) if total else []


def key(r):
    return r[0]


@pytest.mark.parametrize(("symbols", "bucket"), [(8, 64), (2, 1), (3, 4), (8, 1)])
def test_variants(spark, symbols, bucket):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    words = variants.word_counts(docs)
    assert {r.word: r.n for r in words.collect()} == counts(rows())
    got = variants.variants(words, symbols, bucket)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(counts(rows()))
    assert sum(r[1] is not None for r in want) > 20
    assert sorted((tuple(r) for r in got.collect()), key=key) == want


def test_chains_ties_and_small_batches(spark, monkeypatch):
    for name in ("FLUSH_WORDS", "FLUSH_CODES"):
        monkeypatch.setattr(variants, name, 40)
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "zbcdefg": 20, "abcdefz": 20, "lonelyone": 7}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert sorted((tuple(r) for r in variants.variants(words).collect()), key=key) == brute(chain)


@pytest.mark.parametrize("table", [[], [(1, None, "", 1, 1, "")], [(1, "onlyword once", "", 1, 1, "")], [(1, "alonealone alonealone", "", 1, 1, "")]])
def test_few_words(spark, table):
    got = variants.variants(variants.word_counts(spark.createDataFrame(table, SCHEMA))).collect()
    assert [tuple(r) for r in got] == brute(counts(table))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="123", min_size=0, max_size=6), min_size=1, max_size=5))
def test_neighbourhoods_are_full(words):
    for w in words:
        near = {w} | {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "123"} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "123"}
        row = np.array([[ord(c) - ord("0") for c in w]], np.uint64).reshape(1, len(w))
        assert set(variants.neighbourhood(row, 3)[0].tolist()) == set(variants.codes(pa.array(sorted(near))).tolist())
