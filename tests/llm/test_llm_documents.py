"""Operators over documents against brute force on small fixtures with every awkward row."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plurispark.llm import leaks, lengths, lines, near, packing, quality, suffixes
from plurispark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _text string, node string, key int, part int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def texts():
    """Texts with copies, near copies, shared passages, awkward characters and sizes."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["ÄÖ", "naïve", "<|endoftext|>", "été"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    out = [None, "", " \t\n ", "one", "two words", "A b", "a B", base, base, base.upper(), passage, passage + " tail", prose(9000)]
    for k in range(12):
        w = base.split(" ")
        for _ in range(k):
            w[r.randrange(len(w))] = "edit%d" % k
        out.append(" ".join(w))
    out += [prose(30) + "\n" + passage + "\n" + prose(30) for _ in range(6)]
    out += ["menu home\n" + prose(25) + "\n Menu HOME \n\n" + prose(5) for _ in range(12)]
    out += ["aaaa" * 40, "aaaa" * 40 + "b", "x" * 49, "x" * 50, "x" * 51, "same words " * 30, "a  b   c \x0b d", "end ", "\x1cq w", passage[:200]]
    return out


def rows():
    out = [(i, t, "en", "s%d" % (i % 2), 1, "clash", "clash", 1, 2) for i, t in enumerate(texts())]
    out += [(None, texts()[7], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out + [out[7], out[30]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(docs, n, percent):
    sets = {(i, t): shingle_set(t, n) for i, t, *_ in rows()}
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, s) for (i, _), s in sets.items() if i is not None and s]
    for i, a in known:
        for j, b in known:
            if i < j and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted(((i, len(shingle_set(t, n)), None if i is None else find(i)) for i, t, *_ in rows()), key=str)
    assert sorted((tuple(r) for r in near.jaccard_join(docs, n, percent).collect()), key=str) == want


def test_jaccard_join_takes_rounds_over_large_groups(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(99999)}" for _ in range(80)]
    made = []
    for i in range(150):  # near copies that drift away from the first one
        if i % 3 == 0:
            base[r.randrange(80)] = f"new{i}"
        made.append((i, " ".join(base)))
    sets = [shingle_set(t, 4) for _, t in made]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if v in (x, y) else v for v in root]
    got = near.jaccard_join(spark.createDataFrame(made, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_rows_of_one_id_are_one_document_or_rows_of_their_own(spark):
    r = random.Random(8)
    a, b, c = (" ".join(f"w{r.randrange(9999)}" for _ in range(60)) for _ in range(3))
    made = [(3, a), (5, a + " end"), (5, b), (7, b + " end"), (9, c), (9, ""), (None, a)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = near.jaccard_join(docs, 4, 85).collect()
    assert sorted((x.doc_id or 0, x.n_shingles, x.component_id) for x in got) == [
        (0, 57, None), (3, 57, 3), (5, 57, 3), (5, 58, 3), (7, 58, 3), (9, 0, 9), (9, 57, 9)]
    by_row = near.jaccard_join(docs, 4, 85, by_row=True).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in by_row if x.doc_id) == [(3, 57, 3), (5, 57, 5), (5, 58, 3), (7, 58, 5), (9, 0, 9), (9, 57, 9)]
    keys = {(x.doc_id, x.n_shingles): x.text_key for x in by_row}
    assert keys[3, 57] == keys[None, 57] and len(set(keys.values())) == 6


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(7, 7)]
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {n: x for n, x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: x for n, x in root.items() if any(n in e for e in links if e[0] != e[1])}


def test_suffix_dedup(docs):
    first = {}
    for i, t, *_ in rows():
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    want = []
    for i, t, *_ in rows():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in suffixes.suffix_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 1000


def test_suffix_dedup_of_hot_anchors(docs):
    assert sorted(map(str, suffixes.suffix_dedup(docs, hot=0).collect())) == sorted(map(str, suffixes.suffix_dedup(docs).collect()))


def test_rims_of_a_passage_in_different_texts_do_not_meet_in_one_part(spark):
    r = random.Random(6)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, parts = prose(120), 24
    made = [prose(60) + passage + prose(60) for _ in range(3000)]
    texts = spark.createDataFrame([(i, i, t) for i, t in enumerate(made)], "_key long, _rank long, _text string").repartition(4)
    news = suffixes._by_owner(suffixes.met_regions(suffixes.sent_regions(texts, parts, 8), parts, 8), suffixes._NEWS, "news")
    sent = suffixes.sent_rims(texts.join(news, F.col("_key") == F.col("owner")), parts, 8).where(F.col("part") < parts)
    size = [n for _, n in sent.groupBy("part").agg(F.sum(F.octet_length("body"))).collect()]
    assert max(size) < 0.25 * sum(size)
    got = suffixes.suffix_dedup(texts.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text"))).collect()
    first, want = {}, {}
    for i, t in enumerate(made):
        gone = [first.setdefault(t[p : p + 50], i) < i for p in range(len(t) - 49)]
        want[i] = sum(any(gone[max(p - 49, 0) : p + 1]) for p in range(len(t)))
    assert {x.doc_id: x.n_removed for x in got} == want


def test_deep_shallow_orders_suffixes():
    r = random.Random(3)
    data = b"".join(r.choice([b"abracadabra" * 9, b"zz", bytes(r.randrange(97, 99) for _ in range(40))]) for _ in range(60))
    starts = np.arange(len(data) - 50)
    order, equal = suffixes.deep_shallow(data, starts)
    found = [data[s : s + 50] for s in starts[order]]
    assert found == sorted(found)
    assert equal.tolist() == [False] + [a == b for a, b in zip(found, found[1:])]


def brute_leaks(docs, items, percent=80):
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, t in docs:
        s = grams(words(t))
        for i, x in items:
            m = Counter(grams(words(x)))
            size = sum(m.values())
            for start in range(max(len(s) - size, 0) + 1) if s and size else ():
                w = Counter(s[start : start + size])
                both = sum((w & m).values())
                if 100 * both >= percent * (sum(w.values()) + size - both):
                    out[d, i] = max(out.get((d, i), 0), both / (sum(w.values()) + size - both))
    return out


def test_leaks(spark, docs):
    r = random.Random(9)
    made = [w for t in texts()[:10] for w in words(t)]
    item = " ".join(r.choice(made) for _ in range(40))
    edited = item.split(" ")
    edited[1] = "changed"
    short = " ".join(item.split(" ")[:3])
    items = [(1, item), (2, item + " more of it here"), (3, short), (4, None), (5, ""), (1, item), (None, item), (6, "go on " * 12)]
    extra = [(900, "before " + item + " after"), (901, "x " * 50 + " ".join(edited) + " y" * 60), (902, item[: len(item) // 2]), (903, item.upper()), (904, "go on " * 40)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    named = [(i, x) for i, x in items if i is not None]
    want = brute_leaks([(i, t) for i, t, *_ in rows() if i is not None] + extra, named)
    found = leaks.find_leaks(both.withColumn("fp", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
    assert {900, 901, 903, 904} <= {d for d, _ in want} and 902 not in {d for d, _ in want}


def test_repeated_shingles_do_not_hide_a_leak(spark):
    """One shingle held many times decides most bits of a fingerprint; such pairs must still meet."""
    r = random.Random(11)
    items, docs = [], []
    for k in range(25):
        own = [f"q{k}w{i}" for i in range(120)]
        held = r.choice("abc")
        items.append((k, " ".join(own + [held] * 14)))
        docs.append((k, " ".join(["before", *own, *([r.choice("def")] * 14), "after"])))  # similarity 116 / 144
        docs.append((100 + k, " ".join([*own[:90], *([held] * 14)])))
        docs.append((200 + k, " ".join([*(f"x{i}" for i in range(9)), *own, *([held] * 30)])))
    want = brute_leaks(docs, items)
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) == 50 and max(x.hamming for x in found) > leaks.RADIUS
    assert {(x.doc_id, x.item_id): round(x.similarity, 9) for x in found} == {k: round(v, 9) for k, v in want.items()}


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    r = random.Random(4)
    base = r.getrandbits(63)
    flips = [sum(1 << b for b in r.sample(range(63), k)) for k in range(20) for _ in range(5)]
    filed = leaks.near_blocks(spark.createDataFrame([(1, base)], "item long, fp long"), 19).select("_b", "_value")
    asked = spark.createDataFrame([(i, base ^ f) for i, f in enumerate(flips)], "i long, fp long")
    met = None
    for b in range(leaks.BLOCKS):
        hit = asked.select("i", F.lit(b).alias("_b"), leaks.block(F.col("fp"), b).alias("_value")).join(filed, ["_b", "_value"]).select("i")
        met = hit if met is None else met.union(hit)
    assert met.distinct().count() == len(flips)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_is_an_exact_round_trip(docs):
    encode = tokenizer()
    want = Counter()
    for i, t, *_ in rows():
        want[i, tuple(encode.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    pieces = packing.pack(docs).collect()
    by_doc = Counter()
    for (i, ids), n in want.items():
        by_doc[i, len(ids)] += n
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    assert Counter({(i, n): c for (i, n), c in by_doc.items()}) == Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)
    crcs = {(p.doc_id, p.doc_tokens, p.start, p.length): p.ids_crc32 for p in pieces}
    for (i, ids), _ in want.items():
        if i is not None:
            for (d, n, start, length), crc in crcs.items():
                if (d, n) == (i, len(ids)):
                    assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        total = sum(n for _, n in held)
        assert total <= 2048 and (total & (total - 1)) == 0  # no sequence needs padding


def test_hilbert_keys_walk_the_cube():
    bits, dims = 3, 3
    points = np.array([[(i >> (bits * d)) & 7 for d in range(dims)] for i in range(1 << (bits * dims))])
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys) == list(range(len(points)))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_length_histogram(spark, docs):
    encode = tokenizer()
    sizes = sorted(len(encode.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows())
    got = lengths.suffix_sums(lengths.histogram(lengths.token_counts(docs)))
    for r in got.collect():
        n = r.n_tokens
        assert r.n_docs == sizes.count(n)
        assert (r.docs_over, r.tokens_over) == (sum(s > n for s in sizes), sum(s for s in sizes if s > n))
        assert r.tokens_truncated == sum(min(s, n) for s in sizes)
        assert r.quantile == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    limits = spark.createDataFrame([(x,) for x in (0, 1, 5, 77, 1024, 10**6)], "limit long")
    for r in lengths.at_limits(got, limits).collect():
        assert r.tokens_truncated == sum(min(s, r.limit) for s in sizes)


def test_line_dedup(docs):
    form = lambda x: x.strip(" \t\r\x0b\x0c").translate(LOWER)
    pages, counts = Counter(), Counter()
    for _, t, _, host, *_ in rows():
        pages[host] += 1
        counts.update({(host, f) for f in map(form, t.split("\n")) if f} if t is not None else ())
    bad = {k for k, n in counts.items() if n >= 5 and n * 100 >= pages[k[0]] * 20}
    assert any(f == "menu home" for _, f in bad)
    want = []
    for i, t, _, host, *_ in rows():
        kept = None if t is None else "\n".join(x for x in t.split("\n") if (host, form(x)) not in bad)
        want.append((i, kept, 0 if t is None else t.count("\n") + 1))
    got = lines.line_dedup(docs, ratio_percent=20, min_pages=5)
    assert sorted(((r.doc_id, r.text, r._n_lines) for r in got.collect()), key=str) == sorted(want, key=str)
    assert set(docs.columns) < set(got.columns)


def test_quality_rules(docs):
    form = lambda x: x.strip(" \t\r\x0b\x0c").translate(LOWER)
    texts_of, counts = Counter(), Counter()
    for host, t in {(r[3], r[1]) for r in rows()}:
        texts_of[host] += 1
        counts.update({(host, f) for f in map(form, t.split("\n")) if f} if t is not None else ())
    bad = {k for k, n in counts.items() if n >= 5 and n * 100 >= texts_of[k[0]] * 10}
    want = []
    for i, t, _, host, *_ in rows():
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(grams)
        repeated = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)}
        solid = [x for x in (t or "").split("\n") if WORD.search(x)]
        left = len(WORD.findall("\n".join(x for x in (t or "").split("\n") if (host, form(x)) not in bad)))
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(solid) - len(set(solid)), len(repeated), failed,
                     not failed and 100 * left >= 50 * len(w), left))
    got = quality.quality_rules(docs, limit_docs=5).drop("text_left")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_line_dedup_cuts_what_a_twentieth_of_a_host_carries(spark):
    made = [(i, f"own {i}\n" + ("menu" if i < 21 else "quoted" if i < 30 else "x"), "big") for i in range(300)]
    made += [(1000 + i, f"own {i}\n" + ("menu" if i < 5 else "quoted" if i < 9 else f"x {i}"), "small") for i in range(60)]
    got = lines.line_dedup(spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)).collect()
    cut = {r.doc_id for r in got if r._n_cut}
    assert cut == set(range(21)) | set(range(30, 300)) | set(range(1000, 1005))


def test_quality_rules_limit_is_a_number_of_distinct_documents(spark):
    many = "\n".join(f"line {k} of many" for k in range(300))
    made = [(i, f"own {i}\n" + ("shared line" if i < 40 else "seldom line" if i < 60 else many if i < 95 else f"x {i}"), "big") for i in range(1000)]
    made += [(1000 + i, "the same text\nas all copies", "big") for i in range(50)]
    got = {r.doc_id: r.text_left for r in quality.quality_rules(spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)).collect()}
    want = {i: f"own {i}" if i < 40 or 60 <= i < 95 else t for i, t, _ in made}
    assert got == want


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert near.jaccard_join(empty, 4, 85).count() == 0
    assert suffixes.suffix_dedup(empty).count() == 0
    assert leaks.find_leaks(empty, items).count() == 0
    assert packing.pack(empty).count() == 0
    assert lengths.suffix_sums(lengths.histogram(lengths.token_counts(empty))).count() == 0
    assert lines.line_dedup(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0


def test_no_items_leak_nothing(spark, docs):
    assert leaks.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
