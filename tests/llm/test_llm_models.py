"""The language model, URL filters, chat repair and pipeline against models written here."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plurispark.llm import chat, perplexity, urls

WORDS = ["red", "green", "blue", "sun", "moon", "star", "in", "of"]


def prose(r, n):
    return " ".join(r.choice(WORDS[: 3 + i % 6]) for i in range(n))


def kneser_ney(texts):
    """log p of a word after two others, written from the formulas."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.lower().split(), "</s>"]
        tri.update(zip(w, w[1:], w[2:]))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05 * k), 0.95 * k) if n[k] else 0.5 for k in (1, 2, 3)]
        return lambda x: d[min(x, 3) - 1]

    d1, d2, d3 = discounts(uni), discounts(bi), discounts(tri)
    total = sum(uni.values())
    floor = sum(map(d1, uni.values())) / total / (len(uni) + 1)

    def contexts(c, d):
        sums, left = Counter(), defaultdict(float)
        for k, v in c.items():
            sums[k[:-1]] += v
            left[k[:-1]] += d(v)
        return sums, left

    (s2, l2), (s3, l3) = contexts(bi, d2), contexts(tri, d3)

    def p(u, v, w):
        q = floor + ((uni[w] - d1(uni[w])) / total if w in uni else 0)
        if s2[v,]:
            q = l2[v,] / s2[v,] * q + ((bi[v, w] - d2(bi[v, w])) / s2[v,] if (v, w) in bi else 0)
        if s3[u, v]:
            q = l3[u, v] / s3[u, v] * q + ((tri[u, v, w] - d3(tri[u, v, w])) / s3[u, v] if (u, v, w) in tri else 0)
        return math.log(q)

    return p


@pytest.mark.parametrize("vocabulary", [perplexity.VOCABULARY, 3])
def test_perplexity_is_modified_kneser_ney(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(perplexity, "VOCABULARY", vocabulary)
    r = random.Random(1)
    docs = [(i, prose(r, r.randint(1, 60)), "en" if i % 3 else "de") for i in range(120)]
    docs += [(500, "unknown words qqq zzz", None), (501, "", "en"), (502, None, "en"), (503, docs[0][1], "en"), (None, "red sun", "de"), (504, "RED Sun", "de"), docs[0]]
    labels = [(i, 1, 0) for i in range(100)] + [(100, 0, 0), (101, 1, 1), (102, 1, None), (999, 1, 0), (0, 1, 0)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, lang string, perplexity int")
    trained = []
    plain = perplexity.train

    def spied(texts):
        trained.extend(row[0] for row in texts.collect())
        return plain(texts)

    monkeypatch.setattr(perplexity, "train", spied)
    got = perplexity.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), least=5).collect()
    assert len(got) == len(docs) and 50 <= len(trained) <= 100
    p = kneser_ney(trained)
    by_id = {x[0]: x for x in docs}
    for row in got:
        w = ["<s>", "<s>", *(by_id[row.doc_id][1] or "").lower().split(), "</s>"]
        assert row.n_words == len(w) - 3
        if row.n_words:
            want = math.exp(-sum(p(*w[i - 2 : i + 1]) for i in range(2, len(w))) / (len(w) - 2))
            assert row.perplexity == pytest.approx(want, rel=1e-6)
            assert row.kept == (row.perplexity <= row.threshold)
        else:
            assert row.perplexity is None and not row.kept


def test_classifier_without_trusted_text(spark):
    d = spark.createDataFrame([(1, "a b", "en"), (2, "", "en"), (3, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.n_words, r.kept) for r in perplexity.classify(d, none).collect()} == {(1, 2, True), (2, 0, False), (3, 0, False)}
    assert perplexity.classify(d.limit(0), none).count() == 0


def test_classifier_tells_junk_from_prose(spark):
    tables = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    got = perplexity.classify(spark.read.parquet(f"{tables}/documents.parquet"), labels)
    rates = {r.quality: r.kept for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.5


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?q=1#f", "a.example.net", "/en/x", "example.net/en/"), ("http://example.net/fr/", "example.net", "/fr/", "net/"),
        ("http://example.net", "example.net", "", None), ("https://notexample.com/de/", "notexample.com", "/de/", None),
        ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/"), ("x://b.org/fr/y://z", "b.org", "/fr/y://z", "org/fr/"),
        ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("a://h?x/y", "h", "", None), ("a://ÄB.net/\n/é", "Äb.net", "/\n/é", "net/"),
    ]
    pages = spark.createDataFrame([(i, c[0], "host", "label") for i, c in enumerate(cases)] + [(0, cases[0][0], None, None)], "page_id long, url string, host string, label string")
    got = urls.judge(pages, RULES).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        _, host, path, rule = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == dict(RULES)[rule] if rule else r.verdict in ("allow", "block")


def test_trees_find_held_out_labels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    fewer = (("example.net/de/", "block"), ("example.net/en/", "block"), ("example.org/de/", "allow"), ("example.org/en/", "allow"))
    got = urls.judge(pages, fewer).where("host LIKE '%.example.net' AND path LIKE '/fr/%' OR host LIKE '%.example.org' AND path LIKE '/fr/%'")
    right = F.avg(((F.col("verdict") == "block") == F.col("host").endswith(".net")).cast("int"))
    assert got.agg(right).first()[0] > 0.95


def test_labels_that_differ_within_a_suffix_teach_more_than_the_suffix(spark):
    """Hosts of one domain, told apart by what their URLs look like; other hosts of that domain have no rule."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    junk = lambda host: f"http://{host}.one.com/{r.randrange(10**9)}/{r.randrange(10**9)}?a={r.randrange(99)}&b={r.randrange(99)}&c=1"
    plain = lambda host: f"http://{host}.one.com/{word()}/{word()}"
    made = [junk(r.choice(["bad", "worse"])) for _ in range(300)] + [plain(r.choice(["good", "fine"])) for _ in range(300)]
    made += [f"http://{word()}.two.net/{word()}" for _ in range(900)]
    asked = [(junk(f"new{k}"), "block") for k in range(60)] + [(plain(f"new{k}"), "allow") for k in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made + [u for u, _ in asked])], "page_id long, url string")
    rules = (("bad.one.com/", "block"), ("worse.one.com/", "block"), ("good.one.com/", "allow"), ("fine.one.com/", "allow"), ("two.net/", "allow"))
    got = {x.page_id: x.verdict for x in urls.judge(pages, rules).collect()}
    assert sum(got[len(made) + i] == v for i, (_, v) in enumerate(asked)) >= 114


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages, RULES).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), RULES).count() == 0


def brute_cost(roles):
    """The cheapest repair by trying all role choices and all ways to merge or insert."""
    best = math.inf
    legal = {(None, 0), (None, 1), (0, 1), (1, 2), (2, 1)}

    def gap(s, t):
        for n in range(3):
            for mid in itertools.product(range(3), repeat=n):
                chain = [s, *mid, t]
                if all(p in legal for p in zip(chain, chain[1:])):
                    return chat.INSERT * n
        return math.inf

    for chosen in itertools.product(range(3), repeat=len(roles)):
        cost, state = 0, None
        for own, t in zip(roles, chosen):
            cost += 0 if own == t else chat.RELABEL if own < 3 else chat.RELABEL_UNKNOWN
            cost += min(gap(state, t), chat.MERGE if state == t else math.inf)
            state = t
        cost += 0 if state == 2 else gap(state, 2) + chat.INSERT
        best = min(best, cost)
    return best


def test_repairs_are_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            if n < 5 or hash(roles) % 5 == 0:
                assert chat.repair_cost(bytes(roles)) == brute_cost(roles), roles


def rendered_is_legal(text):
    roles = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]
    if roles[0] == "system":
        roles = roles[1:]
    return len(roles) % 2 == 0 and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(roles))


def conversations():
    r = random.Random(8)
    names = ["system", "user", "assistant", None, "tool", "User"]
    rows = [(c, t, r.choice(names), f"text {c} {t}", 1, "x") for c in range(25) for t in range(r.randint(1, 9))]
    rows += [(100, t % 40, r.choice(names), f"long {t}", 1, "x") for t in range(200)]  # a hot conversation, turns tie
    rows += [(None, 0, "user", None, None, None), (None, None, "assistant", "", None, None), (7, 0, "user", "again", 1, "x"), (7, 0, "user", "again", 1, "x")]
    return rows


@pytest.mark.parametrize("segment", [7, 4096])
def test_repaired_conversations(spark, segment):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int, rendered string").repartition(3)
    got = chat.repair(df, segment=segment).collect()
    assert len(got) == len(rows)
    code = {n: i for i, n in enumerate(chat.ROLES)}
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for conv, held in by.items():
        held.sort(key=lambda r: r.position)
        assert [r.position for r in held] == list(range(len(held)))
        keys = [(r.turn is not None, r.turn, r.role is not None, r.role or "") for r in held]
        assert keys == sorted(keys)
        text = "".join(r.rendered for r in held)
        assert rendered_is_legal(text)
        for _, _, _, t, *_ in (x for x in rows if x[0] == conv):
            assert (t or "") in text
        cost = sum(chat.MERGE * r.merged + chat.INSERT * (len(r.inserted) + len(r.ending)) for r in held)
        cost += sum(0 if r.role == r.new_role else chat.RELABEL if r.role in code else chat.RELABEL_UNKNOWN for r in held)
        assert cost == chat.repair_cost(bytes(code.get(r.role, 3) for r in held))


def test_segments_do_not_change_the_result(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string, a int, b string")
    assert sorted(map(str, chat.repair(df, segment=5).collect())) == sorted(map(str, chat.repair(df).collect()))
    assert chat.repair(df.limit(0)).count() == 0


def test_all_trusted_documents_train_or_set_thresholds(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(perplexity, "train", lambda texts: counted.append(texts.count()))
    d = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    perplexity.classify(d, spark.range(2500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).count()
    assert abs(counted[0] - 2500 * perplexity.TRAIN_SHARE) < 100
