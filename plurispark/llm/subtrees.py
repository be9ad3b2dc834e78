"""Substring dedup of word sequences, by prefix-partitioned suffix trees.

Each word is removed that lies in a window of ``WINDOW`` words which also starts in a
document with a smaller id.

1. *Suffixes that can repeat.* A window's anchor is its run of ``GRAM`` words with the smallest hash;
   equal windows have equal anchors at equal places, and neighbouring windows share one. Anchors
   meet with a byte for the words on either side; a suffix stays only if its anchor and the side on
   which its window reaches further occur in another document. Nothing is decided here.
2. *Variable-length prefixes.* A suffix belongs to the subtree of its first ``LENGTHS[0]`` words. A prefix
   that starts more than 1 / ``SHARE`` of a part's fair share of all windows is split by the next
   length, up to the whole window: so a part holds many short prefixes or few long ones, and no prefix
   is larger than a part. At most ``SHARE`` times as many prefixes as there are parts can be that frequent.
3. *Subtrees.* A part sorts the rest of its suffixes below each prefix. A subtree is its leaves in
   order and the depth at which neighbours part; an internal node is a run of leaves that part no
   sooner than its depth, and the deep ones (``WINDOW`` words or more) are the repeats. Of each the smallest
   id keeps its words. The repeats of a text, joined, are its maximal repeated runs.

Equal texts are one text with the smallest of their ids. Words travel as 40 bits of their hash,
prefixes as 64; equal suffixes of one task are one suffix before they are sent.

Defined cases: null, empty and blank texts have no words; texts under WINDOW words lose nothing; a document with
a null id neither loses nor removes anything; rows of one id never remove each other's words.
"""

from __future__ import annotations

import hashlib
import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.llm.common import WIDTH, hash_spans, mix, narrow, shuffle_partitions, slices, windows, words_of
from plurispark.llm.suffixes import window_min
from plurispark.session import broadcast_if_small, stage

WINDOW = 13
GRAM = 5
#: Words on one side of an anchor on which two equal windows agree at least.
SIDE = (WINDOW - GRAM) // 2
#: Lengths of prefixes, each for those that are too frequent with the one before.
LENGTHS = (7, 10, WINDOW)
SHARE = 8
#: A prefix is counted in a task's batch of FLUSH_WORDS words if it starts that many windows there.
LEAST = 16
#: Parts in which suffixes meet, for each shuffle partition; texts have as many groups as there are partitions.
PARTS = 2
#: Words whose anchors, and suffixes that, a task holds before it hands them out.
FLUSH_WORDS = 4_000_000
FLUSH_ANCHORS = 400_000
FLUSH_SUFFIXES = 300_000
#: Entries of one row, below the 16 bits that number its owners.
_CHUNK = 60_000

_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("who", pa.binary()), ("body", pa.binary())])
_PACKED_DDL = "part int, kind int, who binary, body binary"
#: Whose entries a row has; ``base`` is added to their 16-bit places, as long texts have more.
_WHO = np.dtype([("owner", "<i8"), ("rank", "<i8"), ("base", "<u4")])
_ANCHOR = np.dtype([("of", "<u2"), ("nth", "<u2"), ("key", "<u4"), ("left", "u1"), ("right", "u1")])
#: What a text learns of an anchor of its own: bit 1, its left side occurs elsewhere; bit 2, its right side.
_NEWS = np.dtype([("owner", "<i8"), ("nth", "<u4"), ("sides", "u1")])
#: A window of a text that goes.
_GONE = np.dtype([("owner", "<i8"), ("nth", "<u4")])


def _suffix(length: int) -> np.dtype:
    return np.dtype([("of", "<u2"), ("nth", "<u2"), ("prefix", "<u8"), ("words", "u1", (WINDOW - length, WIDTH))])


class Words:
    """The words of a slice of texts: hashes, and per text the number of words before it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        first, last, self.before = words_of(data, offsets)
        self.h = hash_spans(data, first, last)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.before))
        starts = np.arange(max(len(self.h) - WINDOW + 1, 0))
        #: Whether a window starts at each word (and stays in its text).
        self.valid = starts + WINDOW <= self.before[self.text[starts] + 1]

    def anchors(self) -> dict[str, np.ndarray]:
        """Of each text, in order: ``text``, ``nth`` in it, ``first`` window, number of windows ``count``, place ``at``, ``key`` and sides."""
        names = ("text", "nth", "first", "count", "at", "key", "left", "right")
        if not self.valid.any():
            return {k: np.zeros(0, np.uint64 if k == "key" else np.int64) for k in names}
        g, side = windows(self.h, GRAM), windows(self.h, SIDE)
        ranked = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        anchor = (window_min(ranked, WINDOW - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = self.valid.copy()
        text = self.text[: len(anchor)]
        new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~self.valid[:-1]
        first = np.flatnonzero(new)
        run = np.cumsum(new)[self.valid] - 1
        count = np.bincount(run, minlength=len(first))
        at, text = anchor[first], text[first]
        byte = lambda i: (side[np.clip(i, 0, len(side) - 1)] % np.uint64(255) + np.uint64(1)).astype(np.int64)
        left = np.where(at - SIDE >= self.before[text], byte(at - SIDE), 0)
        right = np.where(at + GRAM + SIDE <= self.before[text + 1], byte(at + GRAM), 0)
        return dict(zip(names, (text, np.arange(len(first)) - np.searchsorted(text, text), first, count, at, g[at], left, right)))


def _cut(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and where each part starts and ends in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


class _Rows:
    """Packed rows on their way to parts, and to the groups of texts (numbered after the parts)."""

    def __init__(self, parts: int, groups: int):
        self.parts, self.groups, self.rows = parts, groups, {k: [] for k in _PACKED.names}

    def _add(self, *values) -> None:
        for k, v in zip(_PACKED.names, values):
            self.rows[k].append(v)

    def to_parts(self, part: np.ndarray, kind: int, text: np.ndarray, nth: np.ndarray, owners: np.ndarray, ranks: np.ndarray, entries: np.ndarray) -> None:
        slot = text * (1 << 20) + (nth >> 16)
        order, cuts = _cut(part, self.parts)
        for p in np.flatnonzero(np.diff(cuts)):
            for a in range(cuts[p], cuts[p + 1], _CHUNK):
                i = order[a : min(a + _CHUNK, cuts[p + 1])]
                slots, of = np.unique(slot[i], return_inverse=True)
                body, who = entries[i], np.zeros(len(slots), _WHO)
                body["of"], body["nth"] = of, nth[i] & 0xFFFF
                who["owner"], who["rank"], who["base"] = owners[slots >> 20], ranks[slots >> 20], (slots & ((1 << 20) - 1)) << 16
                self._add(int(p), kind, who.tobytes(), body.tobytes())

    def to_groups(self, news: np.ndarray, start: int) -> None:
        order, cuts = _cut((mix(news["owner"].astype(np.uint64)) % np.uint64(self.groups)).astype(np.int64), self.groups)
        for g in np.flatnonzero(np.diff(cuts)):
            self._add(int(g) + start, 0, b"", news[order[cuts[g] : cuts[g + 1]]].tobytes())

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(self.rows, schema=_PACKED)


def _unpacked(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Owners and entries of packed rows, one beside the other; the entries' places are filled up beyond 16 bits by ``base``."""
    who, body = [np.zeros(0, _WHO)], [np.zeros(0, kind)]
    for w, b in zip(table.column("who").to_pylist(), table.column("body").to_pylist()):
        b = np.frombuffer(b, kind)
        who.append(np.frombuffer(w, _WHO)[b["of"]])
        body.append(b)
    return np.concatenate(who), np.concatenate(body)


def _several(code: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code occurs with two ranks or more; and the entries with the first and the last rank of those codes."""
    order = np.lexsort((rank, code))
    c = code[order]
    start = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(c)))
    hit = rank[order[start]] != rank[order[start + size - 1]]
    out = np.zeros(len(code), bool)
    out[order] = np.repeat(hit, size)
    return out, np.concatenate((order[start[hit]], order[(start + size - 1)[hit]]))


def _sides(key: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor the sides that occur in several documents, and the anchors that stand for those sides."""
    sides, stand = np.zeros(len(key), np.uint8), np.zeros(len(key), bool)
    for bit, side in ((1, left), (2, right)):
        has = np.flatnonzero(side)
        hit, ends = _several(key[has].astype(np.uint64) << np.uint64(8) | side[has].astype(np.uint64), rank[has])
        sides[has[hit]] |= bit
        stand[has[ends]] = True
    return sides, stand


def _low(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(0xFFFFFFFF)).astype("<u4")


def sent_anchors(texts: DataFrame, parts: int, groups: int) -> DataFrame:
    """Anchors, dealt by their hashes.

    Anchors whose sides both (or the only one) already occur in two documents of this task have their answer; of each such side two
    anchors still go on, for other tasks. So an anchor that a third of all documents hold costs few entries a batch.
    """

    def run(batches):
        owners, ranks, found, held, n = [], [], [], 0, 0

        def handed():
            o, r = np.concatenate(owners), np.concatenate(ranks)
            a = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            low, part = _low(a["key"]), ((a["key"] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            sides, stand = _sides(low.astype(np.uint64) | part.astype(np.uint64) << np.uint64(32), a["left"], a["right"], r[a["text"]])
            rows = _Rows(parts, groups)
            news = np.zeros(int((sides > 0).sum()), _NEWS)
            news["owner"], news["nth"], news["sides"] = o[a["text"]][sides > 0], a["nth"][sides > 0], sides[sides > 0]
            rows.to_groups(news, parts)
            open_ = ((a["left"] > 0) & (sides & 1 == 0)) | ((a["right"] > 0) & (sides & 2 == 0))
            go = np.flatnonzero(open_ | stand)
            entries = np.zeros(len(go), _ANCHOR)
            entries["key"], entries["left"], entries["right"] = low[go], a["left"][go], a["right"][go]
            rows.to_parts(part[go], 0, a["text"][go], a["nth"][go], o, r, entries)
            return rows.batch()

        for batch in batches:
            keys, rank = (np.asarray(batch.column(k)).astype("<i8") for k in ("_key", "_rank"))
            for at, data, offsets in slices(batch.column("_text")):
                end = at + len(offsets) - 1
                a = Words(data, offsets).anchors()
                found.append(a | {"text": a["text"] + n})
                owners.append(keys[at:end])
                ranks.append(rank[at:end])
                n, held = n + end - at, held + len(a["text"])
                if held >= FLUSH_ANCHORS:
                    yield handed()
                    owners, ranks, found, held, n = [], [], [], 0, 0
        if found:
            yield handed()

    return texts.select("_key", "_rank", "_text").mapInArrow(run, _PACKED_DDL)


def met_anchors(sent: DataFrame, parts: int, groups: int) -> DataFrame:
    """News for the texts, packed by their groups."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= parts:
            return _shifted(table, parts)
        who, body = _unpacked(table, _ANCHOR)
        sides, _ = _sides(body["key"], body["left"], body["right"], who["rank"])
        hit = np.flatnonzero(sides)
        news = np.zeros(len(hit), _NEWS)
        news["owner"], news["nth"], news["sides"] = who["owner"][hit], who["base"][hit] + body["nth"][hit], sides[hit]
        rows = _Rows(parts, groups)
        rows.to_groups(news, 0)
        return pa.Table.from_batches([rows.batch()])

    return sent.groupBy("part").applyInArrow(run, _PACKED_DDL)


def _shifted(table: pa.Table, parts: int) -> pa.Table:
    return table.set_column(0, "part", pa.array([p - parts for p in table.column("part").to_pylist()], pa.int32()))


def by_owner(packed: DataFrame, kind: np.dtype, name: str) -> DataFrame:
    """One row for each ``owner``, its records one after the other in *name*."""

    def run(table: pa.Table) -> pa.Table:
        records = np.frombuffer(b"".join(table.column("body").to_pylist()), kind)
        records = records[np.argsort(records["owner"], kind="stable")]
        owners, start = np.unique(records["owner"], return_index=True)
        stop = np.append(start[1:], len(records))
        return pa.table({"owner": owners, name: pa.array([records[a:b].tobytes() for a, b in zip(start, stop)], pa.binary())})

    return packed.groupBy("part").applyInArrow(run, f"owner long, {name} binary")


def frequent_prefixes(texts: DataFrame, parts: int, share: int = SHARE, least: int = LEAST) -> dict[int, np.ndarray]:
    """Of each length but the last the prefixes that start more than 1 / *share* of a part's fair share of windows.

    There are fewer than *share* times *parts* of a length: that bounds what comes to the driver and goes to the tasks.
    """

    def run(batches):
        held, words = [], 0

        def counted():
            for length in LENGTHS[:-1]:
                values, n = np.unique(np.concatenate([h[length] for h in held]), return_counts=True)
                often = n >= least
                yield from zip([length] * int(often.sum()), values[often].view(np.int64), n[often])
            yield 0, 0, sum(len(h[LENGTHS[0]]) for h in held)

        def rows():
            length, prefix, n = zip(*counted())
            return pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(prefix, pa.int64()), pa.array(n, pa.int64())], ["length", "prefix", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch.column("_text")):
                w = Words(data, offsets)
                at = np.flatnonzero(w.valid)
                held.append({length: windows(w.h, length)[at] if len(at) else np.zeros(0, np.uint64) for length in LENGTHS[:-1]})
                words += len(w.h)
                if words >= FLUSH_WORDS:
                    yield rows()
                    held, words = [], 0
        if held:
            yield rows()

    counts = texts.select("_text").mapInArrow(run, "length int, prefix long, n long").groupBy("length", "prefix").agg(F.sum("n").alias("n"))
    counts = stage(counts)
    total = counts.where("length = 0").agg(F.max("n")).first()[0] or 0
    found = counts.where(f"length > 0 AND n * {share * parts} > {total}").collect()
    return {k: np.sort(np.array([r["prefix"] for r in found if r["length"] == k], np.int64).view(np.uint64)) for k in LENGTHS[:-1]}


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def sent_suffixes(told: DataFrame, parts: int, groups: int, frequent) -> DataFrame:
    """The suffixes that can repeat, dealt by their prefixes; *told* are texts with the news of their anchors."""

    def run(batches):
        owners, ranks, held, n, size = [], [], [], 0, 0

        def handed():
            o, r = np.concatenate(owners), np.concatenate(ranks)
            s = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            rows = _Rows(parts, groups)
            rank = r[s["text"]]
            order = np.lexsort((rank, s["whole"]))
            whole = s["whole"][order]
            start = np.concatenate(([True], whole[1:] != whole[:-1]))
            least = rank[order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
            gone = np.sort(order[rank[order] > least])
            records = np.zeros(len(gone), _GONE)
            records["owner"], records["nth"] = o[s["text"][gone]], s["nth"][gone]
            rows.to_groups(records, parts)
            stay = np.ones(len(rank), bool)
            stay[gone] = False
            for length, longer in zip(LENGTHS, (*LENGTHS[1:], None)):
                prefix = s["whole"] if longer is None else s[length]
                mine = stay & ~_among(prefix, frequent.value[length]) if longer else stay
                i = np.flatnonzero(mine)
                stay &= ~mine
                entries = np.zeros(len(i), _suffix(length))
                entries["prefix"] = prefix[i]
                if longer:
                    rest = s["rest"][i, length - LENGTHS[0] :]
                    entries["words"] = np.frombuffer(narrow(rest.reshape(-1)), np.uint8).reshape(*rest.shape, WIDTH)
                rows.to_parts((mix(prefix[i]) % np.uint64(parts)).astype(np.int64), length, s["text"][i], s["nth"][i], o, r, entries)
            return rows.batch()

        for batch in batches:
            keys, rank = (np.asarray(batch.column(k)).astype("<i8") for k in ("_key", "_rank"))
            news = batch.column("news").to_pylist()
            for at, data, offsets in slices(batch.column("_text")):
                end = at + len(offsets) - 1
                w = Words(data, offsets)
                a = w.anchors()
                sides = np.zeros(len(a["text"]), np.uint8)
                for i, first in enumerate(np.searchsorted(a["text"], np.arange(end - at))):
                    told_ = np.frombuffer(news[at + i], _NEWS)
                    np.bitwise_or.at(sides, first + told_["nth"].astype(np.int64), told_["sides"])
                count = np.where(sides > 0, a["count"], 0)
                of = np.repeat(np.arange(len(count)), count)
                place = a["first"][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                before = a["at"][of] - place  # words of the window before its anchor
                need = np.where(before > SIDE, 1, np.where(before < SIDE, 2, 3))
                fit = sides[of] & need == need
                place, text = place[fit], a["text"][of[fit]]
                if len(place):
                    held.append({"text": text + n, "nth": place - w.before[text], "whole": windows(w.h, WINDOW)[place],
                                 "rest": w.h[place[:, None] + np.arange(LENGTHS[0], WINDOW)]} | {k: windows(w.h, k)[place] for k in LENGTHS[:-1]})
                owners.append(keys[at:end])
                ranks.append(rank[at:end])
                n, size = n + end - at, size + len(place)
                if size >= FLUSH_SUFFIXES:
                    yield handed()
                    owners, ranks, held, n, size = [], [], [], 0, 0
        if held:
            yield handed()

    return told.select("_key", "_rank", "_text", "news").mapInArrow(run, _PACKED_DDL)


def subtree(prefix: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves (suffixes) in order, and the depth in words at which each parts from the one before.

    Suffixes of different prefixes are different subtrees, side by side: they part at 0.
    """
    order = np.lexsort((*words.T[::-1], prefix))
    p, w = prefix[order], words[order]
    depth = np.zeros(len(order), np.int64)
    same = np.concatenate((np.zeros((1, w.shape[1]), bool), w[1:] == w[:-1])) if len(order) else np.zeros((0, w.shape[1]), bool)
    depth[1:] = np.where(p[1:] == p[:-1], length + np.cumprod(same[1:], axis=1).sum(axis=1), 0)
    return order, depth


def deep_nodes(depth: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """First leaf and number of leaves of the highest internal nodes of depth *deep* or more."""
    first = np.flatnonzero(depth < deep)
    size = np.diff(np.append(first, len(depth)))
    return first[size > 1], size[size > 1]


def grown_subtrees(sent: DataFrame, parts: int, groups: int) -> DataFrame:
    """The windows that go, packed by their texts' groups."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= parts:
            return _shifted(table, parts)
        rows = _Rows(parts, groups)
        kinds = np.asarray(table.column("kind"))
        for length in LENGTHS:
            who, body = _unpacked(table.filter(pa.array(kinds == length)), _suffix(length))
            if not len(body):
                continue
            words = np.zeros((len(body), WINDOW - length, 8), np.uint8)
            words[:, :, :WIDTH] = body["words"]
            order, depth = subtree(body["prefix"], words.reshape(len(body), -1).view("<u8").reshape(len(body), WINDOW - length), length)
            first, size = deep_nodes(depth, WINDOW)
            node = np.repeat(np.arange(len(first)), size)
            leaf = order[first[node] + np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)]
            rank = who["rank"][leaf]
            least = np.minimum.reduceat(rank, np.cumsum(size) - size) if len(first) else rank
            gone = leaf[rank > least[node]]
            records = np.zeros(len(gone), _GONE)
            records["owner"], records["nth"] = who["owner"][gone], who["base"][gone] + body["nth"][gone]
            rows.to_groups(records, 0)
        return pa.Table.from_batches([rows.batch()])

    return sent.groupBy("part").applyInArrow(run, _PACKED_DDL)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_texts(texts: DataFrame) -> DataFrame:
    """Of each text its words, what goes and what is left; ``plain_sha256`` is of all its words."""

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "n_spans", "kept_sha256", "plain_sha256", "kept")}
            for text, gone in zip(batch.column("_text").cast(pa.large_binary()), batch.column("gone")):
                words = _WORD.findall(text.as_py())
                plain, gone, kept = b" ".join(words), gone.as_py(), None
                step = np.zeros(len(words) + 1, np.int32)
                if gone:
                    starts = np.unique(np.frombuffer(gone, _GONE)["nth"]).astype(np.int64)
                    step[starts] += 1
                    step[starts + WINDOW] -= 1
                out = np.cumsum(step[:-1]) > 0
                kept = b" ".join(compress(words, (~out).tolist())) if gone else plain
                rows["n_words"].append(len(words))
                rows["n_removed"].append(int(out.sum()))
                rows["n_spans"].append(int((out[1:] & ~out[:-1]).sum()) + int(out[:1].sum()))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["plain_sha256"].append(hashlib.sha256(plain).hexdigest() if gone else rows["kept_sha256"][-1])
                rows["kept"].append(kept.decode())
            longs = [pa.array(rows[k], pa.int64()) for k in ("n_words", "n_removed", "n_spans")]
            strings = [pa.array(rows[k], pa.string()) for k in ("kept_sha256", "plain_sha256", "kept")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *longs, *strings], ["_key", *rows])

    return texts.select("_key", "_text", "gone").mapInArrow(
        run, "_key long, n_words long, n_removed long, n_spans long, kept_sha256 string, plain_sha256 string, kept string")


def subtree_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", with_kept: bool = False, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``n_spans`` (and the ``kept`` words, joined by spaces)."""
    spark = docs.sparkSession
    groups = shuffle_partitions(spark)
    parts = PARTS * groups
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id).alias("_id"), t.alias("_text"), F.xxhash64(t, F.reverse(t)).alias("_key"))
    ids = stage(keyed.select("_id", "_key"))
    first = ids.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    repeats = ids.join(first.where("_c > 1"), "_key").where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_key").distinct()
    single = keyed.alias("k").join(
        broadcast_if_small(repeats).alias("r"), F.col("k._id").eqNullSafe(F.col("r._id")) & (F.col("k._key") == F.col("r._key")), "left_anti")
    every = single.select("_key", F.col("_id").cast("long").alias("_rank"), "_text")
    texts = every.where("_rank IS NOT NULL")
    frequent = spark.sparkContext.broadcast(frequent_prefixes(texts, parts, share, least))
    news = by_owner(met_anchors(sent_anchors(texts, parts, groups), parts, groups), _NEWS, "news")
    told = texts.join(news, F.col("_key") == F.col("owner"))
    gone = stage(by_owner(grown_subtrees(sent_suffixes(told, parts, groups, frequent), parts, groups), _GONE, "gone"))
    cut = cut_texts(every.join(gone, F.col("_key") == F.col("owner"), "left"))
    if not with_kept:
        cut = cut.drop("kept")
    out = ids.join(first.drop("_c"), "_key", "left").join(cut.dropDuplicates(["_key"]), "_key")
    whole = F.col("_id").isNotNull() & (F.col("_id") > F.col("_first")) & (F.col("n_words") >= WINDOW)
    pick = lambda full, own, none: F.when(F.col("_id").isNull(), none).when(whole, full).otherwise(own)
    zero = F.lit(0).cast("long")
    columns = [
        F.col("_id").alias(id), "n_words", pick(F.col("n_words"), F.col("n_removed"), zero).alias("n_removed"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("plain_sha256")).alias("kept_sha256"),
        pick(zero + 1, F.col("n_spans"), zero).alias("n_spans")]
    if with_kept:
        columns.append(pick(F.lit(""), F.col("kept"), F.lit(None).cast("string")).alias("kept"))
    return out.select(*columns)
