"""Suffix-array dedup of byte strings, by deep-shallow sorting.

Each byte is removed that lies in a string of ``SIZE`` bytes which also starts in a
document with a smaller id. Sorting every suffix of a corpus would move it fifty
times over, so suffixes are sorted only where strings can be shared:

1. Every string of SIZE bytes is filed under its *anchor*, the ``GRAM``-byte string in it
   with the smallest hash (the leftmost of equals). Equal strings have equal anchors at
   equal places, and neighbouring strings share one, so a text is a row of *regions*: an
   anchor with the run of strings filed under it. A region travels as a few hashed bytes.
2. Regions meet by anchor. A region that equals one of a smaller id goes altogether. Of
   the others the first of its kind is kept if some other region of the anchor agrees with
   it for half of the missing bytes on one side (any shared string needs that).
3. The texts of those regions, mostly the rims of copied passages, meet by anchor, and
   the suffixes starting in them are sorted deep-shallow (those of an anchor that many kinds of
   regions share are reduced in the sending task and meet by string): multikey quicksort on machine words
   to ``SHALLOW`` bytes, then a blind trie for each group that is still tied. Equal neighbours
   keep only the smallest id.

Equal texts are one text with the smallest of their ids; its copies go altogether.

Defined cases: a null text is empty; a text under SIZE bytes loses nothing; a document with a
null id neither loses nor removes anything; rows of one id never remove each other's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.llm.common import mix, shuffle_partitions, slices
from plurispark.session import broadcast_if_small, stage

SIZE = 50
GRAM = 20
#: Grams in a string; an anchor files at most so many strings in a row.
SPAN = SIZE - GRAM + 1
#: Bytes on one side of the anchor on which two regions with a shared string agree at least.
SIDE = (SIZE - GRAM + 1) // 2
SHALLOW = 24
#: Parts in which anchors meet, for each shuffle partition; texts have as many groups as there are partitions.
GROUPS = 3
#: Regions held by a task before they are handed out.
FLUSH = 400_000
#: An anchor with more kinds of regions whose texts are wanted is hot: its strings are dealt one by one.
HOT = 1000
#: Strings of hot anchors held by a task before they are handed out.
FLUSH_STRINGS = 200_000

_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all *n*-byte strings, by doubling."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    out, done, h, width = None, 0, _BYTE[data], 1
    count = len(data) - n + 1
    while True:
        if n & width:
            part = h[done : done + count]
            out = part.copy() if out is None else out * _power(width) + part
            done += width
        width *= 2
        if width > n:
            return mix(out)
        half = width // 2
        h = h[: len(h) - half] * _power(half) + h[half:]


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every *n* neighbours."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def regions(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The regions of each text, in order.

    ``text`` number, ``nth`` region of the text, ``first`` string and number of strings
    ``count``, and the hashes ``key`` (of the anchor), ``same`` (of the whole region),
    ``left`` and ``right`` (of the bytes beside the anchor; 0 where the text ends before).
    """
    names = ("text", "nth", "first", "count", "key", "same", "left", "right")
    if len(data) < SIZE:
        return {k: np.zeros(0, np.int64 if k in names[:4] else np.uint64) for k in names}
    h = gram_hashes(data, GRAM)
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (window_min(ranked, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    strings = np.maximum(size - SIZE + 1, 0)
    valid = np.zeros(len(anchor) + 1, np.int32)
    held = strings > 0
    np.add.at(valid, offsets[:-1][held], 1)
    np.add.at(valid, offsets[:-1][held] + strings[held], -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[offsets[:-1][held]] = True
    first = np.flatnonzero(new)
    ends = valid.copy()
    ends[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(ends)
    at = anchor[first]
    text = np.searchsorted(offsets, first, side="right") - 1
    nth = np.arange(len(first)) - np.searchsorted(text, text)
    whole = h[first] * _power(1) + h[first + GRAM]  # with the last gram, every byte of the first string
    whole = mix(whole) * _power(2) + h[first + SIZE - GRAM]
    tail = h[last] * _power(3) + h[last + GRAM]
    tail = mix(tail) * _power(4) + h[last + SIZE - GRAM]
    same = mix(whole ^ mix(tail + (last - first).astype(np.uint64)) ^ (at - first).astype(np.uint64))
    side = gram_hashes(data, SIDE)
    left = np.where(at - SIDE >= offsets[text], side[np.maximum(at - SIDE, 0)] % np.uint64(255) + np.uint64(1), 0)
    stop = at + GRAM
    right = np.where(stop + SIDE <= offsets[text + 1], side[np.minimum(stop, len(side) - 1)] % np.uint64(255) + np.uint64(1), 0)
    return dict(zip(names, (text, nth, first, last - first + 1, h[at], same, left.astype(np.uint64), right.astype(np.uint64))))


def _cut(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _group(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


_MET = pa.schema([("part", pa.int32()), ("owner", pa.binary()), ("rank", pa.binary()), ("body", pa.binary())])
_MET_DDL = "part int, owner binary, rank binary, body binary"
#: A region on its way: number of its owner in this row's list, number in its text, hashes.
_REGION = np.dtype([("of", "<u2"), ("nth", "<u2"), ("key", "<u4"), ("same", "<u4"), ("left", "u1"), ("right", "u1")])
#: What a text learns of one of its regions: all strings go (``verdict`` 1), or its text is wanted (2; 3 if the anchor is hot).
_NEWS = np.dtype([("owner", "<i8"), ("nth", "<u4"), ("verdict", "u1")])
_CHUNK = 60_000


def _news_rows(news: np.ndarray, parts: int, start: int) -> dict[str, list]:
    order, cuts = _cut(_group(news["owner"], parts), parts)
    rows: dict[str, list] = {k: [] for k in _MET.names}
    for g in np.flatnonzero(np.diff(cuts)):
        for k, v in (("part", int(g) + start), ("owner", b""), ("rank", b""), ("body", news[order[cuts[g] : cuts[g + 1]]].tobytes())):
            rows[k].append(v)
    return rows


class _Outbox:
    """Collects regions of many texts and hands them out by anchor.

    Equal regions are reduced to the one of the smallest id at once: the others have
    met a smaller id already. An anchor that a third of all texts share thus costs one
    entry for each kind of region in every hand-out, however many texts hold it.
    """

    def __init__(self, parts: int, groups: int):
        self.parts, self.groups, self.held, self.owners, self.ranks, self.found = parts, groups, 0, [], [], []

    def add(self, owners: np.ndarray, ranks: np.ndarray, r: dict[str, np.ndarray]) -> None:
        self.found.append(r | {"text": r["text"] + sum(map(len, self.owners))})
        self.owners.append(owners)
        self.ranks.append(ranks)
        self.held += len(r["text"])

    def hand_out(self) -> pa.RecordBatch:
        owners, ranks = np.concatenate(self.owners), np.concatenate(self.ranks)
        r = {k: np.concatenate([f[k] for f in self.found]) for k in self.found[0]}
        self.__init__(self.parts, self.groups)
        kind = r["key"] * _power(5) + r["same"]
        order = np.lexsort((ranks[r["text"]], kind))
        k, rank = kind[order], ranks[r["text"]][order]
        start = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
        least = rank[np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))] if len(k) else rank
        gone = order[rank > least]
        stay = np.sort(order[rank == least])
        news = np.zeros(len(gone), _NEWS)
        news["owner"], news["nth"], news["verdict"] = owners[r["text"][gone]], r["nth"][gone], 1
        rows = _news_rows(news, self.groups, self.parts)
        r = {k: v[stay] for k, v in r.items()}
        # A list of owners is numbered with 16 bits; long texts take several numbers.
        slot = r["text"] * (1 << 20) + (r["nth"] >> 16)
        part = ((r["key"] >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)
        order, cuts = _cut(part, self.parts)
        for p in np.flatnonzero(np.diff(cuts)):
            for at in range(cuts[p], cuts[p + 1], _CHUNK):
                i = order[at : min(at + _CHUNK, cuts[p + 1])]
                slots, of = np.unique(slot[i], return_inverse=True)
                body = np.zeros(len(i), _REGION)
                body["of"], body["nth"], body["key"], body["same"] = of, r["nth"][i] & 0xFFFF, r["key"][i] & np.uint64(0xFFFFFFFF), r["same"][i] >> np.uint64(32)
                body["left"], body["right"] = r["left"][i], r["right"][i]
                who = np.zeros(len(slots), [("owner", "<i8"), ("base", "<u4")])
                who["owner"], who["base"] = owners[slots >> 20], (slots & ((1 << 20) - 1)) << 16
                for k, v in (("part", int(p)), ("owner", who.tobytes()), ("rank", ranks[slots >> 20].tobytes()), ("body", body.tobytes())):
                    rows[k].append(v)
        return pa.RecordBatch.from_pydict(rows, schema=_MET)


def sent_regions(texts: DataFrame, parts: int, groups: int) -> DataFrame:
    def run(batches):
        box = _Outbox(parts, groups)
        for batch in batches:
            owners, ranks = (np.asarray(batch.column(k)).astype("<i8") for k in ("_key", "_rank"))
            for at, data, offsets in slices(batch.column("_text")):
                end = at + len(offsets) - 1
                box.add(owners[at:end], ranks[at:end], regions(data, offsets))
                if box.held >= FLUSH:
                    yield box.hand_out()
        if box.found:
            yield box.hand_out()

    return texts.select("_key", "_rank", "_text").mapInArrow(run, _MET_DDL)


def met_regions(sent: DataFrame, parts: int, groups: int, hot: int = HOT) -> DataFrame:
    """News for the texts, packed by their groups, from the regions of each anchor."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= parts:
            group = pa.array([x - parts for x in table.column("part").to_pylist()], pa.int32())
            return table.set_column(0, "part", group)
        who, rank, body = [], [], []
        for o, r, b in zip(*(table.column(k).to_pylist() for k in ("owner", "rank", "body"))):
            o, r, b = np.frombuffer(o, [("owner", "<i8"), ("base", "<u4")]), np.frombuffer(r, "<i8"), np.frombuffer(b, _REGION)
            who.append(o[b["of"]])
            rank.append(r[b["of"]])
            body.append(b)
        who, rank, body = np.concatenate(who), np.concatenate(rank), np.concatenate(body)
        key = body["key"].astype(np.uint64)
        same = body["same"].astype(np.uint64) << np.uint64(16) | body["left"].astype(np.uint64) << np.uint64(8) | body["right"]
        order = np.lexsort((rank, same, key))
        who, rank, body, key, same = who[order], rank[order], body[order], key[order], same[order]
        n = np.arange(len(key))
        fresh_key = np.concatenate(([True], key[1:] != key[:-1]))
        fresh = fresh_key.copy()
        fresh[1:] |= same[1:] != same[:-1]
        least = rank[np.maximum.accumulate(np.where(fresh, n, 0))]
        verdict = np.zeros(len(key), np.uint8)
        verdict[rank > least] = 1
        # Kinds of one anchor that agree on one side and come from different ids want their texts.
        kinds = np.flatnonzero(fresh)
        wanted = np.zeros(len(kinds), bool)
        for side in ("left", "right"):
            s = body[side][kinds].astype(np.uint64)
            code = key[kinds] << np.uint64(8) | s
            o = np.lexsort((rank[kinds], code))
            c, q = code[o], rank[kinds][o]
            start = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            size = np.diff(np.append(start, len(c)))
            several = q[start] != q[start + size - 1]
            hit = np.repeat(several, size) & (s[o] > 0)
            wanted[o[hit]] = True
        kind_of = np.cumsum(fresh) - 1
        # All regions of an anchor are here, so every task learns the same of it.
        begin = np.flatnonzero(fresh_key[kinds])
        many = np.repeat(np.add.reduceat(wanted.astype(np.int64), begin) > hot, np.diff(np.append(begin, len(kinds))))
        verdict[(verdict == 0) & wanted[kind_of]] = 2
        verdict[(verdict == 2) & many[kind_of]] = 3
        keep = verdict > 0
        news = np.zeros(int(keep.sum()), _NEWS)
        news["owner"], news["nth"], news["verdict"] = who["owner"][keep], who["base"][keep] + body["nth"][keep], verdict[keep]
        return pa.Table.from_pydict(_news_rows(news, groups, 0), schema=_MET)

    return sent.groupBy("part").applyInArrow(run, _MET_DDL)


def _by_owner(packed: DataFrame, kind: np.dtype, name: str) -> DataFrame:
    """One row for each owner, its records joined in ``name``."""

    def run(table: pa.Table) -> pa.Table:
        all_ = np.frombuffer(b"".join(table.column("body").to_pylist()), kind)
        all_ = all_[np.argsort(all_["owner"], kind="stable")]
        owners, start = np.unique(all_["owner"], return_index=True)
        stop = np.append(start[1:], len(all_))
        return pa.table({"owner": owners, name: pa.array([all_[a:b].tobytes() for a, b in zip(start, stop)], pa.binary())})

    return packed.groupBy("part").applyInArrow(run, f"owner long, {name} binary")


#: Bytes of a region on their way: ``count`` strings from the string ``base`` on.
_RIM = np.dtype([("owner", "<i8"), ("rank", "<i8"), ("nth", "<u4"), ("base", "u1"), ("count", "u1")])


def _masks(head: np.ndarray, of: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The masks of strings that go: number of the head and of the string from its base on."""
    bits = np.zeros(len(head), np.uint64)
    np.bitwise_or.at(bits, of, np.uint64(1) << (head["base"][of] + nth).astype(np.uint64))
    hit = np.flatnonzero(bits)
    masks = np.zeros(len(hit), _MASK)
    masks["owner"], masks["nth"], masks["bits"] = head["owner"][hit], head["nth"][hit], bits[hit]
    return masks


def hot_strings(head: np.ndarray, data: np.ndarray, parts: int, groups: int) -> dict[str, list]:
    """Single strings of hot anchors, dealt by their hashes, and the masks of those that a smaller id in this task removes."""
    h = gram_hashes(data, SIZE)[::SIZE]
    text = data.reshape(-1, SIZE)
    order = np.lexsort((head["rank"], h))
    start = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    first = order[np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
    gone = (head["rank"][order] > head["rank"][first]) & (text[order] == text[first]).all(axis=1)
    rows = _news_rows(_masks(head, order[gone], np.zeros(int(gone.sum()), np.int64)), groups, parts)
    stay = order[~gone]
    dealt, cuts = _cut(_group(h[stay], parts), parts)
    for p in np.flatnonzero(np.diff(cuts)):
        i = stay[dealt[cuts[p] : cuts[p + 1]]]
        for k, v in (("part", int(p)), ("owner", head[i].tobytes()), ("rank", b""), ("body", text[i].tobytes())):
            rows[k].append(v)
    return rows


def sent_rims(texts: DataFrame, parts: int, groups: int) -> DataFrame:
    """The wanted regions' bytes, dealt by anchor, or by string where the anchor is hot; *texts* carry the news of their regions."""

    def run(batches):
        held, strings, n = [], [], 0
        for batch in batches:
            owners, ranks = (np.asarray(batch.column(k)) for k in ("_key", "_rank"))
            news = batch.column("news")
            out: dict[str, list] = {k: [] for k in _MET.names}
            heads, bodies, keys = [], [], []
            for at, data, offsets in slices(batch.column("_text")):
                r = regions(data, offsets)
                begin = np.searchsorted(r["text"], np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    told = np.frombuffer(news[at + i].as_py(), _NEWS)
                    many = told[told["verdict"] == 3]
                    told = told[told["verdict"] == 2]
                    if len(many):
                        j = begin[i] + many["nth"].astype(np.int64)
                        count = r["count"][j]
                        head = np.zeros(int(count.sum()), _RIM)
                        base = np.arange(len(head)) - np.repeat(np.cumsum(count) - count, count)
                        head["owner"], head["rank"], head["nth"], head["base"], head["count"] = owners[at + i], ranks[at + i], np.repeat(many["nth"], count), base, 1
                        held.append(head)
                        strings.append(data[(np.repeat(r["first"][j], count) + base)[:, None] + np.arange(SIZE)].reshape(-1))
                        n += len(head)
                        if n >= FLUSH_STRINGS:
                            yield pa.RecordBatch.from_pydict(hot_strings(np.concatenate(held), np.concatenate(strings), parts, groups), schema=_MET)
                            held, strings, n = [], [], 0
                    j = begin[i] + told["nth"].astype(np.int64)
                    head = np.zeros(len(j), _RIM)
                    head["owner"], head["rank"], head["nth"], head["count"] = owners[at + i], ranks[at + i], told["nth"], r["count"][j]
                    heads.append(head)
                    keys.append(r["key"][j])
                    bodies += [data[f : f + c - 1 + SIZE].tobytes() for f, c in zip(r["first"][j], r["count"][j])]
            if not bodies:
                continue
            heads, key = np.concatenate(heads), np.concatenate(keys)
            order, cuts = _cut(((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), parts)
            for p in np.flatnonzero(np.diff(cuts)):
                i = order[cuts[p] : cuts[p + 1]]
                for k, v in (("part", int(p)), ("owner", heads[i].tobytes()), ("rank", b""), ("body", b"".join(bodies[x] for x in i))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_MET)
        if n:
            yield pa.RecordBatch.from_pydict(hot_strings(np.concatenate(held), np.concatenate(strings), parts, groups), schema=_MET)

    return texts.select("_key", "_rank", "_text", "news").mapInArrow(run, _MET_DDL)


def blind_trie(data: bytes, starts: list[int], known: int, depth: int) -> list[list[int]]:
    """The suffixes in order, equal ones (to *depth*) together; all agree on *known* bytes.

    Inner nodes hold only the position at which their suffixes branch; a suffix is led
    down blindly to some leaf, compared with it once, and inserted where they part.
    """
    root: list = [starts[0]]  # a leaf: equal suffixes; an inner node: (position, {byte: child})
    for s in starts[1:]:
        node = root
        while type(node) is tuple:
            child = node[1].get(data[s + node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        t, at = node[0], known
        if data[s + known : s + depth] == data[t + known : t + depth]:
            node.append(s)
            continue
        while data[s + at] == data[t + at]:
            at += 1
        node, above, edge = root, None, None
        while type(node) is tuple and node[0] < at:
            above, edge = node, data[s + node[0]]
            node = node[1][edge]
        if type(node) is tuple and node[0] == at:
            node[1][data[s + at]] = [s]
            continue
        split = (at, {data[t + at]: node, data[s + at]: [s]})
        if above is None:
            root = split
        else:
            above[1][edge] = split
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if type(node) is tuple:
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def _word(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes as one number that compares like them."""
    word = np.zeros(len(at), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | raw[at + k]
    return word


def _pairs(raw: np.ndarray, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0 or 1 for each two suffixes that agree on SHALLOW bytes: tries of two leaves, all at once."""
    sign = np.zeros(len(x), np.int8)
    for at in (*range(SHALLOW, depth - 8, 8), depth - 8):
        a, b = _word(raw, x + at), _word(raw, y + at)
        sign = np.where(sign == 0, (a > b).astype(np.int8) - (a < b).astype(np.int8), sign)
    return sign


def deep_shallow(data: bytes, starts: np.ndarray, depth: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """*starts* in the order of their first *depth* bytes, and whether each equals the one before."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    order, head = np.arange(len(starts)), np.zeros(len(starts), np.int64)  # head: where a tied group begins
    tied = np.arange(len(starts))  # places that are still in a group of several
    for at in range(0, SHALLOW, 8):
        if not len(tied):
            break
        word = _word(raw, starts[order[tied]] + at)
        o = np.lexsort((word, head[tied]))
        order[tied] = order[tied][o]
        word, group = word[o], head[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        head[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
    equal = np.zeros(len(starts), bool)
    if len(tied):
        first = np.flatnonzero(np.concatenate(([True], head[tied][1:] != head[tied][:-1])))
        after = np.append(first[1:], len(tied))
        two = tied[first[after - first == 2]]
        sign = _pairs(raw, starts[order[two]], starts[order[two + 1]], depth)
        swap = two[sign > 0]
        order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()
        equal[two[sign == 0] + 1] = True
        more = after - first > 2
        for a, b in zip(first[more], after[more]):
            places = tied[a:b]
            members = order[places]
            where = dict(zip(starts[members].tolist(), members.tolist()))
            at = int(places[0])
            for leaf in blind_trie(data, starts[members].tolist(), SHALLOW, depth):
                order[at : at + len(leaf)] = [where[x] for x in leaf]
                equal[at + 1 : at + len(leaf)] = True
                at += len(leaf)
    return order, equal


#: Strings of a region that go: bit i is its i-th string.
_MASK = np.dtype([("owner", "<i8"), ("nth", "<u4"), ("bits", "<u8")])


def sorted_rims(sent: DataFrame, parts: int, groups: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= parts:
            return table.set_column(0, "part", pa.array([x - parts for x in table.column("part").to_pylist()], pa.int32()))
        head = np.frombuffer(b"".join(table.column("owner").to_pylist()), _RIM)
        data = b"".join(table.column("body").to_pylist())
        count = head["count"].astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(count + SIZE - 1)))[:-1]
        of = np.repeat(np.arange(len(head)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        order, equal = deep_shallow(data, begin[of] + nth)
        rank = head["rank"][of[order]]
        group = np.flatnonzero(~equal)
        least = np.repeat(np.minimum.reduceat(rank, group), np.diff(np.append(group, len(rank)))) if len(rank) else rank
        gone = order[rank > least]
        return pa.Table.from_pydict(_news_rows(_masks(head, of[gone], nth[gone]), groups, 0), schema=_MET)

    return sent.groupBy("part").applyInArrow(run, _MET_DDL)


def cut_texts(texts: DataFrame) -> DataFrame:
    """(``_key``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept``) of texts with their news and masks."""

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
            news, masks = batch.column("news"), batch.column("masks")
            for at, data, offsets in slices(batch.column("_text")):
                r = regions(data, offsets)
                begin = np.searchsorted(r["text"], np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    steps = np.zeros(b - a + 1, np.int32)
                    told = np.frombuffer(news[at + i].as_py() or b"", _NEWS)
                    j = begin[i] + told["nth"][told["verdict"] == 1].astype(np.int64)
                    np.add.at(steps, r["first"][j] - a, 1)
                    np.add.at(steps, r["first"][j] - a + r["count"][j] - 1 + SIZE, -1)
                    bits = np.frombuffer(masks[at + i].as_py() or b"", _MASK)
                    if len(bits):
                        on = (bits["bits"][:, None] >> np.arange(SPAN, dtype=np.uint64)) & np.uint64(1) > 0
                        row, nth = np.nonzero(on)
                        s = r["first"][begin[i] + bits["nth"].astype(np.int64)][row] - a + nth
                        np.add.at(steps, s, 1)
                        np.add.at(steps, s + SIZE, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    kept = data[a:b][~gone].tobytes()
                    rows["n_removed"].append(int(gone.sum()))
                    rows["n_spans"].append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                    rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    rows["kept"].append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["n_spans"], pa.int64()),
                 pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept"], pa.binary())],
                ["_key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("_key", "_text", "news", "masks").mapInArrow(run, "_key long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and the ``kept`` bytes)."""
    groups = shuffle_partitions(docs.sparkSession)
    parts = GROUPS * groups
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id).alias("_id"), t.alias("_text"), F.xxhash64(t, F.reverse(t)).alias("_key"))
    ids = stage(keyed.select("_id", "_key", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_sha")))
    known = ids.where("_id IS NOT NULL")
    first = known.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    repeats = known.join(first.where("_c > 1"), "_key").where("_id > _first").select(F.col("_id").alias("_i"), F.col("_key").alias("_k")).distinct()
    rows = keyed.where("_id IS NOT NULL")
    single = rows.join(broadcast_if_small(repeats), (rows["_id"] == F.col("_i")) & (rows["_key"] == F.col("_k")), "left_anti")
    texts = single.select("_key", F.col("_id").cast("long").alias("_rank"), "_text")
    news = stage(_by_owner(met_regions(sent_regions(texts, parts, groups), parts, groups, hot), _NEWS, "news"))
    told = texts.join(news, F.col("_key") == F.col("owner"))
    masks = _by_owner(sorted_rims(sent_rims(told, parts, groups), parts, groups), _MASK, "masks").withColumnRenamed("owner", "_o")
    cut = cut_texts(texts.join(news.join(masks, F.col("owner") == F.col("_o"), "left"), F.col("_key") == F.col("owner")))
    if not with_kept:
        cut = cut.drop("kept")
    cut = cut.dropDuplicates(["_key"])
    out = ids.join(first.drop("_c"), "_key", "left").join(cut, "_key", "left")
    whole = F.col("_id").isNotNull() & (F.col("_id") > F.col("_first")) & (F.col("n_bytes") >= SIZE)
    mine = F.col("_id").isNotNull() & F.col("n_removed").isNotNull()
    zero = F.lit(0).cast("long")
    pick = lambda full, own, none: F.when(whole, full).when(mine, own).otherwise(none)
    columns = [
        F.col("_id").alias(id), F.col("n_bytes"), pick(F.col("n_bytes"), F.col("n_removed"), zero).alias("n_removed"),
        pick(zero + 1, F.col("n_spans"), zero).alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("_sha")).alias("kept_sha256"),
    ]
    if with_kept:
        columns.append(F.when(whole, F.lit(b"")).when(mine, F.col("kept")).alias("kept"))
    return out.select(*columns)
