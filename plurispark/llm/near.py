"""N-gram Jaccard join: prefix filters under several global orders, intersected before verification.

A document is the set of its distinct word shingles. Sets A and B link when
``100 * |A and B| >= percent * |A or B|``; then at most ``n - ceil(percent * n / 100)`` members
of a set of n are missing from its partner, so under *any* order of all shingles the two
sets share one among the first ``n - ceil(percent * n / 100) + 1`` members: their prefixes.

1. Shingles are counted exactly: hashed shingle sets are shuffled in packed columns, and
   only shingles that two or more sets hold go back to their sets. A set whose
   unshared shingles fill the prefix links with nothing; most texts end here.
2. Each order ranks rarer shingles first (that is where few sets meet) and breaks ties by
   a hash of its own. Sets that share a prefix shingle of the first order meet; those
   that share none under some other order are dropped, and only the rest are verified.
   Shingles that no other set holds also bound the overlap itself, and so does the place of
   the first shingle that two sets share: what comes before it is in one of them only.
3. Meeting is done in rounds. First every set meets one leader, the set with the fewest
   unshared shingles on its posting lists; that is one pair a set and merges groups
   of copies. Then the sets of a list that are in different components and within those
   bounds meet. No link between different texts can be missed: two sets are left out only
   when they are already connected or cannot link.

Equal texts (after lower-casing) are one set; they cost one row each.

Defined cases: null and empty texts and texts without words have the empty set and link with
nothing; a text with fewer words than a shingle is one shingle; repeated rows and repeated
ids are kept, and rows of one id are one document for the links, whatever their texts (with
``by_row`` each row links by its own text alone); a null id never links and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.llm.common import WIDTH, ascii_lower, hash_spans, lower_bytes, mix, narrow, shuffle_partitions, slices, wide, windows, words_of
from plurispark.llm.components import components
from plurispark.session import broadcast_if_small, is_empty, stage

#: Prefix filters, one for each global order.
ORDERS = 3
#: Shingles held by a task before it hands out packed columns.
FLUSH = 1_000_000
#: Parts in which shingles meet, for each shuffle partition; sets have as many groups as there are partitions.
GROUPS = 3
STAR_ROUNDS = 2


def allowed_missing(n, percent: int):
    """Members of a set of *n* that a linked partner may lack."""
    return n - (n * percent + 99) // 100


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of *n* words."""
    for _, data, offsets in slices(texts):
        data = lower_bytes(data)
        first, last, before = words_of(data, offsets)
        h = hash_spans(data, first, last)
        g = windows(h, n)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                short = np.full(n - (b - a), 0x5DEECE66D, np.uint64)  # so that it never equals a full shingle
                yield windows(np.concatenate((h[a:b], short)), n)
            else:
                yield np.zeros(0, np.uint64)


#: Owners (8 bytes each), how many shingles of each follow (4 bytes; in the second shuffle their part too), the
#: shingles (WIDTH bytes each) and how common they are (a byte each, once it is known).
_PACKED = pa.schema([("part", pa.int32()), ("origin", pa.int32()), ("owner", pa.binary()), ("count", pa.binary()), ("value", pa.binary()), ("rank", pa.binary())])
_PACKED_DDL = "part int, origin int, owner binary, count binary, value binary, rank binary"


def _row(rows: dict[str, list], part: int, origin: int, owner: np.ndarray, count: np.ndarray, value: bytes = b"", rank: bytes = b"") -> None:
    for k, v in zip(_PACKED.names, (int(part), int(origin), owner.astype("<i8").tobytes(), count.astype("<i4").tobytes(), value, rank)):
        rows[k].append(v)


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _slices(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and where each part starts and ends in it."""
    order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _dealt(sets: list[np.ndarray], keys: list[int], parts: int, groups: int) -> pa.RecordBatch:
    """One row for each part: owners, how many shingles each has here, and the shingles.

    Further rows, numbered from *parts* on, give each owner's group the size of its set.
    """
    owner, size = np.array(keys, "<i8"), np.array([len(s) for s in sets], "<i4")
    values = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), size)
    rows: dict[str, list] = {k: [] for k in _PACKED.names}
    order, cuts = _slices(((values >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), parts)
    of, values = of[order], values[order]
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[p], cuts[p + 1]
        who, count = np.unique(of[a:b], return_counts=True)
        _row(rows, p, p, owner[who], count, narrow(values[a:b]))
    order, cuts = _slices(_group(owner, groups), groups)
    for g in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[g] : cuts[g + 1]]
        _row(rows, parts + g, parts, owner[at], size[at])
    return pa.RecordBatch.from_pydict(rows, schema=_PACKED)


def packed_shingles(docs: DataFrame, n: int, parts: int, groups: int) -> DataFrame:
    def run(batches):
        sets, keys, held = [], [], 0
        for batch in batches:
            for key, s in zip(batch.column("_key").to_pylist(), shingle_sets(batch.column("_text"), n)):
                sets.append(s)
                keys.append(key)
                held += len(s) + 1
                if held >= FLUSH:
                    yield _dealt(sets, keys, parts, groups)
                    sets, keys, held = [], [], 0
        if sets:
            yield _dealt(sets, keys, parts, groups)

    return docs.select("_key", "_text").mapInArrow(run, _PACKED_DDL)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def shared_shingles(packed: DataFrame, parts: int, groups: int) -> DataFrame:
    """Of each part the shingles that two or more sets hold, packed for their owners' groups with their numbers of holders."""

    def run(table: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in _PACKED.names}
        if table.column("part")[0].as_py() >= parts:
            at = table.schema.get_field_index("part")
            group = pa.array([x - parts for x in table.column("part").to_pylist()], pa.int32())
            return table.set_column(at, "part", group)
        part = table.column("part")[0].as_py()
        owner = np.repeat(_joined(table, "owner", "<i8"), _joined(table, "count", "<i4"))
        value = wide(b"".join(table.column("value").to_pylist()))
        order = np.lexsort((owner, value))
        owner, value = owner[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        owner, value = owner[new], value[new]
        start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        holders = np.diff(np.append(start, len(value)))
        holders = np.repeat(holders, holders)
        keep = holders > 1
        owner, value = owner[keep], value[keep]
        rank = np.minimum(np.log2(holders[keep]) * 6, 255).astype(np.uint8)
        order = np.lexsort((owner, _group(owner, groups)))
        owner, value, rank = owner[order], value[order], rank[order]
        cuts = np.searchsorted(_group(owner, groups), np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[g], cuts[g + 1]
            who, count = np.unique(owner[a:b], return_counts=True)
            _row(rows, g, part, who, count, narrow(value[a:b]), rank[a:b].tobytes())
        return pa.Table.from_pydict(rows, schema=_PACKED)

    return packed.groupBy("part").applyInArrow(run, _PACKED_DDL)


def _prefixes(value: np.ndarray, rank: np.ndarray, take: int) -> list[np.ndarray]:
    """The first *take* members of a set's shared shingles under each order: the rarer first, ties by a hash."""
    out = []
    for k in range(ORDERS):
        tie = mix(value ^ np.uint64(0xA5A5A5A5 * (k + 1)))
        out.append(value[np.lexsort((tie, rank if k == 0 else rank // 6))[:take]])
    return out


def candidates(shared: DataFrame, percent: int, parts: int) -> DataFrame:
    """Every set's ``key`` and ``n``; those that may link also have their number ``s`` of ``shared`` shingles and a prefix for each order."""
    names = [f"prefix{k}" for k in range(ORDERS)]
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("shared", pa.binary()), *((p, pa.list_(pa.int64())) for p in names)])

    def run(table: pa.Table) -> pa.Table:
        origin = np.asarray(table.column("origin"))
        of_sets, of_shingles = table.filter(pa.array(origin == parts)), table.filter(pa.array(origin < parts))
        keys, at = np.unique(_joined(of_sets, "owner", "<i8"), return_index=True)
        n = _joined(of_sets, "count", "<i4")[at].astype(np.int64)
        owner = np.repeat(_joined(of_shingles, "owner", "<i8"), _joined(of_shingles, "count", "<i4"))
        value, rank = wide(b"".join(of_shingles.column("value").to_pylist())), _joined(of_shingles, "rank", np.uint8)
        value = value | np.repeat(origin[origin < parts].astype(np.uint64) << np.uint64(8 * WIDTH), [len(x) // WIDTH for x in of_shingles.column("value").to_pylist()])
        order = np.lexsort((value, owner))
        owner, rank, value = owner[order], rank[order], value[order]
        first, last = np.searchsorted(owner, keys), np.searchsorted(owner, keys, side="right")
        alone = n - (last - first)
        take = allowed_missing(n, percent) + 1 - alone
        out: dict[str, list] = {k: [None] * len(keys) for k in schema.names[2:]}
        for i in np.flatnonzero((take > 0) & (last > first)):
            a, b = first[i], last[i]
            out["s"][i], out["shared"][i] = int(b - a), value[a:b].tobytes()
            for name, p in zip(names, _prefixes(value[a:b], rank[a:b], int(take[i]))):
                out[name][i] = p.view(np.int64)
        return pa.Table.from_pydict({"key": keys, "n": n} | out, schema=schema)

    fields = ", ".join(f"{p} array<long>" for p in names)
    return shared.groupBy("part").applyInArrow(run, f"key long, n long, s long, shared binary, {fields}")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (``a``, ``b``) of *pairs* that share a prefix under every order and link."""
    others = [f"prefix{k}" for k in range(1, ORDERS)]
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"), *(F.col(p).alias(f"a_{p}") for p in others))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"), *(F.col(p).alias(f"b_{p}") for p in others))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    met = pairs.join(left, "a").join(right, "b").where(small * 100 >= large * percent)
    for p in others:
        met = met.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            for i, (na, nb) in enumerate(sizes):
                x = np.frombuffer(batch.column("sa")[i].as_py(), "<u8")
                y = np.frombuffer(batch.column("sb")[i].as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (na + nb - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return met.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _may_link(x: str, y: str, percent: int) -> str:
    """Whether two list rows may be the first that their sets share, and the sets may link.

    ``r`` counts a set's shared shingles from this one on: what comes before the first
    common shingle is in one of the two only, so the overlap is at most the smaller ``r``.
    """
    return (
        f"least({x}.n, {y}.n) * 100 >= greatest({x}.n, {y}.n) * {percent}"
        f" AND least({x}.r, {y}.r) * {100 + percent} >= ({x}.n + {y}.n) * {percent}"
    )


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of all sets that link with another, from the candidate sets."""
    rows = sets.select("key", "n", "s", F.posexplode("prefix0").alias("place", "t"))
    rows = rows.select("key", "n", "s", "t", (F.col("s") - F.col("place")).alias("r"))
    held = rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t")
    lists = stage(rows.join(held, "t", "left_semi").withColumn("root", F.col("key")))
    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        if labels is not None:
            moved = lists.drop("root").join(labels, lists["key"] == labels["node"], "left").withColumn("root", F.coalesce("root", "key")).drop("node")
            still = moved.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")
            lists = stage(moved.join(still, "t", "left_semi"))
            if is_empty(lists):
                break
        if turn == STAR_ROUNDS:
            x, y = lists.alias("x"), lists.alias("y")
            pairs = x.join(y, F.expr(f"x.t = y.t AND x.key < y.key AND x.root <> y.root AND {_may_link('x', 'y', percent)}"))
            pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
        else:
            # The first leader has the fewest unshared shingles; the next ones are drawn, so that others get their turn.
            order = F.struct((F.col("n") - F.col("s")).alias("u"), "key") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), F.col("root")).alias("u"), "key")
            leaders = lists.groupBy("t").agg(F.min(F.struct(order.alias("o"), "key", "n", "r", "root")).alias("l")).select("t", "l.*")
            met = lists.alias("x").join(leaders.alias("y"), F.expr(f"x.t = y.t AND x.root <> y.root AND {_may_link('x', 'y', percent)}"))
            best = met.groupBy(F.col("x.key").alias("k")).agg(F.min(F.struct("y.o", F.col("y.key").alias("lead"))).alias("m"))
            pairs = best.select(F.least("k", "m.lead").alias("a"), F.greatest("k", "m.lead").alias("b")).distinct()
        more = stage(verified(pairs, sets, percent))
        links = more if links is None else links.union(more)
        labels = components(links)
    return labels


def text_key(text: Column) -> Column:
    """The key of a text: texts that are equal after lower-casing share it."""
    lower = ascii_lower(F.coalesce(text, F.lit("")))
    return F.xxhash64(lower, F.reverse(lower))


def _of_one_id(ids: DataFrame) -> DataFrame:
    """Edges between the keys of ids that have several; *ids* are (``_id``, ``_key``) of texts with words."""
    ends = ids.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_key").alias("a"), F.max("_key").alias("_hi")).where("a <> _hi")
    return ids.join(ends.select(F.col("_id").alias("_i"), "a"), F.col("_id") == F.col("_i")).where("_key <> a").select("a", F.col("_key").alias("b")).distinct()


def jaccard_join(docs: DataFrame, n: int, percent: int, id: str = "doc_id", text: str = "text", by_row: bool = False) -> DataFrame:
    """Per row of *docs*: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    With *by_row*, also the ``text_key`` by which rows of one id are told apart.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    keyed = rows.select("_id", text_key(F.col("_text")).alias("_key"), "_text")
    ids = stage(keyed.select("_id", "_key"))
    # One row of each text makes its set: the first id; rows that repeat it stay out.
    first = ids.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    repeats = ids.join(first.where("_c > 1"), "_key").where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_key").distinct()
    single = keyed.alias("k").join(
        broadcast_if_small(repeats).alias("r"),
        F.col("k._id").eqNullSafe(F.col("r._id")) & (F.col("k._key") == F.col("r._key")), "left_anti")
    groups = shuffle_partitions(spark)
    parts = GROUPS * groups
    everything = stage(candidates(shared_shingles(packed_shingles(single, n, parts, groups), parts, groups), percent, parts))
    sets = everything.where("shared IS NOT NULL")
    out = ids.join(everything.select(F.col("key").alias("_key"), F.col("n").alias("n_shingles")), "_key")
    if is_empty(sets):
        out = out.withColumn("_root", F.col("_key"))
    else:
        roots = linked(sets, percent)
        out = out.join(roots, out["_key"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_key"))
    out = stage(out.select("_id", "_key", "_root", "n_shingles"))
    if not by_row:
        same = stage(_of_one_id(out.where("n_shingles > 0").select("_id", F.col("_root").alias("_key"))))
        if not is_empty(same):
            further = components(same).select("node", F.col("root").alias("_to"))
            out = out.join(further, F.col("_root") == F.col("node"), "left").withColumn("_root", F.coalesce("_to", "_root"))
    least = out.where("n_shingles > 0").groupBy("_root").agg(F.min("_id").alias("_least"))
    own = F.when(F.col("_id").isNull() | (F.col("n_shingles") == 0), F.col("_id")).otherwise(F.coalesce("_least", "_id"))
    columns = [F.col("_id").cast(kind).alias(id), F.col("n_shingles").cast("long").alias("n_shingles"), own.alias("component_id")]
    return out.join(least, "_root", "left").select(*columns, *([F.col("_key").alias("text_key")] if by_row else []))
