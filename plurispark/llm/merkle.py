"""Merkle dataset manifest with incremental witnesses.

Every row is a leaf; the leaves of a group, in order, are the bottom of a tree whose runs
of ``ARITY`` neighbours hash to one node; the groups' roots, in order, are the bottom of the
tree above them. A *witness* lists, level by level, a node's siblings up to the root.

1. A leaf's place in its group comes from a range partition and one running sum over the
   partitions' counts, so a group with a third of all rows is many partitions.
2. Leaves meet in aligned blocks of ``ARITY ** HEIGHT``. A task streams its blocks through a
   ``Frontier``: an append opens a leaf's (empty) witness, and whenever a run of siblings is
   complete, every leaf below one of them gets the others attached. What a task holds is one block.
3. Block roots are appends to the next, shorter sequence: the same step over a table of one row a
   block, until each group has one node, and again over the groups' roots.
4. A leaf's witness is its block's part, the block's own witness and the group's. A row then
   proves itself: ``fold`` needs the leaf and the witness, no other row.

Defined cases: a null value is framed as ``-``; rows of a null group are a group of their own,
before all others; null ids come first; equal ids are ordered by their leaves (equal rows are equal
leaves, so the result does not depend on their order); an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurispark.llm.common import shuffle_partitions
from plurispark.session import broadcast_if_small, is_empty, stage

ARITY = 3
#: Levels of a block: 3 ** 7 = 2187 leaves.
HEIGHT = 7


def framed(*values: Column) -> Column:
    """The values one after the other, each as its length in bytes, a colon and itself; null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def joined(digests) -> bytes:
    """The digest of several digests, as hexadecimal text one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Frontier:
    """The open subtrees of a growing sequence, and the witness of every leaf as far as it is known.

    A step of a witness is one byte (16 times the node's place among its siblings, plus how many
    there are besides it) and the siblings' digests.
    """

    def __init__(self):
        self.open: list[list[tuple[bytes, int, int]]] = [[]]
        self.witness: list[bytearray] = []

    def append(self, leaf: bytes) -> None:
        at, level = len(self.witness), 0
        self.witness.append(bytearray())
        self._add(0, (leaf, at, at + 1))
        while len(self.open[level]) == ARITY:
            self._complete(level)
            level += 1

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for place, (_, first, end) in enumerate(run):
            step = bytes([16 * place + len(run) - 1]) + b"".join(d for k, (d, _, _) in enumerate(run) if k != place)
            for i in range(first, end):
                self.witness[i] += step
        self._add(level + 1, (joined(d for d, _, _ in run), run[0][1], run[-1][2]))

    def close(self, height: int | None = None) -> bytes:
        """The root: of the given height, or as soon as one node is left."""
        level = 0
        while level < height if height is not None else sum(map(len, self.open)) > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return next(nodes for nodes in reversed(self.open) if nodes)[0][0]


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Of each level the node's place and its siblings."""
    at = 0
    while at < len(witness):
        place, n = divmod(witness[at], 16)
        yield place, [witness[at + 1 + 32 * k : at + 33 + 32 * k] for k in range(n)]
        at += 1 + 32 * n


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that *leaf* and its witness give."""
    for place, others in steps(witness):
        leaf = joined([*others[:place], leaf, *others[place:]])
    return leaf


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Staged rows with ``_at``, their place in their group ``_group``, and ``_n``, the group's size."""
    parts = shuffle_partitions(rows.sparkSession)
    placed = stage(rows.repartitionByRange(parts, "_group", *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part", "_group").agg(F.count(F.lit(1)).alias("_c"))
    of_group = Window.partitionBy("_group")
    counts = counts.select(
        F.col("_part").alias("_p"), F.col("_group").alias("_g"), F.sum("_c").over(of_group).alias("_n"),
        (F.sum("_c").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*order))
    numbered = placed.withColumn("_at", within - 1)
    met = numbered.join(counts, (numbered["_part"] == counts["_p"]) & numbered["_group"].eqNullSafe(counts["_g"]))
    return met.withColumn("_at", F.col("_at") + F.col("_base")).drop("_part", "_p", "_g", "_base")


def appended(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes with their ``_witness`` within their block; the block's first row also has its root ``_top``."""
    parts = shuffle_partitions(nodes.sparkSession)
    blocked = nodes.withColumn("_block", F.floor(F.col("_at") / ARITY**height))
    dealt = blocked.repartition(parts, "_group", "_block").sortWithinPartitions("_group", "_block", "_at")

    def run(batches):
        held, frontier, block = [], None, None

        def closed():
            several = held[0].column("_n")[0].as_py() > ARITY**height
            top = frontier.close(height if several else None)
            rows = pa.Table.from_batches(held)
            rows = rows.append_column("_witness", pa.array(map(bytes, frontier.witness), pa.binary()))
            rows = rows.append_column("_top", pa.array([top] + [None] * (rows.num_rows - 1), pa.binary()))
            return rows.to_batches()

        for batch in batches:
            keys = list(zip(batch.column("_group").to_pylist(), batch.column("_block").to_pylist()))
            digests = batch.column("_node").to_pylist()
            first = 0
            for i, key in enumerate(keys):
                if key != block:
                    if held or first < i:
                        if first < i:
                            held.append(batch.slice(first, i - first))
                        yield from closed()
                    held, frontier, block, first = [], Frontier(), key, i
                frontier.append(digests[i])
            if first < len(keys):
                held.append(batch.slice(first))
        if held:
            yield from closed()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return stage(dealt.mapInArrow(run, f"{kinds}, _witness binary, _top binary"))


def climb(nodes: DataFrame, height: int) -> DataFrame:
    """``_group``, ``_at``, ``_witness`` and the group's root ``_sub`` of every node."""
    level = appended(nodes, height)
    above = tops(level, height)
    key = [F.col("_group").alias("_g"), F.col("_at").alias("_b")]
    if is_empty(above.where("_n > 1")):
        upper = above.select(*key, F.lit(b"").alias("_more"), F.col("_node").alias("_sub"))
    else:
        upper = climb(above, height).select(*key, F.col("_witness").alias("_more"), "_sub")
    met = level.join(upper, level["_group"].eqNullSafe(upper["_g"]) & (level["_block"] == upper["_b"]))
    return stage(met.select("_group", "_at", F.concat("_witness", "_more").alias("_witness"), "_sub"))


def tops(level: DataFrame, height: int) -> DataFrame:
    """The blocks' roots as the nodes of the next sequence."""
    return level.where("_top IS NOT NULL").select(
        "_group", F.col("_block").alias("_at"), F.ceil(F.col("_n") / ARITY**height).alias("_n"), F.col("_top").alias("_node"))


def manifest(rows: DataFrame, order: list[str], height: int = HEIGHT) -> DataFrame:
    """*rows* with ``witness``, ``subroot`` and ``root``.

    *rows* have ``_group``, the digest ``_node`` and the columns of *order*; ties of the order go by ``_node``.
    """
    level = appended(positions(rows, [*order, "_node"]), height)
    blocks = climb(tops(level, height), height)
    subs = blocks.where("_at = 0").select(F.lit(0).alias("_group"), F.col("_group").alias("_name"), F.col("_sub").alias("_node"))
    named = stage(positions(subs, ["_name"]))
    roots = climb(named.drop("_name"), height).join(named.select("_at", "_name"), "_at").select(
        "_name", F.col("_witness").alias("_last"), F.col("_sub").alias("root"))
    upper = blocks.join(broadcast_if_small(stage(roots)), F.col("_group").eqNullSafe(F.col("_name")))
    upper = upper.select(F.col("_group").alias("_g"), F.col("_at").alias("_b"), F.concat("_witness", "_last").alias("_more"), F.col("_sub").alias("subroot"), "root")
    met = level.join(upper, level["_group"].eqNullSafe(upper["_g"]) & (level["_block"] == upper["_b"]))
    return met.withColumn("witness", F.concat("_witness", "_more")).drop("_g", "_b", "_block", "_top", "_witness", "_more", "_at", "_n")


def proved(rows: DataFrame, id: str) -> DataFrame:
    """Rows of a manifest with their proof's digest and the root that the leaf they have now gives.

    ``_now`` is the digest of a row as it is now, null where it is the manifest's.
    """

    def run(batches):
        for batch in batches:
            leaf, now, witness, sub, root = (batch.column(k).to_pylist() for k in ("_node", "_now", "witness", "subroot", "root"))
            folded = [fold(leaf[i] if now[i] is None else now[i], w) for i, w in enumerate(witness)]
            columns = [
                [x.hex() for x in leaf], [x.hex() for x in sub], [x.hex() for x in root],
                [joined(d for _, others in steps(w) for d in others).hex() for w in witness], [x.hex() for x in folded]]
            texts = [pa.array(c, pa.string()) for c in columns]
            good = pa.array([a == b for a, b in zip(folded, root)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(id), *texts, good], [id, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(id, "_node", "_now", "witness", "subroot", "root").mapInArrow(
        run, f"{id} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every document's leaf and proof, checked against the document as it is after tampering.

    Tampering deletes the line breaks of the texts whose id has an even checksum.
    """
    values = {k: F.col(k) for k in FIELDS}
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = even & F.contains(F.col("text"), F.lit("\n"))
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_group"), digest(framed(*values.values())).alias("_node"),
        F.when(changed, digest(framed(*(values | {"text": cut}).values()))).alias("_now"))
    return proved(manifest(stage(rows), ["_id"], height), "_id").withColumnRenamed("_id", "doc_id")
