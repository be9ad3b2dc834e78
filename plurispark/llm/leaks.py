"""Benchmark decontamination: SimHash over item-sized windows, found by Hamming blocks, verified exactly.

An item is the multiset of its shingles of ``N`` words (A to Z lower-cased). In each document
the windows of an item's length compete; a window leaks the item when the weighted
Jaccard similarity (shared occurrences / all occurrences) is ``PERCENT`` or more.

1. Every shingle of every text is looked up among the items' shingles. A window can only
   reach the similarity when ``PERCENT`` of its shingles are found, so only windows dense
   in found shingles are fingerprinted; no window that could pass is left out.
2. A window's fingerprint has 64 bits: bit b is the majority, over all occurrences of
   shingles in the window, of bit b of their hashes.
3. Fingerprints are cut in ``BLOCKS`` blocks of 16 bits. Two that differ in at most ``RADIUS``
   bits differ in at most ``RADIUS // BLOCKS`` bits of some block; items are filed under all block
   values that near, and windows look up their own four. All pairs within the radius meet.
4. The exact weighted similarity of those pairs decides. A shingle that occurs several times weighs on
   every bit, so fingerprints say less about windows and items with repeated shingles: those meet by their
   shingles instead, and are decided in the same way.

Everything is DataFrame functions. Items are few beside the texts; their side is only
broadcast when it is measured to be small.

Defined cases: null and empty texts and texts shorter than N words leak nothing; items shorter than
N words are never found; a text shorter than an item is one window; repeated rows of a document or
item are one; rows without an id are not searched, since they could not be named (a caller gives them a key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.llm.common import ascii_lower
from plurispark.session import broadcast_if_small, stage

N = 5
PERCENT = 80
#: A similarity of 0.8 is an angle of 27 degrees at most: 9.7 of 64 bits differ on average, with a deviation of 2.9.
RADIUS = 19
BLOCKS = 4
_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text, A to Z lower-cased; none for null or blank texts."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(ascii_lower(trimmed), r"[\x20\x09-\x0D]+"))


def shingles(w: Column, n: int) -> Column:
    """The hashes of all runs of *n* words, in order."""
    return F.when(F.size(w) < n, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(n)])))


def fingerprints(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """``fp`` per row of *rows*, from its array of shingle hashes (two counters travel in each sum)."""
    h = F.col("_h")
    pair = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(pair)).alias(f"_s{k}") for k in range(32)]
    counted = rows.select(*keys, F.explode(hashes).alias("_h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), *sums)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"_s{k}"), 32)
        fp = fp.bitwiseOR(F.when(low * 2 > F.col("_all"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
        fp = fp.bitwiseOR(F.when(high * 2 > F.col("_all"), F.shiftleft(F.lit(1).cast("long"), k + 32)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF)).cast("int")


def near_blocks(items: DataFrame, radius: int) -> DataFrame:
    """Items under every block value within their share of the radius: ``_b``, ``_value`` and the item's columns."""
    near = [m for m in range(1 << 16) if m.bit_count() <= radius // BLOCKS]
    masks = F.expr(f"array({', '.join(map(str, near))})")
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])
    filed = items.withColumn("_block", F.explode(blocks)).withColumn("_mask", F.explode(masks))
    return filed.withColumn("_b", F.col("_block.b")).withColumn("_value", F.col("_block.v").bitwiseXOR(F.col("_mask"))).drop("_block", "_mask")


def shared_weight(x: Column, y: Column) -> Column:
    """Occurrences two arrays share, with multiplicity."""
    both = F.array_intersect(x, y)
    times = lambda a, h: F.size(F.filter(a, lambda v: v == h))
    slow = F.aggregate(both, F.lit(0), lambda n, h: n + F.least(times(x, h), times(y, h)))
    plain = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
    return F.when(plain, F.size(both)).otherwise(slow)


def find_leaks(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = N, percent: int = PERCENT, radius: int = RADIUS,
) -> DataFrame:
    """One row for each document and item it leaks, with the best window: id, item, ``start`` and ``n_words``
    (in words), ``similarity`` and ``hamming`` (bits by which the fingerprints differ)."""
    wanted = items.where(F.col(item).isNotNull()).select(F.col(item).alias("_item"), words(F.col(item_text)).alias("_w")).where(F.size("_w") >= n)
    wanted = stage(wanted.select("_item", F.size("_w").alias("_len"), shingles(F.col("_w"), n).alias("_hi")).distinct())
    lengths = broadcast_if_small(wanted.select(F.explode_outer("_hi").alias("_h"), "_len").distinct())
    slim = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    worded = slim.select("_id", words(F.col("_text")).alias("_w"))
    hashed = worded.select("_id", F.size("_w").alias("_n"), shingles(F.col("_w"), n).alias("_hd"))

    # The outer form: for the inner one a filter on the array is inferred, which splits the text anew for each word.
    seeds = hashed.select("_id", "_n", F.posexplode_outer("_hd").alias("_pos", "_h")).join(lengths, "_h").select("_id", "_n", "_pos", "_len")
    inside = F.least("_len", "_n") - n  # a window's last shingle, from its start
    least = F.ceil((inside + 1) * percent / 100).cast("int")
    # Written before it is searched: the lambdas below would sort the positions anew for each element.
    placed = stage(seeds.groupBy("_id", "_n", "_len").agg(F.sort_array(F.collect_set("_pos")).alias("_p")).where(F.size("_p") >= least)
                   .withColumn("_in", inside).withColumn("_m", least))
    found = placed.withColumn("_dense", F.filter(
        F.sequence(F.lit(0), F.size("_p") - F.col("_m")), lambda i: F.get("_p", i + F.col("_m") - 1) - F.get("_p", i) <= F.col("_in"))
    ).where(F.size("_dense") > 0)
    last_start = F.greatest(F.col("_n") - F.col("_len"), F.lit(0))
    ranges = F.transform("_dense", lambda i: F.sequence(
        F.greatest(F.least(F.get("_p", i + F.col("_m") - 1) - F.col("_in"), last_start), F.lit(0)), F.least(F.get("_p", i), last_start)))
    windows = stage(found.select("_id", "_n", "_len", F.array_distinct(F.flatten(ranges)).alias("_starts")))

    per_doc = windows.groupBy("_id").agg(F.collect_list(F.struct("_n", "_len", "_starts")).alias("_windows"))
    # Only the few texts that have windows are hashed once more.
    again = slim.join(broadcast_if_small(per_doc), "_id").select("_id", "_windows", words(F.col("_text")).alias("_w"))
    again = again.select("_id", "_windows", F.size("_w").alias("_n"), shingles(F.col("_w"), n).alias("_hd"))
    again = again.withColumn("_win", F.explode_outer("_windows")).where("_win._n = _n")
    cut = again.select("_id", "_hd", F.col("_win._len").alias("_len"), F.explode("_win._starts").alias("_start"), "_n")
    cut = stage(cut.select("_id", "_n", "_len", "_start", F.slice(
        "_hd", F.col("_start") + 1, F.least("_len", "_n") - (n - 1)).alias("_hw")).distinct())
    where = ["_id", "_n", "_len", "_start", "_hw"]
    marked = stage(fingerprints(cut, where, "_hw").withColumn("_window", F.xxhash64(*where)))
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])
    asked = marked.select("_window", "_len", F.col("fp").alias("_fw"), F.explode(blocks).alias("_block")).select(
        "_window", "_len", "_fw", F.col("_block.b").alias("_b"), F.col("_block.v").alias("_value"))
    printed = stage(fingerprints(wanted, ["_item", "_len", "_hi"], "_hi").withColumnRenamed("fp", "_fi"))
    filed = near_blocks(printed.select("_item", "_len", F.col("_fi").alias("fp")), radius).withColumnRenamed("fp", "_fi")
    apart = F.bit_count(F.col("_fw").bitwiseXOR(F.col("_fi"))).alias("hamming")
    # Each item is filed thousands of times, which a plan's size estimate does not see: no broadcast.
    met = asked.join(filed.hint("merge"), ["_len", "_b", "_value"]).select("_window", "_item", apart).where(F.col("hamming") <= radius)
    repeats = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    by_window = marked.select("_window", "_len", F.col("fp").alias("_fw"), F.explode(F.array_distinct("_hw")).alias("_h"), repeats("_hw").alias("_r"))
    by_item = printed.select("_item", "_len", "_fi", F.explode(F.array_distinct("_hi")).alias("_h"), repeats("_hi").alias("_r"))
    for x, y in ((by_window.where("_r"), by_item), (by_window.where("NOT _r"), by_item.where("_r"))):
        met = met.union(x.drop("_r").join(broadcast_if_small(y.drop("_r")), ["_len", "_h"]).select("_window", "_item", apart))
    met = met.distinct()
    pairs = met.join(marked, "_window").join(broadcast_if_small(wanted.select("_item", "_hi")), "_item")
    pairs = pairs.withColumn("_shared", shared_weight(F.col("_hw"), F.col("_hi")))
    all_ = F.size("_hw") + F.size("_hi") - F.col("_shared")
    sure = pairs.where(F.col("_shared") * 100 >= all_ * percent).withColumn("similarity", F.col("_shared") / all_)
    best = sure.groupBy("_id", "_item").agg(F.max(F.struct(
        "similarity", (-F.col("_start")).alias("s"), F.least("_len", "_n").alias("n"), "hamming")).alias("_best"))
    return best.select(
        F.col("_id").alias(id), F.col("_item").alias(item), (-F.col("_best.s")).cast("long").alias("start"),
        F.col("_best.n").cast("long").alias("n_words"), F.col("_best.similarity").alias("similarity"), F.col("_best.hamming").alias("hamming"))
