"""Spelling variant grouping, by one-edit neighbourhoods over a reduced alphabet.

Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is
its near word of largest count, where that is ``RATIO`` times its own or more; its root is the last of its forms.

1. Letters are hashed to ``SYMBOLS`` symbols, which the vocabulary uses about equally often (letters go, the
   commonest first, to the symbol used least). Near words have reduced words that are equal or one edit apart.
2. Each reduced word generates its full one-edit neighbourhood, as 64-bit codes that follow from the codes of its
   beginnings and ends. Every pair of reduced words is generated from both sides; the side whose neighbour has the
   smaller code sends it to that code's part, where it meets the reduced vocabulary.
3. The words behind two reduced words that met are verified on their original letters. Reduced words that stand
   for more than ``BUCKET`` words do not meet word by word: their words and those of their neighbours are
   joined on the words with one place left out, which groups no more words than there are letters.
4. Forms are followed by doubling: a chain's counts grow by ``RATIO`` each step, so rounds are few.

Defined cases: null and empty texts have no words; a document without an id loses no letter; words of any length
are whole; repeated rows count as often as they occur; an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.llm.common import WIDTH, mix, narrow, shuffle_partitions, text_bytes, wide
from plurispark.session import is_empty, stage

SYMBOLS = 8
RATIO = 10
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: Words of one reduced word beyond which they are not compared one by one.
BUCKET = 64
#: Distinct words that a task counts before it hands them out.
FLUSH_WORDS = 300_000
#: Codes that a task holds before it hands them out.
FLUSH_CODES = 1_000_000
PARTS = 2

_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of at least LEAST_LENGTH letters, lower-cased, some with a letter lost.

    A run of a document loses the letter at its checksum's place if 31 divides the checksum of id and run.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column("_id").to_pylist(), batch.column("_text").cast(pa.large_binary())):
                for word, n in Counter(runs.findall(value.as_py().lower().decode())).items():  # bytes.lower() knows A to Z only
                    h = zlib.crc32(f"{key}:{word}".encode()) if key is not None else 1
                    if h % 31 == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] += n
                if len(total) >= FLUSH_WORDS:
                    yield handed(total)
                    total = Counter()
        if total:
            yield handed(total)

    def handed(total):
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def alphabet(words: DataFrame, symbols: int = SYMBOLS) -> dict[str, str]:
    """Letters and their symbols (digits from 1 on), from the letters of all *words*; as many entries as there are letters."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    load, out = [0] * symbols, {}
    for r in sorted(letters, key=lambda r: (-r["count"], r["letter"])):
        symbol = load.index(min(load))
        load[symbol] += r["count"]
        out[r["letter"]] = chr(ord("1") + symbol)
    return out


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.cumprod(np.full(n - 1, _BASE))
    return out


def _by_length(column: pa.Array, cells: int):
    """Reduced words of one length at a time: their numbers and a matrix of their symbols of about *cells* cells."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(cells // max(length, 1), 1)
        for a in range(0, len(rows), step):
            i = rows[a : a + step]
            yield i, data[offsets[i][:, None] + np.arange(length)].astype(np.uint64) - np.uint64(ord("0"))


def _ends(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first k symbols and of the symbols from k on, for every k, and the powers that join them."""
    n, length = s.shape
    power = _powers(length + 2)
    head, tail = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
    for k in range(length):
        head[:, k + 1] = head[:, k] * _BASE + s[:, k]
    tail[:, :-1] = np.cumsum((s * power[:length][::-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    return head, tail, power


def codes(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.uint64)
    for i, s in _by_length(column, 1 << 20):
        out[i] = mix(_ends(s)[0][:, -1])
    return out


def neighbourhood(s: np.ndarray, symbols: int) -> np.ndarray:
    """Codes of all words within one edit of the words of *s* (one a row): itself, deletions, replacements, insertions."""
    head, tail, power = _ends(s)
    length = s.shape[1]
    k = np.arange(length + 1)
    whole = head[:, -1:]
    deleted = head[:, :-1] * power[length - 1 - k[:-1]] + tail[:, 1:] if length else np.zeros((len(s), 0), np.uint64)
    out = [whole, deleted]
    for x in np.arange(1, symbols + 1, dtype=np.uint64):
        out.append(head[:, :-1] * power[length - k[:-1]] + x * power[length - 1 - k[:-1]] + tail[:, 1:])
        out.append(head * power[length + 1 - k] + x * power[length - k] + tail)
    return mix(np.concatenate(out, axis=1))


_PACKED = pa.schema([("part", pa.int32()), ("code", pa.binary()), ("of", pa.binary())])
_PACKED_DDL = "part int, code binary, of binary"


def sent_codes(reduced: DataFrame, parts: int, symbols: int) -> DataFrame:
    """The reduced vocabulary (``of`` is empty) and its neighbourhoods (40 bits of the neighbour's code, and whose it is), by part."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def dealt(code, pack):
            part = (code >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part.astype(np.int64), kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(cuts)):
                yield int(p), *pack(order[cuts[p] : cuts[p + 1]])

        def handed():
            code, of = (np.concatenate(x) for x in zip(*held))
            return batch_of(dealt(code, lambda i: (narrow(code[i]), of[i].tobytes())))

        def batch_of(rows):
            rows = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _PACKED.types)], schema=_PACKED)

        for batch in batches:
            own = codes(batch.column("reduced"))
            several = np.asarray(batch.column("words")) > 1
            yield batch_of(dealt(own, lambda i: (own[i].tobytes(), b"")))
            for i, s in _by_length(batch.column("reduced"), FLUSH_CODES // (2 * symbols)):
                near = neighbourhood(s, symbols)
                row = np.repeat(i, near.shape[1])
                near = near.reshape(-1)
                smaller = (near < own[row]) | ((near == own[row]) & several[row])
                pair = np.unique(np.stack((near[smaller], own[row[smaller]])), axis=1)
                held.append((pair[0], pair[1]))
                size += pair.shape[1]
                if size >= FLUSH_CODES:
                    yield handed()
                    held, size = [], 0
        if held:
            yield handed()

    # The vocabulary is small beside what is generated from it: its files alone would make a few long tasks.
    spread = reduced.repartition(shuffle_partitions(reduced.sparkSession), "reduced")
    return spread.select("reduced", "words").mapInArrow(run, _PACKED_DDL)


def met_codes(sent: DataFrame) -> DataFrame:
    """``a, b``: codes of reduced words of the vocabulary that are equal or one edit apart, each two once."""

    def run(table: pa.Table) -> pa.Table:
        here, code, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for c, o in zip(table.column("code").to_pylist(), table.column("of").to_pylist()):
            if o:
                code.append(wide(c))
                of.append(np.frombuffer(o, np.uint64))
            else:
                here.append(np.frombuffer(c, np.uint64))
        here, code, of = (np.concatenate(x) for x in (here, code, of))
        low = here & np.uint64((1 << (8 * WIDTH)) - 1)
        here = here[np.argsort(low, kind="stable")]
        low = np.sort(low)
        first, last = np.searchsorted(low, code), np.searchsorted(low, code, side="right")
        i = np.repeat(np.arange(len(code)), last - first)
        at = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        pair = np.unique(np.stack((of[i], here[at])), axis=1)
        return pa.table({"a": pair[0].view(np.int64), "b": pair[1].view(np.int64)})

    return sent.groupBy("part").applyInArrow(run, "a long, b long")


def left_out(words: DataFrame) -> DataFrame:
    """*words* once for each place, without the letter there: ``at`` and ``rest``."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("at")
    rest = F.concat(F.expr("left(word, at - 1)"), F.expr("substring(word, at + 1)"))
    return words.select("word", "n", at).withColumn("rest", rest)


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """``x, nx, y, ny``: each two near words once, from distinct ``word`` with count ``n``."""
    parts = PARTS * shuffle_partitions(words.sparkSession)
    letters = alphabet(words, symbols)
    reduced = F.translate("word", "".join(letters), "".join(letters.values())) if letters else F.col("word")

    def run(batches):
        for batch in batches:
            yield batch.append_column("code", pa.array(codes(batch.column("reduced")).view(np.int64)))

    coded = stage(words.select("word", "n", reduced.alias("reduced")).mapInArrow(run, "word string, n long, reduced string, code long"))
    vocabulary = stage(coded.groupBy("code").agg(F.min("reduced").alias("reduced"), F.count(F.lit(1)).alias("words")))
    met = stage(met_codes(sent_codes(vocabulary, parts, symbols)))
    large = vocabulary.where(F.col("words") > bucket).select("code")
    some = not is_empty(large)
    if some:
        crowd = large.select(F.col("code").alias("_l"))
        ends = met.join(crowd, F.col("a") == F.col("_l"), "left_semi").union(met.join(crowd, F.col("b") == F.col("_l"), "left_semi"))
        crowded = stage(ends.distinct())
        met = met.join(crowded, ["a", "b"], "left_anti")
    x = coded.select(F.col("code").alias("a"), F.col("word").alias("x"), F.col("n").alias("nx"))
    y = coded.select(F.col("code").alias("b"), F.col("word").alias("y"), F.col("n").alias("ny"))
    one_edit = F.levenshtein("x", "y", 1) == 1
    twice = (F.col("a") == F.col("b")) & (F.col("x") >= F.col("y"))
    pairs = met.join(x, "a").join(y, "b").where(~twice & one_edit).select("x", "nx", "y", "ny")
    if some:
        ends = crowded.select(F.col("a").alias("code")).union(crowded.select(F.col("b").alias("code"))).distinct()
        out = stage(left_out(coded.join(ends, "code", "left_semi")))
        p, q = out.alias("p"), out.alias("q")
        replaced = p.join(q, F.expr("p.rest = q.rest AND p.at = q.at AND p.word < q.word"))
        shorter = coded.join(ends, "code", "left_semi").alias("q")
        removed = p.join(shorter, F.expr("p.rest = q.word"))
        pick = [F.col("p.word").alias("x"), F.col("p.n").alias("nx"), F.col("q.word").alias("y"), F.col("q.n").alias("ny")]
        both = replaced.select(*pick).union(removed.select(*pick))
        flip = F.col("x") > F.col("y")
        turned = lambda d: d.select(
            F.least("x", "y").alias("x"), F.when(flip, F.col("ny")).otherwise(F.col("nx")).alias("nx"),
            F.greatest("x", "y").alias("y"), F.when(flip, F.col("nx")).otherwise(F.col("ny")).alias("ny"))
        pairs = turned(pairs.union(both)).distinct()
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a ``form``, from (``word``, ``form``)."""
    table = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = table.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        moved = table.join(ahead, table["root"] == F.col("_w"), "left")
        moved = stage(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("more")))
        if is_empty(moved.where("more")):
            return moved.drop("more")
        table = moved.drop("more")


def variants(words: DataFrame, symbols: int = SYMBOLS, bucket: int = BUCKET, ratio: int = RATIO) -> DataFrame:
    """Of each distinct ``word`` with its count ``n``: ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = stage(words.select("word", "n"))
    pairs = stage(near_pairs(words, symbols, bucket))
    both = pairs.union(pairs.select("y", "ny", "x", "nx"))
    best = both.groupBy("x").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("ny")).alias("less"), "y")).alias("b"), F.first("nx").alias("nx"))
    best = best.withColumn("top", -F.col("b.less")).withColumn("good", F.col("top") >= ratio * F.col("nx"))
    best = stage(best.select(
        F.col("x").alias("_x"), "n_near", F.when(F.col("good"), F.col("b.y")).alias("form"), F.when(F.col("good"), F.col("top")).alias("form_n")))
    last = roots(best.where("form IS NOT NULL").select(F.col("_x").alias("word"), "form")).select(F.col("word").alias("_r"), "root")
    out = words.join(best, F.col("word") == F.col("_x"), "left").join(last, F.col("word") == F.col("_r"), "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
