"""URL filters: host and path rules, and boosted trees on lexical features for every other URL.

Rules decide the URLs they fit (longest rule first) and thereby label them; gradient-boosted
trees learn from those labelled URLs and decide the rest. Features are lexical: lengths,
depth, digit ratio, character entropy, parameters, labels of the host, and for each of three
suffixes of the host (last label, last two, whole host) how often labelled URLs with it are blocked
and what share of its URLs is labelled at all (smoothed, over all URLs).

A labelled URL meets rates that were counted without its own fold, so its label does not tell
itself. Suffixes whose labels differ teach what the rates cannot: together their URLs weigh as much as
those of all suffixes with one label. Trees are trained on at most about ``TRAIN_ROWS`` labelled URLs,
chosen by hash; everything else covers all rows. All of it is DataFrame functions and the DataFrame API of Spark ML.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule
and is judged by the trees; without labelled URLs of both kinds the method answers the kind
there is, or ``allow``; repeated rows are judged each; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.llm.common import ascii_lower
from plurispark.session import broadcast_if_small, stage

TRAIN_ROWS = 20_000
TREES = 10
DEPTH = 4
#: Labelled URLs that each suffix is credited with at the overall rate.
SMOOTHING = 20
FOLDS = 5
#: Labels of the host, from its end, in each suffix; 0 is the whole host.
SUFFIXES = {"label": 1, "domain": 2, "host": 0}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action; null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, does in sorted(rules, key=lambda r: len(r[0])):  # a longer rule wraps the shorter ones
        of, slash, below = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + below)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(action)
    return rule, action


def entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c))) / size
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.coalesce(F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))), F.lit(0.0))


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "fragment",
            "has_extension", "last_number", *(f"{k}_{v}" for k in SUFFIXES for v in ("rate", "count", "labelled")))


def lexical(rows: DataFrame) -> DataFrame:
    """Add the features that need nothing but ``_url``, ``host`` and ``path``."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    kept = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    number = {
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "depth": kept(F.col("path"), "[^/]"),
        "labels": kept(F.col("host"), "[^.]"), "digit_ratio": kept(url, "[^0-9]") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": kept(F.col("host"), "[^0-9]"), "hyphens": kept(url, "[^-]"), "entropy": entropy(url),
        "parameters": F.when(query == "", F.lit(0)).otherwise(kept(query, "[^&]") + 1), "fragment": F.contains(url, F.lit("#")),
        "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]+$"), "last_number": F.length(F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1)),
    }
    return rows.withColumns({k: v.cast("double") for k, v in number.items()})


def suffix(k: str) -> Column:
    return F.substring_index("host", ".", -SUFFIXES[k]) if SUFFIXES[k] else F.col("host")


def suffix_statistics(rows: DataFrame, rate: float) -> DataFrame:
    """Per kind of suffix and suffix, of all its URLs (``_f`` -1) and without each fold: smoothed rate, labelled URLs, share labelled, whether labels differ.

    *rows* have ``host``, ``label`` (null where no rule fits) and ``_fold``.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), suffix(k).alias("s")) for k in SUFFIXES]))
    counted = rows.select(kinds.alias("_x"), "_fold", "label").groupBy("_x.k", "_x.s", "_fold").agg(
        F.sum("label").alias("b"), F.count("label").alias("n"), F.count(F.lit(1)).alias("a"))
    whole = counted.groupBy("k", "s").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("b", "n", "a")))
    every = F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))).alias("_f")
    own = counted.select(F.col("k").alias("_ok"), F.col("s").alias("_os"), F.col("_fold").alias("_of"), *(F.col(c).alias(f"_{c}") for c in ("b", "n", "a")))
    x = whole.select("*", every).join(own, (F.col("k") == F.col("_ok")) & (F.col("s") == F.col("_os")) & (F.col("_f") == F.col("_of")), "left")
    less = {c: F.col(c) - F.coalesce(f"_{c}", F.lit(0)) for c in ("b", "n", "a")}
    return x.select(
        "k", "s", "_f", ((less["b"] + rate * SMOOTHING) / (less["n"] + SMOOTHING)).alias("rate"), F.log1p(less["n"].cast("double")).alias("count"),
        ((less["n"] + 1) / (less["a"] + 2)).alias("labelled"), ((F.col("b") > 0) & (F.col("b") < F.col("n"))).alias("mixed"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url", train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``score`` (block probability of the trees)."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    label = (F.col("_action") == "block").cast("double")
    fold = F.pmod(F.xxhash64("_url", "_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    rows = lexical(rows.withColumn("rule", rule).withColumn("_action", action).withColumn("label", label).withColumn("_fold", fold))
    total = rows.agg(F.sum("label").alias("blocked"), F.count("label").alias("all")).first()
    n, blocked = total["all"], total["blocked"] or 0.0
    out = ["_id", "host", "path", "rule"]
    if not 0 < blocked < n:
        fixed = F.lit("block" if n and blocked else "allow")
        score = F.lit(1.0 if n and blocked else 0.0)
        return rows.select(F.col("_id").alias(id), *out[1:], F.coalesce("_action", fixed).alias("verdict"), score.alias("score"))
    rate = blocked / n
    stats = stage(suffix_statistics(rows.select("host", "label", "_fold"), rate))

    def with_suffixes(df: DataFrame, fold: Column) -> DataFrame:
        df = df.withColumn("_want", fold)
        for k in SUFFIXES:
            mine = stats.where(F.col("k") == k).select(F.col("s").alias("_s"), "_f", *(F.col(c).alias(f"{k}_{c}") for c in ("rate", "count", "labelled", "mixed")))
            df = df.join(broadcast_if_small(mine), (suffix(k) == F.col("_s")) & (F.col("_want") == F.col("_f")), "left").drop("_s", "_f")
        return df

    million = 1_000_000
    part = F.pmod(F.xxhash64("_url", "_id"), F.lit(million)) < int(million * min(1.0, train_rows / n))
    sample = with_suffixes(rows.where(F.col("label").isNotNull() & part), F.col("_fold"))
    sample = stage(sample.select("label", F.col("domain_mixed").alias("_mixed"), *FEATURES)).coalesce(4)  # about train_rows rows at any size
    seen = sample.agg(F.count_if("_mixed").alias("mixed"), F.count_if(~F.col("_mixed")).alias("plain")).first()
    weight = seen["plain"] / seen["mixed"] if seen["mixed"] and seen["plain"] else 1.0
    sample = sample.withColumn("_weight", F.when(F.col("_mixed"), F.lit(weight)).otherwise(F.lit(1.0)))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="_weight").fit(
        assembler.transform(sample).select("label", "_weight", "features"))
    scored = trees.transform(assembler.transform(with_suffixes(rows, F.lit(-1))))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce("_action", F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col("_id").alias(id), *out[1:], verdict.alias("verdict"), score.alias("score"))
