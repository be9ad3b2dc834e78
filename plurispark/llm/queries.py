"""The registered queries of this package and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurispark.llm import chat, leaks, lengths, lines, merkle, near, packing, perplexity, quality, subtrees, suffixes, urls, variants
from plurispark.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return wrap


_LINES = """
pages AS (SELECT row_number() OVER () AS row_id, doc_id, source, text, string_split(text, chr(10)) AS raw FROM documents),
lines AS (SELECT row_id, doc_id, source, text, raw, list_transform(raw, lambda x: translate(trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS form FROM pages)"""


@register("op10_line_dedup", f"""
WITH {_LINES},
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
counts AS (SELECT source, line, count(*) AS n FROM
  (SELECT DISTINCT row_id, source, unnest(form) AS line FROM lines) WHERE line <> '' GROUP BY source, line),
bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {lines.MIN_PAGES} AND c.n * 100 >= t.n * {lines.RATIO_PERCENT} GROUP BY c.source),
cut AS (SELECT l.doc_id, l.text, l.raw, l.form, list_filter(l.raw, lambda x, i: NOT list_contains(coalesce(b.bad, []), l.form[i])) AS left_over
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(raw) - len(left_over), 0) AS BIGINT) AS n_cut,
  md5(array_to_string(left_over, chr(10))) AS text_md5 FROM cut""")
def op10_line_dedup(spark, folder):
    out = lines.line_dedup(read(spark, folder, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_cut").alias("n_cut"), F.md5("text").alias("text_md5"))


@register("op3_quality_rules", f"""
WITH {_LINES},
words AS (SELECT row_id, doc_id, source, text, form, raw, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM lines),
grams AS (SELECT row_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT row_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY row_id),
solid AS (SELECT row_id, unnest(list_filter(raw, lambda x, i: form[i] <> '')) AS line FROM lines),
dups AS (SELECT row_id, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY row_id),
texts AS (SELECT DISTINCT source, text, form FROM lines),
totals AS (SELECT source, count(*) AS n FROM texts GROUP BY source),
counts AS (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT source, text, unnest(form) AS line FROM texts) WHERE line <> '' GROUP BY source, line),
bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {quality.LIMIT_DOCS} AND c.n * 100 >= t.n * {quality.LIMIT_PERCENT} GROUP BY c.source),
cut AS (SELECT w.row_id, array_to_string(list_filter(w.raw, lambda x, i: NOT list_contains(coalesce(b.bad, []), w.form[i])), chr(10)) AS left_over
  FROM words w LEFT JOIN bad b ON w.source IS NOT DISTINCT FROM b.source),
facts AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w.w, '')), 0) AS BIGINT) AS word_chars,
  CAST(coalesce(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(len(regexp_extract_all(c.left_over, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_words_left
  FROM words w LEFT JOIN dups d USING (row_id) LEFT JOIN repeated r USING (row_id) LEFT JOIN cut c USING (row_id)),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM facts)
SELECT *, NOT base_failed AND 100 * n_words_left >= {quality.MIN_LEFT_PERCENT} * n_words AS kept FROM base""")
def op3_quality_rules(spark, folder):
    return quality.quality_rules(read(spark, folder, "documents")).drop("text_left")


@register("op9_token_counts")
def op9_token_counts(spark, folder):
    return lengths.suffix_sums(lengths.histogram(lengths.token_counts(read(spark, folder, "documents"))))


@register("op8_packing")
def op8_packing(spark, folder):
    return packing.pack(read(spark, folder, "documents"))


@register("op2_ngram_jaccard", r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM g),
t AS (SELECT doc_id, md5(unnest(s)) AS t FROM g),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least_id AS component_id FROM n JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = n.doc_id""")
def op2_ngram_jaccard(spark, folder):
    return near.jaccard_join(read(spark, folder, "documents"), n=4, percent=85)


@register("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark, folder):
    return leaks.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark, folder):
    return suffixes.suffix_dedup(read(spark, folder, "documents"))


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@register("op4_url_filters")
def op4_url_filters(spark, folder):
    return urls.judge(read(spark, folder, "pages"), URL_RULES)


@register("op5_chat_formatting")
def op5_chat_formatting(spark, folder):
    return chat.repair(read(spark, folder, "conversations"))


@register("op1_quality_classifier")
def op1_quality_classifier(spark, folder):
    return perplexity.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


#: The usual table of 256 entries for CRC-32.
_CRC = """
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS tab)"""


def _crc(octets: str) -> str:
    """SQL for the unsigned checksum of a list of numbers below 256."""
    return f"xor(list_reduce({octets}, lambda s, o: xor(s >> 8, tab[(xor(s, o) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _frame(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in fields)


def _levels(name: str, keys: str, start: str) -> str:
    """SQL for all nodes above those of *start*, whose rows are keys, level, pos, node and n."""
    return f"""{name} AS ({start}
  UNION ALL SELECT {keys}, level + 1, pos // {merkle.ARITY}, sha256(string_agg(node, '' ORDER BY pos)), (min(n) + {merkle.ARITY - 1}) // {merkle.ARITY}
  FROM {name} WHERE n > 1 GROUP BY {keys}, level, pos // {merkle.ARITY})"""


@register("op11_merkle_manifest", f"""
WITH RECURSIVE {_CRC},
docs AS (SELECT *, {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)")} % 2 = 0 AS tampered FROM documents, crc_table),
leaves AS (SELECT doc_id, source, sha256({_frame('text')}) AS leaf,
  CASE WHEN tampered THEN sha256({_frame("replace(text, chr(10), '')")}) ELSE sha256({_frame('text')}) END AS now FROM docs),
sources AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
placed AS (SELECT row_number() OVER () AS row_id, l.doc_id, l.leaf, l.now, s.tree,
  row_number() OVER (PARTITION BY s.tree ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS pos
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
{_levels('up', 'tree', "SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM placed")},
subs AS (SELECT tree, node AS subroot, level AS height FROM up WHERE n = 1),
{_levels('over', 'tree', "SELECT -1 AS tree, 0 AS level, tree AS pos, subroot AS node, count(*) OVER () AS n FROM subs")},
roots AS (SELECT node AS root, level AS height FROM over WHERE n = 1),
nodes AS (SELECT tree, level, pos, node FROM up UNION ALL SELECT tree, level, pos, node FROM over),
path AS (SELECT row_id, k AS step, p.tree, k AS level, pos // pow({merkle.ARITY}, k)::BIGINT AS own FROM placed p JOIN subs USING (tree), range(30) r(k) WHERE k < height
  UNION ALL SELECT row_id, s.height + k, -1, k, p.tree // pow({merkle.ARITY}, k)::BIGINT FROM placed p JOIN subs s USING (tree), roots, range(30) r(k) WHERE k < roots.height),
kin AS (SELECT row_id, step, own, n.pos, n.node FROM path p JOIN nodes n ON n.tree = p.tree AND n.level = p.level AND n.pos // {merkle.ARITY} = p.own // {merkle.ARITY}),
proofs AS (SELECT row_id, sha256(string_agg(node, '' ORDER BY step, pos)) AS proof FROM kin WHERE pos <> own GROUP BY row_id),
fold AS (SELECT row_id, 0::BIGINT AS step, now AS h FROM placed
  UNION ALL SELECT f.row_id, f.step + 1, sha256(string_agg(CASE WHEN k.pos = k.own THEN f.h ELSE k.node END, '' ORDER BY k.pos))
  FROM fold f JOIN kin k ON k.row_id = f.row_id AND k.step = f.step GROUP BY f.row_id, f.step),
ends AS (SELECT row_id, arg_max(h, step) AS folded FROM fold GROUP BY row_id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN subs USING (tree) JOIN ends USING (row_id) LEFT JOIN proofs USING (row_id), roots""")
def op11_merkle_manifest(spark, folder):
    return merkle.document_manifest(read(spark, folder, "documents"))


@register("op12_substring_dedup", rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT row_id, doc_id, i, md5(array_to_string(w[i:i + {subtrees.WINDOW - 1}], ' ')) AS g
  FROM (SELECT row_id, doc_id, w, unnest(range(1, len(w) - {subtrees.WINDOW - 2})) AS i FROM docs WHERE doc_id IS NOT NULL AND len(w) >= {subtrees.WINDOW})),
gone AS (SELECT row_id, i FROM (SELECT row_id, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_id FROM starts) WHERE doc_id > first_id),
spots AS (SELECT DISTINCT row_id, i + k AS i FROM gone, range({subtrees.WINDOW}) r(k)),
runs AS (SELECT row_id, count(*) AS n_spans FROM (SELECT row_id, i - lag(i) OVER (PARTITION BY row_id ORDER BY i) AS gap FROM spots) WHERE gap IS NULL OR gap > 1 GROUP BY row_id),
lost AS (SELECT row_id, list(i) AS cut FROM spots GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(cut, []), i)), ' ')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM docs LEFT JOIN lost USING (row_id) LEFT JOIN runs USING (row_id)""")
def op12_substring_dedup(spark, folder):
    return subtrees.subtree_dedup(read(spark, folder, "documents"))


@register("op13_spelling_variants", f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {variants.LEAST_LENGTH} GROUP BY doc_id, run),
summed AS (SELECT run, n, {_crc("list_transform(string_split(rtrim(regexp_replace(hex(encode(doc_id || ':' || run)), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT)")} AS h
  FROM counted, crc_table),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {variants.LEAST_COUNT}),
outs AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM words, range(1, 200) r(k) WHERE k <= length(word)),
near AS (SELECT a.word AS x, a.n AS nx, b.word AS y, b.n AS ny FROM outs a JOIN outs b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM outs a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM outs a JOIN words b ON a.rest = b.word),
best AS (SELECT x, nx, count(*) AS n_near, arg_min(y, (-ny, encode(y))) AS y, max(ny) AS ny FROM near GROUP BY x, nx),
forms AS (SELECT x AS word, n_near, CASE WHEN ny >= {variants.RATIO} * nx THEN y END AS form, CASE WHEN ny >= {variants.RATIO} * nx THEN ny END AS form_n FROM best),
chain AS (SELECT word, 0 AS step, word AS root FROM words UNION ALL SELECT c.word, step + 1, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n FROM words JOIN ends USING (word) LEFT JOIN forms USING (word)""")
def op13_spelling_variants(spark, folder):
    return variants.variants(variants.word_counts(read(spark, folder, "documents")))
