"""The queries of this subpackage: name -> callable, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtide.llm import decontamination, divergence, html, language, licenses, near_dup, packing, pii, quality, secrets, sharding, vectors, whitening
from adtide.llm.staging import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.spans_text(pii.KINDS, "pii_", by_start=False)
    every = {"pii_all_" + k: F.concat("pii_" + k, "pii_more_" + k) for k in pii.KINDS}
    counts = [F.size("pii_" + k).cast("long").alias("n_" + k) for k in pii.KINDS]
    return docs.withColumns(every).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(pii.KINDS, "pii_all_", by_start=False).alias("spans"))


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sharding.shard(docs).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE["op6_decontamination"] = r"""
WITH item_words AS (SELECT row_number() OVER () AS item_row, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
item_grams AS (SELECT DISTINCT item_row, item_id, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT item_row, item_id, w, least(len(w), 5) AS width, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_row, count(*) AS n_item FROM item_grams GROUP BY item_row),
doc_words AS (SELECT row_number() OVER () AS doc_row, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
doc_grams AS (SELECT DISTINCT doc_row, doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT doc_row, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, (SELECT DISTINCT width FROM item_grams) WHERE len(w) >= width)),
shared AS (SELECT doc_row, doc_id, item_row, item_id, count(*) AS n_shared FROM doc_grams JOIN item_grams USING (width, g) GROUP BY doc_row, doc_id, item_row, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_row) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared / n_item DESC, n_shared DESC, n_item DESC) = 1
"""


@_query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size("secret_" + k).cast("long").alias("n_" + k) for k in ("assign", "access", "hex")]
    base = secrets.spans_text(secrets.KINDS[:3], "secret_", by_start=True)
    return docs.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(secrets.KINDS, "secret_", by_start=True).alias("spans"))


#: Where the public vocabulary files are; a parameter of the operators.
def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out() -> Column:
    """Documents that language identification must not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), with_bound=True)


@_query
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


@_query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    signals = quality.measure(docs).select(F.struct("doc.doc_id", "doc.lang", "doc.source").alias("doc"), "signals")
    judged = quality.judge(settle(signals, "signals"))  # the texts are measured once
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc.doc_id", *["signals." + c for c in columns], "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


ORACLE["op11_quality"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^ 	-
]+') AS w FROM d),
word AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
win AS (SELECT a.k, a.i, a.x AS x, b.x AS y, c.x AS z FROM word a JOIN word b ON b.k = a.k AND b.i = a.i + 1 JOIN word c ON c.k = a.k AND c.i = a.i + 2),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x, y, z) AS c FROM win) WHERE c > 1),
hit AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, i + unnest([0, 1, 2]) AS j FROM rep) GROUP BY k),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM line WHERE regexp_matches(x, '[^ 	-
]') GROUP BY k),
words AS (SELECT k, count(*) AS n_words, sum(length(x)) AS word_chars FROM word GROUP BY k),
s AS (SELECT d.k, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_lines, 0)::BIGINT AS n_lines,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN words ON words.k = d.k LEFT JOIN lines ON lines.k = d.k LEFT JOIN hit ON hit.k = d.k),
m AS (SELECT k, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS rule,
    unnest([word_chars * 100 // n_words, n_symbols * 1000 // n_words, n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // n_words]) AS v FROM s WHERE n_words > 0),
b AS (SELECT *, CASE WHEN v < 128 THEN v ELSE 64 * (length(bin(v)) - 7) + (v >> (length(bin(v)) - 7)) END AS bin FROM m),
own AS (SELECT lang, source, rule, bin, count(*) AS n FROM b GROUP BY ALL),
lang_bins AS (SELECT lang, rule, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, rule) AS total FROM own GROUP BY lang, rule, bin),
mixed AS (SELECT lang, source, rule, bin, sum(weight) AS weight FROM (
    SELECT own.lang, own.source, own.rule, own.bin, own.n * t.total AS weight FROM own JOIN (SELECT DISTINCT lang, rule, total FROM lang_bins) t ON t.lang = own.lang AND t.rule = own.rule
    UNION ALL SELECT l.lang, g.source, l.rule, l.bin, l.n * {quality.PRIOR} FROM lang_bins l JOIN (SELECT DISTINCT lang, source FROM own) g ON g.lang = l.lang) GROUP BY lang, source, rule, bin),
ranked AS (SELECT *, sum(weight) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto, sum(weight) OVER (PARTITION BY lang, source, rule) AS total FROM mixed),
q AS (SELECT lang, source, rule, min(bin) FILTER (WHERE upto * 4 >= total) AS q1, min(bin) FILTER (WHERE upto * 4 >= total * 3) + 1 AS q3 FROM ranked GROUP BY lang, source, rule),
e AS (SELECT lang, source, rule, CASE WHEN q1 < 128 THEN q1 ELSE (q1 - 64 * (q1 // 64 - 1)) << (q1 // 64 - 1) END AS low,
    CASE WHEN q3 < 128 THEN q3 ELSE (q3 - 64 * (q3 // 64 - 1)) << (q3 // 64 - 1) END - 1 AS high FROM q),
fence AS (SELECT lang, source, rule, low - spread AS low, high + spread AS high FROM (SELECT *, {quality.REACH} * greatest(high - low,
    CASE rule {" ".join(f"WHEN '{r.name}' THEN {r.spread}" for r in quality.RULES)} END) AS spread FROM e)),
bad AS (SELECT k, string_agg(m.rule, ',' ORDER BY CASE m.rule {" ".join(f"WHEN '{r.name}' THEN {i}" for i, r in enumerate(quality.RULES))} END) AS failed
  FROM m JOIN fence f ON f.lang = m.lang AND f.source = m.source AND f.rule = m.rule WHERE v > high OR (m.rule = 'word_length' AND v < low) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM s LEFT JOIN bad ON bad.k = s.k
"""


@_query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


ORACLE["op12_divergence"] = r"""
WITH w AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM w),
t AS (SELECT k, lang, source, unnest(w) AS term FROM w),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
lang_sum AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
own AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY t.lang, t.source, t.term),
own_sum AS (SELECT lang, source, sum(c) AS n FROM own GROUP BY lang, source),
grid AS (SELECT g.lang, g.source, kept.term, coalesce(own.c, 0) AS c,
    1 + (1000000000 * (coalesce(own.c, 0) + 2)::HUGEINT) // (coalesce(s.n, 0) + 2 * l.v) AS p, 1 + (1000000000 * (kept.c + 2)::HUGEINT) // (l.n + 2 * l.v) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN lang_sum l ON l.lang = g.lang LEFT JOIN own_sum s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
pair_sum AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pair_sum s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM grid WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
