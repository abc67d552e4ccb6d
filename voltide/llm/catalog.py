"""Queries of the numbered operators over the driver tables: thin steps from tables to operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import chat, divergence, exact, fingerprints, hmm, html, langid, lines, neardup, packing, periodic, quality, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as traces."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("series_id"), F.col("text").alias("trace"))


@query("op1_lm_scoring")
def op1(spark, sf):
    held = F.crc32(F.col("series_id").cast("string")) % 10 == 0
    d = hmm.score_traces(traces(spark, sf).withColumn("learn", ~held))
    return d.select(
        F.col("series_id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_minhash_near_dedup")
def op2(spark, sf):
    return neardup.near_classes(traces(spark, sf)).withColumnRenamed("series_id", "doc_id")


@query("op3_chat_formatting")
def op3(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], c.schema)
    return chat.read_back(chat.format_chats(c.unionByName(probe)))


@query("op4_bpe")
def op4(spark, sf):
    d = wordbpe.bpe_encode(traces(spark, sf))
    return d.select(
        F.col("series_id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_best_fit_packing")
def op5(spark, sf):
    d = packing.pack(packing.token_pieces(traces(spark, sf)))
    return d.select(F.col("series_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


OP6 = r"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op6_line_dedup", OP6)
def op6(spark, sf):
    d = lines.dedup_lines(traces(spark, sf))
    return d.select(F.col("series_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_html_extraction")
def op7(spark, sf):
    return html.extract_pages(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op8_language_id")
def op8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    out = langid.identify_languages(d.withColumnRenamed("doc_id", "text_id"), d.where(fold != 1))
    out = out.withColumnRenamed("text_id", "doc_id")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score")


@query("op9_document_fingerprints")
def op9(spark, sf):
    return fingerprints.compare_with_next(traces(spark, sf)).withColumnRenamed("series_id", "doc_id")


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP10 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
             len(list_filter(ws, lambda q: lower(q) IN ({_STOP}))) AS n_stop_words
      FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             word_chars / greatest(n_words, 1) BETWEEN 3 AND 8 AND n_symbols / greatest(word_chars, 1) <= 0.05
             AND n_upper / greatest(word_chars, 1) <= 0.3 AND n_stop_words / greatest(n_words, 1) >= 0.08
             AND n_dup_lines / greatest(n_lines, 1) <= 0.7 AS good FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM b
"""


@query("op10_quality_rules", OP10)
def op10(spark, sf):
    return quality.quality_rules(traces(spark, sf)).select(
        F.col("series_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT id, lang, source, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
v AS (SELECT lang, term, count(*) AS c FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
n AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY 1),
c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN v ON v.lang = o.lang AND v.term = o.term GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // CAST(coalesce(s.n, 0) + 5 * n.v AS HUGEINT) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (v.c + 5)) // CAST(n.n + 5 * n.v AS HUGEINT) AS q
      FROM g JOIN v ON v.lang = g.lang JOIN n ON n.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) f
        ON f.lang = a.lang AND f.a = a.source AND f.b = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", OP11)
def op11(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("scenario"), F.col("source").alias("arm"), F.col("text").alias("trace"))
    return divergence.source_divergence(d).withColumnsRenamed({"scenario": "lang", "arm": "source"})


OP12 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) WINDOW g AS (PARTITION BY x)
"""


@query("op12_exact_dedup", OP12)
def op12(spark, sf):
    d = exact.index_traces(traces(spark, sf))
    return d.select(F.col("series_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def looped(d: DataFrame) -> DataFrame:
    """Traces of which a tenth (crc32 of the id divisible by ten) go on from some word with a block of words again and again."""
    h = F.crc32(F.col("series_id").cast("string"))
    words = F.expr(r"regexp_extract_all(trace, '[^\\x20\\x09-\\x0D]+', 0)")
    d = d.withColumns({"_g": F.floor(h / 10), "_w": F.when(h % 10 == 0, words)}).withColumn("_n", F.size("_w").cast("long"))
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    d = d.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    again = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return d.select("series_id", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("trace")).alias("trace"))


@query("op13_periodic_runs")
def op13(spark, sf):
    d = periodic.periodic_runs(looped(traces(spark, sf)))
    line = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    milli = F.expr("1000 * top.length div top.period")
    return d.select(
        F.col("series_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli.alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
