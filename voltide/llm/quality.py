"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages that traces are annotated in.
STOP_WORDS = (
    "the of and to in is that it for on was be with as this by at are from or "
    "der die das und den von zu mit ist im nicht ein eine dem sich auf für des auch als "
    "de la le et les des en un une du que est pour qui dans par sur au pas avec "
    "el y los las del se por con una su para al lo no más o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a trace if `low` <= `measure` <= `high` (None: open)."""

    measure: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (Rule("n_words", low=50), Rule("repeat_percent", high=50))
RULES = (
    Rule("mean_word_chars", low=3.0, high=8.0),
    Rule("symbol_ratio", high=0.05),
    Rule("upper_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.08),
    Rule("dup_line_ratio", high=0.7),
)


def _count_of(text: Column, symbols: str) -> Column:
    return F.length(text) - F.length(F.translate(text, symbols, ""))


def _measures(traces: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("trace"), F.lit(""))
    d = traces.withColumn("_t", t)
    d = d.withColumn("_words", F.filter(F.split("_t", SPACE), lambda w: w != ""))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    # 64-bit names of the 3-word windows
    d = d.withColumn("_grams", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(3)]))).otherwise(F.array().cast("array<bigint>")))
    # starts of windows that occur again: equal neighbours in the order of names; only texts with a repeat are sorted
    d = d.withColumn("_named", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    d = d.withColumn("_starts", F.array_sort(F.transform(
        F.filter("_named", lambda x, k: (F.get("_named", k - 1)["g"] == x["g"]) | (F.get("_named", k + 1)["g"] == x["g"])), lambda x: x["i"])))
    # a start covers three words, less what the next start covers too
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"),
        lambda acc, x: acc + x)
    word_chars = F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))
    d = d.select(
        "series_id",
        n.cast("bigint").alias("n_words"),
        word_chars.cast("bigint").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]", "")).cast("bigint").alias("n_upper"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return d.withColumns({
        "repeat_percent": 100 * F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / chars,
        "upper_ratio": F.col("n_upper") / chars,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
    })


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column: every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.measure) >= r.low)
        if r.high is not None:
            verdict = verdict & (F.col(r.measure) <= r.high)
    return verdict


def quality_rules(traces: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict per trace, built-in functions only, no shuffle.

    traces: series_id, trace; other columns are ignored. Returns series_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_upper, n_stop_words, the ratios, base_failed and kept.

    A NULL or empty trace has no words and fails the base rules. Repeated rows and equal or NULL ids give a row each.
    An empty table gives an empty one. Of the words of 3-word windows found twice or more, all are counted, once each.
    Long traces cost n log n at most.
    """
    m = _measures(traces.select("series_id", "trace"))
    failed = ~compile_rules(base)
    d = m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    # counted as they pass; a filter on the verdict stays above this, and the measures are computed once
    return d.observe(f"quality_rules_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"))
