"""Line dedup: range-partitioned line names, first occurrences by document, run-length keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltide.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]"
BANDS = 64  # a frequent line's rows are dealt over so many (name, band) groups


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_lines(trace: Column) -> Column:
    return F.split(F.coalesce(trace, F.lit("")), "\n", -1)


def _row() -> Column:
    """Tells rows of one series_id with different traces apart."""
    return F.xxhash64("trace")


def _occurrences(traces: DataFrame, min_chars: int) -> DataFrame:
    """series_id, row, pos, name: every line whose key has min_chars code points or more. name: 128 bits of the key."""
    d = traces.select("series_id", _row().alias("row"), F.posexplode(split_lines(F.col("trace"))).alias("pos", "line"))
    d = d.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return d.where(F.length("key") >= min_chars).select("series_id", "row", "pos", F.unhex(F.md5("key")).alias("name"))


def _runs(dropped: Column) -> Column:
    """Sorted positions as run lengths: kept, dropped, kept, dropped ... Lines after the last run are kept."""
    starts = F.filter(dropped, lambda p, k: (k == 0) | (F.get(dropped, k - 1) != p - 1))
    ends = F.filter(dropped, lambda p, k: (k == F.size(dropped) - 1) | (F.get(dropped, k + 1) != p + 1))
    edges = F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))
    return _let(edges, lambda e: F.transform(e, lambda x, k: x - F.coalesce(F.get(e, k - 1), F.lit(0))))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apply_runs(lines: Column, runs: Column) -> Column:
    """The kept lines joined by newlines."""
    none = F.array().cast("array<int>")
    edges = F.aggregate(runs, none, lambda acc, r: F.concat(acc, F.array(r + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))

    def kept(e: Column) -> Column:  # edge k ends run k; runs 0, 2, 4 ... and what follows the last run are kept
        pieces = F.transform(e, lambda x, k: F.when(k % 2 == 0, F.slice(lines, F.coalesce(F.get(e, k - 1), F.lit(0)) + 1, x - F.coalesce(F.get(e, k - 1), F.lit(0)))))
        return F.array_join(F.flatten(F.filter(pieces, lambda x: x.isNotNull())), "\n")

    return _let(F.concat(edges, F.array(F.size(lines))), kept)


def keep_bitmaps(traces: DataFrame, min_chars: int = 20, min_series: int = 3) -> DataFrame:
    """series_id, row, n_dropped, keep_runs: which lines of a trace stay, for every trace that loses one.

    A line's key is the line stripped of white space at its ends, A-Z in lower case. Keys of at least min_chars code
    points in at least min_series series stay only in the largest series_id that has them. keep_runs is the keep bitmap
    as run lengths: kept lines, dropped lines, and so on; lines after the last run stay. row is a hash of the trace.

    Names of lines are range-partitioned by (name, band of the series), sorted by series descending and position, and
    the first line of a series is marked in that order; the counts per name are added up from the bands, so that a
    line which a third of all traces have is dealt over many tasks. Built-in functions only.

    A NULL or empty trace is one empty line. Rows with one series_id count as one series; repeated rows lose the same
    lines. Rows without id are left alone. An empty table gives an empty one; further columns are ignored.
    """
    d = traces.select("series_id", "trace").where(F.col("series_id").isNotNull())
    occ = cut_lineage(_occurrences(d, min_chars))
    occ = occ.withColumn("band", F.pmod(F.xxhash64("series_id"), F.lit(BANDS)).cast("int"))
    ranged = occ.select("name", "band", "series_id", "pos").repartitionByRange("name", "band")
    ranged = ranged.sortWithinPartitions("name", "band", F.desc("series_id"), "pos")
    w = Window.partitionBy("name", "band").orderBy(F.desc("series_id"), "pos")
    first = ranged.withColumn("first", F.coalesce(F.lag("series_id").over(w) != F.col("series_id"), F.lit(True)))
    bands = first.where("first").groupBy("name", "band").agg(F.count(F.lit(1)).alias("n"), F.max("series_id").alias("keeper"))
    heads = bands.groupBy("name").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"), F.collect_list("band").alias("bands"))
    heads = heads.where(F.col("n") >= min_series).select("name", "keeper", F.explode("bands").alias("band"))
    gone = occ.join(heads, ["name", "band"]).where(F.col("series_id") != F.col("keeper"))
    gone = gone.groupBy("series_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return gone.select("series_id", "row", F.size("dropped").alias("n_dropped"), _runs(F.col("dropped")).alias("keep_runs"))


def dedup_lines(traces: DataFrame, min_chars: int = 20, min_series: int = 3) -> DataFrame:
    """Traces with n_lines, n_dropped, keep_runs and kept, the trace without the lines that keep_bitmaps drops.

    Returns all columns of traces and these four (kept is empty for a NULL trace)."""
    gone = keep_bitmaps(traces, min_chars, min_series).select(
        F.col("series_id").alias("_id"), F.col("row").alias("_row"), F.col("n_dropped").alias("_n"), F.col("keep_runs").alias("_runs"))
    d = traces.drop("n_lines", "n_dropped", "keep_runs", "kept").join(gone, (F.col("series_id") == F.col("_id")) & (_row() == F.col("_row")), "left")
    d = d.withColumn("_lines", split_lines(F.col("trace")))
    kept = F.when(F.col("_runs").isNull(), F.coalesce(F.col("trace"), F.lit(""))).otherwise(apply_runs(F.col("_lines"), F.col("_runs")))
    return d.withColumns({
        "n_lines": F.size("_lines").cast("bigint"), "n_dropped": F.coalesce(F.col("_n"), F.lit(0)).cast("bigint"),
        "keep_runs": F.coalesce(F.col("_runs"), F.array().cast("array<int>")), "kept": kept,
    }).drop("_id", "_row", "_n", "_runs", "_lines")
