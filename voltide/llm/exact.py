"""Exact dedup: a persistent digest index, bucketed and sorted by hash; new traces meet it in a sort-merge anti-join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.session import cut_lineage, scratch_table

BUCKETS = 64
HOT_SHARE = 1000  # a digest is hot with more than one row in so many: there are fewer such digests than this


def trace_digest(trace: Column) -> Column:
    """SHA-256 of the whole trace in UTF-8, nothing changed; NULL counts as empty."""
    return F.unhex(F.sha2(F.coalesce(trace, F.lit("")), 256))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = BUCKETS) -> str:
    """Name of the session's table over the index at ``path``, a folder that all executors share; created where there is
    none. One row per different trace: digest, keep_id, n (rows that brought it with its batch) and the batch."""
    name = f"digest_index_{uuid.uuid4().hex}"
    files, folder = _folder(spark, path)
    files.mkdirs(folder)
    spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id {id_type}, n BIGINT, batch INT) USING parquet PARTITIONED BY (batch) "
              f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def add_batch(index: str, path: str, digests: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """Append what is new of ``digests`` (series_id, digest) to the index at ``path`` as batch number ``batch``.

    Equal digests are added up before the shuffle, so that a trace with a third of all rows is one row of each task. The
    digests that earlier batches have go in an anti-join with the index, whose buckets are read as they lie: only the new
    rows move. The rest is written as the batch's partition. What is there of it from a call that was lost goes first, so
    that a batch can be added again with the same result."""
    spark = digests.sparkSession
    new = digests.groupBy("digest").agg(F.max("series_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).repartition(buckets, "digest")
    known = spark.table(index).where(F.col("batch") < batch).select("digest")
    new = new.join(known.hint("merge"), "digest", "left_anti")
    new.createOrReplaceTempView(f"{index}_new")
    files, lost = _folder(spark, f"{path}/batch={int(batch)}")
    files.delete(lost, True)
    spark.sql(f"ALTER TABLE {index} DROP IF EXISTS PARTITION (batch = {int(batch)})")
    spark.sql(f"INSERT INTO {index} PARTITION (batch = {int(batch)}) SELECT digest, keep_id, n FROM {index}_new")
    spark.catalog.dropTempView(f"{index}_new")


def look_up(digests: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of digests with the other columns of the index's entries and group_size, the rows of digests that share
    the digest.

    The few digests with more than a thousandth of all rows are fewer than a thousand and travel to every task; their
    rows stay where they are. All others meet by sort-merge."""
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    of = cut_lineage(sizes.join(entries.hint("merge"), "digest"))
    more = [c for c in of.columns if c != "digest"]
    limit = max(1, (of.agg(F.sum("group_size")).first()[0] or 0) // HOT_SHARE)
    hot = of.where(F.col("group_size") > limit).select("digest", F.struct(*more).alias("_found"))
    d = digests.join(F.broadcast(hot), "digest", "left")
    here = d.where(F.col("_found").isNotNull()).select(*digests.columns, "_found.*")
    there = d.where(F.col("_found").isNull()).drop("_found").join(of.where(F.col("group_size") <= limit).hint("merge"), "digest")
    return here.unionByName(there)


def index_traces(traces: DataFrame, path: str | None = None, call: int | None = None, steps: int = 2) -> DataFrame:
    """Exact duplicates among traces and against what the index at ``path`` has from earlier calls.

    traces: series_id, trace; other columns are ignored. Returns one row per row of traces, dropped ones too:
    series_id, digest, keep_id (the series_id that stays for this text), group_size (rows of traces with this text) and
    kept. Traces are equal when they are identical with no change; NULL counts as empty.

    Of equal traces that the index doesn't have, the row with the largest series_id stays; where the index has the text
    from an earlier call, its keep_id stays and none of these rows. The traces are added in ``steps`` ranges of
    series_id (numbers; other ids in one), the largest first, each deduplicated against the index by a sort-merge
    anti-join and appended to it. A call without ``path`` starts a new index in the shared folder. Calls are numbered on;
    one that was lost half way is repeated with its number as ``call``, which replaces what it had written.

    Rows with a NULL id come last: they stay only where no row of that text has an id. Rows equal in id and text are one
    record and marked alike. Empty in, empty out; the order of rows and the partitions don't matter. Built-in functions
    only."""
    spark = traces.sparkSession
    digests = cut_lineage(traces.select("series_id", trace_digest(F.col("trace")).alias("digest")))
    kind = dict(digests.dtypes)["series_id"]
    path = scratch_table(spark, "digests") if path is None else path
    index = open_index(spark, path, kind)
    if call is None:
        call = (spark.table(index).agg(F.max("batch")).first()[0] or 0) // steps + 1
    bounds = []
    if steps > 1 and kind in ("tinyint", "smallint", "int", "bigint"):
        cuts = [F.percentile_approx("series_id", k / steps) for k in range(1, steps)]
        bounds = [b for b in digests.agg(F.array(*cuts)).first()[0] if b is not None]
    step = F.lit(len(bounds))  # 0 for the rows with the largest ids
    for b in bounds:
        step = step - F.coalesce(F.col("series_id") > F.lit(b), F.lit(False)).cast("int")
    for k in range(len(bounds) + 1):
        add_batch(index, path, digests.where(step == k), call * steps + k)
    entries = spark.table(index).where(F.col("batch") < (call + 1) * steps)
    found = look_up(digests, entries.select("digest", "keep_id", (F.col("batch") < call * steps).alias("_old")))
    kept = F.col("series_id").eqNullSafe(F.col("keep_id")) & ~F.col("_old")
    return found.select("series_id", "digest", "keep_id", "group_size", kept.alias("kept"))
