"""Session helper, lineage cuts and the size checks every operator relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A group with at most this many rows may be handled by one window task.
MAX_GROUP_ROWS = 1 << 20
# A table with at most this many rows and bytes may be broadcast.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def get_session(app: str = "voltide", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is configured, a local session gets a fresh local folder; on a
    cluster that is an error, since executors don't see each other's disks."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not configured and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="voltide-"))
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table of the shared folder and go on from there. Each row is computed once, later steps
    read only the columns they need, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = scratch_table(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_table(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def group_bound(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group. One column-pruned aggregate with map-side combine."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first()
    return int(row["m"] or 0)


def fits_broadcast(df: DataFrame, limit: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when the table has at most ``limit`` rows and ``max_bytes`` (as JSON); reads no more than limit+1 of them."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, total = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return rows <= limit and (total or 0) <= max_bytes
