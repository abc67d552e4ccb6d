"""File sources and sinks for prices, returns, traces, diagnostics and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators.layout import rank_rows

MARKET_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("return", T.DoubleType()),
    T.StructField("log_return", T.DoubleType()),
])
BLOCK_BYTES = 64 << 20


def dataset_name(by: str = "file") -> F.Column:
    """File name without its extension, or the name of the folder that holds a dataset's files."""
    if by == "folder":
        return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z0-9]+$", "")


def read_market_csv(spark: SparkSession, paths: str | list[str], by: str = "file") -> DataFrame:
    """date, price, return, log_return files with one header line; unparsable cells become NULL."""
    raw = spark.read.schema(MARKET_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(paths)
    return raw.select(dataset_name(by).alias("dataset"), *MARKET_SCHEMA.names)


def rejected_cells(df: DataFrame) -> DataFrame:
    """Cells per dataset that did not parse."""
    bad = [F.count_if(F.col(c).isNull()).alias(f"bad_{c}") for c in MARKET_SCHEMA.names]
    return df.groupBy("dataset").agg(*bad)


def read_returns_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One value per line, no header; the line number is t.

    Files stay splittable: a line's place is (start of its split, order inside the split), and ``t`` is its rank.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), dataset_name().alias("dataset"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"),
        F.col("value").try_cast("double").alias("y"),
    )
    return rank_rows(lines, ["path"], ["_start", "_row"]).select("path", "dataset", "t", "y")


def read_returns_f32(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Packed little-endian float32; n = bytes // 4. Each task reads one byte range, never a whole large file."""
    paths = [paths] if isinstance(paths, str) else paths
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(BLOCK_BYTES).cast("long"))
    ranges = files.filter("length >= 4").select("path", "length", F.explode(starts).alias("start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = ranges.repartition(n, "path", "start")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for path, length, start in pdf.itertuples(index=False):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    f.seek(start)
                    data = f.read(min(BLOCK_BYTES, length // 4 * 4 - start))
                y = np.frombuffer(data, "<f4").astype(float)
                yield pd.DataFrame({"path": path, "t": start // 4 + np.arange(len(y)), "y": y})

    return ranges.mapInPandas(load, "path string, t bigint, y double")


def manifest(df: DataFrame, key: str = "dataset") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def _dec(c: str) -> F.Column:
    return F.format_string("%.10f", F.col(c))


def returns_text(df: DataFrame) -> DataFrame:
    """Market rows as text cells: ISO date and ten decimals."""
    return df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), *[_dec(c).alias(c) for c in MARKET_SCHEMA.names[1:]])


def write_returns(df: DataFrame, path: str) -> None:
    returns_text(df).write.mode("overwrite").option("header", True).csv(path)


def write_returns_only(df: DataFrame, path: str, order: tuple[str, ...] = ("date",)) -> None:
    """One value per line. Range partitioning keeps the files in order without one task holding them all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(_dec("log_return")).write.mode("overwrite").text(path)


def write_returns_f32(df: DataFrame, path: str, y: str = "y") -> int:
    """Packed float32 files, one per partition, streamed batch by batch. Returns the number of values written.

    A file is named after its partition, so that a retried task replaces what it wrote before. The path must name its
    file system, which all executors have to reach."""
    if ":" not in path:
        raise ValueError("the path needs a scheme")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        n = 0
        with system.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():06d}.bin") as out:
            for pdf in batches:
                out.write(pdf[y].to_numpy("<f4").tobytes())
                n += len(pdf)
        yield pd.DataFrame({"n": [n]})

    return int(df.select(y).mapInPandas(store, "n bigint").agg(F.sum("n")).first()[0] or 0)


def trace(truth: DataFrame, est: DataFrame) -> DataFrame:
    """Per-tick rows of truth and estimate."""
    return truth.join(est, ["series_id", "t"]).select(
        "series_id", "t", F.col("y").alias("return"), F.col("h_true").alias("true_logvol"),
        F.col("vol_true").alias("true_vol"), F.col("h_mean").alias("est_logvol"), F.col("vol").alias("est_vol"),
        F.col("mu").alias("true_mu"), F.col("sigma_z").alias("true_sigma"), F.col("scenario_id").alias("scenario"),
    )


def write_trace(df: DataFrame, path: str, buckets: int = 16) -> None:
    """Trace files by hash bucket of the series: the number of folders does not grow with the number of series."""
    bucket = F.pmod(F.xxhash64("series_id"), F.lit(buckets))
    df.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").option("header", True).csv(path)


def pivot_gradients(df: DataFrame, nus: tuple[float, ...] = (5.0, 10.0, 30.0), keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """Gradient series at several nu side by side."""
    cols = [F.max(F.when(F.col("nu") == v, F.col("nu_grad"))).alias(f"grad_nu{int(v)}") for v in nus]
    return df.groupBy(*keys).agg(*cols)


DIAG_COLUMNS = ["t", "y_t", "vol", "z_sq", "nu_grad", "nu_grad_ema", "z_sq_ema", "shock_state"]


def write_diag(df: DataFrame, path: str, key: str = "series_id") -> None:
    df.select(key, *DIAG_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def to_json_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("report"))
