"""The particle filter on a stream: micro-batches advance versioned state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.functions.config import FilterConfig
from voltide.operators import particles as pt
from voltide.operators.layout import rank_rows
from voltide.plans.series_filter import KEY, STATE, advance, run_tick, start_rows, step_ticks, table_exists
from voltide.session import scratch_table


class FilterStream:
    """The state of all series in the folder ``path``, which all executors see: one version per micro-batch.

    ``process`` is a ``foreachBatch`` function for rows series_id, ts, tie, y. The rows of a batch are taken per series by
    (ts, tie); batches must come in the order of time, as from the ordering processor. A version holds ests (estimates),
    health every ``health_every`` ticks of a series, particles (with ``keep_particles``; of the last ``retain`` batches
    where given) and, written last, state. A batch whose state is there was done and is passed over, and one that was
    lost half way is written again with the same result, since draws depend on series, tick and particle only."""

    def __init__(self, path: str, cfg: FilterConfig, seed: int = 42, ticks: int | None = None, health_every: int = 0, keep_particles: bool = False, retain: int | None = None):
        self.path, self.cfg, self.health_every, self.keep_particles, self.retain = path, cfg, health_every, keep_particles, retain
        self.tick = run_tick(cfg, seed, bool(health_every or keep_particles))
        self.ticks = step_ticks(self.tick) if ticks is None else ticks

    def _files(self, spark: SparkSession):
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder

    def versions(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches that are done."""
        files, folder = self._files(spark)
        if not files.exists(folder):
            return []
        found = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(k for k in (int(x[6:]) for x in found if x.startswith("batch-")) if table_exists(spark, f"{self.path}/batch-{k}/state"))

    def process(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = self.versions(spark)
        if number in done:
            return
        at, before = f"{self.path}/batch-{number}", [k for k in done if k < number]
        rows = batch.select("series_id", "ts", "tie", "y").where(F.col("y").isNotNull() & ~F.isnan("y"))
        ranked = rank_rows(rows, ["series_id"], ["ts", "tie"], "_k")
        ys = ranked.groupBy("series_id", F.floor(F.col("_k") / self.ticks).cast("int").alias("step")).agg(F.array_sort(F.collect_list(F.struct("_k", "y"))).alias("_ys"))
        ys.select("series_id", "step", F.col("_ys.y").alias("ys")).write.mode("overwrite").parquet(f"{at}/ys")
        ys = spark.read.parquet(f"{at}/ys")
        theta = ys.where("step = 0").select("series_id", F.lit(self.cfg.config_id).alias("config_id"), *[F.lit(float(getattr(self.cfg, c))).alias(c) for c in ("rho", "sigma_z", "mu")])
        old = spark.read.parquet(f"{self.path}/batch-{before[-1]}/state") if before else None
        fresh = start_rows(theta if old is None else theta.join(old, "series_id", "left_anti"), self.cfg, self.tick.draws)
        state = fresh if old is None else old.select(*STATE).unionByName(fresh)
        now, tables = state, []
        for k in range((ys.agg(F.max("step")).first()[0] if not ys.isEmpty() else -1) + 1):
            advance(now, ys.where(F.col("step") == k), self.tick, self.ticks).write.mode("overwrite").parquet(f"{at}/step-{k}")
            now = spark.read.parquet(f"{at}/step-{k}")
            tables.append((k, now))
        if tables:
            self._emit(at, tables)
        # the version: each series' last step of this batch, or what it was; a step has the series that have its returns
        if tables:
            last = ys.groupBy("series_id").agg(F.max("step").alias("step"))
            moved = reduce(DataFrame.unionByName, [d.select(*STATE, F.lit(k).alias("step")) for k, d in tables])
            moved = moved.join(last.hint("merge"), ["series_id", "step"]).select(*STATE)
            state = moved if old is None else moved.unionByName(old.select(*STATE).join(last.hint("merge"), "series_id", "left_anti"))
        state.write.mode("overwrite").parquet(f"{at}/state")
        if self.retain is not None:
            files, _ = self._files(spark)
            for k in done:
                if k <= number - self.retain:
                    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-{k}/particles"), True)

    def _emit(self, at: str, tables: list[tuple[int, DataFrame]]) -> None:
        d = None
        for _, x in tables:
            x = x.select(*KEY, F.explode("ests").alias("e")).select(*KEY, "e.*")
            d = x if d is None else d.unionByName(x)
        sets = [c for c in ("h", "log_w") if c in d.columns]
        d.drop(*sets).write.mode("overwrite").parquet(f"{at}/ests")
        if sets:
            p = d.select(*KEY, "t", F.inline(F.arrays_zip(F.col("h"), F.col("log_w"))))
            if self.health_every:
                health = pt.health_status(pt.particle_health(p.where(F.col("t") % self.health_every == 0), [*KEY, "t"]))
                health.write.mode("overwrite").parquet(f"{at}/health")
            if self.keep_particles:
                p.write.mode("overwrite").parquet(f"{at}/particles")

    def read(self, spark: SparkSession, what: str = "ests") -> DataFrame:
        """ests, health, particles or, of the last version, state; readable while the stream runs."""
        done = self.versions(spark)
        if what == "state":
            return spark.read.parquet(f"{self.path}/batch-{done[-1]}/state")
        found = [f"{self.path}/batch-{k}/{what}" for k in done if table_exists(spark, f"{self.path}/batch-{k}/{what}")]
        return spark.read.parquet(*found)


def run_arrivals(spark: SparkSession, parts: list[DataFrame], start, label: str) -> None:
    """A file stream that grows by one table after another: each is written with the files it has, then a query over the
    same checkpoint takes everything that is new. ``start`` turns a stream and its checkpoint folder into a running query."""
    path = scratch_table(spark, label)
    for p in parts:
        p.write.mode("append").parquet(path)
        start(spark.readStream.schema(parts[0].schema).parquet(path), path + "-log").awaitTermination()
