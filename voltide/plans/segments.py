"""Long series cut into segments that run side by side, each with a copied burn-in before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.functions.config import FilterConfig
from voltide.operators.layout import rank_rows
from voltide.plans.series_filter import filter_series


def segment_rows(obs: DataFrame, batch: int, burn_in: int, least: int = 10, bound: int | None = None) -> DataFrame:
    """The rows (series_id, t, y) as segments of ``batch`` rows: series, segment, series_id (`series:segment`), t (the row's
    place in its segment) and own. The last ``burn_in`` rows of a segment are copied before the next one, where they are
    not its own. A segment with fewer than ``least`` rows of its own is left out."""
    if burn_in > batch:
        raise ValueError("a burn-in must fit into one segment")
    d = rank_rows(obs.select("series_id", "t", "y"), ["series_id"], ["t"], "_k", bound, size="_n")
    at = F.floor(F.col("_k") / batch)
    copy = F.struct(at.alias("segment"), (F.col("_k") - at * batch + F.when(at > 0, burn_in).otherwise(0)).alias("place"), F.lit(True).alias("own"))
    halo = F.struct((at + 1).alias("segment"), (F.col("_k") - (at + 1) * batch + burn_in).alias("place"), F.lit(False).alias("own"))
    last = F.floor((F.col("_n") - 1) / batch)
    rows = F.when((F.col("_k") - at * batch >= batch - burn_in) & (at < last), F.array(copy, halo)).otherwise(F.array(copy))
    d = d.select("series_id", "y", "_n", F.inline(rows))
    own = F.least(F.col("_n") - F.col("segment") * batch, F.lit(batch))
    d = d.where(own >= least)
    return d.select(F.col("series_id").alias("series"), "segment", F.concat_ws(":", "series_id", "segment").alias("series_id"),
                    F.col("place").cast("long").alias("t"), "y", "own")


def predictive_nll(obs: DataFrame, cfg: FilterConfig, batch: int = 250, burn_in: int = 20, least: int = 10, bound: int | None = None, **run) -> DataFrame:
    """Mean predictive negative log-likelihood of every series over its segments, the evidence taken before particles move:
    series_id, nll, n_segments, n_scored and n_left_out, the rows that no segment scores: the burn-in of the first one and
    segments that are too short. Antithetic draws are an option of ``cfg``."""
    rows = segment_rows(obs, batch, burn_in, least, bound)
    est = filter_series(rows.select("series_id", "t", "y"), cfg, bound=batch + burn_in, **run)
    est = est.where(F.col("t") >= burn_in).select(F.substring_index("series_id", ":", 1).alias("series"), "series_id", "loglik_predictive")
    scored = est.groupBy("series").agg((-F.avg("loglik_predictive")).alias("nll"), F.count_distinct("series_id").alias("n_segments"), F.count(F.lit(1)).alias("n_scored"))
    sizes = obs.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    d = sizes.join(scored, F.col("series_id").cast("string") == F.col("series"), "left")
    return d.select("series_id", "nll", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
                    (F.col("_n") - F.coalesce("n_scored", F.lit(0))).alias("n_left_out"))
