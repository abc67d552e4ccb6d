"""Two time scales of the same series: a quick scout and a slow baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEVATED, RATIO = 0.02, 1.3


def multiscale(fast: DataFrame, slow: DataFrame, obs: DataFrame, w_fast: float = 0.0, w_slow: float = 1.0, vol0: float = 0.01,
               bound: int | None = None) -> DataFrame:
    """Estimates of both scales joined per tick, combined, and classified as transient, regime shift or calm.

    The default weights trust the slow scale alone; the surprise is measured against the previous combined vol.
    """
    from voltide.operators.layout import over_time

    cols = ["vol", "h_mean", "loglik_filtered", "ksd", "stein_steps"]
    side = lambda d, s: d.select("series_id", "t", *[F.col(c).alias(f"{c}_{s}") for c in cols if c in d.columns])
    d = side(fast, "fast").join(side(slow, "slow"), ["series_id", "t"]).join(obs.select("series_id", "t", "y"), ["series_id", "t"])
    vf, vs = F.col("vol_fast"), F.col("vol_slow")
    d = d.withColumn("h_combined", w_fast * F.col("h_mean_fast") + w_slow * F.col("h_mean_slow"))
    d = d.withColumn("vol_combined", F.pow(vf, F.lit(w_fast)) * F.pow(vs, F.lit(w_slow)))
    if "loglik_filtered" in fast.columns:
        d = d.withColumn("loglik_combined", w_fast * F.col("loglik_filtered_fast") + w_slow * F.col("loglik_filtered_slow"))
    d = over_time(d, ["series_id"], {"_vp": lambda w: F.lag("vol_combined", 1, vol0).over(w)}, bound=bound)
    d = d.withColumn("surprise", F.abs("y") / F.greatest(F.col("_vp"), F.lit(1e-6))).drop("_vp")
    ratio = vf / F.greatest(vs, F.lit(1e-8))
    return (d.withColumn("transient_magnitude", vf - vs).withColumn("transient_ratio", ratio)
            .withColumn("is_transient", (vf > ELEVATED) & (ratio > RATIO) & (vs < ELEVATED))
            .withColumn("is_regime_shift", (vf > ELEVATED) & (vs > ELEVATED))
            .withColumn("is_calm", (vf < ELEVATED) & (vs < ELEVATED)))


def vol_for(purpose: str) -> Column:
    """Vol blend for a use: execution leans on the quick scale, position on the slow one, risk takes the larger."""
    f, s = F.col("vol_fast"), F.col("vol_slow")
    return {"execution": 0.7 * f + 0.3 * s, "position": 0.2 * f + 0.8 * s, "conservative": F.greatest(f, s)}[purpose]
