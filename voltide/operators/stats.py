"""Aggregations over returns, estimates, diagnostics and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.operators.layout import index_at, join_back, order_stats
from voltide.session import MAX_GROUP_ROWS


def return_stats(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"),
                                 F.min(y).alias("min"), F.max(y).alias("max"))


def tail_counts(df: DataFrame, keys: list[str], mode: str = "centred", y: str = "y") -> DataFrame:
    """Counts beyond 3/4(/5) sigma: centred with population std, or raw with sample std."""
    sd = F.stddev_pop(y) if mode == "centred" else F.stddev_samp(y)
    moments = df.groupBy(*keys).agg((F.avg(y) if mode == "centred" else F.lit(0.0)).alias("_m"), sd.alias("_s"))
    dev = F.abs(F.col(y) - F.col("_m"))
    levels = (3, 4) if mode == "centred" else (3, 4, 5)
    return join_back(df, moments, keys).groupBy(*keys).agg(
        *[F.count_if(dev > k * F.col("_s")).alias(f"n_{k}sigma") for k in levels])


def mu_level(y: str = "y") -> Column:
    return 2 * F.log(F.stddev_pop(y) + 1e-8)


def estimate_mu(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(mu_level(y).alias("mu"))


def sequence_loglik(est: DataFrame, keys: list[str], col: str = "loglik") -> DataFrame:
    return est.groupBy(*keys).agg(F.sum(col).alias("loglik"), F.count(F.lit(1)).alias("n"))


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation, 0 when either sum of squares is below 1e-10."""
    n = F.count(F.lit(1))
    flat = (F.var_pop(a) * n < 1e-10) | (F.var_pop(b) * n < 1e-10)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def error_aggs(est: str = "h_est", true: str = "h_true") -> list[Column]:
    d = F.col(est) - F.col(true)
    return [F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias")]


def error_metrics(df: DataFrame, keys: list[str], est: str = "h_est", true: str = "h_true") -> DataFrame:
    return df.groupBy(*keys).agg(*error_aggs(est, true), guarded_corr(est, true).alias("corr"))


def nll(est: DataFrame, keys: list[str], warmup: int, col: str = "loglik") -> DataFrame:
    return est.filter(F.col("t") >= warmup).groupBy(*keys).agg((-F.avg(col)).alias("nll"))


def coverage(particles: DataFrame, truth: DataFrame, set_keys: list[str], out_keys: list[str], h: str = "h",
             levels: tuple[float, ...] = (0.5, 0.9, 0.95), tie: str = "i", bound: int | None = None,
             on: list[str] | None = None) -> DataFrame:
    """Share of true values inside the central interval of their particle set, by sorted-index picks."""
    picks = {}
    for lv in levels:
        alpha = (1 - lv) / 2
        picks[f"_lo{int(lv * 100)}"] = index_at(alpha)
        picks[f"_hi{int(lv * 100)}"] = index_at(1 - alpha)
    bands = order_stats(particles, set_keys, h, picks, [tie], bound)
    joined = bands.join(truth, on or set_keys)
    inside = [F.avg(F.col("h_true").between(F.col(f"_lo{int(lv * 100)}"), F.col(f"_hi{int(lv * 100)}")).cast("double"))
              .alias(f"coverage_{int(lv * 100)}") for lv in levels]
    return joined.groupBy(*out_keys).agg(*inside)


def metric_stats(df: DataFrame, keys: list[str], value: str, tie: list[str], bound: int | None = None) -> DataFrame:
    """Mean, sample std, index-based median / p5 / p95, min, max."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                    F.min(value).alias("min"), F.max(value).alias("max"))
    picks = {"median": index_at(0.5), "p5": index_at(0.05), "p95": index_at(0.95)}
    return moments.join(order_stats(df, keys, value, picks, tie, bound), keys)


def percentiles(df: DataFrame, keys: list[str], value: str, tie: list[str], bound: int | None = None,
                approx: bool = False, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """p50/p90/p99/p99.9 by index with mean and population std; ``approx`` uses the built-in quantile sketch."""
    moments = [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
               F.max(value).alias("max")]
    qs = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    if approx:
        return df.groupBy(*keys).agg(*moments, *[F.percentile_approx(value, q, 10_000).alias(n) for n, q in qs.items()])
    picks = {n: index_at(q) for n, q in qs.items()}
    return df.groupBy(*keys).agg(*moments).join(order_stats(df, keys, value, picks, tie, bound, limit), keys)


def ksd_summary(df: DataFrame, keys: list[str], col: str, tie: list[str], bound: int | None = None) -> DataFrame:
    base = df.groupBy(*keys).agg(F.min(col).alias("ksd_min"), F.max(col).alias("ksd_max"))
    picks = {"ksd_median": index_at(0.5), "ksd_p99": index_at(0.99)}
    return base.join(order_stats(df, keys, col, picks, tie, bound), keys)


def step_histogram(est: DataFrame, keys: list[str], col: str = "stein_steps") -> DataFrame:
    """Ticks per number of steps, their share, and the share at the group's maximum."""
    counts = est.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.max_by("n", col).alias("_top"))
    return counts.join(total, keys).select(*keys, col, "n", (F.col("n") / F.col("_n")).alias("share"),
                                           (F.col("_top") / F.col("_n")).alias("share_at_max"))


def crash_calm_split(diag: DataFrame, keys: list[str], threshold: float = 9.0) -> DataFrame:
    crash = F.col("z_sq") > threshold
    out = diag.groupBy(*keys).agg(
        F.count_if(crash).alias("n_crash"),
        F.coalesce(F.avg(F.when(crash, F.col("nu_grad"))), F.lit(0.0)).alias("grad_crash"),
        F.coalesce(F.avg(F.when(~crash, F.col("nu_grad"))), F.lit(0.0)).alias("grad_calm"),
    )
    ratio = F.when(F.col("grad_calm") == 0, 0.0).otherwise(F.abs(F.try_divide("grad_crash", "grad_calm")))
    return out.withColumn("ratio", ratio)


def grad_corr(diag: DataFrame, keys: list[str], a: str = "nu_grad", b: str = "z_sq") -> DataFrame:
    n = F.count(F.lit(1))
    return diag.groupBy(*keys).agg(
        (F.covar_pop(a, b) * n / (F.sqrt(F.var_pop(a) * n * F.var_pop(b) * n) + 1e-10)).alias("grad_corr"))


def grad_informativeness(diag: DataFrame, keys: list[str], col: str, threshold: float) -> DataFrame:
    """Sign counts, mean |g| and share above the threshold; non-finite rows are excluded, the divisor stays n."""
    g = F.col(col)
    ok = g.isNotNull() & ~F.isnan(g) & (F.abs(g) < float("inf"))
    n = F.count(F.lit(1))
    return diag.groupBy(*keys).agg(
        F.count_if(ok & (g > 0)).alias("n_pos"), F.count_if(ok & (g <= 0)).alias("n_neg"),
        (F.sum(F.when(ok, g).otherwise(0.0)) / n).alias("mean_grad"),
        (F.sum(F.when(ok, F.abs(g)).otherwise(0.0)) / n).alias("mean_abs"),
        (F.count_if(ok & (F.abs(g) > threshold)) / n).alias("informative"),
    )


def finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def split_failed(m: DataFrame, keys: list[str], col: str = "rmse_h") -> tuple[DataFrame, DataFrame]:
    """Runs with a finite error, and per key the number of failed ones."""
    return m.filter(finite(col)), m.groupBy(*keys).agg(F.count_if(~finite(col)).alias("failed_runs"),
                                                        F.count(F.lit(1)).alias("n_runs"))


def ess_summary(est: DataFrame, keys: list[str], col: str = "ess_ratio", low: float = 0.3) -> DataFrame:
    return est.groupBy(*keys).agg(F.avg(col).alias("ess_mean"), F.min(col).alias("ess_min"),
                                  F.avg((F.col(col) < low).cast("double")).alias("ess_below"))


def health_summary(h: DataFrame, keys: list[str]) -> DataFrame:
    bad = (F.col("status") > 0) & (F.col("status") < 1000)
    return h.groupBy(*keys).agg(
        F.count_if(~bad).alias("steps"), F.count_if(bad).alias("errors"),
        F.count_if(F.col("status") >= 1000).alias("warnings"),
        F.max_by("status", F.when(bad, F.col("t"))).alias("last_error"), F.max(F.when(bad, F.col("t"))).alias("last_error_t"),
    )


def mc_summary(m: DataFrame, keys: list[str], col: str, tie: list[str], bound: int | None = None) -> DataFrame:
    """Mean, population std and the interpolated 2.5 / 97.5 percentiles, from exact ranks."""
    moments = m.groupBy(*keys).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    picks, cols = {}, []
    for name, q in (("p2_5", 0.025), ("p97_5", 0.975)):
        picks[f"_a_{name}"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1)).cast("long")
        picks[f"_b_{name}"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1)).cast("long")
        pos = F.lit(q) * (F.col("_n") - 1)
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        cols.append((a + (b - a) * (pos - F.floor(pos))).alias(name))
    sizes = m.filter(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return moments.join(order_stats(m, keys, col, picks, tie, bound), keys).join(sizes, keys).select(
        *keys, "mean", "std", *cols)


def agreement(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], col: str = "h_mean") -> DataFrame:
    joined = a.select(*by, F.col(col).alias("_a")).join(b.select(*by, F.col(col).alias("_b")), by)
    return error_metrics(joined, keys, "_a", "_b")


def array_stats(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
                                 F.stddev_pop(col).alias("std"))


def detection_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of labelled transients and regimes that were flagged."""
    def rate(label: str, flag: str) -> Column:
        return F.try_divide(F.count_if(F.col(label) & F.col(flag)), F.count_if(F.col(label)))

    return df.groupBy(*keys).agg(rate("true_transient", "is_transient").alias("transient_rate"),
                                 rate("true_regime", "is_regime").alias("regime_rate"))


def own_vol_tails(est: DataFrame, keys: list[str], k: float = 4.0) -> DataFrame:
    return est.groupBy(*keys).agg(F.count_if(F.abs(F.col("y")) > k * F.col("vol")).alias("n_tail"),
                                  F.max("y").alias("max_ret"), F.min("y").alias("min_ret"))


def segment_metrics(df: DataFrame, segment: str, est: str = "h_est", true: str = "h_true") -> DataFrame:
    """RMSE/MAE per segment and the overall row (is_total = 1, segment NULL)."""
    return df.rollup(segment).agg(*error_aggs(est, true), F.count(F.lit(1)).alias("n"),
                                  F.grouping(segment).cast("int").alias("is_total"))


def mean_segment_rmse(df: DataFrame, segment: str, est: str = "h_est", true: str = "h_true") -> DataFrame:
    """The plain average of the per-segment RMSEs, which is not the overall RMSE."""
    return df.groupBy(segment).agg(*error_aggs(est, true)).agg(F.avg("rmse").alias("mean_segment_rmse"),
                                                               F.count(F.lit(1)).alias("n_segments"))


def segment_vol(est: DataFrame, keys: list[str], segment: str = "segment_id", vol: str = "vol") -> DataFrame:
    return est.groupBy(*keys, segment).agg(F.avg(vol).alias("mean_vol"), F.count(F.lit(1)).alias("n"))


def error_histogram(df: DataFrame, keys: list[str], err: str, bins: int) -> DataFrame:
    """Equal-width bins between the group's extremes, density normalised; the top edge belongs to the last bin."""
    span = df.groupBy(*keys).agg(F.min(err).alias("_lo"), F.max(err).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(err) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return (join_back(df, span, keys).withColumn("bin", b).withColumn("_w", width)
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.max(F.col("_n") * F.col("_w"))).alias("density")))


def metric_trend(m: DataFrame, keys: list[str], metric: str, param: str) -> DataFrame:
    return m.groupBy(*keys).agg(F.regr_slope(metric, param).alias("slope"), F.regr_intercept(metric, param).alias("intercept"))
