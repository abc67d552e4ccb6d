"""Evaluation of filter runs: per-run metrics, scenario aggregates, paired comparison, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.operators import stats
from voltide.operators.layout import over_time


def run_metrics(est: DataFrame, truth: DataFrame, run_keys: list[str], warmup: int = 0, particles: DataFrame | None = None,
                bound: int | None = None) -> DataFrame:
    """One row per run with all accuracy, likelihood and sample-size metrics after the warm-up."""
    d = est.filter(F.col("t") >= warmup).join(truth.filter(F.col("t") >= warmup), ["series_id", "t"])
    d = over_time(d.withColumn("_k", F.col("t") - warmup), run_keys, {"_n": lambda w: F.lead("h_mean").over(w)}, "_k", 0, 1, bound)
    e, v = F.col("h_mean") - F.col("h_true"), F.col("vol") - F.col("vol_true")
    nan_safe = lambda a, b: stats.guarded_corr(a, b)
    both = F.when(F.col("_n").isNotNull(), F.col("h_true"))
    d = d.withColumn("_b", both)
    out = d.groupBy(*run_keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse_h"), F.avg(F.abs(e)).alias("mae_h"), F.avg(e).alias("bias_h"),
        F.sqrt(F.avg(v * v)).alias("rmse_vol"), (-F.avg("loglik")).alias("nll"), nan_safe("h_mean", "h_true").alias("lag_corr"),
        nan_safe("_n", "_b").alias("lag1_corr"), F.avg("ess_ratio").alias("ess_mean"), F.min("ess_ratio").alias("ess_min"),
        F.avg((F.col("ess_ratio") < 0.3).cast("double")).alias("ess_below"),
    )
    out = out.withColumn("failed", ~stats.finite("rmse_h"))
    if particles is None:
        return out
    set_keys = list(dict.fromkeys([*run_keys, "series_id", "t"]))
    cov = stats.coverage(particles.filter(F.col("t") >= warmup), truth, set_keys, run_keys, on=["series_id", "t"])
    return out.join(cov, run_keys)


def scenario_stats(m: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("scenario",), run: str = "seed") -> DataFrame:
    """Index-based statistics over seeds for every metric (long form)."""
    long = m.unpivot([*keys, run], metrics, "metric", "v")
    return stats.metric_stats(long, [*keys, "metric"], "v", [run])


def pair_runs(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("scenario", "seed"), check: str = "rmse_h") -> DataFrame:
    """Arms joined by run, both finite."""
    metrics = [c for c in a.columns if c not in by]
    pa = a.filter(stats.finite(check)).select(*by, *[F.col(c).alias(f"{c}_a") for c in metrics])
    pb = b.filter(stats.finite(check)).select(*by, *[F.col(c).alias(f"{c}_b") for c in metrics])
    return pa.join(pb, list(by))


def _diff_stats(paired: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per metric x the columns x_m (mean difference), x_s, x_se, x_t and x_p, from one aggregate over the runs."""
    d = {x: F.col(f"{x}_b") - F.col(f"{x}_a") for x in metrics}
    g = paired.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f for x in metrics for f in (F.avg(d[x]).alias(f"{x}_m"), F.stddev_samp(d[x]).alias(f"{x}_s"))])
    g = g.filter("n >= 2").withColumns({f"{x}_se": F.col(f"{x}_s") / F.sqrt(F.col("n").cast("double")) for x in metrics})
    g = g.withColumns({f"{x}_t": F.when(F.col(f"{x}_se") > 1e-10, F.try_divide(f"{x}_m", f"{x}_se")).otherwise(0.0) for x in metrics})
    return g.withColumns({f"{x}_p": 2 * (1 - fn.normal_cdf(F.abs(f"{x}_t"))) for x in metrics})


def paired_ttest(paired: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Paired t statistic of B - A; the p-value uses the normal distribution for every sample size."""
    g = _diff_stats(paired, keys, [metric])
    return g.select(*keys, "n", F.col(f"{metric}_m").alias("mean_diff"), F.col(f"{metric}_t").alias("t_stat"), F.col(f"{metric}_p").alias("p_normal"))


def compare(a: DataFrame, b: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("scenario",), level: float = 0.05) -> DataFrame:
    """Differences B - A per scenario with standard error, t, p, effect size and flags, for every metric."""
    g = _diff_stats(pair_runs(a, b), list(keys), metrics)
    cols = []
    for m in metrics:
        mean, sd, p = F.col(f"{m}_m"), F.col(f"{m}_s"), F.col(f"{m}_p")
        effect = F.when(sd > 1e-10, F.try_divide(mean, sd)).otherwise(0.0)
        cols += [mean.alias(f"{m}_diff"), F.col(f"{m}_se"), F.col(f"{m}_t"), p, effect.alias(f"{m}_d"), (p < level).alias(f"{m}_significant"),
                 (mean < 0).alias(f"{m}_b_better")]
    return g.select(*keys, "n", *cols)


def winners(comp: DataFrame, metric: str = "rmse_h") -> DataFrame:
    sig, better = F.col(f"{metric}_significant"), F.col(f"{metric}_b_better")
    return comp.withColumn("winner", F.when(sig & better, "B").when(sig, "A").otherwise("tie"))


def verdict(won: DataFrame) -> DataFrame:
    c = won.agg(*[F.count_if(F.col("winner") == w).alias(n) for w, n in (("A", "wins_a"), ("B", "wins_b"), ("tie", "ties"))])
    b_wins = (F.col("wins_b") > F.col("wins_a")) & (F.col("wins_b") > F.col("ties"))
    return c.withColumn("verdict", F.when(b_wins, "use B").when(F.col("wins_a") > F.col("wins_b"), "keep A").otherwise("no clear winner"))


def improvement(a: DataFrame, b: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean metric of both models and the relative gain of B in percent."""
    p = pair_runs(a, b)
    g = p.groupBy(*keys).agg(F.avg(f"{metric}_a").alias("mean_a"), F.avg(f"{metric}_b").alias("mean_b"))
    return g.withColumn("improvement_pct", (F.col("mean_a") - F.col("mean_b")) / F.col("mean_a") * 100)
