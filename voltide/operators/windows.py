"""Per-tick signals that look back a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.operators.layout import join_back, last_known, over_time, rank_rows, running_min

KEY = ["series_id"]


def _lag(df: DataFrame, col: str, out: str, bound: int | None, default: float | None = None, keys=KEY) -> DataFrame:
    return over_time(df, keys, {out: lambda w: F.lag(col, 1, default).over(w)}, bound=bound)


def surprise(est: DataFrame, vol0: float = 0.01, bound: int | None = None) -> DataFrame:
    """|y| against the previous tick's vol."""
    d = _lag(est, "vol", "vol_prev", bound, vol0)
    return d.withColumn("surprise", F.abs("y") / F.greatest(F.col("vol_prev"), F.lit(1e-6)))


def return_z(vol_prev: str = "vol_prev") -> Column:
    return F.abs(F.col("y")) / F.greatest(F.col(vol_prev), F.lit(1e-4))


def severity(z: Column, threshold: Column) -> Column:
    return F.when(z > threshold, F.least((z - threshold) / 3, F.lit(1.0))).otherwise(0.0)


def breathing_sigma(est: DataFrame, sigma: float, threshold: float, boost_max: float, bound: int | None = None) -> DataFrame:
    """State noise widened when the return is large against the previous vol; not at t = 0."""
    d = _lag(est, "vol", "vol_prev", bound)
    sev = severity(return_z(), F.lit(threshold))
    boost = F.when(F.col("t") > 0, 1 + (boost_max - 1) * sev).otherwise(1.0)
    return d.withColumn("sigma_eff", sigma * boost)


def guide_strength(est: DataFrame, base: float, top: float, threshold: float, offset: float,
                   bound: int | None = None) -> DataFrame:
    """Guide strength raised only by large returns that imply a higher level than the previous vol."""
    d = _lag(est, "vol", "vol_prev", bound)
    v = F.greatest(F.col("vol_prev"), F.lit(1e-4))
    innovation = fn.log_y2("y") + offset - F.log(v * v + 1e-8)
    sev = F.when((innovation > 0) & (F.col("t") > 0), severity(return_z(), F.lit(threshold))).otherwise(0.0)
    return d.withColumn("strength", base + (top - base) * sev)


def cross_correlation(df: DataFrame, a: str, b: str, max_lag: int, bound: int | None = None) -> DataFrame:
    """Correlation of a[t] with b[t + lag] for every lag, with full-sample means and norms.

    One window pass holds all shifted copies, so no lag joins are made.
    """
    m = df.groupBy(*KEY).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"),
                             (F.var_pop(a) * F.count(F.lit(1))).alias("_va"), (F.var_pop(b) * F.count(F.lit(1))).alias("_vb"))
    lags = range(-max_lag, max_lag + 1)
    shifted = over_time(df, KEY, {f"_s{k + max_lag}": (lambda w, k=k: F.lead(b, k).over(w) if k >= 0 else F.lag(b, -k).over(w))
                                  for k in lags}, back=max_lag, ahead=max_lag, bound=bound)
    da = F.col(a) - F.col("_ma")
    sums = join_back(shifted, m, KEY).groupBy(*KEY).agg(
        F.greatest(F.sqrt(F.first("_va") * F.first("_vb")), F.lit(1e-10)).alias("_norm"),
        *[F.coalesce(F.sum(da * (F.col(f"_s{k + max_lag}") - F.col("_mb"))), F.lit(0.0)).alias(f"_x{k + max_lag}") for k in lags])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_x{k + max_lag}") / F.col("_norm")).alias("xcorr")) for k in lags])
    return sums.select(*KEY, F.inline(rows))


def lag1_corr(df: DataFrame, keys: list[str], est: str = "h_est", true: str = "h_true", bound: int | None = None) -> DataFrame:
    """est[t+1] with truth[t]."""
    from voltide.operators.stats import guarded_corr

    d = over_time(df, keys, {"_n": lambda w: F.lead(est).over(w)}, back=0, ahead=1, bound=bound).filter("_n is not null")
    return d.groupBy(*keys).agg(guarded_corr("_n", true).alias("lag1_corr"))


def realised_vol_ratio(df: DataFrame, short_h: int = 24, long_h: int = 168, threshold: float = 1.5) -> DataFrame:
    """Root-mean-square return over the trailing short and long span, by hour, with their ratio and a flag.

    Rows are first summed per (series, hour), so the range window runs over at most one row per hour.
    """
    instant = F.col("ts").cast("timestamp")
    if df.schema["ts"].dataType.simpleString() == "timestamp_ntz":
        instant = F.from_utc_timestamp(instant, F.current_timezone())  # hours of the wall clock in any session zone
    hour = F.floor(F.unix_micros(instant) / F.lit(3_600_000_000)).cast("long")
    h = df.groupBy("series_id", hour.alias("hour")).agg(F.sum(F.col("y") * F.col("y")).alias("_q"), F.count("y").alias("_n"))
    w = Window.partitionBy("series_id").orderBy("hour")

    def vol(span: int) -> Column:
        f = w.rangeBetween(-(span - 1), 0)
        return F.sqrt(F.sum("_q").over(f) / F.sum("_n").over(f))

    out = h.select("series_id", "hour", vol(short_h).alias("vol_short"), vol(long_h).alias("vol_long"))
    out = out.withColumn("ratio", F.try_divide("vol_short", "vol_long"))
    return out.withColumn("regime_up", F.col("ratio") > threshold)


def enhanced_breathing(df: DataFrame, n: int, spread_thr: float, return_thr: float, boost_max: float,
                       spread: str = "spread", vol_prev: str = "vol_prev", bound: int | None = None) -> DataFrame:
    """Boost when the spread is wide against its trailing n rows or the return is large; not at t = 0, where nothing
    lies before. A NULL previous vol (before the first) gives no return score. The boost has no upper limit."""
    d = over_time(df, KEY, {"_m": lambda w: F.avg(spread).over(w.rowsBetween(-n, -1)),
                            "_s": lambda w: F.stddev_pop(spread).over(w.rowsBetween(-n, -1))}, back=n, bound=bound)
    sz = F.when(F.col("_s") > 1e-12, (F.col(spread) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    d = d.withColumn("spread_z", F.coalesce(sz, F.lit(0.0))).withColumn(
        "return_z", F.when(F.col(vol_prev).isNull(), 0.0).otherwise(return_z(vol_prev)))
    hit = (F.col("t") > 0) & ((F.col("spread_z") > spread_thr) | (F.col("return_z") > return_thr))
    boost = F.when(hit, 1 + F.greatest("spread_z", "return_z") / 3 * (boost_max - 1)).otherwise(1.0)
    return d.withColumn("sigma_boost", boost).drop("_m", "_s")


def label_transient(truth: DataFrame, h: str = "h_true", jump: float = 0.5, bound: int | None = None) -> DataFrame:
    return over_time(truth, KEY, {"_p": lambda w: F.lag(h).over(w)}, bound=bound).withColumn(
        "true_transient", F.coalesce(F.abs(F.col(h) - F.col("_p")) > jump, F.lit(False))).drop("_p")


def label_regime(truth: DataFrame, mu: Column, h: str = "h_true", n: int = 10, bound: int | None = None) -> DataFrame:
    d = over_time(truth, KEY, {"_a": lambda w: F.avg(h).over(w.rowsBetween(-n, -1))}, back=n, bound=bound)
    return d.withColumn("true_regime", F.coalesce((F.col("t") > n) & (F.col("_a") > mu + 1), F.lit(False))).drop("_a")


def segment_of(df: DataFrame, starts: DataFrame, keys: list[str] = KEY, t: str = "t", bound: int | None = None) -> DataFrame:
    """Segment by each series' own starts: (keys, start, segment_id, segment_name). Rows before the first have none.

    Starts and rows are one sequence by tick, filled forward in bounded pieces."""
    s = starts.select(*keys, F.col("start").cast("long").alias(t), "segment_id", "segment_name")
    rows = df.drop("segment_id", "segment_name").withColumn("_n", F.lit(0))
    return asof(rows, s.withColumn("_n", F.lit(0)), keys, t, "_n", ["segment_id", "segment_name"], bound).drop("_n")


def segment_id(df: DataFrame, starts: list[tuple[int, int, str]], t: str = "t") -> DataFrame:
    """Segment by start tick. The start table is a short caller-given list, so it becomes a literal CASE."""
    out_id, out_name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for start, sid, name in sorted(starts):
        out_id = F.when(F.col(t) >= start, sid).otherwise(out_id)
        out_name = F.when(F.col(t) >= start, F.lit(name)).otherwise(out_name)
    return df.withColumn("segment_id", out_id).withColumn("segment_name", out_name)


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, tie: str, cols: list[str],
         bound: int | None = None) -> DataFrame:
    """Each left row with the latest right values at or before its time; equal times count as before.

    Both sides are unioned into one ordered sequence and forward filled, in bounded pieces.
    """
    l = left.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in cols], F.lit(1).alias("_side"))
    r = right.select(*[F.col(c) if c in (*keys, ts, tie, *cols) else F.lit(None).cast(left.schema[c].dataType).alias(c)
                       for c in [*left.columns, *cols]], F.lit(0).alias("_side"))
    both = rank_rows(l.unionByName(r), keys, [ts, "_side", tie], "_k", bound)
    return last_known(both, keys, cols, "_k", bound).filter("_side = 1").drop("_side", "_k")


def pareto(df: DataFrame, a: str, b: str, tie: list[str], keys: list[str] | None = None, bound: int | None = None) -> DataFrame:
    """Rows not dominated on (a, b), smaller is better.

    In order of (a, b), a row survives when b is below every b of a strictly smaller a and minimal within its a.
    Best b per distinct a comes from a partial aggregate; the rest is a running minimum over distinct a.
    """
    group = keys or ["_g"]
    d = df if keys else df.withColumn("_g", F.lit(0))
    best = d.groupBy(*group, a).agg(F.min(b).alias("_best"))
    best = rank_rows(best, group, [a], "_k", bound)
    best = running_min(best, group, "_best", "_before", "_k", True, bound)
    front = best.filter(F.col("_before").isNull() | (F.col("_best") < F.col("_before"))).select(*group, a, "_best")
    return d.join(front, [*group, a]).filter(F.col(b) == F.col("_best")).drop("_best", "_g")


def stein_budget(df: DataFrame, low: int, high: int, keys: list[str] = KEY, bound: int | None = None) -> DataFrame:
    """Steps from the previous tick's KSD; the maximum during the first ten ticks."""
    d = _lag(df, "ksd", "ksd_prev", bound, 1e10, keys)
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ksd_prev") - 0.05) / 0.45))
    steps = F.when(F.col("t") < 10, F.lit(high)).otherwise(low + F.floor(x * (high - low)).cast("int"))
    return d.withColumn("budget", steps.cast("int"))


def beta_schedule(df: DataFrame, n_anneal: int, adaptive: bool = True, ksd: str = "ksd_prev") -> DataFrame:
    """One row per annealing stage with its beta and its share of the step budget."""
    k, stage = F.col(ksd), F.col("stage")
    ramp = F.when(k > 0.5, 0.3).when(k < 0.05, 0.8).otherwise(0.3 + (0.5 - k) / 0.45 * 0.5)
    moved = F.greatest(F.lit(0.1), F.least(F.lit(1.0), ramp * (0.5 + 0.5 * (stage + 1) / n_anneal)))
    fixed = F.element_at(F.array(*[F.lit(v) for v in (0.3, 0.65, 1.0)]), (stage % 3 + 1).cast("int"))
    beta = F.when(stage == n_anneal - 1, 1.0).otherwise(moved) if adaptive else fixed
    per = F.floor(F.col("budget") / n_anneal).cast("int")
    steps = F.when(stage == n_anneal - 1, F.col("budget") - per * (n_anneal - 1)).otherwise(per)
    return (df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_anneal - 1))).alias("stage"))
            .withColumn("beta", beta).withColumn("beta_root", F.sqrt(beta)).withColumn("steps", steps.cast("int")))
