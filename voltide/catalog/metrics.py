"""Queries: statistics, error metrics, order statistics, per-tick windows, evaluation of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.session import cut_lineage
from voltide.catalog.registry import DAILY, EV, OBS, daily, estimates, obs, query, rounded
from voltide.catalog.returns import _r, nu_score, nu_score_sql
from voltide.functions import columns as fn
from voltide.operators import stats, windows
from voltide.plans import evaluate


def _aggs(c: str) -> str:
    return f"{_r(f'avg({c})', 'mean')}, {_r(f'stddev_pop({c})', 'std')}, {_r(f'min({c})', 'min')}, {_r(f'max({c})', 'max')}"


@query("return_stats", f"WITH {OBS} SELECT series_id, count(y) AS n, {_aggs('y')} FROM obs GROUP BY 1")
def return_stats(spark, sf):
    return rounded(stats.return_stats(obs(spark, sf)[0], ["series_id"]))


@query("tail_counts_centred", f"""
WITH {DAILY}, m AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS s FROM daily GROUP BY 1)
SELECT series_id, count(*) FILTER (abs(y - m) > 3 * s) AS n_3sigma, count(*) FILTER (abs(y - m) > 4 * s) AS n_4sigma
FROM daily JOIN m USING (series_id) GROUP BY 1""")
def tail_counts_centred(spark, sf):
    return stats.tail_counts(daily(spark, sf)[0], ["series_id"])


@query("tail_counts_raw", f"""
WITH {DAILY}, m AS (SELECT series_id, stddev_samp(y) AS s FROM daily GROUP BY 1)
SELECT series_id, count(*) FILTER (abs(y) > 3 * s) AS n_3sigma, count(*) FILTER (abs(y) > 4 * s) AS n_4sigma,
       count(*) FILTER (abs(y) > 5 * s) AS n_5sigma FROM daily JOIN m USING (series_id) GROUP BY 1""")
def tail_counts_raw(spark, sf):
    return stats.tail_counts(daily(spark, sf)[0], ["series_id"], "raw")


@query("estimate_mu", f"WITH {OBS} SELECT series_id, {_r('2 * ln(stddev_pop(y) + 1e-8)', 'mu')} FROM obs GROUP BY 1")
def estimate_mu(spark, sf):
    return rounded(stats.estimate_mu(obs(spark, sf)[0], ["series_id"]))


@query("sequence_loglik", f"WITH {EV} SELECT series_id, {_r('sum(loglik)', 'loglik')}, count(*) AS n FROM ev GROUP BY 1")
def sequence_loglik(spark, sf):
    return rounded(stats.sequence_loglik(estimates(spark, sf)[0], ["series_id"]))


ERR_SQL = f"""{_r('sqrt(avg((h_est - h_true) * (h_est - h_true)))', 'rmse')}, {_r('avg(abs(h_est - h_true))', 'mae')},
  {_r('avg(h_est - h_true)', 'bias')}"""
CORR_SQL = _r("""CASE WHEN var_pop(h_est) * count(*) < 1e-10 OR var_pop(h_true) * count(*) < 1e-10 THEN 0
  ELSE covar_pop(h_est, h_true) / (stddev_pop(h_est) * stddev_pop(h_true)) END""", "corr")


@query("error_metrics", f"WITH {EV} SELECT series_id, {ERR_SQL}, {CORR_SQL} FROM ev GROUP BY 1")
def error_metrics(spark, sf):
    return rounded(stats.error_metrics(estimates(spark, sf)[0], ["series_id"]))


@query("nll_after_warmup", f"WITH {EV} SELECT series_id, {_r('-avg(loglik)', 'nll')} FROM ev WHERE t >= 10 GROUP BY 1")
def nll(spark, sf):
    return rounded(stats.nll(estimates(spark, sf)[0], ["series_id"], 10))


def _pick(c: str, q: float, name: str) -> str:
    return _r(f"max(CASE WHEN rk = least(CAST(floor({q} * n) AS BIGINT), n - 1) THEN {c} END)", name)


@query("metric_stats", f"""
WITH {EV}, m AS (SELECT event_type AS scenario, series_id, sqrt(avg((h_est - h_true) * (h_est - h_true))) AS rmse FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY rmse, series_id) - 1 AS rk, count(*) OVER (PARTITION BY scenario) AS n FROM m)
SELECT scenario, {_r('avg(rmse)', 'mean')}, {_r('stddev_samp(rmse)', 'std')}, {_r('min(rmse)', 'min')}, {_r('max(rmse)', 'max')},
  {_pick('rmse', 0.5, 'median')}, {_pick('rmse', 0.05, 'p5')}, {_pick('rmse', 0.95, 'p95')} FROM r GROUP BY 1""")
def metric_stats(spark, sf):
    m = estimates(spark, sf)[0].groupBy(F.col("event_type").alias("scenario"), "series_id").agg(*stats.error_aggs())
    return rounded(stats.metric_stats(m, ["scenario"], "rmse", ["series_id"]))


@query("percentiles", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, {_aggs('value')}, {_pick('value', 0.5, 'p50')}, {_pick('value', 0.9, 'p90')}, {_pick('value', 0.99, 'p99')},
  {_pick('value', 0.999, 'p999')} FROM r GROUP BY 1""")
def percentiles(spark, sf):
    from voltide.catalog.registry import table

    return rounded(stats.percentiles(table(spark, sf, "events"), ["event_type"], "value", ["event_id"]))


STEPS_SQL = "least(4 + CAST(floor(abs(y) * 4) AS INT), 12)"


def with_steps(e):
    return e.withColumn("stein_steps", F.least(4 + F.floor(F.abs("y") * 4).cast("int"), F.lit(12)))


@query("step_histogram", f"""
WITH {EV}, c AS (SELECT event_type, {STEPS_SQL} AS stein_steps, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT event_type, stein_steps, n, {_r('n / sum(n) OVER (PARTITION BY event_type)', 'share')},
  {_r('first_value(n) OVER (PARTITION BY event_type ORDER BY stein_steps DESC) / sum(n) OVER (PARTITION BY event_type)', 'share_at_max')} FROM c""")
def step_histogram(spark, sf):
    return rounded(stats.step_histogram(with_steps(estimates(spark, sf)[0]), ["event_type"]))


@query("ksd_summary", f"""
WITH {EV}, r AS (SELECT event_type, abs(h_est) AS ksd, row_number() OVER (PARTITION BY event_type ORDER BY abs(h_est), tie) - 1 AS rk,
  count(*) OVER (PARTITION BY event_type) AS n FROM ev)
SELECT event_type, {_r('min(ksd)', 'ksd_min')}, {_r('max(ksd)', 'ksd_max')}, {_pick('ksd', 0.5, 'ksd_median')}, {_pick('ksd', 0.99, 'ksd_p99')}
FROM r GROUP BY 1""")
def ksd_summary(spark, sf):
    e = estimates(spark, sf)[0].select("event_type", "tie", F.abs("h_est").alias("ksd"))
    return rounded(stats.ksd_summary(e, ["event_type"], "ksd", ["tie"]))


Z2 = "(y * y / ((exp(h_true / 2) + 1e-8) * (exp(h_true / 2) + 1e-8)))"
DIAG = EV + f", dg AS (SELECT *, {Z2} * 3 AS z_sq, {nu_score_sql(10.0)} AS nu_grad FROM ev)"


def diag(spark, sf):
    e, bound = estimates(spark, sf)
    return e.withColumn("z_sq", 3 * F.pow(fn.std_residual("y", "h_true"), F.lit(2.0))).withColumn("nu_grad", nu_score(10.0)), bound


@query("crash_calm_split", f"""
WITH {DIAG}, g AS (SELECT series_id, count(*) FILTER (z_sq > 9) AS n_crash, coalesce(avg(nu_grad) FILTER (z_sq > 9), 0) AS a,
  coalesce(avg(nu_grad) FILTER (z_sq <= 9), 0) AS b FROM dg GROUP BY 1)
SELECT series_id, n_crash, {_r('a', 'grad_crash')}, {_r('b', 'grad_calm')}, {_r('CASE WHEN b = 0 THEN 0 ELSE abs(a / b) END', 'ratio')} FROM g""")
def crash_calm(spark, sf):
    return rounded(stats.crash_calm_split(diag(spark, sf)[0], ["series_id"]))


@query("grad_corr", f"""
WITH {DIAG} SELECT series_id, {_r('covar_pop(nu_grad, z_sq) * count(*) / (sqrt(var_pop(nu_grad) * count(*) * var_pop(z_sq) * count(*)) + 1e-10)', 'grad_corr')}
FROM dg GROUP BY 1""")
def grad_corr(spark, sf):
    return rounded(stats.grad_corr(diag(spark, sf)[0], ["series_id"]))


@query("grad_informativeness", f"""
WITH {DIAG}, b AS (SELECT series_id, CASE WHEN t % 13 = 5 THEN CAST('NaN' AS DOUBLE) ELSE nu_grad END AS g FROM dg),
o AS (SELECT *, NOT isnan(g) AND abs(g) < CAST('Infinity' AS DOUBLE) AS ok FROM b)
SELECT series_id, count(*) FILTER (ok AND g > 0) AS n_pos, count(*) FILTER (ok AND g <= 0) AS n_neg,
  {_r('sum(CASE WHEN ok THEN g ELSE 0 END) / count(*)', 'mean_grad')}, {_r('sum(CASE WHEN ok THEN abs(g) ELSE 0 END) / count(*)', 'mean_abs')},
  {_r('count(*) FILTER (ok AND abs(g) > 0.001) / count(*)', 'informative')} FROM o GROUP BY 1""")
def grad_informativeness(spark, sf):
    d = diag(spark, sf)[0].withColumn("g", F.when(F.col("t") % 13 == 5, F.lit(float("nan"))).otherwise(F.col("nu_grad")))
    return rounded(stats.grad_informativeness(d, ["series_id"], "g", 0.001))


FIN = EV + """, fr AS (SELECT event_type AS scenario, series_id, CASE WHEN series_id % 19 = 4 THEN CAST('NaN' AS DOUBLE)
  ELSE sqrt(avg((h_est - h_true) * (h_est - h_true))) END AS rmse_h FROM ev GROUP BY 1, 2)"""


def failing_runs(spark, sf):
    m = estimates(spark, sf)[0].groupBy(F.col("event_type").alias("scenario"), "series_id").agg(*stats.error_aggs())
    return m.withColumn("rmse_h", F.when(F.col("series_id") % 19 == 4, F.lit(float("nan"))).otherwise(F.col("rmse")))


@query("failed_runs", f"WITH {FIN} SELECT scenario, count(*) FILTER (isnan(rmse_h)) AS failed_runs, count(*) AS n_runs FROM fr GROUP BY 1")
def failed_runs(spark, sf):
    return stats.split_failed(failing_runs(spark, sf), ["scenario"])[1]


@query("finite_runs", f"WITH {FIN} SELECT scenario, series_id, {_r('rmse_h')} FROM fr WHERE NOT isnan(rmse_h)")
def finite_runs(spark, sf):
    return rounded(stats.split_failed(failing_runs(spark, sf), ["scenario"])[0].select("scenario", "series_id", "rmse_h"))


@query("ess_summary", f"""
WITH {EV}, x AS (SELECT event_type, 1 / (1 + y * y) AS r FROM ev)
SELECT event_type, {_r('avg(r)', 'ess_mean')}, {_r('min(r)', 'ess_min')}, {_r('avg(CASE WHEN r < 0.3 THEN 1.0 ELSE 0.0 END)', 'ess_below')} FROM x GROUP BY 1""")
def ess_summary(spark, sf):
    e = estimates(spark, sf)[0].withColumn("ess_ratio", 1 / (1 + F.col("y") * F.col("y")))
    return rounded(stats.ess_summary(e, ["event_type"]))


STAT_SQL = "CASE WHEN abs(y) > 4 THEN 302 WHEN abs(y) > 3 THEN 1001 WHEN abs(y) > 2.5 THEN 1000 ELSE 0 END"


@query("health_summary", f"""
WITH {EV}, s AS (SELECT series_id, t, {STAT_SQL} AS status FROM ev)
SELECT series_id, count(*) FILTER (NOT (status > 0 AND status < 1000)) AS steps, count(*) FILTER (status > 0 AND status < 1000) AS errors,
  count(*) FILTER (status >= 1000) AS warnings, CAST(arg_max(status, t) FILTER (status > 0 AND status < 1000) AS INT) AS last_error,
  max(t) FILTER (status > 0 AND status < 1000) AS last_error_t FROM s GROUP BY 1""")
def health_summary(spark, sf):
    a = F.abs("y")
    e = estimates(spark, sf)[0].withColumn("status", F.when(a > 4, 302).when(a > 3, 1001).when(a > 2.5, 1000).otherwise(0))
    return stats.health_summary(e, ["series_id"])


@query("mc_summary", f"""
WITH {EV}, m AS (SELECT event_type AS scenario, series_id, sqrt(avg((h_est - h_true) * (h_est - h_true))) AS rmse FROM ev GROUP BY 1, 2)
SELECT scenario, {_r('avg(rmse)', 'mean')}, {_r('stddev_pop(rmse)', 'std')}, {_r('quantile_cont(rmse, 0.025)', 'p2_5')},
  {_r('quantile_cont(rmse, 0.975)', 'p97_5')} FROM m GROUP BY 1""")
def mc_summary(spark, sf):
    m = estimates(spark, sf)[0].groupBy(F.col("event_type").alias("scenario"), "series_id").agg(*stats.error_aggs())
    return rounded(stats.mc_summary(m, ["scenario"], "rmse", ["series_id"]))


@query("estimator_agreement", f"WITH {EV} SELECT series_id, {ERR_SQL}, {CORR_SQL} FROM ev GROUP BY 1")
def estimator_agreement(spark, sf):
    e = estimates(spark, sf)[0]
    a, b = e.select("series_id", "t", F.col("h_est").alias("h_mean")), e.select("series_id", "t", F.col("h_true").alias("h_mean"))
    return rounded(stats.agreement(a, b, ["series_id"], ["series_id", "t"]))


@query("array_stats", f"WITH {EV} SELECT event_type, {_aggs('h_est')} FROM ev GROUP BY 1")
def array_stats(spark, sf):
    return rounded(stats.array_stats(estimates(spark, sf)[0], ["event_type"], "h_est"))


LABELS = EV + """, lb AS (SELECT *, coalesce(abs(h_true - lag(h_true) OVER w) > 0.5, false) AS true_transient,
  coalesce(t > 10 AND avg(h_true) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) > -0.5 + 1, false) AS true_regime
  FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY t))"""


def labelled(spark, sf):
    e, bound = estimates(spark, sf)
    return windows.label_regime(windows.label_transient(e, bound=bound), F.lit(-0.5), bound=bound), bound


@query("labels", f"WITH {LABELS} SELECT series_id, t, true_transient, true_regime FROM lb")
def labels(spark, sf):
    return labelled(spark, sf)[0].select("series_id", "t", "true_transient", "true_regime")


@query("detection_rates", f"""
WITH {LABELS}
SELECT event_type, {_r('count(*) FILTER (true_transient AND vol > 1.5) / nullif(count(*) FILTER (true_transient), 0)', 'transient_rate')},
  {_r('count(*) FILTER (true_regime AND vol > 1.0) / nullif(count(*) FILTER (true_regime), 0)', 'regime_rate')} FROM lb GROUP BY 1""")
def detection_rates(spark, sf):
    d = labelled(spark, sf)[0].withColumn("is_transient", F.col("vol") > 1.5).withColumn("is_regime", F.col("vol") > 1.0)
    return rounded(stats.detection_rates(d, ["event_type"]))


@query("own_vol_tails", f"""
WITH {EV} SELECT series_id, count(*) FILTER (abs(y) > 1.5 * vol) AS n_tail, {_r('max(y)', 'max_ret')}, {_r('min(y)', 'min_ret')} FROM ev GROUP BY 1""")
def own_vol_tails(spark, sf):
    return rounded(stats.own_vol_tails(estimates(spark, sf)[0], ["series_id"], 1.5))


SEGS = [(0, 1, "calm"), (20, 2, "crisis"), (40, 3, "recovery")]
SEG_SQL = """CASE WHEN t >= 40 THEN 3 WHEN t >= 20 THEN 2 ELSE 1 END AS segment_id,
  CASE WHEN t >= 40 THEN 'recovery' WHEN t >= 20 THEN 'crisis' ELSE 'calm' END AS segment_name"""


@query("segment_metrics", f"""
WITH {EV}, s AS (SELECT *, {SEG_SQL} FROM ev)
SELECT segment_name, {ERR_SQL}, count(*) AS n, CAST(grouping(segment_name) AS INT) AS is_total FROM s GROUP BY ROLLUP (segment_name)""")
def segment_metrics(spark, sf):
    return rounded(stats.segment_metrics(windows.segment_id(estimates(spark, sf)[0], SEGS), "segment_name"))


@query("mean_segment_rmse", f"""
WITH {EV}, s AS (SELECT *, {SEG_SQL} FROM ev), g AS (SELECT segment_name, sqrt(avg((h_est - h_true) * (h_est - h_true))) AS r FROM s GROUP BY 1)
SELECT {_r('avg(r)', 'mean_segment_rmse')}, count(*) AS n_segments FROM g""")
def mean_segment_rmse(spark, sf):
    return rounded(stats.mean_segment_rmse(windows.segment_id(estimates(spark, sf)[0], SEGS), "segment_name"))


@query("segment_vol", f"""
WITH {EV}, s AS (SELECT *, {SEG_SQL} FROM ev)
SELECT series_id, segment_id, {_r('avg(vol)', 'mean_vol')}, count(*) AS n FROM s GROUP BY 1, 2""")
def segment_vol(spark, sf):
    return rounded(stats.segment_vol(windows.segment_id(estimates(spark, sf)[0], SEGS), ["series_id"]))


@query("error_histogram", f"""
WITH {EV}, e AS (SELECT event_type, h_est - h_true AS err FROM ev),
x AS (SELECT event_type, min(err) AS lo, (max(err) - min(err)) / 20 AS w, count(*) AS n FROM e GROUP BY 1)
SELECT event_type, CAST(least(floor((err - lo) / w), 19) AS INT) AS bin, count(*) AS n, {_r('count(*) / max(x.n * w)', 'density')}
FROM e JOIN x USING (event_type) GROUP BY 1, 2""")
def error_histogram(spark, sf):
    e = estimates(spark, sf)[0].select("event_type", (F.col("h_est") - F.col("h_true")).alias("err"))
    return rounded(stats.error_histogram(e, ["event_type"], "err", 20))


@query("metric_trend", f"""
WITH {EV}, m AS (SELECT event_type, series_id, sqrt(avg((h_est - h_true) * (h_est - h_true))) AS rmse, stddev_pop(y) AS param FROM ev GROUP BY 1, 2)
SELECT event_type, {_r('regr_slope(rmse, param)', 'slope')}, {_r('regr_intercept(rmse, param)', 'intercept')} FROM m GROUP BY 1""")
def metric_trend(spark, sf):
    m = estimates(spark, sf)[0].groupBy("event_type", "series_id").agg(*stats.error_aggs(), F.stddev_pop("y").alias("param"))
    return rounded(stats.metric_trend(m, ["event_type"], "rmse", "param"))


LAGV = EV + ", lv AS (SELECT *, lag(vol) OVER (PARTITION BY series_id ORDER BY t) AS vp FROM ev)"


@query("surprise", f"WITH {LAGV} SELECT series_id, t, {_r('abs(y) / greatest(coalesce(vp, 0.01), 1e-6)', 'surprise')} FROM lv")
def surprise(spark, sf):
    e, bound = estimates(spark, sf)
    return rounded(windows.surprise(e, bound=bound).select("series_id", "t", "surprise"))


@query("breathing_sigma", f"""
WITH {LAGV}, z AS (SELECT *, abs(y) / greatest(vp, 1e-4) AS rz FROM lv)
SELECT series_id, t, {_r('0.1 * (CASE WHEN t > 0 AND rz > 1 THEN 1 + 2.0 * least((rz - 1) / 3, 1.0) ELSE 1.0 END)', 'sigma_eff')} FROM z""")
def breathing(spark, sf):
    e, bound = estimates(spark, sf)
    return rounded(windows.breathing_sigma(e, 0.1, 1.0, 3.0, bound).select("series_id", "t", "sigma_eff"))


@query("guide_strength", f"""
WITH {LAGV}, z AS (SELECT *, greatest(vp, 1e-4) AS v FROM lv)
SELECT series_id, t, {_r('''0.05 + 0.25 * (CASE WHEN t > 0 AND ln(y * y + 1e-8) + 1.2 - ln(v * v + 1e-8) > 0 AND abs(y) / v > 1
  THEN least((abs(y) / v - 1) / 3, 1.0) ELSE 0 END)''', 'strength')} FROM z""")
def guide_strength(spark, sf):
    e, bound = estimates(spark, sf)
    return rounded(windows.guide_strength(e, 0.05, 0.30, 1.0, 1.2, bound).select("series_id", "t", "strength"))


@query("cross_correlation", f"""
WITH {EV}, m AS (SELECT series_id, avg(h_true) AS ma, avg(h_est) AS mb, sqrt(var_pop(h_true) * count(*) * var_pop(h_est) * count(*)) AS nm FROM ev GROUP BY 1),
l AS (SELECT CAST(range - 5 AS INT) AS lag FROM range(11))
SELECT a.series_id, l.lag, {_r('coalesce(sum((a.h_true - ma) * (b.h_est - mb)), 0) / greatest(max(nm), 1e-10)', 'xcorr')}
FROM ev a JOIN l ON true JOIN m ON a.series_id = m.series_id LEFT JOIN ev b ON b.series_id = a.series_id AND b.t = a.t + l.lag GROUP BY 1, 2""")
def cross_correlation(spark, sf):
    e, bound = estimates(spark, sf)
    return rounded(windows.cross_correlation(e.select("series_id", "t", "h_true", "h_est"), "h_true", "h_est", 5, bound))


@query("lag1_corr", f"""
WITH {EV}, n AS (SELECT series_id, h_true, lead(h_est) OVER (PARTITION BY series_id ORDER BY t) AS nx FROM ev)
SELECT series_id, {_r('corr(nx, h_true)', 'lag1_corr')} FROM n WHERE nx IS NOT NULL GROUP BY 1""")
def lag1_corr(spark, sf):
    e, bound = estimates(spark, sf)
    return rounded(windows.lag1_corr(e, ["series_id"], bound=bound))


@query("realised_vol_ratio", f"""
WITH {OBS}, h AS (SELECT series_id, epoch_us(ts) // 3600000000 AS hour, sum(y * y) AS q, count(*) AS n FROM obs GROUP BY 1, 2),
v AS (SELECT series_id, hour, sqrt(sum(q) OVER s / sum(n) OVER s) AS vs, sqrt(sum(q) OVER l / sum(n) OVER l) AS vl FROM h
  WINDOW s AS (PARTITION BY series_id ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW),
         l AS (PARTITION BY series_id ORDER BY hour RANGE BETWEEN 167 PRECEDING AND CURRENT ROW))
SELECT series_id, hour, {_r('vs', 'vol_short')}, {_r('vl', 'vol_long')}, {_r('vs / vl', 'ratio')}, vs / vl > 1.5 AS regime_up FROM v""")
def realised_vol_ratio(spark, sf):
    return rounded(windows.realised_vol_ratio(obs(spark, sf)[0]))


@query("enhanced_breathing", f"""
WITH {LAGV}, s AS (SELECT *, 0.001 + abs(y) / 100 AS sp, CASE WHEN vp IS NULL THEN 0 ELSE abs(y) / greatest(vp, 1e-4) END AS rz FROM lv),
w AS (SELECT *, avg(sp) OVER x AS m, stddev_pop(sp) OVER x AS sd FROM s WINDOW x AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, coalesce(CASE WHEN sd > 1e-12 THEN (sp - m) / sd ELSE 0 END, 0) AS sz FROM w)
SELECT series_id, t, {_r('sz', 'spread_z')}, {_r('rz', 'return_z')},
  {_r('CASE WHEN t > 0 AND (sz > 2 OR rz > 2) THEN 1 + greatest(sz, rz) / 3 * 2.0 ELSE 1.0 END', 'sigma_boost')} FROM z""")
def enhanced_breathing(spark, sf):
    e, bound = estimates(spark, sf)
    e = windows._lag(e, "vol", "vol_prev", bound).withColumn("spread", 0.001 + F.abs("y") / 100)
    d = windows.enhanced_breathing(e, 10, 2.0, 2.0, 3.0, bound=bound)
    return rounded(d.select("series_id", "t", "spread_z", "return_z", "sigma_boost"))


BUD = EV + f""", kp AS (SELECT *, lag(abs(h_est) / 8, 1, 1e10) OVER (PARTITION BY series_id ORDER BY t) AS ksd_prev FROM ev),
bd AS (SELECT *, CASE WHEN t < 10 THEN 12 ELSE 4 + CAST(floor(greatest(0, least(1, (ksd_prev - 0.05) / 0.45)) * 8) AS INT) END AS budget FROM kp)"""


@query("stein_budget", f"WITH {BUD} SELECT series_id, t, CAST(budget AS INT) AS budget FROM bd")
def stein_budget(spark, sf):
    e, bound = estimates(spark, sf)
    return windows.stein_budget(e.withColumn("ksd", F.abs("h_est") / 8), 4, 12, bound=bound).select("series_id", "t", "budget")


@query("beta_schedule", f"""
WITH {BUD}, s AS (SELECT *, CAST(range AS INT) AS stage FROM bd, range(3)),
r AS (SELECT *, CASE WHEN ksd_prev > 0.5 THEN 0.3 WHEN ksd_prev < 0.05 THEN 0.8 ELSE 0.3 + (0.5 - ksd_prev) / 0.45 * 0.5 END AS b FROM s),
f AS (SELECT *, CASE WHEN stage = 2 THEN 1.0 ELSE greatest(0.1, least(1.0, b * (0.5 + 0.5 * (stage + 1) / 3))) END AS beta FROM r)
SELECT series_id, t, stage, {_r('beta')}, {_r('sqrt(beta)', 'beta_root')},
  CAST(CASE WHEN stage = 2 THEN budget - (budget // 3) * 2 ELSE budget // 3 END AS INT) AS steps,
  {_r('CAST([0.3, 0.65, 1.0][stage + 1] AS DOUBLE)', 'beta_fixed')} FROM f""")
def beta_schedule(spark, sf):
    e, bound = estimates(spark, sf)
    d = windows.stein_budget(e.withColumn("ksd", F.abs("h_est") / 8), 4, 12, bound=bound)
    a = windows.beta_schedule(d, 3).select("series_id", "t", "stage", "beta", "beta_root", "steps")
    fixed = F.element_at(F.array(F.lit(0.3), F.lit(0.65), F.lit(1.0)), F.col("stage") + 1)
    return rounded(a.withColumn("beta_fixed", fixed))


# --- evaluation of runs: scenario = event type, seed = user, two estimators of the same truth ------------------------

RUNS = EV + """,
ru AS (SELECT event_type AS scenario, series_id AS seed, t, h_true, vol_true, loglik, h_est AS h_a, ln(y * y + 0.05) AS h_b FROM ev WHERE t >= 5),
ms AS (SELECT scenario, seed, sqrt(avg((h_a - h_true) * (h_a - h_true))) AS rmse_a, sqrt(avg((h_b - h_true) * (h_b - h_true))) AS rmse_b,
  avg(abs(h_a - h_true)) AS mae_a, avg(abs(h_b - h_true)) AS mae_b, -avg(loglik) AS nll_a, -avg(loglik) + 0.01 * avg(h_b) AS nll_b FROM ru GROUP BY 1, 2)"""


def run_pair(spark, sf):
    e = estimates(spark, sf)[0].filter("t >= 5").withColumn("h_b", F.log(F.col("y") * F.col("y") + 0.05))
    a, b = F.col("h_est") - F.col("h_true"), F.col("h_b") - F.col("h_true")
    g = cut_lineage(e.groupBy(F.col("event_type").alias("scenario"), F.col("series_id").alias("seed")).agg(  # both arms in one scan
        F.sqrt(F.avg(a * a)).alias("rmse_a"), F.avg(F.abs(a)).alias("mae_a"), (-F.avg("loglik")).alias("nll_a"),
        F.sqrt(F.avg(b * b)).alias("rmse_b"), F.avg(F.abs(b)).alias("mae_b"), (-F.avg("loglik") + 0.01 * F.avg("h_b")).alias("nll_b")))
    return tuple(g.select("scenario", "seed", F.col(f"rmse_{x}").alias("rmse_h"), F.col(f"mae_{x}").alias("mae_h"), F.col(f"nll_{x}").alias("nll")) for x in "ab")


@query("run_metrics", f"""
WITH {EV}, w AS (SELECT *, lead(h_est) OVER (PARTITION BY series_id ORDER BY t) AS nx FROM ev WHERE t >= 5)
SELECT series_id, {ERR_SQL.replace('AS rmse', 'AS rmse_h').replace('AS mae', 'AS mae_h').replace('AS bias', 'AS bias_h')},
  {_r('sqrt(avg((vol - vol_true) * (vol - vol_true)))', 'rmse_vol')}, {_r('-avg(loglik)', 'nll')}, {_r('corr(h_est, h_true)', 'lag_corr')},
  {_r('corr(nx, h_true)', 'lag1_corr')}, {_r('avg(1 / (1 + y * y))', 'ess_mean')}, {_r('min(1 / (1 + y * y))', 'ess_min')},
  {_r('avg(CASE WHEN 1 / (1 + y * y) < 0.3 THEN 1.0 ELSE 0.0 END)', 'ess_below')}, false AS failed FROM w GROUP BY 1""")
def run_metrics(spark, sf):
    e, bound = estimates(spark, sf)
    truth = e.select("series_id", "t", "h_true", "vol_true")
    est = e.select("series_id", "t", F.col("h_est").alias("h_mean"), "vol", "loglik", (1 / (1 + F.col("y") * F.col("y"))).alias("ess_ratio"))
    return rounded(evaluate.run_metrics(est, truth, ["series_id"], warmup=5, bound=bound))


@query("scenario_stats", f"""
WITH {RUNS}, u AS (SELECT scenario, seed, 'rmse_h' AS metric, rmse_a AS v FROM ms UNION ALL SELECT scenario, seed, 'nll', nll_a FROM ms),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario, metric ORDER BY v, seed) - 1 AS rk, count(*) OVER (PARTITION BY scenario, metric) AS n FROM u)
SELECT scenario, metric, {_r('avg(v)', 'mean')}, {_r('stddev_samp(v)', 'std')}, {_r('min(v)', 'min')}, {_r('max(v)', 'max')},
  {_pick('v', 0.5, 'median')}, {_pick('v', 0.05, 'p5')}, {_pick('v', 0.95, 'p95')} FROM r GROUP BY 1, 2""")
def scenario_stats(spark, sf):
    return rounded(evaluate.scenario_stats(run_pair(spark, sf)[0], ["rmse_h", "nll"]))


ERF_SQL = """(1 - (((((1.061405429 * tt - 1.453152027) * tt) + 1.421413741) * tt - 0.284496736) * tt + 0.254829592) * tt * exp(-xx * xx))"""
TT = RUNS + """,
df AS (SELECT scenario, seed, rmse_b - rmse_a AS d, nll_b - nll_a AS e FROM ms),
ag AS (SELECT scenario, count(*) AS n, avg(d) AS md, stddev_samp(d) AS sd, avg(e) AS me, stddev_samp(e) AS se FROM df GROUP BY 1),
ts AS (SELECT *, sd / sqrt(n) AS se_d, se / sqrt(n) AS se_e, CASE WHEN sd / sqrt(n) > 1e-10 THEN md / (sd / sqrt(n)) ELSE 0 END AS td,
  CASE WHEN se / sqrt(n) > 1e-10 THEN me / (se / sqrt(n)) ELSE 0 END AS te FROM ag),
pv AS (SELECT *, (SELECT 1 - %s FROM (SELECT abs(td) / sqrt(2) AS xx, 1 / (1 + 0.3275911 * abs(td) / sqrt(2)) AS tt)) AS pd,
  (SELECT 1 - %s FROM (SELECT abs(te) / sqrt(2) AS xx, 1 / (1 + 0.3275911 * abs(te) / sqrt(2)) AS tt)) AS pe FROM ts)
""" % (ERF_SQL, ERF_SQL)


@query("paired_ttest", f"""
WITH {TT} SELECT scenario, n, {_r('md', 'mean_diff')}, {_r('td', 't_stat')}, {_r('pd', 'p_normal')} FROM pv""")
def paired_ttest(spark, sf):
    a, b = run_pair(spark, sf)
    return rounded(evaluate.paired_ttest(evaluate.pair_runs(a, b), ["scenario"], "rmse_h"))


@query("compare_arms", f"""
WITH {TT} SELECT scenario, n, {_r('md', 'rmse_h_diff')}, {_r('se_d', 'rmse_h_se')}, {_r('td', 'rmse_h_t')}, {_r('pd', 'rmse_h_p')},
 {_r('CASE WHEN sd > 1e-10 THEN md / sd ELSE 0 END', 'rmse_h_d')}, pd < 0.05 AS rmse_h_significant, md < 0 AS rmse_h_b_better,
 {_r('me', 'nll_diff')}, {_r('se_e', 'nll_se')}, {_r('te', 'nll_t')}, {_r('pe', 'nll_p')},
 {_r('CASE WHEN se > 1e-10 THEN me / se ELSE 0 END', 'nll_d')}, pe < 0.05 AS nll_significant, me < 0 AS nll_b_better FROM pv""")
def compare_arms(spark, sf):
    return rounded(evaluate.compare(*run_pair(spark, sf), ["rmse_h", "nll"]))


@query("arm_verdict", f"""
WITH {TT}, w AS (SELECT CASE WHEN pd < 0.05 AND md < 0 THEN 'B' WHEN pd < 0.05 THEN 'A' ELSE 'tie' END AS w FROM pv),
c AS (SELECT count(*) FILTER (w = 'A') AS wins_a, count(*) FILTER (w = 'B') AS wins_b, count(*) FILTER (w = 'tie') AS ties FROM w)
SELECT *, CASE WHEN wins_b > wins_a AND wins_b > ties THEN 'use B' WHEN wins_a > wins_b THEN 'keep A' ELSE 'no clear winner' END AS verdict FROM c""")
def arm_verdict(spark, sf):
    return evaluate.verdict(evaluate.winners(evaluate.compare(*run_pair(spark, sf), ["rmse_h", "nll"])))


@query("improvement", f"""
WITH {RUNS}, g AS (SELECT scenario, avg(rmse_a) AS a, avg(rmse_b) AS b FROM ms GROUP BY 1)
SELECT scenario, {_r('a', 'mean_a')}, {_r('b', 'mean_b')}, {_r('(a - b) / a * 100', 'improvement_pct')} FROM g""")
def improvement(spark, sf):
    return rounded(evaluate.improvement(*run_pair(spark, sf), ["scenario"], "rmse_h"))
