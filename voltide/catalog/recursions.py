"""Queries: recursions over time, each against a recursive common table expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.catalog.metrics import DIAG, diag
from voltide.catalog.registry import DAILY, EV, OBS, daily, estimates, obs, query, rounded
from voltide.catalog.returns import OFF5, _r
from voltide.functions.config import FilterConfig, implied_offset
from voltide.operators import folds, prep
from voltide.operators.layout import join_back

# Kalman guide with every series' own level as mu
EKF_SQL = f"""
WITH RECURSIVE {OBS},
lv AS (SELECT series_id, 2 * ln(stddev_pop(y) + 1e-8) AS mu FROM obs GROUP BY 1),
ob AS (SELECT o.series_id, o.t, ln(o.y * o.y + 1e-8) + {OFF5} AS z, lv.mu FROM obs o JOIN lv USING (series_id)),
rec AS (
  SELECT series_id, t, mu, mu + k * (z - mu) AS m, (1 - k) * pp AS p FROM
    (SELECT *, pp / (pp + 6.93 + 1e-8) AS k FROM (SELECT *, 0.95 * 0.95 * (0.09 / (1 - 0.95 * 0.95)) + 0.09 AS pp FROM ob WHERE t = 0))
  UNION ALL
  SELECT series_id, t, mu, mp + k * (z - mp), (1 - k) * pp FROM
    (SELECT *, pp / (pp + 6.93 + 1e-8) AS k FROM
      (SELECT ob.series_id, ob.t, ob.mu, ob.z, rec.mu + 0.95 * (rec.m - rec.mu) AS mp, 0.95 * 0.95 * rec.p + 0.09 AS pp
       FROM rec JOIN ob ON ob.series_id = rec.series_id AND ob.t = rec.t + 1)))
"""


def guided(spark, sf):
    o, bound = obs(spark, sf)
    level = o.groupBy("series_id").agg((2 * F.log(F.stddev_pop("y") + 1e-8)).alias("mu"))
    d = join_back(o.select("series_id", "t", "y"), level, ["series_id"])
    d = d.withColumn("rho", F.lit(0.95)).withColumn("sigma_z", F.lit(0.3)).withColumn("offset", F.lit(implied_offset(5.0)))
    return folds.ekf_logvol(d, bound=bound), bound


@query("ekf_logvol", EKF_SQL + f"SELECT series_id, t, {_r('m', 'guide_mean')}, {_r('p', 'guide_var')} FROM rec")
def ekf_logvol(spark, sf):
    return rounded(guided(spark, sf)[0].select("series_id", "t", "guide_mean", "guide_var"))


@query("flagship_last_logvol", EKF_SQL + f"""
SELECT series_id, max(t) AS last_t, {_r('arg_max(m, t)', 'h_last')}, {_r('exp(arg_max(m, t) / 2)', 'vol_last')}, {_r('max(mu)', 'mu')},
  (SELECT count(*) FROM obs o WHERE o.series_id = rec.series_id AND abs(o.y) > 0.5) AS n_extreme FROM rec GROUP BY series_id""")
def flagship(spark, sf):
    d = prep.validate_input(guided(spark, sf)[0])
    return rounded(d.groupBy("series_id").agg(
        F.max("t").alias("last_t"), F.max_by("guide_mean", "t").alias("h_last"), F.exp(F.max_by("guide_mean", "t") / 2).alias("vol_last"),
        F.max("mu").alias("mu"), F.count_if(F.col("status") == 302).alias("n_extreme")))


TWO = FilterConfig("two", model="two_factor", mu=0.5)


@query("ekf_two_factor", f"""
WITH RECURSIVE {OBS},
ob AS (SELECT series_id, t, ln(y * y + 1e-8) + {OFF5} - 0.5 AS z FROM obs),
rec AS (
  SELECT series_id, t, kf * z AS f, ks * z AS s, greatest((1 - kf) * pf, 1e-6) AS vf, greatest((1 - ks) * ps, 1e-6) AS vs FROM
    (SELECT *, pf / (pf + ps + 6.93 + 1e-8) AS kf, ps / (pf + ps + 6.93 + 1e-8) AS ks FROM
      (SELECT *, 0.81 * (0.0225 / 0.19) + 0.0225 AS pf, 0.9801 * (0.0025 / (1 - 0.9801)) + 0.0025 AS ps FROM ob WHERE t = 0))
  UNION ALL
  SELECT series_id, t, fp + kf * (z - fp - sp), sp + ks * (z - fp - sp), greatest((1 - kf) * pf, 1e-6), greatest((1 - ks) * ps, 1e-6) FROM
    (SELECT *, pf / (pf + ps + 6.93 + 1e-8) AS kf, ps / (pf + ps + 6.93 + 1e-8) AS ks FROM
      (SELECT ob.series_id, ob.t, ob.z, 0.9 * rec.f AS fp, 0.99 * rec.s AS sp, 0.81 * rec.vf + 0.0225 AS pf, 0.9801 * rec.vs + 0.0025 AS ps
       FROM rec JOIN ob ON ob.series_id = rec.series_id AND ob.t = rec.t + 1)))
SELECT series_id, t, {_r('f', 'guide_fast')}, {_r('s', 'guide_slow')}, {_r('vf', 'var_fast')}, {_r('vs', 'var_slow')} FROM rec""")
def ekf_two_factor(spark, sf):
    o, bound = obs(spark, sf)
    d = folds.ekf_two_factor(o.select("series_id", "t", "y"), TWO, bound)
    return rounded(d.select("series_id", "t", "guide_fast", "guide_slow", "var_fast", "var_slow"))


@query("adaptive_mu", f"""
WITH RECURSIVE {EV},
e AS (SELECT series_id, t, h_est AS h, least(greatest(abs(y) / 4, 0.01), 2.0) AS bw FROM ev),
rec AS (
  SELECT series_id, t, CAST(-0.5 AS DOUBLE) AS m, CAST(1.0 AS DOUBLE) AS v FROM e WHERE t = 0
  UNION ALL
  SELECT series_id, t, CASE WHEN on_ THEN least(greatest(m + k * (h - m), -1.0), 0.5) ELSE m END, CASE WHEN on_ THEN (1 - k) * pp ELSE v END FROM
    (SELECT *, pp / (pp + 10 * bw * bw + 1e-8) AS k FROM
      (SELECT e.series_id, e.t, e.h, e.bw, rec.m, rec.v, rec.v + 0.001 AS pp, e.t > 10 AS on_ FROM rec JOIN e ON e.series_id = rec.series_id AND e.t = rec.t + 1)))
SELECT series_id, t, {_r('m', 'mu_state')}, {_r('v', 'mu_var')} FROM rec""")
def adaptive_mu(spark, sf):
    e, bound = estimates(spark, sf)
    d = e.select("series_id", "t", F.col("h_est").alias("h_mean"), F.least(F.greatest(F.abs("y") / 4, F.lit(0.01)), F.lit(2.0)).alias("bandwidth"))
    return rounded(folds.adaptive_mu(d, -0.5, 0.001, 10.0, -1.0, 0.5, bound=bound).select("series_id", "t", "mu_state", "mu_var"))


def _smooth_sql(k: int, out: int, rho: float, s2: float, mu: float) -> str:
    """Replay of the lag-k correction with one list of states per tick: newest first."""
    return f"""
WITH RECURSIVE {EV},
e AS (SELECT series_id, t, h_est AS h, 0.04 + y * y / 100 AS v FROM ev),
rec AS (
  SELECT series_id, t, h AS raw, h AS a0, v AS w0, CAST(NULL AS DOUBLE) AS a1, CAST(NULL AS DOUBLE) AS w1, CAST(NULL AS DOUBLE) AS a2, CAST(NULL AS DOUBLE) AS w2 FROM e WHERE t = 0
  UNION ALL
  SELECT series_id, t, raw, a0, w0, a1, w1, CASE WHEN act THEN b2 + g2 * (a1 - ({mu} + {rho} * (b2 - {mu}))) ELSE b2 END,
         CASE WHEN act THEN x2 * (1 - g2 * {rho}) ELSE x2 END FROM
   (SELECT series_id, t, raw, a0, w0, act, CASE WHEN act THEN b1 + g1 * (a0 - ({mu} + {rho} * (b1 - {mu}))) ELSE b1 END AS a1,
         CASE WHEN act THEN x1 * (1 - g1 * {rho}) ELSE x1 END AS w1, b2, x2, {rho} * x2 / ({rho * rho} * x2 + {s2} + 1e-8) AS g2 FROM
     (SELECT e.series_id, e.t, e.h AS raw, e.h AS a0, e.v AS w0, e.t >= {k} AS act, rec.a0 AS b1, rec.w0 AS x1, rec.a1 AS b2, rec.w1 AS x2,
             {rho} * rec.w0 / ({rho * rho} * rec.w0 + {s2} + 1e-8) AS g1
      FROM rec JOIN e ON e.series_id = rec.series_id AND e.t = rec.t + 1)))
SELECT series_id, t, {_r(f'CASE WHEN t < {k} THEN raw ELSE a{out} END', 'h_smoothed')} FROM rec"""


def _smoothed(spark, sf, out):
    e, bound = estimates(spark, sf)
    d = e.select("series_id", "t", F.col("h_est").alias("h_mean"), (0.04 + F.col("y") * F.col("y") / 100).alias("h_var"))
    return rounded(folds.smooth_fixed_lag(d, 0.9, 0.3, -0.5, 3, out, bound=bound).select("series_id", "t", "h_smoothed"))


@query("smooth_lag1", _smooth_sql(3, 1, 0.9, 0.09, -0.5))
def smooth_lag1(spark, sf):
    return _smoothed(spark, sf, 1)


@query("smooth_lag2", _smooth_sql(3, 2, 0.9, 0.09, -0.5))
def smooth_lag2(spark, sf):
    return _smoothed(spark, sf, 2)


@query("ema_first_seed", f"""
WITH RECURSIVE {OBS},
o AS (SELECT series_id, t, CASE WHEN t < 2 THEN 0 ELSE abs(y) END AS x FROM obs),
rec AS (SELECT series_id, t, x AS e, x * x AS q FROM o WHERE t = 0 UNION ALL
  SELECT o.series_id, o.t, CASE WHEN rec.e > 0 THEN 0.05 * o.x + 0.95 * rec.e ELSE o.x END, CASE WHEN rec.q > 0 THEN 0.05 * o.x * o.x + 0.95 * rec.q ELSE o.x * o.x END
  FROM rec JOIN o ON o.series_id = rec.series_id AND o.t = rec.t + 1)
SELECT series_id, t, {_r('e', 'ret_ema')}, {_r('q', 'ret_var')} FROM rec""")
def ema_first_seed(spark, sf):
    o, bound = obs(spark, sf)
    x = F.when(F.col("t") < 2, 0.0).otherwise(F.abs("y"))
    d = folds.ema(o.select("series_id", "t", "y"), x, 0.05, "ret_ema", bound=bound)
    return rounded(folds.ema(d, x * x, 0.05, "ret_var", bound=bound).select("series_id", "t", "ret_ema", "ret_var"))


@query("ema_given_seed", f"""
WITH RECURSIVE {OBS},
o AS (SELECT series_id, t, y, abs(y) AS x, abs(first_value(y) OVER (PARTITION BY series_id ORDER BY t)) AS y0 FROM obs),
rec AS (SELECT series_id, t, 0.3 * x AS s, 0.9 * 1.0 + 0.1 * x * x AS z, 0.9 * y0 + 0.1 * x AS rv FROM o WHERE t = 0 UNION ALL
  SELECT o.series_id, o.t, 0.7 * rec.s + 0.3 * o.x, 0.9 * rec.z + 0.1 * o.x * o.x, 0.9 * rec.rv + 0.1 * o.x
  FROM rec JOIN o ON o.series_id = rec.series_id AND o.t = rec.t + 1)
SELECT series_id, t, {_r('s', 'surprise_ema')}, {_r('z', 'z_sq_ema')}, {_r('rv', 'realised_vol')} FROM rec""")
def ema_given_seed(spark, sf):
    o, bound = obs(spark, sf)
    first = o.groupBy("series_id").agg(F.abs(F.min_by("y", "t")).alias("y0"))
    d = join_back(o.select("series_id", "t", "y"), first, ["series_id"])
    for value, alpha, out, seed in ((F.abs("y"), 0.3, "surprise_ema", 0.0), (F.col("y") * F.col("y"), 0.1, "z_sq_ema", 1.0),
                                    (F.abs("y"), 0.1, "realised_vol", "y0")):
        d = folds.ema(d, value, alpha, out, seed, bound=bound)
    return rounded(d.select("series_id", "t", "surprise_ema", "z_sq_ema", "realised_vol"))


@query("shock_state", f"""
WITH RECURSIVE {DIAG},
e AS (SELECT series_id, t, z_sq * 3 AS z FROM dg),
rec AS (SELECT series_id, t, CASE WHEN z > 9 THEN 1 ELSE 0 END AS s, CASE WHEN z > 9 THEN 0 ELSE 1 END AS n FROM e WHERE t = 0 UNION ALL
  SELECT series_id, t, s2, CASE WHEN s2 <> s OR (s = 2 AND s2 = 1) THEN 0 ELSE n + 1 END FROM
   (SELECT e.series_id, e.t, rec.s, rec.n, CASE rec.s WHEN 0 THEN (CASE WHEN e.z > 9 THEN 1 ELSE 0 END)
       WHEN 1 THEN (CASE WHEN rec.n + 1 >= 5 THEN 2 ELSE 1 END)
       ELSE (CASE WHEN e.z > 9 THEN 1 WHEN rec.n + 1 >= 8 AND e.z < 4 THEN 0 ELSE 2 END) END AS s2
    FROM rec JOIN e ON e.series_id = rec.series_id AND e.t = rec.t + 1))
SELECT series_id, t, CAST(s AS INT) AS shock_state, s <> 1 AS should_learn, {_r('CASE s WHEN 1 THEN 0.0 WHEN 2 THEN 1.5 ELSE 1.0 END::DOUBLE', 'lr_mult')} FROM rec""")
def shock_state(spark, sf):
    d, bound = diag(spark, sf)
    d = d.select("series_id", "t", (F.col("z_sq") * 3).alias("z_sq"))
    d = folds.learn_gate(folds.shock_state(d, shock_ticks=5, recovery_ticks=8, bound=bound), 1.5)
    return rounded(d.select("series_id", "t", F.col("shock_state").cast("int").alias("shock_state"), "should_learn", "lr_mult"))


@query("bandwidth_fold", f"""
WITH RECURSIVE {OBS},
o AS (SELECT series_id, t, abs(y) AS x, 0.02 + y * y / 50 AS v, 0.3 + abs(y) AS sp FROM obs),
rec AS (
  SELECT series_id, t, x AS e, b * greatest(0.5, least(1.0, 1 - 0.25 * least(greatest(x / greatest(x, 1e-8), least(sp * 0.5, 2.0)) - 1, 2.0))) AS q FROM
    (SELECT *, greatest(2 * v / ln(65), 1e-6) AS b FROM o WHERE t = 0)
  UNION ALL
  SELECT series_id, t, e, (0.3 * b + 0.7 * pq) * greatest(0.5, least(1.0, 1 - 0.25 * least(greatest(x / greatest(e, 1e-8), least(sp * 0.5, 2.0)) - 1, 2.0))) FROM
    (SELECT o.series_id, o.t, o.x, o.sp, greatest(2 * o.v / ln(65), 1e-6) AS b, rec.q AS pq, CASE WHEN rec.e > 0 THEN 0.05 * o.x + 0.95 * rec.e ELSE o.x END AS e
     FROM rec JOIN o ON o.series_id = rec.series_id AND o.t = rec.t + 1))
SELECT series_id, t, {_r('q', 'bandwidth_sq')}, {_r('greatest(0.01, least(2.0, sqrt(q)))', 'bandwidth')} FROM rec""")
def bandwidth_fold(spark, sf):
    o, bound = obs(spark, sf)
    d = o.select("series_id", "t", "y", (0.02 + F.col("y") * F.col("y") / 50).alias("var"), (0.3 + F.abs("y")).alias("spread"))
    return rounded(folds.bandwidth_fold(d, 64, bound=bound).select("series_id", "t", "bandwidth_sq", "bandwidth"))


# --- long series from t = 100 on, with every fifth tick missing, in pieces that are much shorter than the series ---------

LATE = DAILY + """,
late AS (SELECT series_id, t, y, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS k FROM daily WHERE t >= 100 AND t % 5 <> 0)
"""


def late(spark, sf):
    d, bound = daily(spark, sf)
    return prep.drop_warmup(d.select("series_id", "t", "y"), 100).filter("t % 5 <> 0"), bound


@query("late_start_averages", f"""
WITH RECURSIVE {LATE},
rec AS (SELECT series_id, t, k, abs(y) AS e, 0.1 * abs(y) + 0.9 * 0.5 AS g FROM late WHERE k = 0 UNION ALL
  SELECT l.series_id, l.t, l.k, CASE WHEN rec.e > 0 THEN 0.05 * abs(l.y) + 0.95 * rec.e ELSE abs(l.y) END, 0.1 * abs(l.y) + 0.9 * rec.g
  FROM rec JOIN late l ON l.series_id = rec.series_id AND l.k = rec.k + 1)
SELECT series_id, t, {_r('e', 'ret_ema')}, {_r('g', 'seeded')} FROM rec""")
def late_start_averages(spark, sf):
    d, bound = late(spark, sf)
    d = folds.ema(d, F.abs("y"), 0.05, "ret_ema", bound=bound, piece=16)
    return rounded(folds.ema(d, F.abs("y"), 0.1, "seeded", 0.5, bound=bound, piece=16).select("series_id", "t", "ret_ema", "seeded"))


@query("late_start_level", f"""
WITH RECURSIVE {LATE},
o AS (SELECT series_id, t, k, ln(y * y + 1e-4) AS h, least(greatest(abs(y) / 4, 0.01), 2.0) AS bw FROM late),
rec AS (
  SELECT series_id, t, k, greatest(-6.0, least(-1.0, CAST(-3.0 AS DOUBLE) + (1.001 / (1.001 + 10 * bw * bw + 1e-8)) * (h + 3.0))) AS m,
         (1 - 1.001 / (1.001 + 10 * bw * bw + 1e-8)) * 1.001 AS v FROM o WHERE k = 0
  UNION ALL
  SELECT series_id, t, k, least(greatest(m + g * (h - m), -6.0), -1.0), (1 - g) * pp FROM
    (SELECT *, pp / (pp + 10 * bw * bw + 1e-8) AS g FROM
      (SELECT o.series_id, o.t, o.k, o.h, o.bw, rec.m, rec.v + 0.001 AS pp FROM rec JOIN o ON o.series_id = rec.series_id AND o.k = rec.k + 1)))
SELECT series_id, t, {_r('m', 'mu_state')}, {_r('v', 'mu_var')} FROM rec""")
def late_start_level(spark, sf):
    d, bound = late(spark, sf)
    d = d.select("series_id", "t", F.log(F.col("y") * F.col("y") + 1e-4).alias("h_mean"), F.least(F.greatest(F.abs("y") / 4, F.lit(0.01)), F.lit(2.0)).alias("bandwidth"))
    return rounded(folds.adaptive_mu(d, -3.0, 0.001, 10.0, -6.0, -1.0, bound=bound, piece=16).select("series_id", "t", "mu_state", "mu_var"))


@query("late_start_shocks", f"""
WITH RECURSIVE {LATE},
o AS (SELECT series_id, t, k, y * y * 40 AS z FROM late),
rec AS (SELECT series_id, t, k, CASE WHEN z > 9 THEN 1 ELSE 0 END AS s, CASE WHEN z > 9 THEN 0 ELSE 1 END AS n FROM o WHERE k = 0 UNION ALL
  SELECT series_id, t, k, s2, CASE WHEN s2 <> s OR (s = 2 AND s2 = 1) THEN 0 ELSE n + 1 END FROM
   (SELECT o.series_id, o.t, o.k, rec.s, rec.n, CASE rec.s WHEN 0 THEN (CASE WHEN o.z > 9 THEN 1 ELSE 0 END)
       WHEN 1 THEN (CASE WHEN rec.n + 1 >= 5 THEN 2 ELSE 1 END)
       ELSE (CASE WHEN o.z > 9 THEN 1 WHEN rec.n + 1 >= 8 AND o.z < 4 THEN 0 ELSE 2 END) END AS s2
    FROM rec JOIN o ON o.series_id = rec.series_id AND o.k = rec.k + 1))
SELECT series_id, t, CAST(s AS INT) AS shock_state FROM rec""")
def late_start_shocks(spark, sf):
    d, bound = late(spark, sf)
    d = d.select("series_id", "t", (F.col("y") * F.col("y") * 40).alias("z_sq"))
    d = folds.shock_state(d, shock_ticks=5, recovery_ticks=8, bound=bound, piece=16)
    return d.select("series_id", "t", F.col("shock_state").cast("int").alias("shock_state"))


LATE_CFG = FilterConfig("late", rho=0.95, sigma_z=0.3, mu=-9.0)


@query("late_start_ekf", f"""
WITH RECURSIVE {LATE},
ob AS (SELECT series_id, t, k, ln(y * y + 1e-8) + {OFF5} AS z FROM late),
rec AS (
  SELECT series_id, t, k, -9.0 + g * (z + 9.0) AS m, (1 - g) * pp AS p FROM
    (SELECT *, pp / (pp + 6.93 + 1e-8) AS g FROM (SELECT *, 0.95 * 0.95 * (0.09 / (1 - 0.95 * 0.95)) + 0.09 AS pp FROM ob WHERE k = 0))
  UNION ALL
  SELECT series_id, t, k, mp + g * (z - mp), (1 - g) * pp FROM
    (SELECT *, pp / (pp + 6.93 + 1e-8) AS g FROM
      (SELECT ob.series_id, ob.t, ob.k, ob.z, -9.0 + 0.95 * (rec.m + 9.0) AS mp, 0.95 * 0.95 * rec.p + 0.09 AS pp
       FROM rec JOIN ob ON ob.series_id = rec.series_id AND ob.k = rec.k + 1)))
SELECT series_id, t, {_r('m', 'guide_mean')}, {_r('p', 'guide_var')} FROM rec""")
def late_start_ekf(spark, sf):
    d, bound = late(spark, sf)
    c = LATE_CFG
    d = d.withColumns({"rho": F.lit(c.rho), "sigma_z": F.lit(c.sigma_z), "mu": F.lit(c.mu), "offset": F.lit(implied_offset(5.0))})
    return rounded(folds.ekf_logvol(d, bound=bound).select("series_id", "t", "guide_mean", "guide_var"))


@query("late_start_two_factor", f"""
WITH RECURSIVE {LATE},
ob AS (SELECT series_id, t, k, ln(y * y + 1e-8) + {OFF5} - 0.5 AS z FROM late),
rec AS (
  SELECT series_id, t, k, kf * z AS f, ks * z AS s, greatest((1 - kf) * pf, 1e-6) AS vf, greatest((1 - ks) * ps, 1e-6) AS vs FROM
    (SELECT *, pf / (pf + ps + 6.93 + 1e-8) AS kf, ps / (pf + ps + 6.93 + 1e-8) AS ks FROM
      (SELECT *, 0.81 * (0.0225 / 0.19) + 0.0225 AS pf, 0.9801 * (0.0025 / (1 - 0.9801)) + 0.0025 AS ps FROM ob WHERE k = 0))
  UNION ALL
  SELECT series_id, t, k, fp + kf * (z - fp - sp), sp + ks * (z - fp - sp), greatest((1 - kf) * pf, 1e-6), greatest((1 - ks) * ps, 1e-6) FROM
    (SELECT *, pf / (pf + ps + 6.93 + 1e-8) AS kf, ps / (pf + ps + 6.93 + 1e-8) AS ks FROM
      (SELECT ob.series_id, ob.t, ob.k, ob.z, 0.9 * rec.f AS fp, 0.99 * rec.s AS sp, 0.81 * rec.vf + 0.0225 AS pf, 0.9801 * rec.vs + 0.0025 AS ps
       FROM rec JOIN ob ON ob.series_id = rec.series_id AND ob.k = rec.k + 1)))
SELECT series_id, t, {_r('f', 'guide_fast')}, {_r('s', 'guide_slow')}, {_r('vf', 'var_fast')}, {_r('vs', 'var_slow')} FROM rec""")
def late_start_two_factor(spark, sf):
    d, bound = late(spark, sf)
    return rounded(folds.ekf_two_factor(d, TWO, bound).select("series_id", "t", "guide_fast", "guide_slow", "var_fast", "var_slow"))


@query("late_start_bandwidth", f"""
WITH RECURSIVE {LATE},
o AS (SELECT series_id, t, k, abs(y) AS x, 0.02 + y * y / 50 AS v, 0.3 + abs(y) AS sp FROM late),
rec AS (
  SELECT series_id, t, k, x AS e, b * greatest(0.5, least(1.0, 1 - 0.25 * least(greatest(x / greatest(x, 1e-8), least(sp * 0.5, 2.0)) - 1, 2.0))) AS q FROM
    (SELECT *, greatest(2 * v / ln(65), 1e-6) AS b FROM o WHERE k = 0)
  UNION ALL
  SELECT series_id, t, k, e, (0.3 * b + 0.7 * pq) * greatest(0.5, least(1.0, 1 - 0.25 * least(greatest(x / greatest(e, 1e-8), least(sp * 0.5, 2.0)) - 1, 2.0))) FROM
    (SELECT o.series_id, o.t, o.k, o.x, o.sp, greatest(2 * o.v / ln(65), 1e-6) AS b, rec.q AS pq, CASE WHEN rec.e > 0 THEN 0.05 * o.x + 0.95 * rec.e ELSE o.x END AS e
     FROM rec JOIN o ON o.series_id = rec.series_id AND o.k = rec.k + 1))
SELECT series_id, t, {_r('q', 'bandwidth_sq')}, {_r('greatest(0.01, least(2.0, sqrt(q)))', 'bandwidth')} FROM rec""")
def late_start_bandwidth(spark, sf):
    d, bound = late(spark, sf)
    d = d.select("series_id", "t", "y", (0.02 + F.col("y") * F.col("y") / 50).alias("var"), (0.3 + F.abs("y")).alias("spread"))
    return rounded(folds.bandwidth_fold(d, 64, bound=bound, piece=16).select("series_id", "t", "bandwidth_sq", "bandwidth"))


@query("sparse_ticks", f"""
WITH RECURSIVE {DAILY},
s AS (SELECT series_id, CAST(date_diff('minute', DATE '1970-01-01', day) AS BIGINT) AS t, y, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS k FROM daily),
rec AS (SELECT series_id, t, k, abs(y) AS e, CASE WHEN y * y * 40 > 9 THEN 1 ELSE 0 END AS s, CASE WHEN y * y * 40 > 9 THEN 0 ELSE 1 END AS n FROM s WHERE k = 0 UNION ALL
  SELECT series_id, t, k, e, s2, CASE WHEN s2 <> s OR (s = 2 AND s2 = 1) THEN 0 ELSE n + 1 END FROM
   (SELECT o.series_id, o.t, o.k, rec.s, rec.n, CASE WHEN rec.e > 0 THEN 0.05 * abs(o.y) + 0.95 * rec.e ELSE abs(o.y) END AS e,
           CASE rec.s WHEN 0 THEN (CASE WHEN o.y * o.y * 40 > 9 THEN 1 ELSE 0 END) WHEN 1 THEN (CASE WHEN rec.n + 1 >= 5 THEN 2 ELSE 1 END)
             ELSE (CASE WHEN o.y * o.y * 40 > 9 THEN 1 WHEN rec.n + 1 >= 8 AND o.y * o.y * 40 < 4 THEN 0 ELSE 2 END) END AS s2
    FROM rec JOIN s o ON o.series_id = rec.series_id AND o.k = rec.k + 1))
SELECT series_id, t, {_r('e', 'ret_ema')}, CAST(s AS INT) AS shock_state FROM rec""")
def sparse_ticks(spark, sf):
    """Averages and shock states where the tick is the minute of a daily row: 1,440 apart, in pieces of 16 rows."""
    d, bound = daily(spark, sf)
    d = d.select("series_id", (F.datediff("day", F.lit("1970-01-01")).cast("long") * 1440).alias("t"), "y")
    d = folds.ema(d, F.abs("y"), 0.05, "ret_ema", bound=bound, piece=16).withColumn("z_sq", F.col("y") * F.col("y") * 40)
    d = folds.shock_state(d, shock_ticks=5, recovery_ticks=8, bound=bound, piece=16)
    return rounded(d.select("series_id", "t", "ret_ema", F.col("shock_state").cast("int").alias("shock_state")))
