"""Queries: sources and sinks, returns, scalar functions, validation, alignment."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voltide.catalog.registry import DAILY, EV, OBS, daily_prices, estimates, obs, query, rounded, table
from voltide.functions import columns as fn
from voltide.functions.config import FilterConfig, presets, with_configs
from voltide.operators import prep, windows
from voltide.session import group_bound, scratch_table
from voltide.sources import files


def _r(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {name or c}"


def market_rows(spark, sf):
    d = daily_prices(spark, sf)
    bound = group_bound(d, ["series_id"])
    p = prep.price_returns(prep.index_prices(d, "series_id", ["day"], "price", bound), bound).filter("k > 0")
    return p.select("series_id", F.col("ts").alias("date"), "price", F.col("ret").alias("return"), F.col("y").alias("log_return"))


@query("io_market_csv", f"""
WITH {DAILY}
SELECT year(day) AS yr, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day,
       {_r('sum(log_return)', 'sum_log_return')}, {_r('sum(price) / 1e6', 'sum_price_m')}, 0::BIGINT AS bad_cells
FROM (SELECT day, round(price, 10) AS price, round(y, 10) AS log_return FROM daily) GROUP BY 1""")
def io_market_csv(spark, sf):
    path = scratch_table(spark, "market")
    files.write_returns(market_rows(spark, sf), path)
    back = files.read_market_csv(spark, path)
    return rounded(back.groupBy(F.year("date").cast("long").alias("yr")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.sum("log_return").alias("sum_log_return"), (F.sum("price") / 1e6).alias("sum_price_m"),
        F.count_if(F.col("price").isNull() | F.col("log_return").isNull()).alias("bad_cells")))


@query("io_returns_lines", f"""
WITH {DAILY}
SELECT count(*) AS n_lines, {_r('sum(round(y, 10))', 'sum_y')}, 0::BIGINT AS gaps FROM daily""")
def io_returns_lines(spark, sf):
    path = scratch_table(spark, "lines")
    files.write_returns_only(market_rows(spark, sf), path, ("date", "series_id"))
    back = files.read_returns_csv(spark, path)
    per_file = back.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.max("t").alias("m"),
                                        F.count_distinct("t").alias("d"))
    return rounded(per_file.agg(F.sum("n").alias("n_lines"), F.sum("s").alias("sum_y"),
                                F.sum((F.col("m") + 1 - F.col("n")) + (F.col("n") - F.col("d"))).alias("gaps")))


@query("io_returns_f32", f"""
WITH {OBS}
SELECT count(*) AS n, round(sum(CAST(CAST(y AS FLOAT) AS DOUBLE)), 6) + 0.0 AS sum_y FROM obs""")
def io_returns_f32(spark, sf):
    path = scratch_table(spark, "f32")
    files.write_returns_f32(obs(spark, sf)[0], path)
    return rounded(files.read_returns_f32(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y")))


@query("io_manifest", "SELECT event_type AS dataset, count(*) AS n_rows FROM events GROUP BY 1")
def io_manifest(spark, sf):
    return files.manifest(table(spark, sf, "events").select(F.col("event_type").alias("dataset")))


@query("io_json_report", f"""
WITH {OBS}
SELECT series_id, count(*) AS n, {_r('avg(y)', 'mean')} FROM obs GROUP BY 1""")
def io_json_report(spark, sf):
    o, _ = obs(spark, sf)
    stats = o.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    path = scratch_table(spark, "report")
    files.to_json_report(stats).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "series_id bigint, n bigint, mean double").alias("r"))
    return rounded(back.select("r.*"))


@query("io_trace", f"""
WITH {EV}
SELECT series_id, count(*) AS n, {_r('sum(h_true)', 'sum_true')}, {_r('sum(h_est)', 'sum_est')}, {_r('sum(y)', 'sum_return')}
FROM ev GROUP BY 1""")
def io_trace(spark, sf):
    e, _ = estimates(spark, sf)
    truth = e.select("series_id", "t", "y", "h_true", "vol_true", F.lit(-3.5).alias("mu"), F.lit(0.1).alias("sigma_z"),
                     F.lit(0).alias("scenario_id"))
    est = e.select("series_id", "t", F.col("h_est").alias("h_mean"), "vol")
    path = scratch_table(spark, "trace")
    files.write_trace(files.trace(truth, est), path)
    back = spark.read.schema("series_id BIGINT, t BIGINT, return DOUBLE, true_logvol DOUBLE, true_vol DOUBLE, est_logvol DOUBLE, "
                             "est_vol DOUBLE, true_mu DOUBLE, true_sigma DOUBLE, scenario INT, bucket BIGINT").option("header", True).csv(path)
    return rounded(back.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("true_logvol").alias("sum_true"), F.sum("est_logvol").alias("sum_est"),
        F.sum("return").alias("sum_return")))


def psi(x: float) -> float:
    """Digamma for SQL constants."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 0.5 / x - 1 / (12 * x * x) + 1 / (120 * x**4)


def nu_score_sql(nu: float, y: str = "y", h: str = "h_true") -> str:
    z2 = f"({y} * {y} / ((exp({h} / 2) + 1e-8) * (exp({h} / 2) + 1e-8)))"
    c = psi((nu + 1) / 2) - psi(nu / 2) - 1 / nu
    return f"0.5 * ({c!r} - ln(1 + {z2} / {nu}) + {nu + 1} * {z2} / ({nu * nu} * (1 + {z2} / {nu})))"


def nu_score(nu, y="y", h="h_true"):
    z2 = F.pow(fn.std_residual(y, h), F.lit(2.0))
    n = fn._c(nu)
    a = 1 + z2 / n
    return 0.5 * (fn.digamma((n + 1) / 2) - fn.digamma(n / 2) - 1 / n - F.log(a) + (n + 1) * z2 / (n * n * a))


@query("io_pivot_gradients", f"""
WITH {EV}
SELECT series_id, t, {_r(nu_score_sql(5.0), 'grad_nu5')}, {_r(nu_score_sql(10.0), 'grad_nu10')}, {_r(nu_score_sql(30.0), 'grad_nu30')}
FROM ev""")
def io_pivot_gradients(spark, sf):
    e, _ = estimates(spark, sf)
    long = e.select("*", F.explode(F.array(*[F.lit(v) for v in (5.0, 10.0, 30.0)])).alias("nu"))
    return rounded(files.pivot_gradients(long.withColumn("nu_grad", nu_score("nu")), keys=("series_id", "t")))


@query("io_diag", f"""
WITH {EV}
SELECT series_id, count(*) AS n, {_r('sum(y * y / ((exp(h_true / 2) + 1e-8) * (exp(h_true / 2) + 1e-8)))', 'sum_z_sq')},
       {_r('sum(' + nu_score_sql(10.0) + ')', 'sum_grad')} FROM ev GROUP BY 1""")
def io_diag(spark, sf):
    e, _ = estimates(spark, sf)
    d = e.select("series_id", "t", F.col("y").alias("y_t"), "vol", F.pow(fn.std_residual("y", "h_true"), F.lit(2.0)).alias("z_sq"),
                 nu_score(10.0).alias("nu_grad"), F.lit(0.0).alias("nu_grad_ema"), F.lit(1.0).alias("z_sq_ema"),
                 F.lit(0).alias("shock_state"))
    path = scratch_table(spark, "diag")
    files.write_diag(d, path)
    back = spark.read.schema("series_id BIGINT, t BIGINT, y_t DOUBLE, vol DOUBLE, z_sq DOUBLE, nu_grad DOUBLE, nu_grad_ema DOUBLE, "
                             "z_sq_ema DOUBLE, shock_state INT").option("header", True).csv(path)
    return rounded(back.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("z_sq").alias("sum_z_sq"),
                                                 F.sum("nu_grad").alias("sum_grad")))


@query("returns", f"WITH {OBS} SELECT series_id, t, tie, {_r('price')}, {_r('ret')}, {_r('y')} FROM obs")
def returns(spark, sf):
    return rounded(obs(spark, sf)[0].select("series_id", "t", "tie", "price", "ret", "y"))


@query("drop_first_reindex", f"""
WITH {OBS} SELECT series_id, min(t) AS t_min, max(t) AS t_max, count(*) AS n FROM obs GROUP BY 1""")
def drop_first_reindex(spark, sf):
    return obs(spark, sf)[0].groupBy("series_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"),
                                                      F.count(F.lit(1)).alias("n"))


@query("y_prev", f"""
WITH {OBS} SELECT series_id, t, {_r('coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY t), 0)', 'y_prev')} FROM obs""")
def y_prev(spark, sf):
    o, bound = obs(spark, sf)
    return rounded(prep.with_y_prev(o, bound).select("series_id", "t", "y_prev"))


@query("annualise", f"""
WITH {DAILY}
SELECT series_id, {_r('avg(y) * 252', 'mean_ann')}, {_r('stddev_pop(y) * sqrt(252)', 'std_ann')} FROM daily GROUP BY 1""")
def annualise(spark, sf):
    m = market_rows(spark, sf).groupBy("series_id").agg(F.avg("log_return").alias("mean"), F.stddev_pop("log_return").alias("std"))
    return rounded(prep.annualise(m).select("series_id", "mean_ann", "std_ann"))


OFF5 = "(-(ln(5) - 1.9635100260214235 - (ln(2.5) - 1 / 5.0 - 1 / 75.0)))"


@query("log_squared", f"""
WITH {OBS}
SELECT series_id, t, {_r('ln(y * y + 1e-8)', 'log_y2_guide')}, {_r('ln(y * y + 1e-10)', 'log_y2_grad')},
       {_r(f'greatest(ln(y * y + 1e-10) + {OFF5}, -5.0)', 'h_implied')} FROM obs""")
def log_squared(spark, sf):
    o, _ = obs(spark, sf)
    return rounded(o.select("series_id", "t", fn.log_y2("y").alias("log_y2_guide"), fn.log_y2("y", 1e-10).alias("log_y2_grad"),
                            fn.implied_h("y", fn.t_implied_offset(F.lit(5.0))).alias("h_implied")))


@query("student_t_consts", f"""
WITH n AS (SELECT DISTINCT 1.5 + user_id % 28 AS nu FROM events)
SELECT {_r('nu')}, {_r('lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(pi() * nu)', 'log_norm')},
       {_r('''-(ln(nu) - 1.9635100260214235 - (CASE WHEN nu / 2 >= 1 THEN ln(nu / 2) - 1 / nu - 1 / (3 * nu * nu)
              ELSE -0.5772156649 - 2 / nu END))''', 'implied_offset')}
FROM (SELECT CAST(nu AS DOUBLE) AS nu FROM n)""")
def student_t_consts(spark, sf):
    n = table(spark, sf, "events").select((F.lit(1.5) + F.col("user_id") % 28).alias("nu")).distinct()
    return rounded(n.select("nu", fn.t_log_norm("nu").alias("log_norm"), fn.t_implied_offset("nu").alias("implied_offset")))


@query("digamma", f"""
WITH n AS (SELECT DISTINCT 0.25 + (user_id % 40) / 4.0 AS x FROM events),
k AS (SELECT CAST(x AS DOUBLE) AS x, CAST(greatest(ceil(6 - x), 0) AS INT) AS k FROM n)
SELECT {_r('x')}, {_r('''coalesce(-list_sum(list_transform(range(k), lambda j: 1 / (x + j))), 0) + ln(x + k) - 0.5 / (x + k)
   - 1 / (12 * (x + k) * (x + k)) + 1 / (120 * (x + k) * (x + k) * (x + k) * (x + k))''', 'psi')} FROM k""")
def digamma(spark, sf):
    n = table(spark, sf, "events").select((F.lit(0.25) + (F.col("user_id") % 40) / 4.0).alias("x")).distinct()
    return rounded(n.select("x", fn.digamma("x").alias("psi")))


@query("student_t_density", f"""
WITH {EV}
SELECT series_id, t, {_r('loglik')}, {_r('y / (exp(h_est / 2) + 1e-8)', 'z')},
       {_r('(y / (exp(h_est / 2) + 1e-8)) * (y / (exp(h_est / 2) + 1e-8))', 'z_sq')} FROM ev""")
def student_t_density(spark, sf):
    e, _ = estimates(spark, sf)
    z = fn.std_residual("y", "h_est")
    return rounded(e.select("series_id", "t", "loglik", z.alias("z"), (z * z).alias("z_sq")))


@query("clamps", f"""
WITH {OBS},
x AS (SELECT series_id, t, CASE WHEN t = 0 THEN NULL WHEN t = 1 THEN CAST('NaN' AS DOUBLE) ELSE 4 * y END AS v FROM obs)
SELECT series_id, t, v IS NULL AS is_null, coalesce(isnan(v), false) AS is_nan,
       {_r("CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE least(greatest(v, -15.0), 5.0) END", 'h_clamped')},
       {_r("CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE least(greatest(v, -10.0), 10.0) END", 'g_clamped')} FROM x""")
def clamps(spark, sf):
    v = F.when(F.col("t") == 0, F.lit(None).cast("double")).when(F.col("t") == 1, F.lit(float("nan"))).otherwise(4 * F.col("y"))
    x = obs(spark, sf)[0].withColumn("v", v)
    zero = lambda c: F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)
    return rounded(x.select("series_id", "t", fn.clamp_h("v").isNull().alias("is_null"),
                            F.coalesce(F.isnan(fn.clamp_h("v")), F.lit(False)).alias("is_nan"),
                            zero(fn.clamp_h("v")).alias("h_clamped"), zero(fn.clamp("v", -10, 10)).alias("g_clamped")))


@query("transforms", f"""
WITH {OBS}, x AS (SELECT series_id, t, y / 4 AS e, y / 4 - 1 AS k FROM obs)
SELECT series_id, t, {_r('tanh(e)', 'a_rho')}, {_r('exp(k)', 'a_sigma')}, {_r('2 + exp(k)', 'a_nu')},
  {_r('0.999 / (1 + exp(-e))', 'b_rho')}, {_r('1 / (1 + exp(-e))', 'c_rho')}, {_r('greatest(exp(least(greatest(k, -20), 20)), 0.01)', 'c_sigma')},
  {_r('0.5 + 0.499 / (1 + exp(-e))', 'd_rho')}, {_r('ln(1 + exp(k)) + 0.001', 'd_sigma')},
  {_r('1 - tanh(e) * tanh(e)', 'd_rho_deta')},
  {_r('0.5 * ln((1 + least(greatest(tanh(e), -0.999), 0.999)) / (1 - least(greatest(tanh(e), -0.999), 0.999)))', 'a_eta')},
  {_r('ln((1 / (1 + exp(-e))) / (1 - 1 / (1 + exp(-e)) + 1e-8))', 'b_eta')}, {_r('e', 'd_eta')}
FROM x""")
def transforms(spark, sf):
    x = obs(spark, sf)[0].select("series_id", "t", (F.col("y") / 4).alias("e"), (F.col("y") / 4 - 1).alias("k"))
    a, b = fn.constrain("tanh", "e", "k", nu="k"), fn.constrain("sigmoid", "e", "k")
    c, d = fn.constrain("joint", "e", "k"), fn.constrain("soft", "e", "k")
    ua, ub = fn.unconstrain("tanh", a["rho"], a["sigma"]), fn.unconstrain("sigmoid", b["rho"], b["sigma"])
    ud = fn.unconstrain("soft", d["rho"], d["sigma"])
    ch = fn.chain_factors(a["rho"], a["sigma"], a["nu"])
    return rounded(x.select("series_id", "t", a["rho"].alias("a_rho"), a["sigma"].alias("a_sigma"), a["nu"].alias("a_nu"),
                            b["rho"].alias("b_rho"), c["rho"].alias("c_rho"), c["sigma"].alias("c_sigma"), d["rho"].alias("d_rho"),
                            d["sigma"].alias("d_sigma"), ch["d_rho"].alias("d_rho_deta"), ua["rho"].alias("a_eta"),
                            ub["rho"].alias("b_eta"), ud["rho"].alias("d_eta")))


@query("stationary_variance", f"""
WITH c AS (SELECT user_id, 0.5 + 0.49 * (user_id % 100) / 100.0 AS rho, avg(value) / 1000 AS sigma FROM events GROUP BY 1, 2)
SELECT user_id, {_r('sigma * sigma / (1 - rho * rho + 1e-6)', 'var_gauss')},
       {_r('2.5 / 0.5 * sigma * sigma / (1 - rho * rho + 1e-6)', 'var_t')},
       {_r('vr', 'rho_1f')}, {_r('sqrt((vf + vs) * (1 - vr * vr))', 'sigma_1f')}
FROM (SELECT *, (rho * vf + 0.99 * vs) / (vf + vs) AS vr FROM
  (SELECT *, sigma * sigma / (1 - rho * rho) AS vf, 0.05 * 0.05 / (1 - 0.99 * 0.99) AS vs FROM c))""")
def stationary_variance(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", (F.lit(0.5) + 0.49 * (F.col("user_id") % 100) / 100.0).alias("rho")).agg(
        (F.avg("value") / 1000).alias("sigma"))
    one = fn.collapse_two_factor("rho", "sigma", 0.99, 0.05)
    return rounded(c.select("user_id", fn.stationary_variance("rho", "sigma").alias("var_gauss"),
                            fn.stationary_variance("rho", "sigma", True, 2.0).alias("var_t"),
                            one["rho"].alias("rho_1f"), one["sigma_z"].alias("sigma_1f")))


STATUS_SQL = """CASE WHEN v IS NULL THEN 320 WHEN isnan(v) THEN 300 WHEN abs(v) > 1e30 THEN 301 WHEN abs(v) > 0.5 THEN 302 ELSE 0 END"""
BAD = OBS + f""",
bad AS (SELECT series_id, t, CASE WHEN t % 11 = 3 THEN NULL WHEN t % 13 = 5 THEN CAST('NaN' AS DOUBLE)
               WHEN t % 17 = 7 THEN CAST('Infinity' AS DOUBLE) ELSE y END AS v FROM obs),
st AS (SELECT *, {STATUS_SQL} AS status FROM bad)"""


def flawed(spark, sf):
    o, bound = obs(spark, sf)
    t = F.col("t")
    v = (F.when(t % 11 == 3, F.lit(None).cast("double")).when(t % 13 == 5, F.lit(float("nan")))
         .when(t % 17 == 7, F.lit(float("inf"))).otherwise(F.col("y")))
    return prep.validate_input(o.select("series_id", "t", v.alias("y"))), bound


@query("validate_input", f"""
WITH {BAD}
SELECT CAST(status AS INT) AS status, CASE status WHEN 320 THEN 'INPUT_IS_NULL' WHEN 300 THEN 'INPUT_IS_NAN' WHEN 301 THEN 'INPUT_IS_INF'
       WHEN 302 THEN 'INPUT_EXTREME_VALUE' ELSE 'OK' END AS status_name, count(*) AS n,
       bool_or(status > 0 AND status < 1000) AS is_error, bool_or(status >= 1000) AS is_warning FROM st GROUP BY 1, 2""")
def validate_input(spark, sf):
    d, _ = flawed(spark, sf)
    return d.groupBy("status", "status_name").agg(F.count(F.lit(1)).alias("n"), F.bool_or(fn.is_error("status")).alias("is_error"),
                                                  F.bool_or(fn.is_warning("status")).alias("is_warning"))


@query("repair_skip", f"WITH {BAD} SELECT series_id, t, {_r('v', 'y')} FROM st WHERE status = 0")
def repair_skip(spark, sf):
    d, bound = flawed(spark, sf)
    return rounded(prep.repair_input(d, "skip", bound).select("series_id", "t", "y"))


@query("repair_carry", f"""
WITH {BAD}
SELECT series_id, t, {_r('''last_value(CASE WHEN status = 0 THEN v END IGNORE NULLS) OVER
  (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''', 'y')} FROM st""")
def repair_carry(spark, sf):
    d, bound = flawed(spark, sf)
    return rounded(prep.repair_input(d, "carry", bound).select("series_id", "t", "y"))


@query("repair_mean", f"""
WITH {BAD}, g AS (SELECT *, CASE WHEN status = 0 THEN v END AS g FROM st),
n AS (SELECT *, lag(g) OVER w AS a, lead(g) OVER w AS b FROM g WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, {_r('coalesce(g, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END)', 'y')} FROM n""")
def repair_mean(spark, sf):
    d, bound = flawed(spark, sf)
    return rounded(prep.repair_input(d, "mean", bound).select("series_id", "t", "y"))


PERIODS_SQL = """
periods AS (SELECT user_id AS ticker, 'first' AS period_id, min(ts) AS start, min(ts) + INTERVAL 5 DAY AS "end" FROM events GROUP BY 1
  UNION ALL SELECT user_id, 'last', max(ts) - INTERVAL 3 DAY, max(ts) FROM events GROUP BY 1)"""


def period_table(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("ticker")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    first = g.select(F.lit("first").alias("period_id"), "ticker", F.col("a").alias("start"),
                     (F.col("a") + F.expr("interval 5 days")).alias("end"))
    last = g.select(F.lit("last").alias("period_id"), "ticker", (F.col("b") - F.expr("interval 3 days")).alias("start"),
                    F.col("b").alias("end"))
    return first.unionByName(last)


@query("slice_periods", f"""
WITH {PERIODS_SQL}
SELECT p.period_id, e.user_id AS series_id, e.event_id, {_r('e.value', 'price')}
FROM events e JOIN periods p ON e.user_id = p.ticker AND e.ts >= p.start AND e.ts < p."end" """)
def slice_periods(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", F.col("value").alias("price"))
    return rounded(prep.slice_periods(e, period_table(spark, sf)).select("period_id", "series_id", "event_id", "price"))


@query("concat_periods", f"""
WITH {PERIODS_SQL}, s AS (SELECT e.user_id || ':' || p.period_id AS series_id, e.ts, e.event_id, e.value AS v
FROM events e JOIN periods p ON e.user_id = p.ticker AND e.ts >= p.start AND e.ts < p."end"),
y AS (SELECT series_id, ln(v / lag(v) OVER (PARTITION BY series_id ORDER BY ts, event_id)) AS y FROM s WHERE v > 0)
SELECT series_id, count(y) AS n, {_r('sum(y)', 'sum_y')} FROM y GROUP BY 1""")
def concat_periods(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", F.col("value").alias("price"))
    p = period_table(spark, sf)
    parts = [prep.slice_periods(e, p.filter(F.col("period_id") == x)) for x in ("first", "last")]
    both = prep.concat_periods(parts)
    y = prep.price_returns(prep.index_prices(both, "series_id", ["ts", "event_id"], "price"))
    return rounded(y.groupBy("series_id").agg(F.count("y").alias("n"), F.sum("y").alias("sum_y")))


@query("drop_warmup", f"WITH {OBS} SELECT series_id, count(*) AS n, {_r('sum(y)', 'sum_y')} FROM obs WHERE t >= 10 GROUP BY 1")
def drop_warmup(spark, sf):
    return rounded(prep.drop_warmup(obs(spark, sf)[0], 10).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y")))


@query("bad_prices", "SELECT user_id, count(*) FILTER (value IS NULL OR isnan(value) OR value <= 0) AS bad_prices FROM events GROUP BY 1")
def bad_prices(spark, sf):
    return prep.bad_prices(table(spark, sf, "events"), "user_id", "value")


@query("status_names", """
SELECT code, n FROM (VALUES ('OK', 0), ('INPUT_EXTREME_VALUE', 0)) v(code, n) WHERE false
UNION ALL SELECT CASE WHEN abs(value) > 50 THEN 'VOL_EXTREME' WHEN value < 1 THEN 'ESS_LOW' ELSE 'OK' END, count(*) FROM events GROUP BY 1""")
def status_names(spark, sf):
    code = F.when(F.abs("value") > 50, 1001).when(F.col("value") < 1, 1000).otherwise(0)
    return table(spark, sf, "events").groupBy(fn.status_name(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("relative_spread", f"""
SELECT event_id, {_r('(ask - bid) / nullif((ask + bid) / 2, 0)', 'spread')}
FROM (SELECT event_id, value * 0.99 AS bid, value * (1 + event_id % 7 * 0.01) AS ask FROM events)""")
def relative_spread(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") * 0.99).alias("bid"),
                                          (F.col("value") * (1 + F.col("event_id") % 7 * 0.01)).alias("ask"))
    return rounded(e.select("event_id", prep.relative_spread().alias("spread")))


def _u_sql(*parts: str) -> str:
    text = "concat_ws('/', '7', " + ", ".join(parts) + ")"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / {float(1 << 52)!r})"


def _z_sql(*parts: str) -> str:
    return f"sqrt(-2 * ln({_u_sql(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {_u_sql(*parts, chr(39) + 'b' + chr(39))})"


_ID = ("user_id", "event_id")


@query("noise_columns", f"""
SELECT event_id, {_r(_u_sql(*_ID, "'u'"), 'u')}, {_r(_z_sql(*_ID, "'z'"), 'z')},
  {_r('(' + _z_sql(*_ID, "'z'") + ') * sqrt(5.0 / (' + ' + '.join('pow(' + _z_sql(*_ID, f"'c{j}'") + ', 2)' for j in range(5)) + ' + 1e-8))', 's')}
FROM events""")
def noise_columns(spark, sf):
    keys = (F.col("user_id"), F.col("event_id"))
    return rounded(table(spark, sf, "events").select(
        "event_id", fn.uniform_noise(7, *keys, F.lit("u")).alias("u"), fn.normal_noise(7, *keys, F.lit("z")).alias("z"),
        fn.student_noise(7, 5.0, *keys).alias("s")))


# returns with every kind of bad input, by event
BAD = OBS + """,
bad AS (SELECT series_id, t, tie, CASE WHEN tie % 7 = 0 THEN NULL WHEN tie % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN tie % 13 = 0 THEN CAST('infinity' AS DOUBLE)
               ELSE y END AS y, CASE WHEN tie % 17 = 0 THEN NULL WHEN tie % 19 = 0 THEN CAST('nan' AS DOUBLE) ELSE ln(y * y + 1e-8) END AS h FROM obs)
"""


def bad_inputs(spark, sf):
    o, bound = obs(spark, sf)
    tie = F.col("tie")
    y = F.when(tie % 7 == 0, None).when(tie % 11 == 0, float("nan")).when(tie % 13 == 0, float("inf")).otherwise(F.col("y"))
    h = F.when(tie % 17 == 0, None).when(tie % 19 == 0, float("nan")).otherwise(F.log(F.col("y") * F.col("y") + 1e-8))
    return o.select("series_id", "t", "tie", y.alias("y"), h.alias("h")), bound


def _nan_sql(expr: str, name: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'null' WHEN isnan({expr}) THEN 'nan' WHEN isinf({expr}) THEN 'inf' ELSE 'number' END AS {name}"


def _kind(c: str):
    x = F.col(c)
    return F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise("number").alias(f"{c}_kind")


_LOGPDF = "lgamma(3) - lgamma(2.5) - 0.5 * ln(pi() * 5) - 0.5 * h - 3 * ln(1 + y * y / (eh + 1e-8) / 5)"


@query("bad_input_density", f"""
WITH {BAD}, e AS (SELECT *, CASE WHEN h IS NULL OR isnan(h) THEN h ELSE exp(least(h, 20)) END AS eh FROM bad),
d AS (SELECT series_id, t, {_LOGPDF} AS lp, CASE WHEN y IS NULL OR isnan(y) THEN y ELSE greatest(ln(y * y + 1e-10) + 0.5, -5) END AS ih, eh FROM e)
SELECT series_id, t, {_nan_sql('lp', 'lp_kind')}, {_nan_sql('ih', 'ih_kind')}, {_nan_sql('eh', 'eh_kind')},
  {_r("CASE WHEN isnan(lp) OR isinf(lp) THEN NULL ELSE lp END", 'lp')}, {_r("CASE WHEN isnan(ih) OR isinf(ih) THEN NULL ELSE ih END", 'ih')},
  {_r("CASE WHEN isnan(eh) THEN NULL ELSE eh END", 'eh')} FROM d""")
def bad_input_density(spark, sf):
    """NULL, NaN and infinite returns and levels through the density, the implied level and the exponential."""
    d, _ = bad_inputs(spark, sf)
    d = d.select("series_id", "t", fn.t_logpdf("y", "h", F.lit(5.0), fn.t_log_norm(F.lit(5.0))).alias("lp"),
                 fn.implied_h("y", F.lit(0.5)).alias("ih"), fn.safe_exp("h").alias("eh"))
    plain = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in ("lp", "ih", "eh")]
    return rounded(d.select("series_id", "t", _kind("lp"), _kind("ih"), _kind("eh"), *plain))


@query("bad_prices_left_out", f"""
WITH b AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -value ELSE value END AS price FROM events),
o AS (SELECT user_id AS series_id, event_id, row_number() OVER w - 2 AS t, ln(price / lag(price) OVER w) AS y FROM b WHERE price > 0 AND NOT isnan(price) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT series_id, event_id, t, {_r('y')} FROM o WHERE t >= 0""")
def bad_prices_left_out(spark, sf):
    e = table(spark, sf, "events")
    n = F.col("event_id")
    price = F.when(n % 7 == 0, float("nan")).when(n % 11 == 0, None).when(n % 13 == 0, -F.col("value")).otherwise(F.col("value"))
    o = prep.observations(e.withColumn("value", price), "user_id", ["ts", "event_id"], "value")
    return rounded(o.select("series_id", F.col("tie").alias("event_id"), "t", "y"))


CONFIG_SQL = "(VALUES ('a', 0.98, 0.15), ('b', 0.95, 0.30), ('c', 0.90, 0.60)) c(config_id, rho, sigma_z)"
CONFIGS = [FilterConfig("a", rho=0.98, sigma_z=0.15), FilterConfig("b", rho=0.95, sigma_z=0.30), FilterConfig("c", rho=0.90, sigma_z=0.60)]


@query("with_configs", f"""
WITH {OBS}
SELECT series_id, config_id, count(*) AS n, {_r('sum(rho * y)', 'sum_rho_y')}, {_r('sum(sigma_z * y)', 'sum_sigma_y')}
FROM obs, {CONFIG_SQL} GROUP BY 1, 2""")
def configs_on_series(spark, sf):
    d = with_configs(obs(spark, sf)[0], CONFIGS, ["config_id", "rho", "sigma_z"])
    return rounded(d.groupBy("series_id", "config_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rho") * F.col("y")).alias("sum_rho_y"),
                                                           F.sum(F.col("sigma_z") * F.col("y")).alias("sum_sigma_y")))


@query("preset_levels", f"""
WITH {OBS}
SELECT series_id, config_id, {_r('sum(abs(y)) * sigma_z', 'moved')}
FROM obs, (VALUES ('default', 0.10), ('wrapper', 0.10), ('reactive', 0.18), ('inertial', 0.10), ('two_factor', 0.10), ('joint', 0.10),
  ('best', 0.10)) c(config_id, sigma_z) GROUP BY series_id, config_id, sigma_z""")
def preset_levels(spark, sf):
    d = with_configs(obs(spark, sf)[0], presets(), ["config_id", "sigma_z"])
    return rounded(d.groupBy("series_id", "config_id", "sigma_z").agg((F.sum(F.abs("y")) * F.col("sigma_z")).alias("moved")).drop("sigma_z"))


@query("asof_alignment", f"""
SELECT l.event_id, l.user_id AS series_id, {_r('r.value', 'signal')}
FROM (SELECT * FROM events WHERE event_type <> 'view') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r
  ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_alignment(spark, sf):
    e = table(spark, sf, "events")
    left = e.filter("event_type <> 'view'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'view'").select("user_id", "ts", "event_id", F.col("value").alias("signal"))
    out = windows.asof(left, right, ["user_id"], "ts", "event_id", ["signal"], group_bound(e, ["user_id"]))
    return rounded(out.select("event_id", F.col("user_id").alias("series_id"), "signal"))


@query("pareto_frontier", f"""
WITH m AS (SELECT user_id, round(avg(value), 2) AS cost, round(stddev_pop(value), 2) AS err FROM events GROUP BY 1)
SELECT user_id, {_r('cost')}, {_r('err')} FROM m WHERE NOT EXISTS (
  SELECT 1 FROM m o WHERE o.cost <= m.cost AND o.err <= m.err AND (o.cost < m.cost OR o.err < m.err))""")
def pareto_frontier(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 2).alias("cost"), F.round(F.stddev_pop("value"), 2).alias("err"))
    return rounded(windows.pareto(m, "cost", "err", ["user_id"]))


@query("preset_table", f"""
WITH {OBS}, l AS (SELECT series_id, 2 * ln(stddev_pop(y) + 1e-8) AS level FROM obs GROUP BY 1),
c AS (SELECT config_id, CAST(rho AS DOUBLE) AS rho, CAST(sg AS DOUBLE) AS sg FROM (VALUES ('default', 0.98, 0.10), ('wrapper', 0.98, 0.10), ('reactive', 0.92, 0.18),
  ('inertial', 0.98, 0.10), ('two_factor', 0.98, 0.10), ('joint', 0.98, 0.10), ('best', 0.98, 0.10)) v(config_id, rho, sg))
SELECT series_id, config_id, {_r('level - 2 * sqrt(sg * sg / (1 - rho * rho + 1e-6))', 'low')}, {_r('level + 2 * sqrt(sg * sg / (1 - rho * rho + 1e-6))', 'high')} FROM l, c""")
def preset_table(spark, sf):
    """Presets applied to the data: stationary spread of each preset around every series' own level."""
    mu = obs(spark, sf)[0].groupBy("series_id").agg((2 * F.log(F.stddev_pop("y") + 1e-8)).alias("level"))
    d = with_configs(mu, presets(), ["config_id", "rho", "sigma_z"])
    return rounded(d.select("series_id", "config_id", (F.col("level") - 2 * F.sqrt(fn.stationary_variance("rho", "sigma_z"))).alias("low"),
                            (F.col("level") + 2 * F.sqrt(fn.stationary_variance("rho", "sigma_z"))).alias("high")))
