"""Queries that take the other branch of operators with a size check, at limits far below the data, and proofs of parts that
no other query reaches."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from voltide.catalog.particle_sets import K, PAIR, SETS, _cl, sets
from voltide.catalog.registry import EV, OBS, estimates, obs, query, rounded, table
from voltide.catalog.returns import PERIODS_SQL, _r, period_table
from voltide.functions.config import presets, with_configs
from voltide.operators import layout, particles as pt, prep, stats, windows
from voltide.plans import evaluate
from voltide.session import group_bound, scratch_table
from voltide.sources import files

LIMIT = 48  # rows a group may have before it is split
BLOCK = 16  # particles in a block of a split set


@query("split_positions", """
WITH p AS (SELECT user_id, event_id, ts, value, row_number() OVER w - 1 AS t, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS gap
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, lag(value, 2) OVER w AS back, lead(value) OVER w AS ahead, last_value(gap IGNORE NULLS) OVER r AS known, min(value) OVER r AS low
      FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t), r AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, t, round(back, 6) + 0 AS back, round(ahead, 6) + 0 AS ahead, round(known, 6) + 0 AS known, round(low, 6) + 0 AS low FROM q""")
def split_positions(spark, sf):
    """Positions, look-back and look-ahead, forward fill and running minimum of groups that are split."""
    k = ["user_id"]
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("known"))
    bound = group_bound(e, k)
    d = layout.rank_rows(e, k, ["ts", "event_id"], bound=bound, limit=LIMIT)
    d = layout.over_time(d, k, {"back": lambda w: F.lag("value", 2).over(w), "ahead": lambda w: F.lead("value").over(w)}, back=2, ahead=1, bound=bound, limit=LIMIT)
    d = layout.last_known(d, k, ["known"], bound=bound, limit=LIMIT)
    d = layout.running_min(d, k, "value", "low", "t", strict=False, bound=bound, limit=LIMIT)
    return rounded(d.select("user_id", "event_id", "t", "back", "ahead", "known", "low"))


@query("split_percentiles", f"""
WITH {OBS}, r AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY y, t) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM obs)
SELECT series_id, {_r('avg(y)', 'mean')}, {_r('stddev_pop(y)', 'std')}, {_r('min(y)', 'min')}, {_r('max(y)', 'max')},
  {', '.join(_r(f"max(CASE WHEN k = least(CAST(floor({q} * n) AS BIGINT), n - 1) THEN y END)", c) for c, q in (('p50', 0.5), ('p90', 0.9), ('p99', 0.99), ('p999', 0.999)))}
FROM r GROUP BY 1""")
def split_percentiles(spark, sf):
    return rounded(stats.percentiles(obs(spark, sf)[0].select("series_id", "t", "y"), ["series_id"], "y", ["t"], limit=LIMIT))


@query("split_periods", f"""
WITH {PERIODS_SQL}
SELECT p.period_id, e.user_id AS series_id, e.event_id, {_r('e.value', 'price')}
FROM events e JOIN periods p ON e.user_id = p.ticker AND e.ts >= p.start AND e.ts < p."end" """)
def split_periods(spark, sf):
    """Period slicing by months; periods that end before they start have no rows."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", F.col("value").alias("price"))
    p = period_table(spark, sf)
    turned = p.select(F.lit("turned").alias("period_id"), "ticker", F.col("end").alias("start"), F.col("start").alias("end"))
    return rounded(prep.slice_periods(e, p.unionByName(turned), limit=0).select("period_id", "series_id", "event_id", "price"))


@query("split_pair_sets", f"""
WITH {PAIR}, t AS (SELECT set_id, i, max(-e * e / 0.045) AS top FROM pr GROUP BY 1, 2)
SELECT set_id, i, {_r('-sum(exp(-e * e / 0.045 - top) * e) / 0.0225 / (sum(exp(-e * e / 0.045 - top)) + 1e-8)', 'g_prior')}
FROM pr JOIN t USING (set_id, i) GROUP BY 1, 2""")
def split_pair_sets(spark, sf):
    p = sets(spark, sf).withColumn("sigma", F.lit(0.15))
    return rounded(pt.grad_prior_gauss(p, K, block=BLOCK).select("set_id", "i", "g_prior"))


@query("split_bandwidth_median", f"""
WITH {SETS}, d AS (SELECT a.set_id, abs(a.h - b.h) AS d FROM ps a JOIN ps b ON a.set_id = b.set_id),
r AS (SELECT set_id, d, row_number() OVER (PARTITION BY set_id ORDER BY d) - 1 AS rk FROM d),
q AS (SELECT set_id, max(CASE WHEN rk = 3072 THEN d END) AS d FROM r GROUP BY 1)
SELECT set_id, {_r(_cl(_cl('d', 0.01, 10.0) + ' / ln(65)', 0.01, 10.0), 'bandwidth')} FROM q""")
def split_bandwidth_median(spark, sf):
    return rounded(pt.bandwidth_median(sets(spark, sf), K, rounds=4, block=BLOCK))


@query("far_neighbours", f"""
WITH {SETS}, d AS (SELECT a.set_id, a.i, abs(a.h - b.h) AS d, row_number() OVER (PARTITION BY a.set_id, a.i ORDER BY abs(a.h - b.h)) AS rk
  FROM (SELECT set_id % 50 AS set_id, set_id * 64 + i AS i, h FROM ps) a JOIN (SELECT set_id % 50 AS set_id, set_id * 64 + i AS i, h FROM ps) b ON a.set_id = b.set_id AND a.i <> b.i)
SELECT set_id, i, {_r('d', 'knn')} FROM d WHERE rk = 100""")
def far_neighbours(spark, sf):
    """The 100th nearest particle in sets of several hundred."""
    d = sets(spark, sf).select((F.col("set_id") % 50).alias("set_id"), (F.col("set_id") * 64 + F.col("i")).alias("i"), "h")
    return rounded(pt.knn_distance(d, K, 100).select("set_id", "i", "knn"))


@query("datasets_of_files", f"""
WITH d AS (SELECT event_type AS dataset, CAST(ts AS DATE) AS day, round(avg(value), 10) AS price FROM events GROUP BY 1, 2),
y AS (SELECT dataset, price, ln(price / lag(price) OVER (PARTITION BY dataset ORDER BY day)) AS y FROM d)
SELECT dataset, count(*) AS n_rows, {_r('sum(price)', 'sum_price')}, {_r('sum(y)', 'sum_y')} FROM y GROUP BY 1""")
def datasets_of_files(spark, sf):
    """Several market files at once, each its own dataset by its name; a folder per event type holds one of them."""
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("dataset"), F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("price"))
    path = scratch_table(spark, "datasets")
    line = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), F.format_string("%.10f", "price"), F.lit(""), F.lit(""))
    head = d.select("dataset").distinct().select("dataset", F.lit(0).alias("k"), F.lit("date,price,return,log_return").alias("line"))
    rows = head.unionByName(d.select("dataset", F.lit(1).alias("k"), line.alias("line"))).repartition("dataset").sortWithinPartitions("dataset", "k", "line")
    rows.select("line", F.col("dataset").alias("name")).write.partitionBy("name").text(path)
    names = [r["dataset"] for r in head.select("dataset").collect()]
    back = files.read_market_csv(spark, [f"{path}/name={n}" for n in names], by="folder")
    back = back.withColumn("dataset", F.regexp_replace("dataset", "^name=", ""))
    p = prep.price_returns(prep.index_prices(back, "dataset", ["date"], "price"))
    return rounded(p.groupBy(F.col("series_id").alias("dataset")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("price").alias("sum_price"), F.sum("y").alias("sum_y")))


PRESET_FIELDS = [f for f, v in asdict(presets()[0]).items() if isinstance(v, (bool, int, float))]


def _preset_sql() -> str:
    """The documented values of the presets, field by field, where they differ from the library default."""
    base = {f: v for f, v in asdict(presets()[0]).items() if f in PRESET_FIELDS}
    shared = dict(nu=30.0, lik_offset=0.345, temperature=0.45, n_anneal=5, jump_prob=0.25, jump_scale=9.0, rejuv_ksd=0.05, newton=True, full_newton=True,
                  exact_gradient=True, min_steps=8, max_steps=16, guided=True, guided_shock=0.40, adaptive_guide=True, adaptive_mu=True, mu_obs_scale=11.0,
                  mu_min=-4.0, adaptive_sigma=True, sigma_threshold=0.95, sigma_boost_max=3.2)
    other = {
        "default": {}, "wrapper": shared,
        "reactive": dict(rho=0.92, sigma_z=0.18, rho_up=0.94, rho_down=0.88, jump_prob=0.30, jump_scale=10.0, guide=False, temperature=0.55, annealing=False,
                         n_anneal=1, exact_gradient=True, lik_offset=0.35, min_steps=2, max_steps=5, n_particles=256, n_stein_steps=3, delta_rho=0.0, delta_sigma=0.0),
        "inertial": shared | dict(nu=5.0, lik_offset=0.35, n_anneal=3, n_particles=1024, n_stein_steps=8, rejuv_ksd=0.30),
        "two_factor": {}, "joint": dict(nu=30.0, lik_offset=0.10),
        "best": dict(nu=30.0, rho_up=0.99, rho_down=0.92, guided=True, adaptive_mu=True, mu_obs_scale=11.5, mu_min=-4.0, adaptive_guide=True, lik_offset=0.70, adaptive_sigma=True),
    }
    rows = [f"('{n}', '{f}', CAST({float((base | o)[f])!r} AS DOUBLE))" for n, o in other.items() for f in PRESET_FIELDS]
    return ", ".join(rows)


@query("preset_fields", f"""
WITH {OBS}, l AS (SELECT series_id, avg(abs(y)) AS a FROM obs GROUP BY 1), c AS (SELECT * FROM (VALUES {_preset_sql()}) v(config_id, field, x))
SELECT series_id, config_id, count(*) AS n_fields, {_r('sum(a * x * (ascii(field) + length(field)))', 'moved')} FROM l, c GROUP BY 1, 2""")
def preset_fields(spark, sf):
    """Every numeric and boolean field of every preset, weighted by its name, on every series."""
    a = obs(spark, sf)[0].groupBy("series_id").agg(F.avg(F.abs("y")).alias("a"))
    d = with_configs(a, presets(), ["config_id", *PRESET_FIELDS])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in PRESET_FIELDS])
    d = d.select("series_id", "a", "config_id", F.inline(cells))
    return rounded(d.groupBy("series_id", "config_id").agg(
        F.count(F.lit(1)).alias("n_fields"), F.sum(F.col("a") * F.col("x") * (F.ascii("field") + F.length("field"))).alias("moved")))


@query("series_segments", f"""
WITH {EV}, n AS (SELECT series_id, max(t) + 1 AS n FROM ev GROUP BY 1)
SELECT series_id, CASE WHEN t >= 2 * (n // 3) THEN 2 WHEN t >= n // 3 THEN 1 END AS segment_id, {_r('avg(vol)', 'mean_vol')}, count(*) AS n FROM ev JOIN n USING (series_id) GROUP BY 1, 2""")
def series_segments(spark, sf):
    """Segments that start at each series' own ticks; ticks before the first start have none."""
    e, bound = estimates(spark, sf)
    size = e.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    third = F.floor(F.col("n") / 3)
    starts = size.select("series_id", F.inline(F.array(*[F.struct((third * k).cast("long").alias("start"), F.lit(k).alias("segment_id"), F.lit(f"part {k}").alias("segment_name")) for k in (1, 2)])))
    d = windows.segment_of(e.select("series_id", "t", "vol"), starts)
    return rounded(stats.segment_vol(d, ["series_id"]))


@query("run_coverage", f"""
WITH {EV}, e AS (SELECT series_id, t, h_est, h_true FROM ev WHERE t >= 5),
p AS (SELECT series_id, t, h_true, range AS i, h_est + (range - 9.5) / 10 AS h FROM e, range(20)),
q AS (SELECT series_id, t, max(h_true) AS x, max(CASE WHEN i = 5 THEN h END) AS l50, max(CASE WHEN i = 15 THEN h END) AS h50, max(CASE WHEN i = 1 THEN h END) AS l90,
  max(CASE WHEN i = 19 THEN h END) AS h90, max(CASE WHEN i = 0 THEN h END) AS l95, max(CASE WHEN i = 19 THEN h END) AS h95 FROM p GROUP BY 1, 2),
c AS (SELECT series_id, avg(CASE WHEN x BETWEEN l50 AND h50 THEN 1.0 ELSE 0.0 END) AS c50, avg(CASE WHEN x BETWEEN l90 AND h90 THEN 1.0 ELSE 0.0 END) AS c90,
  avg(CASE WHEN x BETWEEN l95 AND h95 THEN 1.0 ELSE 0.0 END) AS c95 FROM q GROUP BY 1)
SELECT c.series_id, {_r('sqrt(avg((h_est - h_true) * (h_est - h_true)))', 'rmse_h')}, {_r('max(c50)', 'coverage_50')}, {_r('max(c90)', 'coverage_90')}, {_r('max(c95)', 'coverage_95')}
FROM c JOIN e USING (series_id) GROUP BY 1""")
def run_coverage(spark, sf):
    """Interval coverage as part of the run metrics: twenty particles around every estimate."""
    e, bound = estimates(spark, sf)
    est = e.select("series_id", "t", F.col("h_est").alias("h_mean"), "vol", "loglik", (1 / (1 + F.col("y") * F.col("y"))).alias("ess_ratio"))
    p = e.select("series_id", "t", "h_est", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    p = p.select("series_id", "t", "i", (F.col("h_est") + (F.col("i") - 9.5) / 10).alias("h"))
    m = evaluate.run_metrics(est, e.select("series_id", "t", "h_true", "vol_true"), ["series_id"], warmup=5, particles=p, bound=bound)
    return rounded(m.select("series_id", "rmse_h", "coverage_50", "coverage_90", "coverage_95"))
