"""Queries: particle-filter jobs, two scales, calibration, streams. Filter outputs are stochastic by design (hash
draws), so those without a SQL twin are checked in tests against the table form and by invariants."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from voltide.catalog.returns import OFF5
from voltide.catalog.registry import EV, OBS, estimates, obs, query, rounded
from voltide.catalog.returns import _r, nu_score, nu_score_sql
from voltide.functions.config import FilterConfig, log_norm, presets, stationary_var
from voltide.operators import stats
from voltide.plans import calibrate, cross_section, evaluate, multiscale
from voltide.session import cut_lineage, scratch_table
from voltide.streaming.filter_stream import run_arrivals

SMALL = FilterConfig("one", mu=-0.5, sigma_z=0.3, rho=0.95, n_particles=64, newton=True, full_newton=True, exact_gradient=True,
                     lik_offset=0.35, min_steps=4, max_steps=8)
PRESET = {c.config_id: c for c in presets()}


def series(spark, sf):
    o, bound = obs(spark, sf)
    return o.select("series_id", "t", "y"), bound


def levels(o):
    """Every series' own level as mu."""
    return stats.estimate_mu(o, ["series_id"])


def first_ticks(o, cfg, apart=False):
    """Estimates of one tick of every series in o (series_id, y), each from the stationary level, in one pass over sets. Series
    whose return has no finite square are ticked as a particle table, and so are those that come more than once, with all their
    rows in one set; ``apart``: each of these rows has a tick of its own."""
    draw = cross_section.hash_draws(42)
    o = cut_lineage(o)  # read by the joins of the tick
    finite = F.coalesce(F.col("y") * F.col("y") < float("inf"), F.lit(False))
    odd = cut_lineage(o.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("finite")).where("NOT finite" if apart else "n > 1 OR NOT finite").select("series_id")).hint("merge")
    some = not odd.isEmpty()
    sets = o.join(odd, "series_id", "left_anti") if some else o
    est = cross_section.filter_tick(*cross_section.start_state(sets.select("series_id"), cfg, draw, sets=True), sets, cfg, draw)[2]
    if not some:
        return est
    rows = o.join(odd, "series_id", "left_semi")
    return est.unionByName(cross_section.filter_tick(*cross_section.start_state(rows.select("series_id").distinct(), cfg, draw), rows, cfg, draw)[2])


@query("filter_tick")
def filter_tick(spark, sf):
    """One tick of the filter for every observation, each from the stationary level, with the library's own particles and moves."""
    o, _ = obs(spark, sf)
    whole = PRESET["default"]
    cfg = replace(SMALL, n_particles=whole.n_particles, min_steps=whole.min_steps, max_steps=whole.max_steps)
    return rounded(first_ticks(o.select(F.col("tie").alias("series_id"), "y"), cfg, apart=True))


PLAIN = replace(SMALL, config_id="plain", n_particles=16, min_steps=1, max_steps=1, mim=False, guided=False, guide=False, annealing=False, svld=False,
                adaptive_sigma=False, adaptive_guide=False)


def _draw_sql(role: str, t: int) -> str:
    u, v = (f"((('0x' || substr(md5(concat_ws('/', '42', series_id, '{t}', i, '{role}:0:0', '{x}')), 1, 13))::BIGINT + 0.5) / {float(1 << 52)!r})" for x in "ab")
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


_H = "greatest(-15.0, least(5.0, {}))".format
_START = _H(f"{PLAIN.mu} + {stationary_var(PLAIN) ** 0.5!r} * {_draw_sql('init', -1)}")
_NEXT = _H(f"{PLAIN.mu} + {PLAIN.rho} * (h0 - ({PLAIN.mu})) + {PLAIN.sigma_z} * {_draw_sql('state', 0)}")


@query("filter_prediction", f"""
WITH {OBS}, s AS (SELECT tie AS series_id, y, CAST(range AS INT) AS i FROM obs, range({PLAIN.n_particles})),
a AS (SELECT *, {_START} AS h0 FROM s), b AS (SELECT *, {_NEXT} AS h FROM a),
l AS (SELECT series_id, {log_norm(PLAIN.nu)!r} - 0.5 * h - {(PLAIN.nu + 1) / 2} * ln(1 + y * y / (exp(h) + 1e-8) / {PLAIN.nu}) AS lw FROM b),
m AS (SELECT series_id, max(lw) AS top FROM l GROUP BY 1)
SELECT series_id, {_r('max(top) + ln(greatest(avg(exp(lw - top)), 1e-10))', 'loglik_predictive')}, 1 AS stein_steps FROM l JOIN m USING (series_id) GROUP BY 1""")
def filter_prediction(spark, sf):
    """Start sets, state draws and the prediction of one tick for every observation."""
    o, _ = obs(spark, sf)
    est = first_ticks(o.select(F.col("tie").alias("series_id"), "y"), PLAIN)
    return rounded(est.select("series_id", "loglik_predictive", "stein_steps"))


SCALES = EV + f""",
ms AS (SELECT series_id, t, y, vol / 50 AS f, vol_true / 50 AS s, h_est AS hf, h_true AS hs, lag(vol_true / 50, 1, 0.01) OVER (PARTITION BY series_id ORDER BY t) AS vp FROM ev)"""


def scales(spark, sf):
    e, bound = estimates(spark, sf)
    fast = e.select("series_id", "t", (F.col("vol") / 50).alias("vol"), F.col("h_est").alias("h_mean"))
    slow = e.select("series_id", "t", (F.col("vol_true") / 50).alias("vol"), F.col("h_true").alias("h_mean"))
    return multiscale.multiscale(fast, slow, e, bound=bound)


@query("multiscale", f"""
WITH {SCALES} SELECT series_id, t, {_r('s', 'vol_combined')}, {_r('hs', 'h_combined')}, {_r('f - s', 'transient_magnitude')}, {_r('f / greatest(s, 1e-8)', 'transient_ratio')},
  {_r('abs(y) / greatest(vp, 1e-6)', 'surprise')}, f > 0.02 AND f / greatest(s, 1e-8) > 1.3 AND s < 0.02 AS is_transient, f > 0.02 AND s > 0.02 AS is_regime_shift,
  f < 0.02 AND s < 0.02 AS is_calm FROM ms""")
def multiscale_query(spark, sf):
    return rounded(scales(spark, sf).select("series_id", "t", "vol_combined", "h_combined", "transient_magnitude", "transient_ratio", "surprise",
                                            "is_transient", "is_regime_shift", "is_calm"))


@query("vol_for_purpose", f"""
WITH {SCALES} SELECT series_id, t, {_r('0.7 * f + 0.3 * s', 'execution')}, {_r('0.2 * f + 0.8 * s', 'position')}, {_r('greatest(f, s)', 'conservative')} FROM ms""")
def vol_for_purpose(spark, sf):
    return rounded(scales(spark, sf).select("series_id", "t", *[multiscale.vol_for(x).alias(x) for x in ("execution", "position", "conservative")]))


GRID = (3.0, 5.0, 10.0, 30.0)


@query("score_sweep", f"""
WITH {EV}, g AS ({' UNION ALL '.join(f"SELECT series_id, {v} AS value, avg({nu_score_sql(v, h='h_est')}) AS g FROM ev GROUP BY 1" for v in GRID)}),
l AS (SELECT series_id, CAST(value AS DOUBLE) AS value, g, lag(g) OVER w AS pg, lag(value) OVER w AS pv FROM g WINDOW w AS (PARTITION BY series_id ORDER BY value)),
c AS (SELECT *, CASE WHEN pg > 0 AND g < 0 THEN CAST((pv + value) / 2 AS DOUBLE) END AS x FROM l)
SELECT series_id, value, {_r('g', 'mean_grad')}, CASE WHEN g > 0.001 THEN 'increase' WHEN g < -0.001 THEN 'decrease' ELSE 'equilibrium' END AS direction,
  {_r('last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 'equilibrium')} FROM c""")
def score_sweep(spark, sf):
    e, _ = estimates(spark, sf)
    d = e.select("*", F.explode(F.array(*[F.lit(v) for v in GRID])).alias("value")).withColumn("g", nu_score("value", "y", "h_est"))
    s = d.groupBy("series_id", "value").agg(F.avg("g").alias("mean_grad"))
    return rounded(calibrate.sweep_table(s, ["series_id"], 0.001).select("series_id", "value", "mean_grad", "direction", "equilibrium"))


def start_theta(o):
    return levels(o).select("series_id", F.lit(3.0).alias("rho_u"), F.lit(-1.2).alias("sigma_u"), "mu")


def _adam_sql() -> str:
    prev = "SELECT series_id, mu AS x, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v, g FROM gr"
    for k in (1, 2, 3):
        m, v = f"(0.9 * m + 0.1 * g * {k})", f"(0.999 * v + 0.001 * g * {k} * g * {k})"
        prev = (f"SELECT series_id, x + greatest(-0.5, least(0.5, 0.1 * ({m} / (1 - pow(0.9, {k}))) / (sqrt({v} / (1 - pow(0.999, {k}))) + 1e-8))) AS x, "
                f"{m} AS m, {v} AS v, g FROM ({prev})")
    return prev


@query("adam_updates", f"""
WITH {OBS}, gr AS (SELECT series_id, 2 * ln(stddev_pop(y) + 1e-8) AS mu, avg(y) AS g FROM obs GROUP BY 1)
SELECT series_id, {_r('x', 'mu')}, {_r('m', 'm_mu')}, {_r('v', 'v_mu')} FROM ({_adam_sql()})""")
def adam_updates(spark, sf):
    o, _ = series(spark, sf)
    g = o.groupBy("series_id").agg(F.avg("y").alias("g_mu"))
    state = calibrate.adam_start(start_theta(o))
    for k in (1, 2, 3):
        grad = g.select("series_id", (F.col("g_mu") * k).alias("g_mu"), F.lit(0.0).alias("g_rho_u"), F.lit(0.0).alias("g_sigma_u"))
        state = calibrate.adam_step(state, grad, k, 0.1)
    return rounded(state.select("series_id", "mu", "m_mu", "v_mu"))


# --- streams: the observations as a file stream; a control row far ahead moves the watermark past the last tick ----------

def utc_instant(c):
    """The instant whose UTC reading is the zone-free time in column ``c``, in any session zone."""
    return F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())


def utc_reading(c):
    return F.to_utc_timestamp(F.col(c), F.current_timezone()).cast("timestamp_ntz")


SIGNALS = FilterConfig("s", rho=0.95, sigma_z=0.3, mu=-0.5)


def stream_of(spark, sf):
    o, _ = obs(spark, sf)
    path = scratch_table(spark, "stream")
    src = o.select("series_id", utc_instant("ts").alias("ts"), "tie", "y", F.lit("obs").alias("kind"))
    src.write.parquet(path)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("series_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("tie"),
                                F.lit(None).cast("double").alias("y"), F.lit("params").alias("kind"))
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(src.schema).parquet(path)


def drain(df, label: str):
    """Run an append stream over everything available into a table of the shared folder and read it back."""
    spark, name = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    out = scratch_table(spark, label)
    try:  # map state and timers need this provider
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(out)


@query("stream_windowed_vol", f"""
WITH {OBS}
SELECT series_id, time_bucket(INTERVAL 1 DAY, ts) AS start, {_r('sqrt(avg(y * y))', 'realised_vol')}, {_r('2 * ln(sqrt(avg(y * y)) + 1e-8)', 'mu_level')}, count(*) AS n
FROM obs GROUP BY 1, 2""")
def stream_windowed_vol(spark, sf):
    from voltide.streaming.processor import windowed_vol

    return rounded(drain(windowed_vol(stream_of(spark, sf).filter("kind = 'obs' or series_id = -1"), "40 days", "1 day"), "winvol").filter("series_id >= 0")
                   .select("series_id", utc_reading("start").alias("start"), "realised_vol", "mu_level", "n"))


@query("stream_checked", f"WITH {OBS} SELECT CAST(CASE WHEN abs(y) > 0.5 THEN 302 ELSE 0 END AS INT) AS status, count(*) AS n FROM obs GROUP BY 1")
def stream_checked(spark, sf):
    from voltide.streaming.processor import checked

    out = drain(checked(stream_of(spark, sf).filter("kind = 'obs'")), "checked")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("stream_signals", f"""
WITH RECURSIVE {OBS}, ob AS (SELECT series_id, t, y, ln(y * y + 1e-8) + {OFF5} AS z FROM obs),
rec AS (
  SELECT series_id, t, y, m, p, e, 0.9 + 0.1 * q AS zq, CAST(1.0 AS DOUBLE) AS boost, CASE WHEN q > 9 THEN 1 ELSE 0 END AS s, CASE WHEN q > 9 THEN 0 ELSE 1 END AS n FROM
   (SELECT *, pow(y / (exp(m / 2) + 1e-8), 2) AS q FROM
    (SELECT series_id, t, y, -0.5 + k * (z + 0.5) AS m, (1 - k) * pp AS p, abs(y) AS e FROM
     (SELECT *, pp / (pp + 6.93 + 1e-8) AS k FROM (SELECT *, 0.95 * 0.95 * (0.09 / (1 - 0.95 * 0.95)) + 0.09 AS pp FROM ob WHERE t = 0))))
  UNION ALL
  SELECT series_id, t, y, m, p, e, zq, boost, s2, CASE WHEN s2 <> s OR (s = 2 AND s2 = 1) THEN 0 ELSE n + 1 END FROM
   (SELECT *, CASE s WHEN 0 THEN (CASE WHEN q > 9 THEN 1 ELSE 0 END) WHEN 1 THEN (CASE WHEN n + 1 >= 20 THEN 2 ELSE 1 END)
      ELSE (CASE WHEN q > 9 THEN 1 WHEN n + 1 >= 50 AND q < 4 THEN 0 ELSE 2 END) END AS s2, 0.9 * pz + 0.1 * q AS zq FROM
    (SELECT *, pow(y / (exp(m / 2) + 1e-8), 2) AS q, CASE WHEN rz > {SIGNALS.sigma_threshold} THEN 1 + {SIGNALS.sigma_boost_max - 1} * least((rz - {SIGNALS.sigma_threshold}) / 3, 1.0) ELSE 1.0 END AS boost FROM
     (SELECT series_id, t, y, mp + k * (z - mp) AS m, (1 - k) * pp AS p, CASE WHEN e > 0 THEN 0.05 * ay + 0.95 * e ELSE ay END AS e, pz, s, n,
             ay / greatest(exp(pm / 2), 1e-4) AS rz FROM
      (SELECT *, pp / (pp + 6.93 + 1e-8) AS k FROM
       (SELECT ob.series_id, ob.t, ob.y, ob.z, abs(ob.y) AS ay, rec.e, rec.m AS pm, rec.zq AS pz, rec.s, rec.n,
               -0.5 + 0.95 * (rec.m + 0.5) AS mp, 0.95 * 0.95 * rec.p + 0.09 AS pp
        FROM rec JOIN ob ON ob.series_id = rec.series_id AND ob.t = rec.t + 1))))))
SELECT series_id, t, {_r('m', 'guide_mean')}, {_r('p', 'guide_var')}, {_r('e', 'ret_ema')}, {_r('zq', 'z_sq_ema')}, {_r('boost', 'sigma_boost')},
  CAST(s AS INT) AS shock_state FROM rec""")
def stream_signals(spark, sf):
    from voltide.streaming.processor import SignalProcessor, run_stream

    out = drain(run_stream(stream_of(spark, sf), SignalProcessor(SIGNALS), "40 days"), "signals")
    return rounded(out.select("series_id", "t", "guide_mean", "guide_var", "ret_ema", "z_sq_ema", "sigma_boost", F.col("shock_state").cast("int").alias("shock_state")))


@query("stream_sliding_vol", f"""
WITH {OBS}, w AS (SELECT series_id, y, time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY AS start FROM obs, range(7) r(k))
SELECT series_id, start, {_r('sqrt(avg(y * y))', 'realised_vol')}, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding_vol(spark, sf):
    from voltide.streaming.processor import windowed_vol

    return rounded(drain(windowed_vol(stream_of(spark, sf), "40 days", "7 days", "1 day"), "slidevol").filter("series_id >= 0")
                   .select("series_id", utc_reading("start").alias("start"), "realised_vol", "n"))


# --- control rows and late rows: files that arrive one after another --------------------------------------------------------

def drain_arrivals(spark, parts, transform, label: str):
    """Run an append stream over tables that arrive one after another and read its output."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before, out, schema = spark.conf.get(name), scratch_table(spark, label), []

    def start(stream, log):
        df = transform(stream)
        schema[:] = [df.schema]
        return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()

    try:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        run_arrivals(spark, parts, start, label)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(schema[0]).parquet(out)


CONTROL = ["series_id", "ts", "tie", "y", "kind", "signal", "rho"]


def _control(df, kind, at, signal=None, rho=None):
    """Control rows one millisecond before the instant in column ``at``."""
    null = F.lit(None).cast("double")
    return df.select("series_id", (F.col(at) - F.expr("interval 1 millisecond")).alias("ts"), F.lit(0).cast("long").alias("tie"), null.alias("y"),
                     F.lit(kind).alias("kind"), (null if signal is None else signal.cast("double")).alias("signal"), (null if rho is None else F.lit(rho)).alias("rho"))


def _far(spark, day):
    d = spark.range(1).select(F.lit(-1).cast("long").alias("series_id"), F.lit(day).cast("timestamp").alias("at"))
    return _control(d, "params", "at")


def controlled(spark, sf):
    o, _ = obs(spark, sf)
    d = o.select("series_id", utc_instant("ts").alias("ts"), "tie", "y", "t", F.lit("obs").alias("kind"), F.lit(None).cast("double").alias("signal"),
                 F.lit(None).cast("double").alias("rho"))
    at = d.groupBy("series_id").agg(*[F.max(F.when(F.col("t") == k, F.col("ts"))).alias(f"at{k}") for k in (3, 5, 10)])
    return d, at


@query("stream_controls", f"""
WITH RECURSIVE {OBS}, a AS (SELECT series_id, max(ts) FILTER (t = 3) AS a3, max(ts) FILTER (t = 5) AS a5, max(ts) FILTER (t = 10) AS a10 FROM obs GROUP BY 1),
ob AS (SELECT o.series_id, o.t, ln(o.y * o.y + 1e-8) + {OFF5} AS z, CASE WHEN o.ts >= a5 THEN 0.5 ELSE 0.95 END AS rho, o.ts >= a10 AS later, o.ts >= a3 AS told FROM obs o JOIN a USING (series_id)),
rs AS (SELECT *, later AND NOT coalesce(lag(later) OVER (PARTITION BY series_id ORDER BY t), false) AS fresh, sum(CASE WHEN later THEN 0 ELSE 1 END) OVER (PARTITION BY series_id) AS n0 FROM ob),
rec AS (
  SELECT series_id, t, -0.5 + k * (z + 0.5) AS m, (1 - k) * pp AS p, later, told, n0 FROM
    (SELECT *, pp / (pp + 6.93 + 1e-8) AS k FROM (SELECT *, rho * rho * (0.09 / (1 - rho * rho)) + 0.09 AS pp FROM rs WHERE t = 0))
  UNION ALL
  SELECT series_id, t, mp + k * (z - mp), (1 - k) * pp, later, told, n0 FROM
    (SELECT *, pp / (pp + 6.93 + 1e-8) AS k FROM
      (SELECT rs.series_id, rs.t, rs.z, rs.later, rs.told, rs.n0, CASE WHEN rs.fresh THEN -0.5 ELSE -0.5 + rs.rho * (rec.m + 0.5) END AS mp,
              rs.rho * rs.rho * (CASE WHEN rs.fresh THEN 0.09 / (1 - rs.rho * rs.rho) ELSE rec.p END) + 0.09 AS pp
       FROM rec JOIN rs ON rs.series_id = rec.series_id AND rs.t = rec.t + 1)))
SELECT series_id, CASE WHEN later THEN t - CAST(n0 AS BIGINT) ELSE t END AS t, later, {_r('m', 'guide_mean')}, {_r('p', 'guide_var')},
  CASE WHEN told AND NOT later THEN CAST(series_id AS DOUBLE) END AS signal FROM rec""")
def stream_controls(spark, sf):
    """A slow signal, a change of rho and a reset in the middle of every series; arrival in shuffled order."""
    from voltide.streaming.processor import SignalProcessor, run_stream

    d, at = controlled(spark, sf)
    some = lambda k: at.filter(F.col(f"at{k}").isNotNull())
    ctl = _control(some(3), "signal", "at3", signal=F.col("series_id")).union(_control(some(5), "params", "at5", rho=0.5)).union(_control(some(10), "reset", "at10"))
    parts = [d.filter("tie % 2 = 0").select(*CONTROL), ctl.select(*CONTROL), d.filter("tie % 2 = 1").select(*CONTROL), _far(spark, "2100-01-01"), _far(spark, "2100-01-02")]
    out = drain_arrivals(spark, parts, lambda s: run_stream(s, SignalProcessor(SIGNALS), "40 days"), "controls").filter("series_id >= 0")
    out = out.join(at.select("series_id", "at10"), "series_id").withColumn("later", F.coalesce(F.col("ts") >= F.col("at10"), F.lit(False)))
    return rounded(out.select("series_id", "t", "later", "guide_mean", "guide_var", "signal"))


@query("stream_late_rows", f"""
WITH {OBS}
SELECT series_id, tie, CASE WHEN tie % 10 = 0 THEN 321 WHEN abs(y) > 0.5 THEN 302 ELSE 0 END AS status,
  CASE WHEN tie % 10 = 0 THEN -1 ELSE row_number() OVER (PARTITION BY series_id, tie % 10 = 0 ORDER BY ts, tie) - 1 END AS t FROM obs""")
def stream_late_rows(spark, sf):
    """A tenth of the rows arrives when the watermark is past them: they come out marked late and move nothing."""
    from voltide.streaming.processor import SignalProcessor, run_stream

    d, _ = controlled(spark, sf)
    d = d.select(*CONTROL, F.col("tie").alias("_tie"))
    on_time, late = (d.filter(c).select(*CONTROL) for c in ("_tie % 10 <> 0", "_tie % 10 = 0"))
    parts = [on_time, _far(spark, "2100-01-01"), _far(spark, "2100-01-02"), late]
    out = drain_arrivals(spark, parts, lambda s: run_stream(s, SignalProcessor(SIGNALS), "40 days"), "late").filter("series_id >= 0")
    return out.select("series_id", "tie", F.col("status").cast("int").alias("status"), "t")
