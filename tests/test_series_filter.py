"""Filter runs over whole series against the table form of a tick, after losses, and on streams."""

import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_filter import BASE, ticks

from voltide.functions.config import FilterConfig
from voltide.plans import calibrate, cross_section, segments, series_filter
from voltide.streaming.filter_stream import FilterStream

YS = {1: [0.3, -1.2, 0.4, 2.0, -0.1, 0.2, 0.05], 2: [0.1, 0.05]}
EST = ["loglik_predictive", "loglik_filtered", "vol", "vol_std", "h_mean", "ess", "ksd", "bandwidth", "guide_mean", "guide_var", "stein_steps"]
PLAIN = replace(BASE, config_id="p", mim=False, guide=False, annealing=False, svld=False, n_particles=6, gamma=0.0, max_steps=1)


def rows(spark, ys=YS, gap=3):
    return spark.createDataFrame([(s, 5 + gap * t, float(y)) for s, v in ys.items() for t, y in enumerate(v)], "series_id long, t long, y double")


def by_tick(df):
    return {(r.series_id, r.t): r for r in df.collect()}


@pytest.mark.parametrize("extra", [
    dict(), dict(mim=False, guide=False, annealing=False, svld=False, t_state=True),
    dict(newton=True, full_newton=True, guided=True, adaptive_sigma=True, adaptive_guide=True, local_params=True, guided_threshold=0.1, max_steps=4),
])
def test_runs_are_the_ticks_of_the_table_form(spark, extra):
    cfg = replace(BASE, **extra)
    got = by_tick(series_filter.filter_series(rows(spark), cfg, seed=7, buckets=3, ticks=2))
    assert sorted(got) == [(s, t) for s in YS for t in range(len(YS[s]))]
    want = ticks(spark, {1: YS[1][:2], 2: YS[2]}, cfg, cross_section.hash_draws(7))
    for k, r in want.items():
        assert [got[k][c] for c in EST] == pytest.approx([r[c] for c in EST], rel=1e-9)


def test_a_lost_run_goes_on_and_ended_series_leave(spark, fresh):
    path = fresh + "/run"
    whole = by_tick(series_filter.filter_series(rows(spark), PLAIN, buckets=2, ticks=2, path=path))
    assert spark.read.parquet(f"{path}/step-1").select("series_id").distinct().count() == 1
    kept = spark.read.parquet(f"{path}/step-0").inputFiles()
    for k in (2, 3):
        shutil.rmtree(f"{path}/step-{k}")  # as after a loss, also one in the middle of a write
    again = by_tick(series_filter.filter_series(rows(spark), PLAIN, buckets=2, ticks=2, path=path))
    assert {k: tuple(r) for k, r in again.items()} == {k: tuple(r) for k, r in whole.items()}
    assert spark.read.parquet(f"{path}/step-0").inputFiles() == kept
    with pytest.raises(ValueError):
        series_filter.filter_series(rows(spark), replace(PLAIN, rho=0.5), buckets=2, ticks=2, path=path)


def test_options_of_runs(spark):
    """Adaptive level, Heun moves, smoothing and particles run over all ticks; an empty table gives an empty one."""
    cfg = replace(BASE, heun=True, adaptive_mu=True, smoothing=True, newton=True, max_steps=2, n_particles=6, mu_max=1.0)
    ys = {1: [0.3 * (-1) ** k * (1 + k % 4) for k in range(14)]}
    d = by_tick(series_filter.filter_series(rows(spark, ys), cfg, buckets=2, emit_particles=True))
    assert len(d) == 14 and all(len(r.h) == len(r.log_w) == 6 and np.isfinite(r.h_smoothed) for r in d.values())
    mus = [d[1, t].mu_state for t in range(14)]
    assert mus[:12] == [-1.0] * 12 and mus[12] != -1.0
    # the twelfth tick's level: one Kalman step from its mean and bandwidth
    e = d[1, 11]
    k = (1 + cfg.mu_process_var) / (1 + cfg.mu_process_var + cfg.mu_obs_scale * e.bandwidth**2 + 1e-8)
    assert mus[12] == pytest.approx(min(max(-1.0 + k * (e.h_mean + 1.0), cfg.mu_min), cfg.mu_max))
    assert series_filter.filter_series(rows(spark, {1: []}), PLAIN).count() == 0


def test_antithetic_draws(spark):
    draw = series_filter.antithetic(cross_section.hash_draws(3), 8)
    d = spark.range(8).select(F.col("id").alias("i"), F.lit(1).alias("series_id"), F.lit(0).alias("t"))
    r = d.select("i", draw("state").alias("z"), draw("jump", 0, 0, True).alias("u")).orderBy("i").collect()
    for k in range(4):
        assert r[k].z == -r[k + 4].z and r[k].u + r[k + 4].u == pytest.approx(1.0)


def test_segments_against_a_loop(spark):
    ys = {1: list(range(23)), 2: list(range(4)), 3: list(range(12))}
    got = {}
    for r in segments.segment_rows(rows(spark, ys), 10, 4, 3).collect():
        got.setdefault((r.series, r.segment), []).append((r.t, r.y, r.own))
    want = {}
    for s, y in ys.items():
        for g in range(0, len(y), 10):
            own = y[g : g + 10]
            if len(own) >= 3:
                halo = y[max(0, g - 4) : g]
                want[s, g // 10] = [(k, float(v), k >= len(halo)) for k, v in enumerate(halo + own)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_ascent_goes_on_after_a_loss_and_settled_series_stay(spark, fresh):
    theta = spark.createDataFrame([(1, 3.0, -1.2, -0.5), (2, 3.0, -1.2, -0.5)], "series_id long, rho_u double, sigma_u double, mu double")
    path = fresh + "/ascent"
    run = lambda n, **k: {r.series_id: tuple(r) for r in calibrate.ascend(rows(spark), theta, PLAIN, n, 0.05, 0.05, buckets=2, **k).collect()}
    two = run(2, path=path)
    assert two[1][-1] == two[2][-1] == 2
    shutil.rmtree(f"{path}/epoch-1")
    assert run(2, path=path) == two
    still = run(2, settled=10.0)
    assert still[1][-1] == 1 and still[1][:4] == run(1)[1][:4]


def test_stream_of_batches_is_the_run(spark, fresh):
    """Three micro-batches, one of them repeated; health and particles are there, particles only of the last two batches."""
    d = rows(spark).select("series_id", F.timestamp_seconds("t").alias("ts"), F.lit(0).alias("tie"), "y", "t")
    f = FilterStream(fresh + "/stream", PLAIN, ticks=2, health_every=2, keep_particles=True, retain=2)
    for k, (low, high) in enumerate(((0, 9), (9, 15), (15, 99))):
        part = d.where((F.col("t") >= low) & (F.col("t") < high)).drop("t")
        f.process(part, k)
        f.process(part, k)
    got, want = by_tick(f.read(spark)), by_tick(series_filter.filter_series(rows(spark), PLAIN, buckets=2))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert [got[k][c] for c in EST] == pytest.approx([r[c] for c in EST], rel=1e-9)
    health = {(r.series_id, r.t): r for r in f.read(spark, "health").collect()}
    assert sorted(health) == [(1, 0), (1, 2), (1, 4), (1, 6), (2, 0)] and all(r.n == 6 and r.n_nan == 0 for r in health.values())
    assert {r.t for r in f.read(spark, "particles").select("t").distinct().collect()} == {2, 3, 4, 5, 6}
    assert {r.series_id: r.t for r in f.read(spark, "state").collect()} == {1: 7, 2: 2}


def test_the_version_of_a_long_batch_reads_every_step_once(spark, fresh, monkeypatch):
    """Eight steps in one batch: each series' state is that of its last step, and the plan grows with the steps, not with their power."""
    from voltide.streaming import filter_stream

    ys = {1: [0.1] * 8, 2: [0.1] * 3}
    monkeypatch.setattr(filter_stream, "advance", lambda state, now, tick, ticks: state.select(*filter_stream.STATE).join(now.select("series_id"), "series_id").withColumn(
        "t", F.col("t") + 1).withColumn("ests", F.expr("array(struct(t as t))")))
    f = FilterStream(fresh + "/stream", PLAIN, ticks=1)
    f.process(rows(spark, ys).select("series_id", F.timestamp_seconds("t").alias("ts"), F.lit(0).alias("tie"), "y"), 0)
    d = f.read(spark, "state")
    assert {r.series_id: r.t for r in d.collect()} == {1: 8, 2: 3}
    assert len(d.inputFiles()) <= 8


def test_configurations_of_a_series_share_its_draws(spark, monkeypatch):
    """Draws that no state decides on are made on the rows of the series, before they meet its configurations."""
    cfg = replace(BASE, n_particles=6, max_steps=2)
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plans, write = [], series_filter._bucketed
    monkeypatch.setattr(series_filter, "_bucketed", lambda df, path, n: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, path, n))
    levels = {"a": 0.0, "b": -1.0}
    theta = spark.createDataFrame([(s, c, 0.9, 0.2, mu) for s in YS for c, mu in levels.items()], "series_id long, config_id string, rho double, sigma_z double, mu double")
    both = series_filter.filter_series(rows(spark), cfg, theta, seed=3, buckets=2, ticks=2)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    above, below = zip(*[p.split("Join Inner", 1) for p in plans[1:]])
    assert not any("state:0:0" in x for x in above) and all("state:0:0" in x for x in below)
    got = {(r.series_id, r.config_id, r.t): r.vol for r in both.collect()}
    assert len(got) == 18
    for c, mu in levels.items():
        one = series_filter.filter_series(rows(spark), replace(cfg, rho=0.9, sigma_z=0.2, mu=mu), seed=3, buckets=2, ticks=2)
        assert {k[::2]: v for k, v in got.items() if k[1] == c} == pytest.approx({(r.series_id, r.t): r.vol for r in one.collect()}, rel=1e-12)


@pytest.mark.parametrize("shared", [False, True])
def test_a_run_has_few_steps_and_their_length_changes_nothing(spark, shared):
    """Seventy ticks are two steps where no length is given; so the tables are few, and the rows are those of shorter steps."""
    ys = {1: [0.3 * (-1) ** k * (1 + k % 4) for k in range(70)], 2: [0.1, -0.4, 0.2]}
    cfg = replace(BASE, n_particles=4, max_steps=1, annealing=False)
    theta = spark.createDataFrame([(s, c, 0.9, 0.2, mu) for s in ys for c, mu in (("a", 0.0), ("b", -1.0))], "series_id long, config_id string, rho double, sigma_z double, mu double") if shared else None
    tables = series_filter.run_filter(rows(spark, ys), cfg, theta, buckets=2)
    assert len(tables) == 2
    est = lambda d: {(r.series_id, r.config_id, r.t): [r[c] for c in EST] for r in d.collect()}
    got = est(series_filter.filter_series(rows(spark, ys), cfg, theta, buckets=2))
    want = est(series_filter.filter_series(rows(spark, ys), cfg, theta, buckets=2, ticks=24))
    assert len(got) == 73 * (2 if shared else 1) and got.keys() == want.keys()
    for k, x in want.items():
        assert got[k] == pytest.approx(x, rel=1e-12)


def test_steps_of_large_sets_hold_few_draws_and_particles(spark):
    """A row has the draws of its own returns only, and a step is the shorter the more a tick holds."""
    tick = lambda n, particles=False: series_filter.run_tick(replace(PLAIN, n_particles=n), 3, particles)
    assert [series_filter.step_ticks(*x) for x in ((tick(16),), (tick(512),), (tick(16), True), (tick(32), True), (tick(512), True), (tick(16, True),), (tick(512, True),))] == [64, 64, 64, 32, 4, 32, 4]
    ys = spark.createDataFrame([(1, 0, [0.1, 0.2, 0.3]), (2, 0, [0.1])], "series_id long, step int, ys array<double>")
    d = series_filter.with_draws(ys, PLAIN, tick(6).draws, 3)
    assert {r.series_id: len(r.draws) for r in d.collect()} == {1: 18, 2: 6}


def test_segments_of_a_run_are_one_step(spark, monkeypatch):
    """Segments of 30 ticks and 10 of burn-in are written once, whatever the length of their series."""
    paths, write = [], series_filter._bucketed
    monkeypatch.setattr(series_filter, "_bucketed", lambda df, path, n: paths.append(path) or write(df, path, n))
    got = segments.predictive_nll(rows(spark, {1: [0.1 * (-1) ** k for k in range(75)]}), PLAIN, 30, 10, 10, buckets=2).collect()
    assert [(r.n_segments, r.n_scored, r.n_left_out) for r in got] == [(3, 65, 10)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["ys", "step-0"]
