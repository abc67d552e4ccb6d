"""The table form of the filter over several ticks: mixture, annealing, rejuvenation, draws and restarts."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.functions.config import FilterConfig
from voltide.plans import cross_section
from voltide.session import cut_lineage

BASE = FilterConfig("x", mu=-1.0, sigma_z=0.3, rho=0.95, gamma=0.01, n_particles=8, exact_gradient=True, min_steps=1, max_steps=2)


def ticks(spark, ys, cfg, draw, partitions=None):
    """Estimates of every tick, by (series, t)."""
    state = cross_section.start_state(spark.createDataFrame([(i,) for i in ys], "series_id long"), cfg, draw)
    out = {}
    for t in range(len(next(iter(ys.values())))):
        obs = spark.createDataFrame([(i, float(y[t])) for i, y in ys.items()], "series_id long, y double")
        if partitions:
            state = (state[0].repartition(partitions), state[1])
        p, s, est = cross_section.filter_tick(*state, obs, cfg, draw)
        state = (p, s)
        out |= {(r.series_id, r.t): r for r in est.collect()}
    return out


@pytest.mark.parametrize("extra", [
    dict(mim=False, guide=False, annealing=False, svld=False),
    dict(newton=True, full_newton=True, guided=True, adaptive_sigma=True, adaptive_guide=True, local_params=True, guided_threshold=0.1, rejuvenation=True),
])
def test_results_do_not_depend_on_partitions_or_other_series(spark, extra):
    cfg, draw = replace(BASE, **extra), cross_section.hash_draws(7)
    ys = {1: [0.3, -1.2], 2: [0.1, 0.05]}
    a, b = ticks(spark, ys, cfg, draw), ticks(spark, {1: ys[1]}, cfg, draw, 5)
    assert set(a) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    for k, r in b.items():
        for c in ("loglik_predictive", "loglik_filtered", "vol", "h_mean", "ess"):
            assert a[k][c] == pytest.approx(r[c], rel=1e-9)
    for r in a.values():
        assert 0.999 <= r.ess <= 8.001 and r.vol > 0 and r.ksd >= 0


def test_predictive_likelihood_of_the_first_tick(spark):
    """Without guide, mixture and annealing the first tick's prediction is AR(1) from the start set: stated in Python."""
    cfg = replace(BASE, mim=False, guide=False, annealing=False, svld=False, gamma=0.0)
    got = ticks(spark, {3: [0.4]}, cfg, cross_section.zero_draws())[(3, 0)]
    norm = math.lgamma((cfg.nu + 1) / 2) - math.lgamma(cfg.nu / 2) - 0.5 * math.log(math.pi * cfg.nu)
    want = norm - 0.5 * cfg.mu - (cfg.nu + 1) / 2 * math.log1p(0.16 / (math.exp(cfg.mu) + 1e-8) / cfg.nu)
    assert got.loglik_predictive == pytest.approx(want, rel=1e-6)


def test_level_follows_the_returns(spark):
    """Large returns raise the level, small ones lower it."""
    cfg = replace(BASE, n_particles=32, min_steps=2, max_steps=3)
    out = ticks(spark, {1: [2.0, -2.5, 2.2], 2: [0.01, -0.02, 0.01]}, cfg, cross_section.hash_draws(1))
    assert out[(1, 2)].h_mean > out[(2, 2)].h_mean + 0.3


def test_uniform_draws_are_even(spark):
    from voltide.functions import columns as fn

    u = np.array([r[0] for r in spark.range(20_000).select(fn.uniform_noise(5, F.col("id"))).collect()])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003


def test_tables_of_a_tick_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Files of constant columns are far smaller than their rows: the planner takes them for small tables."""
    plans = []
    monkeypatch.setattr(cross_section, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut_lineage(df))
    s = spark.range(3).select(F.col("id").alias("series_id"), F.lit(0.1).alias("y"))
    s.write.parquet(str(tmp_path / "y"))
    y = spark.read.parquet(str(tmp_path / "y"))
    draw = cross_section.zero_draws()
    cross_section.filter_tick(*cross_section.start_state(y.select("series_id"), BASE, draw), y, BASE, draw)
    assert plans
    for plan in plans:
        assert all("strategy=merge" in line for line in plan.splitlines() if "Join Inner" in line), plan


@pytest.mark.parametrize("extra", [
    dict(mim=False, guide=False, annealing=False, svld=False, n_particles=5),
    dict(newton=True, full_newton=True, guided=True, adaptive_sigma=True, adaptive_guide=True, local_params=True, guided_threshold=0.1, max_steps=4),
])
def test_a_tick_of_sets_is_that_of_the_particle_table_and_writes_nothing(spark, monkeypatch, extra):
    cfg, draw = replace(BASE, **extra), cross_section.hash_draws(7)
    ys = {k: [0.4 * math.sin(k), 1.3 * math.cos(k)] for k in range(40)}
    want = ticks(spark, ys, cfg, draw)

    def written(df):
        raise AssertionError("a tick of sets writes no table")

    monkeypatch.setattr(cross_section, "cut_lineage", written)
    state = cross_section.start_state(spark.createDataFrame([(i,) for i in ys], "series_id long"), cfg, draw, sets=True)
    got = {}
    for t in range(2):
        p, s, est = cross_section.filter_tick(*state, spark.createDataFrame([(i, float(y[t])) for i, y in ys.items()], "series_id long, y double"), cfg, draw)
        state = p, s
        got |= {(r.series_id, r.t): r for r in est.collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert [got[k][c] for c in r.asDict()] == pytest.approx(list(r), rel=1e-9)


def test_a_tick_of_sets_takes_draws_by_hash(spark):
    with pytest.raises(ValueError):
        d = spark.createDataFrame([(1, 0.1)], "series_id long, y double")
        cross_section.filter_tick(*cross_section.start_state(d, BASE, cross_section.zero_draws(), sets=True), d, BASE, cross_section.zero_draws())


@pytest.mark.parametrize("odd", [[], [(7, 0.0), (7, 1.5), (9, math.inf), (11, 1e200), (None, 0.2)]])
def test_first_ticks_of_repeated_series_and_infinite_returns(spark, odd):
    """What sets don't cover runs as before, and the other series are not touched by it."""
    from voltide.catalog.filters import PLAIN, first_ticks

    d = spark.createDataFrame([(i, 0.3 * math.sin(i)) for i in range(20)] + odd, "series_id long, y double")
    draw = cross_section.hash_draws(42)
    want = cross_section.filter_tick(*cross_section.start_state(d.select("series_id").distinct(), PLAIN, draw), d, PLAIN, draw)[2]
    cols = want.columns
    rows = lambda df: sorted(([r[c] for c in cols] for r in df.collect()), key=str)
    got, want = rows(first_ticks(d, PLAIN)), rows(want)
    assert len(got) == len(want) >= 20
    for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0])):
        for x, y in zip(a, b):
            assert x == y or x == pytest.approx(y, rel=1e-9, nan_ok=True)


def test_the_tick_query_has_the_librarys_particles_and_moves(spark, sf, monkeypatch):
    """512 particles and twelve moves, some in each annealing stage; a row for every observation."""
    from voltide.catalog import filters, registry

    seen, tick = [], cross_section.filter_tick
    monkeypatch.setattr(cross_section, "filter_tick", lambda *args: seen.append(args[3]) or tick(*args))
    rows = filters.filter_tick(spark, sf).select("stein_steps", "ess").collect()
    default = FilterConfig()
    assert [(c.n_particles, c.min_steps, c.max_steps) for c in seen] == [(default.n_particles, default.min_steps, default.max_steps)]
    assert all(k > 0 for k in cross_section.stage_plan(seen[0])) and {r.stein_steps for r in rows} == {12}
    assert len(rows) == registry.obs(spark, sf)[0].count() and max(r.ess for r in rows) > 16


def test_first_ticks_apart_are_those_of_single_rows(spark):
    """Rows of one series have the ticks that each would have alone."""
    from voltide.catalog.filters import PLAIN, first_ticks

    d = spark.createDataFrame([(1, 0.4), (1, -0.9), (1, 0.4), (2, 0.1), (None, 0.2)], "series_id long, y double")
    got = sorted(tuple(r) for r in first_ticks(d, PLAIN, apart=True).collect())
    want = [tuple(first_ticks(spark.createDataFrame([row], d.schema), PLAIN).first()) for row in [(1, 0.4), (1, -0.9), (1, 0.4), (2, 0.1)]]
    assert got == sorted(want)
