"""Blocks of sets in numpy: draws against the column form, moves against loops over pairs, and the plan of a step."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_filter import BASE
from test_series_filter import YS, rows

from voltide.plans import cross_section, series_filter, set_ticks
from voltide.plans.set_ticks import Draws


@pytest.mark.parametrize("mirrored", [False, True])
def test_draws_are_those_of_the_column_form(spark, mirrored):
    """Also of names whose text is longer than one block of the hash."""
    names = ["1", "-22", "7:12", "x" * 30, "y" * 90]
    draw = series_filter.antithetic(cross_section.hash_draws(3), 5) if mirrored else cross_section.hash_draws(3)
    d = spark.createDataFrame([(s, t) for s in names for t in (0, 17)], "series_id string, t long").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    got = {(r.series_id, r.t, r.i): (r.z, r.u) for r in d.select("series_id", "t", "i", draw("move", 1, 2).alias("z"), draw("jump", 0, 0, True).alias("u")).collect()}
    draws = Draws(3, 5, mirrored)
    heads = draws.heads([s for s in names for _ in range(2)], np.array([0, 17] * len(names)))
    z, u = draws.normal(heads, "move:1:2"), draws.uniform(heads, "jump:0:0")
    for k, (s, t) in enumerate((s, t) for s in names for t in (0, 17)):
        for i in range(5):
            assert (z[k, i], u[k, i]) == pytest.approx(got[s, t, i], rel=1e-13)


@pytest.mark.parametrize("extra", [dict(), dict(newton=True), dict(newton=True, full_newton=True), dict(paper_sign=True)])
def test_sums_over_pairs_against_loops(extra):
    """Tiles of sets and of a set's particles give what a loop over all pairs gives."""
    cfg, rng = replace(BASE, **extra), np.random.default_rng(5)
    h, m, y, sigma, width = rng.normal(-1, 1, (3, 9)), rng.normal(-1, 1, (3, 9)), rng.normal(size=(3, 1)), np.full((3, 1), 0.3), np.array([[0.2], [0.5], [0.05]])
    whole = []
    for pairs in (27, 200, 1 << 15):
        set_ticks.PAIRS, before = pairs, set_ticks.PAIRS
        try:
            score, curv, _ = set_ticks._scored(h, m, y, sigma, np.ones((3, 1)), cfg)
            whole.append((score, *set_ticks._direction(h, score, curv, width, cfg, True)))
        finally:
            set_ticks.PAIRS = before
    for got in whole[1:]:
        for a, b in zip(got, whole[0]):
            assert a == pytest.approx(b, rel=1e-12)
    score, phi, total = whole[0]
    for s in range(3):
        b2, parts = width[s, 0] ** 2, 0.0
        for i in range(9):
            d = h[s, i] - h[s]
            k = 1 / (1 + d * d / b2)
            g = 2 / b2 * d * k * k
            sign = 1.0 if cfg.paper_sign else -1.0
            want = (k * score[s] + sign * g).sum() / 9
            if cfg.full_newton:
                want = want / np.clip(((k * curv[s]) + 2 / b2 * k * k * np.abs(3 * d * d / b2 - 1)).sum() / k.sum(), 0.1, 100) * 0.7
            elif cfg.newton:
                want = (k * 0.7 * score[s] / curv[s] + sign * g / curv[s]).sum() / 9
            assert phi[s, i] == pytest.approx(want, rel=1e-9, abs=1e-12)
            parts += (score[s, i] * k * score[s] + score[s, i] * g - g * score[s] + 2 / b2 * k * k * (1 - 4 * d * d / b2 * k)).sum()
        assert total[s] == pytest.approx(parts, rel=1e-9)


def test_the_plan_of_a_step_does_not_grow_with_its_ticks(spark, monkeypatch):
    """A step is a join and one pass of its rows, however many ticks it has; no tick is written out as expressions."""
    plans, write = [], series_filter._bucketed
    monkeypatch.setattr(series_filter, "_bucketed", lambda df, path, n: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, path, n))
    sizes = []
    for ticks in (1, 4):
        plans.clear()
        series_filter.run_filter(rows(spark, {1: YS[1]}), replace(BASE, n_particles=4, max_steps=1), buckets=2, ticks=ticks, most_steps=2)
        sizes.append(len(plans[2].splitlines()))
        assert "lambda" not in plans[2] and plans[2].count("MapInArrow") == 1
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("spread", [0.1, 1.0, 5.0])
def test_near_means_are_all_that_count_in_a_large_set(spread):
    """The score of a set of 200 against the sum over all of its prior means."""
    rng = np.random.default_rng(7)
    h, m, sigma = rng.normal(-2, 2 * spread, (2, 200)), rng.normal(-2, spread, (2, 200)), np.array([[0.1], [0.3]])
    got, _ = set_ticks._prior(h, m, sigma, BASE)
    d = h[:, :, None] - m[:, None, :]
    e = -0.5 * (d / sigma[:, :, None]) ** 2
    w = np.exp(e - e.max(2, keepdims=True))
    want = -(w * d).sum(2) / sigma**2 / (w.sum(2) + 1e-8)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("extra", [dict(), dict(newton=True), dict(newton=True, full_newton=True), dict(paper_sign=True, ksd_compat=True), dict(heun=True, newton=True)])
@pytest.mark.parametrize("spread", [0.05, 1.0, 6.0])
def test_cells_of_large_sets_sum_all_pairs(extra, spread):
    """Directions and discrepancies of sets of 300 by cells are those from all of their pairs; one of the sets has places far out."""
    cfg, rng = replace(BASE, **extra), np.random.default_rng(9)
    h = rng.normal(-2, spread, (3, 300))
    h[1, :3] += [40, -70, 3]
    score, curv, width = rng.normal(0, 4, h.shape), rng.uniform(0.1, 50, h.shape), np.array([[0.5], [0.8], [1.1]]) * max(spread, 0.1)
    phi, total = set_ticks._direction(h, score, curv, width, cfg, True)
    want, sums = set_ticks._direction_by_pairs(h, (h - h.mean(1, keepdims=True)) / width, score, curv, width, cfg, True)
    assert phi == pytest.approx(want, rel=1e-10, abs=1e-11)
    assert total == pytest.approx(sums, rel=1e-10)
    assert set_ticks._direction(h, score, curv, width, cfg, False)[0] == pytest.approx(want, rel=1e-10, abs=1e-11)


def test_large_sets_make_no_number_for_each_pair(monkeypatch):
    """A tick of sets of 512 goes by cells only, and gives what their pairs give."""
    cfg, rng = replace(BASE, n_particles=512, max_steps=3), np.random.default_rng(4)
    h, m, y, sigma, width = rng.normal(-1, 0.6, (4, 512)), rng.normal(-1, 0.5, (4, 512)), rng.normal(size=4), np.full(4, 0.3), np.full(4, 0.4)
    args = h, np.zeros_like(h), m, None, y, sigma, width, np.full((4, 1), 0.7), np.array([[3], [1], [2], [3]]), cfg
    monkeypatch.setattr(set_ticks, "LARGE", 10**6)
    want = set_ticks.move_sets(*args)
    monkeypatch.setattr(set_ticks, "LARGE", 128)

    def by_pair(*_):
        raise AssertionError("a large set is not taken pair by pair")

    monkeypatch.setattr(set_ticks, "_tiles", by_pair)
    for a, b in zip(set_ticks.move_sets(*args), want):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-11)


def test_means_far_from_a_place_of_a_large_set():
    """Places beyond all means, and sets so scattered that they leave the cells, against the sum over all means."""
    rng = np.random.default_rng(8)
    m = rng.normal(-2, 0.3, (3, 150))
    m[2, :2] = [-14, 4.5]
    h, sigma = m + rng.normal(0, 0.2, m.shape), np.array([[0.1], [0.3], [0.02]])
    h[:, 0], h[:, 1] = 5, -15
    got, _ = set_ticks._prior(h, m, sigma, BASE)
    d = h[:, :, None] - m[:, None, :]
    e = -0.5 * (d / sigma[:, :, None]) ** 2
    w = np.exp(e - e.max(2, keepdims=True))
    assert got == pytest.approx(-(w * d).sum(2) / sigma**2 / (w.sum(2) + 1e-8), rel=1e-9, abs=1e-9)
