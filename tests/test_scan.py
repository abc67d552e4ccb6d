"""Recursions cut into small pieces against plain Python loops."""

import math

from conftest import skewed
from pyspark.sql import functions as F

from voltide.functions.config import OBS_VAR, FilterConfig, implied_offset
from voltide.operators import folds, scan

import pytest


def by_series(df, *cols):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.series_id, r.t)):
        out.setdefault(r.series_id, []).append(tuple(r[c] for c in cols))
    return out


@pytest.fixture
def data(spark):
    d = skewed(spark)
    return d, {k: [x[0] for x in v] for k, v in by_series(d, "y").items()}


@pytest.mark.parametrize("piece", [512, 5])
def test_ekf(data, piece, monkeypatch):
    d, ys = data
    patch(monkeypatch, piece)
    d = d.withColumns({"rho": F.lit(0.97), "sigma_z": F.lit(0.2), "mu": F.lit(-0.7), "offset": F.lit(implied_offset(5.0))})
    got = by_series(folds.ekf_logvol(d), "guide_mean", "guide_var")
    for s, y in ys.items():
        m, p = -0.7, 0.04 / (1 - 0.97**2)
        for k, v in enumerate(y):
            mp, pp = -0.7 + 0.97 * (m + 0.7), 0.97**2 * p + 0.04
            g = pp / (pp + OBS_VAR + 1e-8)
            m, p = mp + g * (math.log(v * v + 1e-8) + implied_offset(5.0) - mp), (1 - g) * pp
            assert got[s][k] == pytest.approx((m, p), rel=1e-9, abs=1e-10)


def patch(monkeypatch, piece):
    real, real_s = scan.prefix_maps, scan.state_scan
    monkeypatch.setattr(folds, "prefix_maps", lambda *a, **k: real(*a[:7], **{**k, "piece": piece}))
    monkeypatch.setattr(folds, "dense_rows", lambda df, keys, t, bound, _: scan.dense_rows(df, keys, t, bound, piece))
    monkeypatch.setattr(folds, "state_scan", lambda *a, **k: real_s(*a[:9], **{**k, "piece": piece}))


@pytest.mark.parametrize("piece", [512, 4])
def test_adaptive_mu_clamped(data, piece, monkeypatch):
    d, ys = data
    patch(monkeypatch, piece)
    e = d.withColumn("h_mean", 3 * F.col("y")).withColumn("bandwidth", 0.05 + F.abs("y") / 5)
    got = by_series(folds.adaptive_mu(e, -0.2, 0.05, 1.0, -0.5, 0.4), "mu_state", "mu_var")
    for s, y in ys.items():
        m, v = -0.2, 1.0
        for k, x in enumerate(y):
            if k > 10:
                pp, r = v + 0.05, (0.05 + abs(x) / 5) ** 2 + 1e-8
                g = pp / (pp + r)
                m, v = min(max(m + g * (3 * x - m), -0.5), 0.4), (1 - g) * pp
            assert got[s][k] == pytest.approx((m, v), rel=1e-9, abs=1e-10)


@pytest.mark.parametrize("piece", [512, 4])
def test_shock_state(data, piece, monkeypatch):
    d, ys = data
    patch(monkeypatch, piece)
    got = by_series(folds.shock_state(d.withColumn("z_sq", 4 * F.col("y") * F.col("y")), shock_ticks=3, recovery_ticks=6), "shock_state")
    for s, y in ys.items():
        state = n = 0
        for k, x in enumerate(y):
            z, n = 4 * x * x, n + 1
            nxt = state
            if state == 0 and z > 9:
                nxt = 1
            elif state == 1 and n >= 3:
                nxt = 2
            elif state == 2:
                nxt = 1 if z > 9 else 0 if n >= 6 and z < 4 else 2
            if nxt != state:
                n = 0
            state = nxt
            assert got[s][k][0] == state


@pytest.mark.parametrize("piece", [512, 4])
def test_bandwidth_and_ema(data, piece, monkeypatch):
    d, ys = data
    patch(monkeypatch, piece)
    e = d.withColumn("var", 0.02 + F.col("y") * F.col("y") / 50).withColumn("spread", 0.3 + F.abs("y"))
    got = by_series(folds.bandwidth_fold(e, 64), "ret_ema", "bandwidth_sq")
    for s, y in ys.items():
        ema, q = 0.0, 0.0
        for k, x in enumerate(y):
            raw = max(2 * (0.02 + x * x / 50) / math.log(65), 1e-6)
            q = 0.3 * raw + 0.7 * q if q > 0 else raw
            ema = 0.05 * abs(x) + 0.95 * ema if ema > 0 else abs(x)
            big = max(abs(x) / max(ema, 1e-8), min((0.3 + abs(x)) / 2, 2.0))
            q *= max(min(1 - 0.25 * min(big - 1, 2.0), 1.0), 0.5)
            assert got[s][k] == pytest.approx((ema, q), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("piece", [512, 6])
def test_two_factor(data, piece, monkeypatch):
    d, ys = data
    patch(monkeypatch, piece)
    c = FilterConfig("x", model="two_factor", mu=-0.4)
    got = by_series(folds.ekf_two_factor(d, c), "guide_fast", "guide_slow", "var_fast")
    for s, y in ys.items():
        f = w = 0.0
        pf, ps = c.sigma_fast**2 / (1 - c.rho_fast**2), c.sigma_slow**2 / (1 - c.rho_slow**2)
        for k, x in enumerate(y):
            fp, sp = c.rho_fast * f, c.rho_slow * w
            af, as_ = c.rho_fast**2 * pf + c.sigma_fast**2, c.rho_slow**2 * ps + c.sigma_slow**2
            tot = af + as_ + OBS_VAR + 1e-8
            inn = math.log(x * x + 1e-8) + implied_offset(5.0) - (c.mu + fp + sp)
            f, w = fp + af / tot * inn, sp + as_ / tot * inn
            pf, ps = max((1 - af / tot) * af, 1e-6), max((1 - as_ / tot) * as_, 1e-6)
            assert got[s][k] == pytest.approx((f, w, pf), rel=1e-9, abs=1e-10)


@pytest.mark.parametrize("lag,out", [(3, 1), (5, 4), (8, 3), (2, 5)])
def test_smoother_replays_ring_buffer(data, lag, out):
    d, ys = data
    e = d.withColumn("h_mean", F.col("y")).withColumn("h_var", 0.05 + F.abs("y") / 10)
    got = by_series(folds.smooth_fixed_lag(e, 0.95, 0.2, -0.3, lag, out), "h_smoothed")
    for s, y in ys.items():
        h, v = [], []
        for t, x in enumerate(y):
            h.append(x)
            v.append(0.05 + abs(x) / 10)
            want = x
            if t >= lag:
                for j in range(1, lag):
                    c, n = t - j, t - j + 1
                    g = 0.95 * v[c] / (0.95**2 * v[c] + 0.04 + 1e-8)
                    h[c] += g * (h[n] - (-0.3 + 0.95 * (h[c] + 0.3)))
                    v[c] *= 1 - g * 0.95
                want = h[t - min(out, lag - 1)]
            assert got[s][t][0] == pytest.approx(want, rel=1e-9, abs=1e-11)


@pytest.mark.parametrize("piece", [512, 7, 3])
def test_series_that_start_late_and_have_gaps(spark, piece):
    """t from 10 on, with holes longer than a piece: the carry comes from the piece that exists before."""
    ts = [10, 11, 12, 19, 40, 41, 300, 301, 1000]
    d = spark.createDataFrame([(s, t, 0.1 * (s + 1) * (i + 1)) for s in (0, 1) for i, t in enumerate(ts)], "series_id long, t long, y double")
    got = by_series(folds.ema(d, F.col("y"), 0.2, "e", 1.0, piece=piece), "e")
    states = by_series(folds.shock_state(d.withColumn("z_sq", F.col("y") * 20), shock_ticks=2, recovery_ticks=3, piece=piece), "shock_state")
    plain = by_series(folds.shock_state(d.withColumn("z_sq", F.col("y") * 20), shock_ticks=2, recovery_ticks=3, piece=10_000), "shock_state")
    for s in (0, 1):
        x = 1.0
        for i in range(len(ts)):
            x = 0.8 * x + 0.2 * 0.1 * (s + 1) * (i + 1)
            assert got[s][i][0] == pytest.approx(x, rel=1e-12)
    assert states == plain


def test_smoothing_lag_has_no_limit(spark):
    d = spark.createDataFrame([(0, t, float(t % 5), 0.1) for t in range(40)], "series_id long, t long, h_mean double, h_var double")
    a = by_series(folds.smooth_fixed_lag(d, 0.9, 0.3, 0.0, 12, 10), "h_smoothed")[0]
    assert [x[0] for x in a[:12]] == [float(t % 5) for t in range(12)] and a[20] != a[19]
