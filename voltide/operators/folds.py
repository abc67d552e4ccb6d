"""Recursions over time. Each is stated as a per-tick map from a family closed under composition (see ``scan``), so
one series can be split over many tasks and the result stays exact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.functions.config import OBS_VAR, FilterConfig, implied_offset
from voltide.operators.layout import over_time, rank_rows
from voltide.operators.scan import AFFINE, AFFINE2, CLAMPED, FAR, MOBIUS, PIECE, SEEDED, dense_rows, prefix_maps, state_scan
from voltide.session import group_bound

KEY = ["series_id"]


def _apply(m: str, x: Column | float) -> Column:
    return F.col(f"{m}.a") * (x if isinstance(x, Column) else F.lit(float(x))) + F.col(f"{m}.b")


def kalman_variance(n: Column, p0: Column, rho: Column, q: Column, r: Column) -> Column:
    """Posterior variance after n updates of a scalar Kalman filter with constant coefficients.

    The update is the fractional map P -> r(rho^2 P + q) / (rho^2 P + q + r); its n-th power follows from the
    eigenvalues of the 2x2 coefficient matrix, so no recursion over time is needed.
    """
    a, b, c, d = r * rho * rho, r * q, rho * rho, q + r
    half, det = (a + d) / 2, a * d - b * c
    l1 = half + F.sqrt(half * half - det)
    l2 = det / l1
    z = F.pow(l2 / l1, n)
    top = ((a - l2) - z * (a - l1)) * p0 + b * (1 - z)
    return top / (c * (1 - z) * p0 + (d - l2) - z * (d - l1))


def ekf_logvol(df: DataFrame, keys: list[str] = KEY, rho="rho", sigma="sigma_z", mu="mu", offset="offset",
               bound: int | None = None) -> DataFrame:
    """Kalman guide of log-vol on ln(y^2 + 1e-8). Model parameters are columns, constant per key. A row is one update,
    whatever its ``t``: a series may start late and have gaps, as after a repair that skips rows."""
    bound = group_bound(df, keys) if bound is None else bound
    rho_c, s_c, mu_c, off = F.col(rho), F.col(sigma), F.col(mu), F.col(offset)
    q, r = s_c * s_c, F.lit(OBS_VAR + 1e-8)
    p0 = q / (1 - rho_c * rho_c)
    var = kalman_variance((F.col("_n") + 1).cast("double"), p0, rho_c, q, r)
    d = rank_rows(df, keys, ["t"], "_n", bound).withColumn("guide_var", var).withColumn("guide_gain", F.col("guide_var") / r)
    k = F.col("guide_gain")
    maps = [(1 - k) * rho_c, (1 - k) * mu_c * (1 - rho_c) + k * (fn.log_y2("y") + off)]
    d = prefix_maps(d, keys, AFFINE, maps, "_n", "_m", bound, dense=True)
    return d.withColumn("guide_mean", _apply("_m", F.col(mu))).drop("_m", "_n")


def two_factor_gains(cfg: FilterConfig, tol: float = 1e-12) -> list[tuple[int, float, float, float, float]]:
    """(update, gain_fast, gain_slow, var_fast, var_slow) until the variances move by less than tol of themselves; they do
    not depend on data. The variances contract by a factor that the slower factor's rho bounds, so the list is as long
    as ln(tol) / ln(rho^2) at most and a bit, and later updates keep the last row."""
    qf, qs = cfg.sigma_fast**2, cfg.sigma_slow**2
    pf, ps = qf / (1 - cfg.rho_fast**2), qs / (1 - cfg.rho_slow**2)
    out: list[tuple[int, float, float, float, float]] = []
    while True:
        af, as_ = cfg.rho_fast**2 * pf + qf, cfg.rho_slow**2 * ps + qs
        s = af + as_ + OBS_VAR + 1e-8
        kf, ks = af / s, as_ / s
        nf, ns = max((1 - kf) * af, 1e-6), max((1 - ks) * as_, 1e-6)
        out.append((len(out), kf, ks, nf, ns))
        if abs(nf - pf) <= tol * nf and abs(ns - ps) <= tol * ns:
            return out
        pf, ps = nf, ns


def ekf_two_factor(df: DataFrame, cfg: FilterConfig, bound: int | None = None) -> DataFrame:
    """Two-component Kalman guide with innovation split. The gain schedule is one short table per configuration; a row is
    one update, whatever its ``t``."""
    bound = group_bound(df, KEY) if bound is None else bound
    sched = two_factor_gains(cfg)
    gains = df.sparkSession.createDataFrame(sched, "_g long, k_fast double, k_slow double, var_fast double, var_slow double")
    d = rank_rows(df, KEY, ["t"], "_n", bound)
    d = d.withColumn("_g", F.least(F.col("_n"), F.lit(len(sched) - 1))).join(F.broadcast(gains), "_g").drop("_g")
    rf, rs, kf, ks = F.lit(cfg.rho_fast), F.lit(cfg.rho_slow), F.col("k_fast"), F.col("k_slow")
    z = fn.log_y2("y") + implied_offset(cfg.nu) - cfg.mu
    maps = [rf * (1 - kf), -kf * rs, -ks * rf, rs * (1 - ks), kf * z, ks * z]
    d = prefix_maps(d, KEY, AFFINE2, maps, "_n", "_m", bound, dense=True)
    return d.withColumn("guide_fast", F.col("_m.b1")).withColumn("guide_slow", F.col("_m.b2")).drop("_m", "_n")


def adaptive_mu(est: DataFrame, mu0: float, process_var: float, obs_scale: float, lo: float, hi: float,
                h: str = "h_mean", bw: str = "bandwidth", keys: list[str] = KEY, bound: int | None = None,
                piece: int = PIECE) -> DataFrame:
    """Slow level tracked by a scalar Kalman filter with noise scale*bw^2, clamped, active after t = 10."""
    bound = group_bound(est, keys) if bound is None else bound
    est, at = dense_rows(est, keys, "t", bound, piece)
    on = F.col("t") > 10
    r = obs_scale * F.col(bw) * F.col(bw) + 1e-8
    q = F.lit(process_var)
    maps = [F.when(on, r).otherwise(1.0), F.when(on, r * q).otherwise(0.0),
            F.when(on, 1.0).otherwise(0.0), F.when(on, q + r).otherwise(1.0)]
    d = prefix_maps(est, keys, MOBIUS, maps, at, "_v", bound, piece, dense=True)
    v = (F.col("_v.p") * 1.0 + F.col("_v.q")) / (F.col("_v.r") * 1.0 + F.col("_v.s"))
    d = d.withColumn("mu_var", v).drop("_v").withColumn("_k", F.when(on, F.col("mu_var") / r).otherwise(0.0))
    k = F.col("_k")
    maps = [1 - k, k * F.col(h), F.when(on, lo).otherwise(-FAR), F.when(on, hi).otherwise(FAR)]
    d = prefix_maps(d, keys, CLAMPED, maps, at, "_m", bound, piece, dense=True)
    x = F.least(F.col("_m.hi"), F.greatest(F.col("_m.lo"), _apply("_m", mu0)))
    return d.withColumn("mu_state", x).drop("_m", "_k", "_row")


def smooth_fixed_lag(est: DataFrame, rho: float, sigma: float, mu: float, lag: int = 3, out_lag: int = 1,
                     h: str = "h_mean", var: str = "h_var", keys: list[str] = KEY, bound: int | None = None) -> DataFrame:
    """Fixed-lag backward correction over the last ``lag`` estimates, re-applied at every tick.

    A corrected entry depends on itself and later ones only, so the output at t needs a fixed number of rows behind t:
    a bounded window holds them and a small nested fold replays the corrections.
    """
    k = max(1, lag)
    depth = min(out_lag, k - 1)
    if depth <= 0:
        return est.withColumn("h_smoothed", F.col(h))
    s2 = sigma * sigma
    # Corrections at tick t touch the k-1 entries before it. The entry read at tick t, age ``depth``, has been
    # corrected at ages 1..depth; its later neighbours have been corrected as often as their own age allows.
    d = over_time(est, keys, {f"_h{j}": (lambda w, j=j: F.lag(h, j).over(w)) for j in range(depth + 1)}
                  | {f"_v{j}": (lambda w, j=j: F.lag(var, j).over(w)) for j in range(depth + 1)}, back=depth, bound=bound)
    hs = [F.col(f"_h{j}") for j in range(depth + 1)]  # by age at output time
    vs = [F.col(f"_v{j}") for j in range(depth + 1)]
    names = list(est.columns)
    # Replay ticks t-depth+1 .. t; at tick t-a the entries of age j > a are in the past of that tick.
    step = 0
    for a in range(depth - 1, -1, -1):
        active = (F.col("t") - a) >= k
        for j in range(a + 1, depth + 1):
            cur_h, cur_v, nxt = hs[j], vs[j], hs[j - 1]
            gain = rho * cur_v / (rho * rho * cur_v + s2 + 1e-8)
            new_h = F.when(active, cur_h + gain * (nxt - (mu + rho * (cur_h - mu)))).otherwise(cur_h)
            new_v = F.when(active, cur_v * (1 - gain * rho)).otherwise(cur_v)
            d = d.withColumn(f"_a{step}", new_h).withColumn(f"_b{step}", new_v)
            hs[j], vs[j] = F.col(f"_a{step}"), F.col(f"_b{step}")
            step += 1
    out = F.when(F.col("t") < k, F.col(h)).otherwise(hs[depth])
    return d.select(*names, out.alias("h_smoothed"))


def ema(df: DataFrame, value: Column, alpha: float, out: str, seed: float | str = "first", keys: list[str] = KEY,
        bound: int | None = None, piece: int = PIECE) -> DataFrame:
    """Exponential average. ``seed='first'`` starts from the first positive value; a number (or column name) is x_0-."""
    d = df.withColumn("_x", value)
    if seed == "first":
        d = prefix_maps(d, keys, SEEDED, [F.col("_x"), F.lit(1 - alpha), alpha * F.col("_x")], "t", "_m", bound, piece)
        return d.withColumn(out, F.col("_m.z")).drop("_m", "_x")
    d = prefix_maps(d, keys, AFFINE, [F.lit(1 - alpha), alpha * F.col("_x")], "t", "_m", bound, piece)
    return d.withColumn(out, _apply("_m", F.col(seed) if isinstance(seed, str) else seed)).drop("_m", "_x")


CALM, SHOCK, RECOVERY = 0, 1, 2


def shock_step(s: Column, z_sq: Column, shock: float = 9.0, calm: float = 4.0, shock_ticks: int = 20,
               recovery_ticks: int = 50) -> Column:
    """One tick of the shock states, coded as 0 = calm, 1..shock_ticks = shock with s-1 ticks spent,
    above = recovery with (s - shock_ticks - 1) ticks spent (capped at the minimum stay)."""
    first_rec = shock_ticks + 1
    last_rec = first_rec + recovery_ticks
    in_shock = F.when(s == shock_ticks, first_rec).otherwise(s + 1)
    in_rec = F.when(z_sq > shock, 1).when((s + 1 >= last_rec) & (z_sq < calm), 0).otherwise(F.least(s + 1, F.lit(last_rec)))
    return F.when(s == 0, F.when(z_sq > shock, 1).otherwise(0)).when(s <= shock_ticks, in_shock).otherwise(in_rec)


def shock_state(diag: DataFrame, z: str = "z_sq", shock: float = 9.0, calm: float = 4.0, shock_ticks: int = 20,
                recovery_ticks: int = 50, keys: list[str] = KEY, bound: int | None = None, piece: int = 4 * PIECE) -> DataFrame:
    """Calm / shock / recovery label per tick."""
    n = shock_ticks + recovery_ticks + 2
    d = state_scan(diag, keys, n, lambda s, x: shock_step(s, x[z], shock, calm, shock_ticks, recovery_ticks), 0, [z],
                   "t", "_s", bound, piece)
    code = F.when(F.col("_s") == 0, CALM).when(F.col("_s") <= shock_ticks, SHOCK).otherwise(RECOVERY)
    return d.withColumn("shock_state", code).drop("_s")


def learn_gate(df: DataFrame, boost: float, state: str = "shock_state") -> DataFrame:
    s = F.col(state)
    return df.withColumn("should_learn", s != SHOCK).withColumn(
        "lr_mult", F.when(s == SHOCK, 0.0).when(s == RECOVERY, boost).otherwise(1.0))


def bandwidth_fold(stats: DataFrame, n: int, alpha: float = 0.3, alpha_ret: float = 0.05, keys: list[str] = KEY,
                   bound: int | None = None, piece: int = PIECE) -> DataFrame:
    """Kernel bandwidth over time from per-tick (var, spread, y): smoothed 2var/ln(n+1), shrunk on large moves.

    The shrunk value is the carried state; only the output is limited to [0.01, 2]. The first row of a series, at
    whatever ``t``, takes its raw value.
    """
    bound = group_bound(stats, keys) if bound is None else bound
    d, at = dense_rows(stats, keys, "t", bound, piece)
    ay = F.abs("y")
    d = prefix_maps(d, keys, SEEDED, [ay, F.lit(1 - alpha_ret), alpha_ret * ay], at, "_e", bound, piece, dense=True)
    d = d.withColumn("ret_ema", F.col("_e.z")).drop("_e")
    raw = F.greatest(2 * F.col("var") / math.log(n + 1), F.lit(1e-6))
    big = F.greatest(ay / F.greatest(F.col("ret_ema"), F.lit(1e-8)), F.least(F.col("spread") * 0.5, F.lit(2.0)))
    scale = F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1 - 0.25 * F.least(big - 1, F.lit(2.0))))
    d = d.withColumn("_raw", raw).withColumn("bw_scale", scale)
    shrunk = F.col("bw_scale") * F.col("_raw")
    d = prefix_maps(d, keys, SEEDED, [shrunk, (1 - alpha) * F.col("bw_scale"), alpha * shrunk], at, "_m", bound, piece, dense=True)
    return (d.withColumn("bandwidth_sq", F.col("_m.z"))
            .withColumn("bandwidth", F.greatest(F.lit(0.01), F.least(F.lit(2.0), F.sqrt("bandwidth_sq")))).drop("_m", "_raw", "_row"))
