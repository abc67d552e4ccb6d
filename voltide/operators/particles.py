"""Particle sets as tables: one row per (set key, i). Draws are explicit columns, so every result is deterministic."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.operators import tiles
from voltide.operators.layout import over_time, rank_rows
from voltide.session import group_bound

_c = fn._c


# --- summaries -----------------------------------------------------------------------------------------------------

def particle_stats(p: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    return p.groupBy(*keys).agg(F.avg(h).alias("h_mean"), F.stddev_pop(h).alias("h_std"))


def particle_outputs(p: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """Mean of exp(h/2) (not exp of the mean), its spread, and mean h."""
    v = fn.safe_exp(F.col(h) / 2)
    return p.groupBy(*keys).agg(F.avg(v).alias("vol"), F.stddev_pop(v).alias("vol_std"), F.avg(h).alias("h_mean"))


WEIGHT_BAND = 64.0


def weighted(p: DataFrame, keys: list[str], lw: str, sums: dict[str, tuple[Column, int]], plain: dict[str, Column] | None = None) -> DataFrame:
    """Per set: ``top`` = max log-weight, ``n`` rows, sums of x * exp(power * (log_w - top)) for every (x, power) in
    ``sums``, and the aggregates in ``plain`` (name -> expression combined by sum, or min/max by name suffix).

    Rows are first summed per band of 64 log units, relative to the band's own base. That needs no joined maximum, so
    the work is one partial aggregate before the shuffle whatever the size of a set; the few bands are then rescaled.
    Rows with a non-finite log-weight carry no weight but count in ``n`` and in ``plain``.
    """
    plain = plain or {}
    x = F.col(lw)
    ok = x.isNotNull() & ~F.isnan(lw) & (F.abs(x) < float("inf"))
    d = p.withColumn("_b", F.when(ok, F.floor(x / WEIGHT_BAND).cast("double")))
    base = F.when(ok, x - WEIGHT_BAND * F.col("_b"))
    bands = d.groupBy(*keys, "_b").agg(
        F.max(F.when(ok, x)).alias("_t"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(v * F.exp(power * base)).alias(f"_s_{k}") for k, (v, power) in sums.items()],
        *[_fold(k)(v).alias(f"_p_{k}") for k, v in plain.items()])
    top_band = F.max("_b").over(Window.partitionBy(*keys))
    bands = bands.withColumn("_d", WEIGHT_BAND * (F.col("_b") - top_band)).withColumn("_B", top_band)
    g = bands.groupBy(*keys).agg(
        F.max("_t").alias("top"), F.sum("_n").alias("n"), F.max("_B").alias("_B"),
        *[F.sum(F.col(f"_s_{k}") * F.exp(power * F.col("_d"))).alias(f"_s_{k}") for k, (_, power) in sums.items()],
        *[_fold(k)(F.col(f"_p_{k}")).alias(k) for k in plain])
    back = WEIGHT_BAND * F.col("_B") - F.col("top")
    return g.select(*keys, "top", "n", *plain, *[(F.col(f"_s_{k}") * F.exp(power * back)).alias(k) for k, (_, power) in sums.items()])


def _fold(name: str):
    return F.min if name.endswith("_min") else F.max if name.endswith("_max") else F.sum


def _w(power: int = 1) -> tuple[Column, int]:
    return F.lit(1.0), power


def log_mean_exp(p: DataFrame, keys: list[str], lw: str = "log_w") -> DataFrame:
    g = weighted(p, keys, lw, {"w": _w()})
    return g.select(*keys, (F.col("top") + F.log(F.greatest(F.col("w") / F.col("n"), F.lit(1e-10)))).alias("loglik"))


def _ess() -> Column:
    return F.col("w") * F.col("w") / (F.col("w2") + 1e-10)


def ess(p: DataFrame, keys: list[str], lw: str = "log_w") -> DataFrame:
    g = weighted(p, keys, lw, {"w": _w(), "w2": _w(2)})
    return g.select(*keys, _ess().alias("ess"), (_ess() / F.col("n")).alias("ess_ratio"))


def posterior_summary(p: DataFrame, keys: list[str], h: str = "h", lw: str = "log_w", extra: dict[str, Column] | None = None) -> DataFrame:
    """Mean and spread of h and of exp(h/2) over the particles that have a value, evidence and ESS of every set.
    ``extra`` adds plain sums."""
    v = fn.safe_exp(F.col(h) / 2)
    extra = extra or {}
    # var_pop merges centred second moments, which neither cancels nor depends on the partitioning's sums of squares
    m = p.groupBy(*keys).agg(F.avg(h).alias("h_mean"), F.stddev_pop(h).alias("h_std"), F.avg(v).alias("vol"), F.stddev_pop(v).alias("vol_std"))
    g = weighted(p, keys, lw, {"w": _w(), "w2": _w(2)}, extra).join(m.hint("merge"), keys)  # one row a set: both sides have the same rows
    return g.select(*keys, "h_mean", "h_std", "vol", "vol_std", (F.col("top") + F.log(F.greatest(F.col("w") / F.col("n"), F.lit(1e-10)))).alias("loglik"),
                    _ess().alias("ess"), (_ess() / F.col("n")).alias("ess_ratio"), "n", *extra)


def particle_health(p: DataFrame, keys: list[str], h: str = "h", lw: str = "log_w") -> DataFrame:
    """NaN / infinity counts, extremes and weight sums of each set."""
    hc, wc = F.col(h), F.col(lw)
    nan = F.isnan(hc) | F.isnan(wc)
    inf = ~nan & ((F.abs(hc) == float("inf")) | (F.abs(wc) == float("inf")))
    good = ~nan & ~inf
    g = weighted(p, keys, lw, {"sum_w": (F.when(good, 1.0), 1), "sum_w2": (F.when(good, 1.0), 2)}, {
        "n_nan": F.when(nan, 1).otherwise(0).cast("long"), "n_inf": F.when(inf, 1).otherwise(0).cast("long"),
        "n_good": F.when(good, 1).otherwise(0).cast("long"), "h_min": F.when(good, hc), "h_max": F.when(good, hc), "h_sum": F.when(good, hc)})
    return g.select(*keys, "n", "n_nan", "n_inf", "h_min", "h_max", F.try_divide("h_sum", "n_good").alias("h_mean"), "sum_w", "sum_w2")


def health_status(health: DataFrame, ess_min: float = 0.3, vol_max: float = 10.0, vol_min: float = 1e-4) -> DataFrame:
    """Status per set from its health row; errors first, and the last warning that applies wins."""
    ess_ratio = F.try_divide(F.col("sum_w") * F.col("sum_w"), F.col("sum_w2")) / F.col("n")
    vol = F.exp(F.col("h_mean") / 2)
    code = (F.when(F.col("n_nan") > 0, 200).when(F.col("n_inf") > 0, 203)
            .when(F.col("sum_w").isNull() | (F.col("sum_w") <= 1e-10), 211)
            .when((vol > vol_max) | (vol < vol_min), 1001).when(ess_ratio < ess_min, 1000).otherwise(0))
    return (health.withColumn("ess_ratio", ess_ratio).withColumn("vol_estimate", vol).withColumn("status", code)
            .withColumn("status_name", fn.status_name("status")))


# --- predict and guide ---------------------------------------------------------------------------------------------

def init_h(mu, sd, z) -> Column:
    return fn.clamp_h(_c(mu) + _c(sd) * _c(z))


def leverage(h, y_prev, gamma) -> Column:
    return _c(gamma) * _c(y_prev) / (fn.safe_exp(_c(h) / 2) + 1e-8)


def prior_mean(h_prev, y_prev, rho, mu, gamma) -> Column:
    return _c(mu) + _c(rho) * (_c(h_prev) - _c(mu)) + leverage(h_prev, y_prev, gamma)


def predict_ar1(h, y_prev, z, rho, sigma, mu, gamma=0.0) -> Column:
    return fn.clamp_h(prior_mean(h, y_prev, rho, mu, gamma) + _c(sigma) * _c(z))


def _mixture(h, h_prev, h_bar, y_prev, z, u, rho_up, rho_down, sigma, mu, gamma, jump_prob, jump_scale, d_rho, d_sigma):
    dev = _c(h) - _c(h_bar)
    base = F.when(_c(h) > _c(h_prev), _c(rho_up)).otherwise(_c(rho_down))
    rho = F.least(F.greatest(base + _c(d_rho) * F.tanh(dev), F.lit(0.0)), F.lit(0.999))
    scale = F.when(_c(u) < _c(jump_prob), _c(jump_scale)).otherwise(1.0)
    return prior_mean(h, y_prev, rho, mu, gamma), _c(sigma) * (1 + _c(d_sigma) * F.abs(dev)) * scale * _c(z)


def predict_mim(h, h_prev, h_bar, y_prev, z, u, rho_up, rho_down, sigma, mu, gamma=0.0, jump_prob=0.05, jump_scale=5.0,
                d_rho=0.0, d_sigma=0.0) -> Column:
    """Mixture innovation: a jump widens the noise; persistence depends on the direction of the last move."""
    mean, noise = _mixture(h, h_prev, h_bar, y_prev, z, u, rho_up, rho_down, sigma, mu, gamma, jump_prob, jump_scale,
                           d_rho, d_sigma)
    return fn.clamp_h(mean + noise)


def predict_guided(h, h_prev, h_bar, y_prev, y, z, u, rho_up, rho_down, sigma, mu, offset, gamma=0.0, jump_prob=0.05,
                   jump_scale=5.0, d_rho=0.0, d_sigma=0.0, alpha_base=0.0, alpha_shock=0.5, threshold=1.5) -> Column:
    """Mixture predict whose mean moves toward the observation-implied level when the surprise is large."""
    mean, noise = _mixture(h, h_prev, h_bar, y_prev, z, u, rho_up, rho_down, sigma, mu, gamma, jump_prob, jump_scale,
                           d_rho, d_sigma)
    implied = fn.implied_h(y, offset)
    zs = (implied - mean) / 2.5
    act = F.when(zs > _c(threshold), F.tanh(zs - _c(threshold))).otherwise(0.0)
    alpha = _c(alpha_base) + (_c(alpha_shock) - _c(alpha_base)) * act
    return fn.clamp_h((1 - alpha) * mean + alpha * implied + noise)


def guide_contract(h, guide, s) -> Column:
    return fn.clamp_h(_c(h) + _c(s) * (_c(guide) - _c(h)))


def guide_preserve(h, h_bar, guide, s) -> Column:
    """Shifts the set toward the guide and keeps deviations from the previous tick's mean."""
    return fn.clamp_h((1 - _c(s)) * _c(h_bar) + _c(s) * _c(guide) + (_c(h) - _c(h_bar)))


# --- bandwidths ----------------------------------------------------------------------------------------------------

def _stats_rule(h: str) -> list[Column]:
    n = F.count(F.lit(1))
    return [F.var_pop(h).alias("var"), (F.max(h) - F.min(h)).alias("spread"), n.alias("n"), (2 * F.var_pop(h) / F.log(n + 1.0)).alias("bw_sq")]


def _silverman_rule(c: str, floor: float) -> Column:
    n = F.count(F.lit(1)).cast("double")
    return F.greatest(1.06 * F.sqrt(F.greatest(F.var_pop(c), F.lit(1e-8))) * F.pow(n, F.lit(-0.2)), F.lit(floor))


def _simple_rule(c: str) -> Column:
    n = F.count(F.lit(1)).cast("double")
    return F.greatest(F.lit(0.01), F.least(F.lit(2.0), F.sqrt(F.greatest(2 * F.var_pop(c) / F.log(n + 1), F.lit(1e-6)))))


def bandwidth_stats(p: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    return p.groupBy(*keys).agg(*_stats_rule(h))


def bandwidth_silverman(p: DataFrame, keys: list[str], floors: dict[str, float]) -> DataFrame:
    return p.groupBy(*keys).agg(*[_silverman_rule(c, f).alias(f"bw_{c}") for c, f in floors.items()])


def bandwidth_simple(p: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """sqrt(2 var / ln(n+1)) per dimension, limited to [0.01, 2]."""
    return p.groupBy(*keys).agg(*[_simple_rule(c).alias(f"bw_{c}") for c in cols])


def bandwidth_rules(p: DataFrame, keys: list[str], h: str = "h", floor: float = 0.01) -> DataFrame:
    """The statistics of every set and its bandwidths by both rules (bw_silverman, bw_simple), from one aggregate."""
    return p.groupBy(*keys).agg(*_stats_rule(h), _silverman_rule(h, floor).alias("bw_silverman"), _simple_rule(h).alias("bw_simple"))


def _median_rule(d: Column, n: Column) -> Column:
    lim = lambda x: F.greatest(F.lit(0.01), F.least(F.lit(10.0), x))
    return lim(lim(d) / F.log(n + 1.0))


def bandwidth_median(p: DataFrame, keys: list[str], h: str = "h", q: float = 0.75, rounds: int = 11,
                     bound: int | None = None, block: int = tiles.BLOCK) -> DataFrame:
    """Distance at sorted position int(q n^2) of all ordered pairs (self-pairs included), then the ln(n+1) rule.

    A set that fits one block sorts its distances in its task. Larger sets narrow the distance down: every round counts
    the pairs within 31 cuts by block pairs and keeps the 32nd part that holds the position, so no pair is ever stored.
    """
    bound = group_bound(p, keys) if bound is None else bound
    n = F.count(F.lit(1)).cast("double")
    if bound <= block:
        def pick(x):
            import numpy as np

            v = np.abs(x["h"][:, None] - x["h"][None, :]).ravel()
            k = min(int(q * len(v)), len(v) - 1)
            return np.partition(v, k)[k]

        def kernel(a, b, prm, same):
            import numpy as np

            return {"dist": np.full(len(a["h"]), pick(a))}

        d = tiles.pairwise(p.withColumn("h", F.col(h)), keys, ["h"], [], [], kernel, ["dist"], bound=bound, block=block)
        return d.groupBy(*keys).agg(_median_rule(F.max("dist"), n).alias("bandwidth"))
    from voltide.session import cut_lineage

    blocks = cut_lineage(tiles.set_blocks(p, keys, h, block=block))
    spread = F.max(F.array_max("_x")) - F.min(F.array_min("_x"))
    state = blocks.groupBy(*keys).agg(F.lit(0.0).alias("lo"), spread.alias("hi"), F.sum(F.size("_x")).cast("double").alias("_n"))
    for _ in range(rounds):
        total = tiles.pair_totals(blocks.join(state.drop("_n"), keys), keys, ["lo", "hi"], tiles.within_counts, tiles.CUT_FIELDS)
        need = F.floor(F.lit(q) * F.col("_n") * F.col("_n")) + 1
        below = sum((F.when(F.col(f) < need, 1).otherwise(0) for f in tiles.CUT_FIELDS), F.lit(0))
        width = (F.col("hi") - F.col("lo")) / tiles.CUTS
        state = cut_lineage(state.join(total, keys).withColumn("_j", below).select(
            *keys, (F.col("lo") + width * F.col("_j")).alias("lo"), (F.col("lo") + width * (F.col("_j") + 1)).alias("hi"), "_n"))
    # the largest distance that is not beyond the bracket is the wanted one, once nothing lies between
    last = tiles.pair_totals(blocks.join(state.select(*keys, "hi"), keys), keys, ["hi"], tiles.largest_within, ["dist"], "max")
    exact = last.join(state, keys)
    return exact.select(*keys, _median_rule(F.col("dist"), F.col("_n")).alias("bandwidth"))


# --- scores --------------------------------------------------------------------------------------------------------

def grad_prior_gauss(p: DataFrame, keys: list[str], sigma: str = "sigma", bound: int | None = None,
                     block: int = tiles.BLOCK) -> DataFrame:
    """Score and curvature of the Gaussian mixture over all prior means ``m`` at each ``h``."""
    d = tiles.attach(p, keys, ["h"], ["m"], {"sigma": F.col(sigma)}, tiles.prior_gauss, ["top", "w", "wg"], "logsum", bound=bound, block=block)
    return (d.withColumn("g_prior", F.col("wg") / (F.col("w") + 1e-8))
            .withColumn("hess_prior", -1 / (F.col(sigma) * F.col(sigma))).drop("top", "w", "wg"))


def grad_prior_t(p: DataFrame, keys: list[str], sigma: str = "sigma", nu_state: float = 5.0, bound: int | None = None,
                 block: int = tiles.BLOCK) -> DataFrame:
    d = tiles.attach(p, keys, ["h"], ["m"], {"sigma": F.col(sigma), "nu_state": F.lit(float(nu_state))}, tiles.prior_t,
                     ["top", "w", "wg", "wh"], "logsum", bound=bound, block=block)
    return (d.withColumn("g_prior", F.col("wg") / (F.col("w") + 1e-8))
            .withColumn("hess_prior", F.col("wh") / (F.col("w") + 1e-8)).drop("top", "w", "wg", "wh"))


def _ratio(y, h, nu) -> Column:
    return _c(y) * _c(y) / (fn.safe_exp(h) + 1e-8) / _c(nu)


def grad_lik_exact(y, h, nu, lik_offset=0.0) -> Column:
    a = _ratio(y, h, nu)
    return -0.5 + 0.5 * (_c(nu) + 1) * a / (1 + a) - _c(lik_offset)


def grad_lik_surrogate(y, h, lik_offset=0.0) -> Column:
    return (fn.log_y2(y, 1e-10) - _c(h) + _c(lik_offset)) / 1.4


def grad_combine(prior, lik, beta, fan: bool = False) -> Column:
    b = F.lit(1.0) if fan else _c(beta)
    return fn.clamp(_c(prior) + b * _c(lik), -10, 10)


def log_weight(y, h, nu, norm, fan: bool = False) -> Column:
    return F.lit(0.0) if fan else fn.t_logpdf(y, h, nu, norm)


def curvature(y, h, nu, hess_prior) -> Column:
    a = _ratio(y, h, nu)
    hess_lik = -0.5 * (_c(nu) + 1) * a / ((1 + a) * (1 + a))
    return fn.clamp(-(hess_lik + _c(hess_prior)), 0.1, 100)


def precondition(grad, curv) -> Column:
    return 0.7 * _c(grad) / _c(curv)


# --- Stein directions ----------------------------------------------------------------------------------------------

def stein_phi(p: DataFrame, keys: list[str], mode: str = "plain", kernel: str = "imq", paper_sign: bool = False,
              grad: str = "grad", curv: str = "curv", bw: str = "bandwidth", compat: bool = False,
              bound: int | None = None, block: int = tiles.BLOCK, both_signs: bool = False) -> DataFrame:
    """Transport direction ``phi`` of every particle; with the IMQ kernel also its share ``ksd_part`` of the
    discrepancy. ``compat`` flips the sign of the mixed kernel derivative (see README); ``both_signs`` adds the share
    with the other sign as ``ksd_part_other``, from the same pass."""
    d = p.withColumn("s", F.col(grad))
    width = {"bw": F.col(bw)}
    if kernel != "imq":
        fnc = {"rbf": tiles.rbf_sums, "imq_half": tiles.imq_half_sums}[kernel]
        d = tiles.attach(d, keys, ["h"], ["h", "s"], width, fnc, ["k_s", "g_sum", "n"], bound=bound, block=block)
        return d.withColumn("phi", (F.col("k_s") + F.col("g_sum")) / F.col("n")).drop("k_s", "g_sum", "n", "s")
    c = F.col(curv) if curv in p.columns else F.lit(1.0)
    d = d.withColumn("c", c).withColumn("ps", 0.7 * F.col("s") / F.col("c"))
    d = tiles.attach(d, keys, ["h", "s"], ["h", "s", "c", "ps"], width, tiles.imq_sums, tiles.IMQ_FIELDS, bound=bound, block=block)
    sign = 1.0 if paper_sign else -1.0
    plain = (F.col("k_s") + sign * F.col("g_sum")) / F.col("n")
    if mode == "plain":
        phi = plain
    elif mode == "newton":
        phi = (F.col("k_ps") + sign * F.col("g_inv")) / F.col("n")
    elif mode == "full_newton":
        hess = fn.clamp(F.col("h_sum") / F.greatest(F.col("k_sum"), F.lit(1e-6)), 0.1, 100)
        phi = plain / hess * 0.7
    else:
        raise ValueError(f"unknown mode {mode!r}")
    part = F.col("u_base") + (-1.0 if compat else 1.0) * F.col("u_cross")
    other = [(F.col("u_base") - (-1.0 if compat else 1.0) * F.col("u_cross")).alias("ksd_part_other")] if both_signs else []
    return d.select(*p.columns, phi.alias("phi"), part.alias("ksd_part"), *other)


def ksd(p: DataFrame, keys: list[str], parts: dict[str, str] | None = None) -> DataFrame:
    """Discrepancy of each set; parts: result name -> column of the particles' shares."""
    n = F.count(F.lit(1)).cast("double")
    parts = parts or {"ksd": "ksd_part"}
    return p.groupBy(*keys).agg(*[F.sqrt(F.greatest(F.sum(c) / (n * n), F.lit(0.0))).alias(k) for k, c in parts.items()])


def transport(h, v, phi, z, step, beta_root, temperature=1.0, rho=0.9, eps=1e-6) -> tuple[Column, Column]:
    """(new h, new v): root-mean-square scaled drift plus Langevin noise."""
    v_new = rho * _c(v) + (1 - rho) * _c(phi) * _c(phi)
    e = _c(step) * _c(beta_root)
    noise = F.sqrt(2 * e * temperature) * _c(z) if temperature > 1e-6 else F.lit(0.0)
    return fn.clamp_h(_c(h) + e * _c(phi) / F.sqrt(v_new + eps) + noise), v_new


def heun_predict(h, v, phi, step, beta_root, eps=1e-6) -> Column:
    return fn.clamp_h(_c(h) + _c(step) * _c(beta_root) * _c(phi) / F.sqrt(_c(v) + eps))


def heun_correct(h0, v, phi_a, phi_b, z, step, beta_root, temperature=1.0, rho=0.9, eps=1e-6) -> tuple[Column, Column]:
    return transport(h0, v, 0.5 * (_c(phi_a) + _c(phi_b)), z, step, beta_root, temperature, rho, eps)


def rejuvenate(h, u, z, guide_mean, guide_var, prob=0.3, blend=0.3, gate: Column | None = None) -> Column:
    """A random share of particles moves part of the way to a draw from the guide; ``gate`` decides per set."""
    sample = _c(guide_mean) + F.sqrt(F.greatest(_c(guide_var), F.lit(1e-6))) * _c(z)
    hit = _c(u) < prob
    hit = hit if gate is None else hit & gate
    return F.when(hit, fn.clamp_h((1 - blend) * _c(h) + blend * sample)).otherwise(_c(h))


# --- set diagnostics -----------------------------------------------------------------------------------------------

def local_density(p: DataFrame, keys: list[str], bw: str = "bandwidth", bound: int | None = None,
                  block: int = tiles.BLOCK) -> DataFrame:
    d = tiles.attach(p, keys, ["h"], ["h"], {"bw": F.col(bw)}, tiles.near_counts, ["near", "n"], bound=bound, block=block)
    return d.withColumn("density", F.try_divide("near", F.col("n") - 1)).drop("near", "n")


def knn_distance(p: DataFrame, keys: list[str], k: int, bound: int | None = None) -> DataFrame:
    """Distance to the k-th nearest other particle, k limited to n-1.

    In sorted order the k nearest are within k places on either side, so a bounded frame is enough.
    """
    bound = group_bound(p, keys) if bound is None else bound
    d = rank_rows(p, keys, ["h", "i"], "_k", bound)
    d = over_time(d, keys, {"_f": lambda w: F.collect_list("h").over(w.rowsBetween(-k, k))}, "_k", k, k, bound)
    size = F.size("_f")
    kk = F.least(F.lit(k), size - 1)
    at = F.least(F.col("_k"), F.lit(k)).cast("int")
    h = F.col("h")

    def span(j: Column) -> Column:
        lo, hi = at - j, at - j + kk
        inside = (lo >= 0) & (hi < size)
        return F.when(inside, F.greatest(h - F.element_at("_f", F.greatest(lo + 1, F.lit(1))),
                                         F.element_at("_f", F.least(hi + 1, size)) - h))

    dist = F.array_min(F.transform(F.sequence(F.lit(0), kk), span))
    return d.withColumn("knn", F.when(size > 1, dist)).drop("_f", "_k")


def nu_gradient(p: DataFrame, keys: list[str], y: str = "y", nu: str = "nu", lw: str = "log_w") -> DataFrame:
    """Weighted mean score in nu and weighted mean squared residual."""
    z = F.col(y) / (F.exp(F.col("h") / 2) + 1e-8)
    z2, n = z * z, F.col(nu)
    a = 1 + z2 / n
    g = 0.5 * (fn.digamma((n + 1) * 0.5) - fn.digamma(n * 0.5) - 1 / n - F.log(a) + (n + 1) * z2 / (n * n * a))
    s = weighted(p, keys, lw, {"w": _w(), "wg": (g, 1), "wz": (z2, 1)})
    inv = 1 / (F.col("w") + 1e-8)
    return s.select(*keys, (F.col("wg") * inv).alias("nu_grad"), (F.col("wz") * inv).alias("z_sq"))


def sigma_gradient(p: DataFrame, keys: list[str], rho: str = "rho", sigma: str = "sigma", mu: str = "mu", pred: str = "h_pred",
                   lw: str = "log_w") -> DataFrame:
    """Weighted mean score in sigma on predicted particles and the mean of eps^2/sigma^2."""
    s2 = F.col(sigma) * F.col(sigma)
    e = F.col(pred) - (F.col(mu) + F.col(rho) * (F.col("h_prev") - F.col(mu)))
    r = e * e / s2
    s = weighted(p, keys, lw, {"w": _w(), "wg": ((r - 1) / F.col(sigma), 1), "wr": (r, 1)})
    inv = 1 / (F.col("w") + 1e-8)
    return s.select(*keys, (F.col("wg") * inv).alias("sigma_grad"), (F.col("wr") * inv).alias("eps_sq_norm"))


# --- two factors ---------------------------------------------------------------------------------------------------

clamp_2f = fn.clamp_h


def init_two_factor(z_fast, z_slow, rho_f, sigma_f, rho_s, sigma_s) -> dict[str, Column]:
    sd = lambda r, s: _c(s) / F.sqrt(1 - _c(r) * _c(r) + 1e-8)
    return {"h_fast": clamp_2f(sd(rho_f, sigma_f) * _c(z_fast)), "h_slow": clamp_2f(sd(rho_s, sigma_s) * _c(z_slow))}


def predict_two_factor(hf, hs, zf, zs, u, rho_f, sigma_f, rho_s, sigma_s, jump_prob=0.05, jump_scale=5.0, mim=True,
                       guided: dict | None = None) -> dict[str, Column]:
    """Jumps act on the fast factor only; with ``guided`` (y, mu, offset, alpha_base, alpha_shock, threshold) the fast
    factor also moves toward the level implied by the observation."""
    jump = F.when(_c(u) < _c(jump_prob), _c(jump_scale)).otherwise(1.0) if mim else F.lit(1.0)
    f = _c(rho_f) * _c(hf) + _c(sigma_f) * _c(zf) * jump
    s = _c(rho_s) * _c(hs) + _c(sigma_s) * _c(zs)
    if guided:
        implied = fn.log_y2(guided["y"]) + _c(guided["offset"])
        miss = F.abs(implied - (_c(guided["mu"]) + _c(hf) + _c(hs)))
        thr = _c(guided["threshold"])
        alpha = F.when(miss > thr, F.least(_c(guided["alpha_base"]) + _c(guided["alpha_shock"]) * (miss - thr) / thr, F.lit(0.8))
                       ).otherwise(_c(guided["alpha_base"]))
        f = (1 - alpha) * f + alpha * (implied - _c(guided["mu"]) - s)
    return {"h_fast": clamp_2f(f), "h_slow": clamp_2f(s)}


def two_factor_gradient(y, mu, hf, hs, hf_prev, hs_prev, rho_f, sigma_f, rho_s, sigma_s, beta, nu, norm, exact=True) -> dict[str, Column]:
    h = _c(mu) + _c(hf) + _c(hs)
    y2 = _c(y) * _c(y)
    ratio = y2 / (_c(nu) * F.exp(h) + 1e-8)
    lw = _c(norm) - 0.5 * h - 0.5 * (_c(nu) + 1) * F.log(1 + ratio)
    lik = -0.5 + 0.5 * (_c(nu) + 1) * ratio / (1 + ratio + 1e-8) if exact else 0.5 * (F.log(y2 + 1e-8) - h)
    vf, vs = _c(sigma_f) * _c(sigma_f) + 1e-8, _c(sigma_s) * _c(sigma_s) + 1e-8
    wf = vf / (vf + vs)
    return {"g_fast": -(_c(hf) - _c(rho_f) * _c(hf_prev)) / vf + _c(beta) * wf * lik,
            "g_slow": -(_c(hs) - _c(rho_s) * _c(hs_prev)) / vs + _c(beta) * (1 - wf) * lik, "log_w": lw}


def guide_two_factor(h, mean, guide, s, preserving: bool = True) -> Column:
    return clamp_2f((1 - _c(s)) * _c(mean) + _c(s) * _c(guide) + _c(h) - _c(mean)) if preserving else clamp_2f(
        (1 - _c(s)) * _c(h) + _c(s) * _c(guide))


def two_factor_outputs(p: DataFrame, keys: list[str], mu: str = "mu") -> DataFrame:
    h = F.col(mu) + F.col("h_fast") + F.col("h_slow")
    s = weighted(p, keys, "log_w", {"w": _w()}, {"_f": F.col("h_fast"), "_sl": F.col("h_slow"), "_h": h, "_v": F.exp(0.5 * h)})
    return s.select(*keys, *[(F.col(a) / F.col("n")).alias(b) for a, b in (("_f", "fast_mean"), ("_sl", "slow_mean"), ("_h", "h_mean"), ("_v", "vol"))],
                    (F.col("top") + F.log(F.greatest(F.col("w") / F.col("n"), F.lit(1e-10)))).alias("loglik"))


# --- joint state and parameters --------------------------------------------------------------------------------------

JOINT = ("h", "mu_t", "rho_t", "sigma_t")


def joint_params(rho_t, sigma_t) -> tuple[Column, Column]:
    c = fn.constrain("joint", rho_t, sigma_t)
    return c["rho"], c["sigma"]


def joint_init(z: dict[str, str | Column], cfg) -> dict[str, Column]:
    centre = {"h": cfg.mu_prior_mean, "mu_t": cfg.mu_prior_mean, "rho_t": cfg.rho_prior_mean, "sigma_t": cfg.sigma_prior_mean}
    return {n: centre[n] + (0.5 if n == "h" else 0.2) * _c(z[n]) for n in JOINT}


def joint_predict(z: dict[str, str | Column], cfg) -> dict[str, Column]:
    """Random walk of the parameters, then the state moves with the moved parameters."""
    mu = fn.clamp(F.col("mu_t") + cfg.diffusion_mu * _c(z["mu_t"]), -10, 5)
    rho_t = fn.clamp(F.col("rho_t") + cfg.diffusion_rho * _c(z["rho_t"]), -5, 5)
    sig_t = fn.clamp(F.col("sigma_t") + cfg.diffusion_sigma * _c(z["sigma_t"]), -5, 2)
    rho, sigma = joint_params(rho_t, sig_t)
    return {"h": fn.clamp_h(mu + rho * (F.col("h") - mu) + sigma * _c(z["h"])), "mu_t": mu, "rho_t": rho_t, "sigma_t": sig_t}


def joint_gradient(y, cfg, norm) -> dict[str, Column]:
    """Scores of state and parameters. Surprise is measured at the previous state; large surprise loosens the motion
    model and pushes sigma up."""
    h, hp, mu = F.col("h"), F.col("h_prev"), F.col("mu_t")
    rho, sigma = joint_params("rho_t", "sigma_t")
    var, y2 = sigma * sigma, _c(y) * _c(y)
    cut = lambda x: F.exp(fn.clamp(x, -20, 20))
    a = y2 / (cut(h) + 1e-8) / cfg.nu
    lw = norm - 0.5 * h - (cfg.nu + 1) * 0.5 * F.log1p(F.greatest(a, F.lit(-0.999)))
    z2 = y2 / (cut(hp) + 1e-8)
    panic = z2 > 9
    motion = F.greatest(var * (1 + 0.3 * F.least(F.greatest(z2 - 4, F.lit(0.0)), F.lit(20.0))), F.lit(0.03 * 0.03))
    motion = F.when(panic, F.greatest(motion, F.lit(1.0))).otherwise(motion)
    wt = F.when(panic, 0.3).otherwise(1.0)
    diff = h - (mu + rho * (hp - mu))
    push = wt * diff / motion
    force = (F.when(panic, F.least((z2 - 9) * 0.5, F.lit(5.0))).when(z2 < 1.5, -(1.5 - z2)).otherwise(0.0))
    prior = lambda x, m, v: -cfg.prior_weight * (x - m) / v
    g_sigma = (diff * diff / var - 1 + force - 0.2 * (F.col("sigma_t") - cfg.sigma_prior_mean)
               + prior(F.col("sigma_t"), cfg.sigma_prior_mean, cfg.sigma_prior_var))
    return {
        "g_h": fn.clamp((fn.log_y2(y, 1e-10) - h + cfg.lik_offset) / 1.4 - push, -10, 10),
        "g_mu_t": fn.clamp(push * (1 - rho) + prior(mu, cfg.mu_prior_mean, cfg.mu_prior_var), -5, 5),
        "g_rho_t": fn.clamp(push * (hp - mu) * rho * (1 - rho) + prior(F.col("rho_t"), cfg.rho_prior_mean, cfg.rho_prior_var), -5, 5),
        "g_sigma_t": F.greatest(F.lit(-5.0), F.least(F.when(panic, 10.0).otherwise(5.0), g_sigma)),
        "log_w": lw,
    }


def joint_stein(p: DataFrame, keys: list[str], y: str, cfg, bound: int | None = None, block: int = tiles.BLOCK) -> DataFrame:
    """One transport step in four dimensions; bandwidths are columns bw_<dim>."""
    d = tiles.attach(p, keys, list(JOINT), [*JOINT, *[f"g_{n}" for n in JOINT]], {f"bw_{n}": F.col(f"bw_{n}") for n in JOINT},
                     tiles.joint_sums, [*[f"phi_{n}" for n in JOINT], "k_sum", "n"], bound=bound, block=block)
    hot = F.col(y) * F.col(y) / (F.exp("h_prev") + 1e-8) > 9
    norm = F.greatest(F.least(F.col("k_sum"), F.col("n")), F.lit(32.0))
    steps = {"h": (cfg.step_h, 5.0), "mu_t": (cfg.step_mu, 2.0), "rho_t": (cfg.step_rho, 1.0), "sigma_t": (cfg.step_sigma, 4.0)}
    lims = {"h": (-15, 5), "mu_t": (-10, 5), "rho_t": (-5, 5), "sigma_t": (-5, 2)}
    new = [fn.clamp(F.col(n) + steps[n][0] * F.when(hot, steps[n][1]).otherwise(1.0) * F.col(f"phi_{n}") / norm, *lims[n]).alias(n)
           for n in JOINT]
    keep = [c for c in p.columns if c not in JOINT]
    return d.select(*keep, *new)


def joint_diagnostics(p: DataFrame, keys: list[str], cfg) -> DataFrame:
    """Means and spreads of state and parameters, collapse flags, effective sample size and evidence."""
    d = p.withColumn("_rho", fn.sigmoid("rho_t")).withColumn("_sigma", F.exp("sigma_t"))
    sd = F.stddev_pop
    moments = d.groupBy(*keys).agg(
        F.avg("h").alias("h_mean"), F.exp(F.avg("h") / 2).alias("vol_mean"), F.avg("mu_t").alias("mu_mean"),
        F.avg("_rho").alias("rho_mean"), F.avg("_sigma").alias("sigma_mean"), sd("mu_t").alias("mu_std"),
        sd("_rho").alias("rho_std"), sd("_sigma").alias("sigma_std"), sd("mu_t").alias("std_mu_tilde"),
        sd("rho_t").alias("std_rho_tilde"), sd("sigma_t").alias("std_sigma_tilde"),
        (sd("mu_t") < cfg.collapse_mu).alias("mu_collapsed"), (sd("rho_t") < cfg.collapse_rho).alias("rho_collapsed"),
        (sd("sigma_t") < cfg.collapse_sigma).alias("sigma_collapsed"))
    s = weighted(p, keys, "log_w", {"w": _w(), "w2": _w(2)})
    s = s.select(*keys, _ess().alias("ess"), (F.col("top") + F.log(F.col("w") / F.col("n"))).alias("loglik"))
    return moments.join(s, keys)
