"""One tick for all series at once: as a plan over particle tables (a row per particle), which writes its steps, or in one pass
over sets (a row per series), which writes none. Suited to wide, short cross-sections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.functions.config import OBS_VAR, FilterConfig, implied_offset, log_norm, stationary_var
from voltide.operators import particles as pt
from voltide.session import cut_lineage

KEY = ["series_id"]
Draw = Callable[..., Column]  # (role, stage, iteration, uniform?, particle = column i) -> column


@dataclass(frozen=True)
class HashDraws:
    """Draws keyed by series, tick and particle, as columns."""

    seed: int

    def __call__(self, role: str, stage: int = 0, it: int = 0, uniform: bool = False, i: Column | None = None) -> Column:
        parts = (F.col("series_id"), F.col("t"), F.col("i") if i is None else i, F.lit(f"{role}:{stage}:{it}"))
        return fn.uniform_noise(self.seed, *parts) if uniform else fn.normal_noise(self.seed, *parts)


def hash_draws(seed: int) -> Draw:
    return HashDraws(seed)


def zero_draws() -> Draw:
    return lambda role, stage=0, it=0, uniform=False, i=None: F.lit(0.5 if uniform else 0.0)


def _by_series(df: DataFrame) -> DataFrame:
    """The rows dealt out by series to a number of tasks that stays: rows are narrow, and what they cost shows in no size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(n, 2 * df.sparkSession.sparkContext.defaultParallelism), *KEY)


def start_state(series: DataFrame, cfg: FilterConfig, draw: Draw, sets: bool = False) -> tuple[DataFrame, DataFrame]:
    """Particles and per-series scalars before the first tick. With ``sets`` a row per series, whose particles (arrays h,
    h_prev, v) and mean are NULL: the first tick draws them in its task, so that no exchange moves them."""
    if sets:
        ids, none = _by_series(series.select(*KEY)).distinct(), F.lit(None)
        p = ids.select(*KEY, *[none.cast("array<double>").alias(c) for c in ("h", "h_prev", "v")])
        return p, ids.select(*KEY, F.lit(0).cast("long").alias("t"), none.cast("double").alias("h_bar"), *_start_scalars(cfg))
    d = series.select("series_id", F.lit(-1).cast("long").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(cfg.n_particles - 1))).alias("i"))
    p = d.withColumn("h", pt.init_h(cfg.mu, stationary_var(cfg) ** 0.5, draw("init", 0, 0, False)))
    p = p.select("series_id", "i", "h", F.col("h").alias("h_prev"), F.lit(0.0).alias("v"))
    s = p.groupBy("series_id").agg(F.avg("h").alias("h_bar")).select(
        "series_id", F.lit(0).cast("long").alias("t"), "h_bar", *_start_scalars(cfg))
    return p, s


def _start_scalars(cfg: FilterConfig) -> list[Column]:
    return [F.lit(cfg.mu).alias("g_mean"), F.lit(cfg.sigma_z**2 / (1 - cfg.rho**2)).alias("g_var"), F.lit(0.0).alias("ema"), F.lit(0.0).alias("bw_sq"),
            F.lit(0.05).alias("vol_prev"), F.lit(1e10).alias("ksd_prev"), F.lit(0.0).alias("y_prev")]


def with_all(d: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for cols in steps:
        d = d.withColumns(cols)
    return d


def tick_scalars(cfg: FilterConfig, rho: str | float | None = None, sigma_z: str | float | None = None, mu: str | float | None = None) -> list[dict[str, Column]]:
    """Guide update, effective noise, step budget: everything known before the particles move. Parameters are those of
    ``cfg``, or columns. The guide before the update stays as _g_mean and _g_var."""
    rho, sigma_z, mu = (fn._c(getattr(cfg, n) if x is None else x) for n, x in (("rho", rho), ("sigma_z", sigma_z), ("mu", mu)))
    off = implied_offset(cfg.nu)
    rz = F.abs("y") / F.greatest(F.col("vol_prev"), F.lit(1e-4))
    sev = lambda thr: F.when(rz > thr, F.least((rz - thr) / 3, F.lit(1.0))).otherwise(0.0)
    sigma = sigma_z
    if cfg.adaptive_sigma:
        sigma = F.when(F.col("t") > 0, sigma_z * (1 + (cfg.sigma_boost_max - 1) * sev(cfg.sigma_threshold))).otherwise(sigma_z)
    pp = rho * rho * F.col("g_var") + sigma_z * sigma_z
    mp = mu + rho * (F.col("g_mean") - mu)
    gain = pp / (pp + OBS_VAR + 1e-8)
    strength = F.lit(cfg.guide_strength)
    if cfg.adaptive_guide:
        vol = F.greatest(F.col("vol_prev"), F.lit(1e-4))
        rise = (fn.log_y2("y") + off - F.log(vol * vol + 1e-8) > 0) & (F.col("t") > 0)
        strength = cfg.guide_strength + (cfg.guide_strength_max - cfg.guide_strength) * F.when(rise, sev(cfg.guide_threshold)).otherwise(0.0)
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ksd_prev") - 0.05) / 0.45))
    budget = F.when(F.col("t") < 10, cfg.max_steps).otherwise(cfg.min_steps + F.floor(x * (cfg.max_steps - cfg.min_steps)))
    return [{"_g_mean": F.col("g_mean"), "_g_var": F.col("g_var")},
            {"g_mean": mp + gain * (fn.log_y2("y") + off - mp), "g_var": (1 - gain) * pp, "sigma": sigma, "strength": strength, "budget": budget.cast("int")}]


def new_bandwidth(raw: Column, spread: Column) -> list[dict[str, Column]]:
    """One step of the bandwidth's recursion: ema_new, bw_sq_new and bandwidth from ema, bw_sq, y, the raw square and the
    spread of the set."""
    ay, raw = F.abs("y"), F.greatest(raw, F.lit(1e-6))
    sq = F.when(F.col("bw_sq") > 0, 0.3 * raw + 0.7 * F.col("bw_sq")).otherwise(raw)
    big = F.greatest(ay / F.greatest(F.col("ema_new"), F.lit(1e-8)), F.least(spread * 0.5, F.lit(2.0)))
    return [{"ema_new": F.when(F.col("ema") > 0, 0.05 * ay + 0.95 * F.col("ema")).otherwise(ay)},
            {"bw_sq_new": sq * F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1 - 0.25 * F.least(big - 1, F.lit(2.0))))},
            {"bandwidth": F.greatest(F.lit(0.01), F.least(F.lit(2.0), F.sqrt("bw_sq_new")))}]


def stage_plan(cfg: FilterConfig) -> list[int]:
    """The most iterations that each annealing stage can have: a smaller budget can leave a longer last stage."""
    stages = cfg.n_anneal if cfg.annealing else 1
    per = cfg.max_steps // stages
    return [per] * (stages - 1) + [cfg.max_steps - per * (stages - 1) + stages - 1]


def _meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables of the tick joined by series. The file sizes that the planner sees say little about written steps
    (constant columns, exploded particles), so neither side may be taken for a small table and broadcast."""
    return a.join(b.hint("merge"), KEY)


def filter_tick(p: DataFrame, s: DataFrame, obs_t: DataFrame, cfg: FilterConfig, draw: Draw, bound: int | None = None
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(particles, scalars, estimates) after one tick; ``obs_t`` is (series_id, y) for that tick.

    Covers the one-factor model without smoothing, adaptive level and Heun moves. Particles that come as sets (a row per
    series, see start_state) stay sets: each of the three tables is one pass over the joined rows, made when it is read, and
    nothing is written. It takes hash_draws, and what a next tick reads should be written first.
    """
    if "i" not in p.columns:
        return _tick_of_sets(p, s, obs_t, cfg, draw)
    bound = cfg.n_particles if bound is None else bound
    s = cut_lineage(with_all(_meet(s, obs_t), tick_scalars(cfg)))  # has three uses
    cols = ["series_id", "t", "y", "y_prev", "h_bar", "g_mean", "g_var", "sigma", "strength", "budget", "ksd_prev"]
    d = _meet(p, s.select(*cols))
    z = draw("state", 0, 0, False)
    if cfg.guided or cfg.mim:
        up, down = (cfg.rho_up, cfg.rho_down) if cfg.asymmetric_rho else (cfg.rho, cfg.rho)
        d_rho, d_sig = (cfg.delta_rho, cfg.delta_sigma) if cfg.local_params else (0.0, 0.0)
        args = dict(gamma=cfg.gamma, jump_prob=cfg.jump_prob, jump_scale=cfg.jump_scale, d_rho=d_rho, d_sigma=d_sig)
        u = draw("jump", 0, 0, True)
        if cfg.guided:
            h = pt.predict_guided("h", "h_prev", "h_bar", "y_prev", "y", z, u, up, down, "sigma", cfg.mu, implied_offset(cfg.nu),
                                  alpha_base=cfg.guided_base, alpha_shock=cfg.guided_shock, threshold=cfg.guided_threshold, **args)
        else:
            h = pt.predict_mim("h", "h_prev", "h_bar", "y_prev", z, u, up, down, "sigma", cfg.mu, **args)
    else:
        h = pt.predict_ar1("h", "y_prev", z, cfg.rho, "sigma", cfg.mu, cfg.gamma)
    d = d.withColumn("h_pred", h).withColumn("h_prev", F.col("h"))
    if cfg.guide:
        g = pt.guide_preserve("h_pred", "h_bar", "g_mean", "strength") if cfg.guide_preserving else pt.guide_contract("h_pred", "g_mean", "strength")
    else:
        g = F.col("h_pred")
    d = cut_lineage(d.withColumn("h", g).withColumn("m", pt.prior_mean("h_prev", "y_prev", cfg.rho, cfg.mu, cfg.gamma)))

    b = _meet(pt.bandwidth_stats(d, KEY).withColumnRenamed("bw_sq", "bw_sq2"), s.select("series_id", "y", "ema", "bw_sq"))
    b = with_all(b, new_bandwidth(F.col("bw_sq2"), F.col("spread"))).select("series_id", "ema_new", "bw_sq_new", "bandwidth")
    d = _meet(d, b.select("series_id", "bandwidth"))

    stages = cfg.n_anneal if cfg.annealing else 1
    base = cfg.step_size * (0.5 if cfg.guide else 1.0)
    k = F.col("ksd_prev")
    ramp = F.when(k > 0.5, 0.3).when(k < 0.05, 0.8).otherwise(0.3 + (0.5 - k) / 0.45 * 0.5)
    mode = "full_newton" if cfg.newton and cfg.full_newton else "newton" if cfg.newton else "plain"
    d = d.withColumn("log_w", F.lit(0.0)).withColumn("_kp", F.lit(0.0))
    for stage in range(stages):
        last = stage == stages - 1
        if not cfg.annealing or (cfg.adaptive_beta and last):
            beta = F.lit(1.0)
        elif cfg.adaptive_beta:
            beta = F.greatest(F.lit(0.1), F.least(F.lit(1.0), ramp * (0.5 + 0.5 * (stage + 1) / stages)))
        else:
            beta = F.lit((0.3, 0.65, 1.0)[stage % 3])
        per = F.floor(F.col("budget") / stages)
        todo = F.col("budget") - per * (stages - 1) if last else per
        top = stage_plan(cfg)[stage]
        d = d.withColumn("beta", beta).withColumn("_todo", todo)
        for it in range(top):
            live = F.col("_todo") > it
            scored = (pt.grad_prior_t(d, KEY, "sigma", cfg.nu_state, bound) if cfg.t_state else pt.grad_prior_gauss(d, KEY, "sigma", bound))
            lik = pt.grad_lik_exact("y", "h", cfg.nu, cfg.lik_offset) if cfg.exact_gradient else pt.grad_lik_surrogate("y", "h", cfg.lik_offset)
            scored = scored.withColumn("grad", pt.grad_combine("g_prior", lik, "beta", cfg.fan))
            scored = scored.withColumn("curv", pt.curvature("y", "h", cfg.nu, "hess_prior") if cfg.newton else F.lit(1.0))
            scored = scored.withColumn("log_w", F.when(live, pt.log_weight("y", "h", cfg.nu, log_norm(cfg.nu), cfg.fan)).otherwise(F.col("log_w")))
            moved = pt.stein_phi(cut_lineage(scored), KEY, mode, paper_sign=cfg.paper_sign or cfg.fan, compat=cfg.ksd_compat, bound=bound)
            temp = cfg.temperature if cfg.svld else 0.0
            h, v = pt.transport("h", "v", "phi", draw("move", stage, it, False), base, F.sqrt("beta"), temp, cfg.rmsprop_rho, cfg.rmsprop_eps)
            moved = moved.withColumn("_h", F.when(live, h).otherwise(F.col("h"))).withColumn("v", F.when(live, v).otherwise(F.col("v")))
            if last:
                moved = moved.withColumn("_kp", F.when(F.col("_todo") == it + 1, F.col("ksd_part")).otherwise(F.col("_kp")))
            d = cut_lineage(moved.withColumn("h", F.col("_h")).drop("_h", "phi", "ksd_part", "g_prior", "hess_prior", "grad", "curv"))

    if cfg.rejuvenation and cfg.guide:
        gate = (F.col("t") > 10) & (F.col("ksd_prev") > cfg.rejuv_ksd)
        d = d.withColumn("h", pt.rejuvenate("h", draw("rej_u", 0, 0, True), draw("rej_z", 0, 0, False), "g_mean", "g_var", cfg.rejuv_prob, cfg.rejuv_blend, gate))
    pred = d.select("series_id", "i", fn.t_logpdf("y", "h_pred", cfg.nu, log_norm(cfg.nu)).alias("log_w"))
    post = pt.posterior_summary(d, KEY, extra={"_u": F.col("_kp")}).withColumnRenamed("loglik", "loglik_filtered")
    post = post.withColumn("ksd", F.sqrt(F.greatest(F.col("_u") / (F.col("n") * F.col("n")), F.lit(0.0))))
    est = _meet(_meet(post, pt.log_mean_exp(pred, KEY).withColumnRenamed("loglik", "loglik_predictive")), b)
    est = cut_lineage(_meet(est, s.select("series_id", "t", "y", "g_mean", "g_var", "budget")))
    new_s = est.select("series_id", (F.col("t") + 1).alias("t"), F.col("h_mean").alias("h_bar"), "g_mean", "g_var", F.col("ema_new").alias("ema"),
                       F.col("bw_sq_new").alias("bw_sq"), F.col("vol").alias("vol_prev"), F.col("ksd").alias("ksd_prev"), F.col("y").alias("y_prev"))
    out = est.select("series_id", "t", "loglik_predictive", "loglik_filtered", "vol", "vol_std", "h_mean", "bandwidth", "ksd",
                     F.col("budget").alias("stein_steps"), F.col("g_mean").alias("guide_mean"), F.col("g_var").alias("guide_var"), "ess")
    return d.select("series_id", "i", "h", "h_prev", "v"), new_s, out


SET = ["h", "h_prev", "v"]
SCALARS = ["t", "h_bar", "g_mean", "g_var", "ema", "bw_sq", "vol_prev", "ksd_prev", "y_prev"]
ESTIMATES = ["t", "loglik_predictive", "loglik_filtered", "vol", "vol_std", "h_mean", "bandwidth", "ksd", "stein_steps", "guide_mean", "guide_var", "ess"]


def _tick_of_sets(p: DataFrame, s: DataFrame, obs_t: DataFrame, cfg: FilterConfig, draw: Draw) -> tuple[DataFrame, DataFrame, DataFrame]:
    from voltide.plans.set_ticks import Draws, cross_rows

    if not isinstance(draw, HashDraws):
        raise ValueError("a tick of sets takes the draws of hash_draws")
    cfg = replace(cfg, adaptive_mu=False, heun=False)
    d = _meet(_meet(_by_series(obs_t.select(*KEY, "y")), s.select(*KEY, *SCALARS)), p.select(*KEY, *SET))
    d = d.withColumn("name", F.col("series_id").cast("string"))
    kinds = {"t": "bigint", "stein_steps": "int"} | {c: "array<double>" for c in SET}

    def table(columns: list[str]) -> DataFrame:
        schema = ", ".join([f"`series_id` {d.schema['series_id'].dataType.simpleString()}", *[f"`{c}` {kinds.get(c, 'double')}" for c in columns]])
        return d.mapInArrow(cross_rows(cfg, Draws(draw.seed, cfg.n_particles), columns, columns is ESTIMATES), schema)

    return table(SET), table(SCALARS), table(ESTIMATES)
