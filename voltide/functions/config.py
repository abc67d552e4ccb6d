"""Filter configurations as plain typed rows."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of log-vol, digamma of a half, variance of ln(y^2) around its level.
H_MIN, H_MAX = -15.0, 5.0
PSI_HALF = -1.9635100260214235
OBS_VAR = 4.93 + 2.0


@dataclass(frozen=True)
class FilterConfig:
    """One model configuration. Field defaults are the library defaults of the one-factor model.

    The defaults and those in ``presets`` are fixed values."""

    config_id: str = "default"
    model: str = "one_factor"
    rho: float = 0.98
    sigma_z: float = 0.10
    mu: float = -3.5
    gamma: float = 0.0
    nu: float = 5.0
    n_particles: int = 512
    n_stein_steps: int = 5
    min_steps: int = 4
    max_steps: int = 12
    lik_offset: float = 0.45
    exact_gradient: bool = False
    svld: bool = True
    temperature: float = 1.0
    rmsprop_rho: float = 0.9
    rmsprop_eps: float = 1e-6
    step_size: float = 0.1
    annealing: bool = True
    n_anneal: int = 3
    adaptive_beta: bool = True
    mim: bool = True
    jump_prob: float = 0.05
    jump_scale: float = 5.0
    asymmetric_rho: bool = True
    rho_up: float = 0.98
    rho_down: float = 0.93
    guide: bool = True
    guide_preserving: bool = True
    guide_strength: float = 0.05
    adaptive_guide: bool = False
    guide_strength_max: float = 0.30
    guide_threshold: float = 1.0
    rejuvenation: bool = True
    rejuv_ksd: float = 0.30
    rejuv_prob: float = 0.30
    rejuv_blend: float = 0.30
    newton: bool = False
    full_newton: bool = False
    heun: bool = False
    guided: bool = False
    guided_base: float = 0.0
    guided_shock: float = 0.5
    guided_threshold: float = 1.5
    local_params: bool = False
    delta_rho: float = 0.02
    delta_sigma: float = 0.1
    adaptive_mu: bool = False
    mu_process_var: float = 0.001
    mu_obs_scale: float = 10.0
    mu_min: float = -6.0
    mu_max: float = -1.0
    adaptive_sigma: bool = False
    sigma_threshold: float = 1.0
    sigma_boost_max: float = 3.0
    paper_sign: bool = False
    fan: bool = False
    t_state: bool = False
    nu_state: float = 5.0
    smoothing: bool = False
    smooth_lag: int = 3
    smooth_output_lag: int = 1
    ksd_compat: bool = False
    antithetic: bool = False
    # two-factor
    rho_fast: float = 0.90
    sigma_fast: float = 0.15
    rho_slow: float = 0.99
    sigma_slow: float = 0.05
    bw_floor_fast: float = 0.01
    bw_floor_slow: float = 0.05
    two_factor_guided: bool = False
    # joint state and parameters
    step_h: float = 0.15
    step_mu: float = 0.005
    step_rho: float = 0.002
    step_sigma: float = 0.03
    diffusion_mu: float = 0.005
    diffusion_rho: float = 0.0005
    diffusion_sigma: float = 0.002
    collapse_mu: float = 0.05
    collapse_rho: float = 0.02
    collapse_sigma: float = 0.02
    mu_prior_mean: float = -3.5
    mu_prior_var: float = 10.0
    rho_prior_mean: float = 2.0
    rho_prior_var: float = 5.0
    sigma_prior_mean: float = -2.0
    sigma_prior_var: float = 5.0
    prior_weight: float = 0.05


def log_norm(nu: float) -> float:
    """Log normaliser of the Student-t density."""
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu)


def implied_offset(nu: float) -> float:
    """-E[ln t^2] with the three-term digamma (other branch below nu = 2)."""
    half = nu / 2
    psi = math.log(half) - 1 / (2 * half) - 1 / (12 * half * half) if half >= 1 else -0.5772156649 - 1 / half
    return -(math.log(nu) + PSI_HALF - psi)


def stationary_var(cfg: FilterConfig) -> float:
    base = cfg.sigma_z**2 / (1 - cfg.rho**2 + 1e-6)
    if not cfg.t_state:
        return base
    nu = max(cfg.nu_state, 2.5)
    return nu / (nu - 2) * base


def presets() -> list[FilterConfig]:
    """Named configurations (fixed values): library default, wrapper default, two scales, joint, two-factor, documented best."""
    wrapper = FilterConfig(
        "wrapper", nu=30.0, lik_offset=0.345, temperature=0.45, n_anneal=5, jump_prob=0.25, jump_scale=9.0,
        rejuv_ksd=0.05, newton=True, full_newton=True, exact_gradient=True, min_steps=8, max_steps=16, guided=True,
        guided_shock=0.40, adaptive_guide=True, adaptive_mu=True, mu_obs_scale=11.0, mu_min=-4.0,
        adaptive_sigma=True, sigma_threshold=0.95, sigma_boost_max=3.2,
    )
    inertial = replace(
        wrapper, config_id="inertial", nu=5.0, lik_offset=0.35, n_anneal=3, n_particles=1024, n_stein_steps=8,
        rejuv_ksd=0.30,
    )
    reactive = FilterConfig(
        "reactive", rho=0.92, sigma_z=0.18, rho_up=0.94, rho_down=0.88, jump_prob=0.30, jump_scale=10.0, guide=False,
        temperature=0.55, annealing=False, n_anneal=1, exact_gradient=True, lik_offset=0.35, min_steps=2, max_steps=5,
        n_particles=256, n_stein_steps=3, delta_rho=0.0, delta_sigma=0.0,
    )
    best = FilterConfig(
        "best", nu=30.0, rho_up=0.99, rho_down=0.92, guided=True, adaptive_mu=True, mu_obs_scale=11.5, mu_min=-4.0,
        adaptive_guide=True, lik_offset=0.70, adaptive_sigma=True,
    )
    return [
        FilterConfig(),
        wrapper,
        reactive,
        inertial,
        FilterConfig("two_factor", model="two_factor"),
        FilterConfig("joint", model="joint", nu=30.0, lik_offset=0.10),
        best,
    ]


def configs_frame(spark: SparkSession, configs: list[FilterConfig]) -> DataFrame:
    """The configuration table; the dataclass fields are its columns."""
    kinds = {"str": "string", "float": "double", "int": "int", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(FilterConfig))
    return spark.createDataFrame([tuple(asdict(c).values()) for c in configs], schema)


def config_column(configs: list[FilterConfig], names: list[str]) -> Column:
    """The configurations as a literal array of structs: exploding it pairs every row with every configuration
    without a join. The list is given by the caller, so its size is known."""
    rows = [F.struct(*[F.lit(getattr(c, n)).alias(n) for n in names]) for c in configs]
    return F.array(*rows)


def with_configs(df: DataFrame, configs: list[FilterConfig], names: list[str]) -> DataFrame:
    """Every row with every configuration (J2)."""
    return df.select("*", F.inline(config_column(configs, names)))
