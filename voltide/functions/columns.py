"""Column expressions: returns, observation models, clamps, special functions, parameter transforms, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltide.functions.config import H_MAX, H_MIN, PSI_HALF

TRADING_DAYS = 252


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x, lo: float, hi: float) -> Column:
    """Limits x to [lo, hi]; NULL stays NULL and NaN stays NaN."""
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def clamp_h(x) -> Column:
    return clamp(x, H_MIN, H_MAX)


def at_most(x, hi: float) -> Column:
    """The smaller of x and hi; NULL stays NULL and NaN stays NaN (Spark's least skips NULL and ranks NaN highest)."""
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(x, F.lit(float(hi))))


def at_least(x, lo: float) -> Column:
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(x, F.lit(float(lo))))


def safe_exp(x) -> Column:
    return F.exp(at_most(x, 20.0))


def log_y2(y, eps: float = 1e-8) -> Column:
    y = _c(y)
    return F.log(y * y + F.lit(eps))


def implied_h(y, offset, eps: float = 1e-10, floor: float = -5.0) -> Column:
    return at_least(log_y2(y, eps) + _c(offset), floor)


def std_residual(y, h) -> Column:
    return _c(y) / (F.exp(_c(h) / 2) + F.lit(1e-8))


def lgamma(x) -> Column:
    """ln Gamma for x > 0: recurrence up to x + 10, then the Stirling series."""
    x = _c(x)
    s = x + 10
    shift = F.lit(0.0)
    for k in range(10):
        shift = shift + F.log(x + k)
    series = 1 / (12 * s) - 1 / (360 * s**3) + 1 / (1260 * s**5) - 1 / (1680 * s**7)
    return (s - 0.5) * F.log(s) - s + F.lit(0.9189385332046727) + series - shift


def digamma(x) -> Column:
    """Recurrence until the argument is at least 6, then the asymptotic series to the fourth order."""
    x = _c(x)
    total, arg = F.lit(0.0), x
    for k in range(6):
        low = (x + k) < 6
        total = total - F.when(low, 1 / (x + k)).otherwise(0.0)
        arg = F.when(low, x + (k + 1)).otherwise(arg)
    inv2 = 1 / (arg * arg)
    return total + F.log(arg) - 0.5 / arg - inv2 / 12 + inv2 * inv2 / 120


def t_log_norm(nu) -> Column:
    nu = _c(nu)
    return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * F.log(F.pi() * nu)


def t_implied_offset(nu) -> Column:
    half = _c(nu) / 2
    psi = F.when(half >= 1, F.log(half) - 1 / (2 * half) - 1 / (12 * half * half)).otherwise(-0.5772156649 - 1 / half)
    return -(F.log(_c(nu)) + F.lit(PSI_HALF) - psi)


def t_logpdf(y, h, nu, norm) -> Column:
    """Student-t log density of y with scale exp(h/2)."""
    y, h, nu = _c(y), _c(h), _c(nu)
    a = y * y / (safe_exp(h) + F.lit(1e-8)) / nu
    return _c(norm) - 0.5 * h - (nu + 1) * 0.5 * F.log1p(at_least(a, -0.999))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def constrain(family: str, rho, sigma, mu=None, nu=None) -> dict[str, Column]:
    """Unconstrained values to model parameters."""
    rho, sigma = _c(rho), _c(sigma)
    if family == "tanh":
        out = {"rho": F.tanh(rho), "sigma": F.exp(sigma)}
        if nu is not None:
            out["nu"] = 2 + F.exp(_c(nu))
    elif family == "sigmoid":
        out = {"rho": 0.999 * sigmoid(rho), "sigma": F.exp(sigma)}
    elif family == "joint":
        out = {"rho": sigmoid(rho), "sigma": F.greatest(F.exp(clamp(sigma, -20, 20)), F.lit(0.01))}
    elif family == "soft":
        out = {"rho": 0.5 + 0.499 * sigmoid(rho), "sigma": F.log1p(F.exp(sigma)) + 0.001}
    else:
        raise ValueError(f"unknown family {family!r}")
    if mu is not None:
        out["mu"] = _c(mu)
    return out


def unconstrain(family: str, rho, sigma, mu=None, nu=None) -> dict[str, Column]:
    rho, sigma = _c(rho), _c(sigma)
    if family == "tanh":
        r = clamp(rho, -0.999, 0.999)
        out = {"rho": 0.5 * F.log((1 + r) / (1 - r)), "sigma": F.log(F.greatest(sigma, F.lit(1e-8)))}
        if nu is not None:
            out["nu"] = F.log(F.greatest(_c(nu) - 2, F.lit(1e-8)))
    elif family == "sigmoid":
        p = rho / 0.999
        out = {"rho": F.log(p / (1 - p + 1e-8)), "sigma": F.log(sigma)}
    elif family == "joint":
        out = {"rho": F.log(rho / (1 - rho)), "sigma": F.log(sigma)}
    elif family == "soft":
        p = (rho - 0.5) / 0.499
        out = {"rho": F.log(p / (1 - p)), "sigma": F.log(F.exp(sigma - 0.001) - 1)}
    else:
        raise ValueError(f"unknown family {family!r}")
    if mu is not None:
        out["mu"] = _c(mu)
    return out


def chain_factors(rho, sigma, nu) -> dict[str, Column]:
    """Derivatives of the tanh family's parameters by their unconstrained values."""
    rho = _c(rho)
    return {"d_rho": 1 - rho * rho, "d_sigma": _c(sigma), "d_nu": _c(nu) - 2}


def stationary_variance(rho, sigma, t_state: bool = False, nu_state=5.0) -> Column:
    rho, sigma = _c(rho), _c(sigma)
    base = sigma * sigma / (1 - rho * rho + 1e-6)
    if not t_state:
        return base
    nu = F.greatest(_c(nu_state), F.lit(2.5))
    return nu / (nu - 2) * base


def collapse_two_factor(rho_f, sigma_f, rho_s, sigma_s) -> dict[str, Column]:
    """One-factor parameters with the same stationary variance."""
    rf, sf, rs, ss = _c(rho_f), _c(sigma_f), _c(rho_s), _c(sigma_s)
    vf, vs = sf * sf / (1 - rf * rf), ss * ss / (1 - rs * rs)
    rho = (rf * vf + rs * vs) / (vf + vs)
    return {"rho": rho, "sigma_z": F.sqrt((vf + vs) * (1 - rho * rho))}


# Status codes and names.
STATUS_NAMES = {
    0: "OK",
    200: "NAN_IN_PARTICLES",
    201: "NAN_IN_WEIGHTS",
    202: "NAN_IN_OUTPUT",
    203: "INF_IN_PARTICLES",
    204: "INF_IN_WEIGHTS",
    210: "PARTICLE_COLLAPSE",
    211: "WEIGHT_UNDERFLOW",
    212: "BANDWIDTH_ZERO",
    300: "INPUT_IS_NAN",
    301: "INPUT_IS_INF",
    302: "INPUT_EXTREME_VALUE",
    310: "PARAMS_INVALID",
    1000: "ESS_LOW",
    1001: "VOL_EXTREME",
    1002: "PARTICLES_CLUSTERED",
    1003: "GRAPH_RECAPTURE",
}
NULL_INPUT = 320
LATE_INPUT = 321


def input_status(y, max_return: float = 0.5) -> Column:
    """First matching input problem of a return; NULL has its own code."""
    y = _c(y)
    return (
        F.when(y.isNull(), NULL_INPUT)
        .when(F.isnan(y), 300)
        .when(F.abs(y) > 1e30, 301)
        .when(F.abs(y) > max_return, 302)
        .otherwise(0)
    )


def status_name(code) -> Column:
    names = STATUS_NAMES | {NULL_INPUT: "INPUT_IS_NULL", LATE_INPUT: "INPUT_LATE"}
    code = _c(code)
    out = F.lit("UNKNOWN_STATUS")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def is_error(code) -> Column:
    return (_c(code) > 0) & (_c(code) < 1000)


def is_warning(code) -> Column:
    return _c(code) >= 1000


def uniform_noise(seed: int, *parts: Column) -> Column:
    """Counter-based uniform in (0, 1): the first 52 bits of the md5 of seed and position, the same on every retry and
    partitioning, and in any SQL engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def normal_noise(seed: int, *parts: Column) -> Column:
    """Box-Muller from two counter-based uniforms."""
    u = uniform_noise(seed, *parts, F.lit("a"))
    v = uniform_noise(seed, *parts, F.lit("b"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def student_noise(seed: int, nu: float, *parts: Column) -> Column:
    """Student-t draw = normal * sqrt(k / chi2_k) with k = nu rounded (at least 3); normal above nu = 30."""
    z = normal_noise(seed, *parts, F.lit("z"))
    if nu > 30:
        return z
    k = max(int(nu + 0.5), 3)
    chi2 = F.lit(0.0)
    for j in range(k):
        chi2 = chi2 + F.pow(normal_noise(seed, *parts, F.lit(f"c{j}")), F.lit(2.0))
    return z * F.sqrt(F.lit(float(k)) / (chi2 + 1e-8))


# Rational approximation of erf (Abramowitz & Stegun 7.1.26).
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x) -> Column:
    x = _c(x)
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x) -> Column:
    return 0.5 * (1 + erf(_c(x) / F.sqrt(F.lit(2.0))))


def r6(x) -> Column:
    """Six decimals, no negative zero."""
    return F.round(_c(x), 6) + 0.0
