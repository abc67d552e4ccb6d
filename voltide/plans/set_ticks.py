"""Ticks of the sets that a task holds: blocks of state rows as numpy arrays, a row per set.

Scalars of a row are arrays of the block's length; h, h_prev and v have a row of particles each. Limits treat NaN as Spark's
do: greatest keeps it, least passes over it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from voltide.functions.config import H_MAX, H_MIN, OBS_VAR, FilterConfig, implied_offset, log_norm, stationary_var
from voltide.operators.cells import CELL, Cells, bent_excess, gauss, gauss_fields, gauss_slope, imq, imq_bent, imq_mixed, imq_slope, pair_sums
from voltide.plans.cross_section import stage_plan

PARTICLES = ["h", "h_prev", "v"]
SCALARS = ["t", "h_bar", "g_mean", "g_var", "ema", "bw_sq", "vol_prev", "ksd_prev", "y_prev", "mu_state", "mu_var"]
ESTIMATES = ["t", "loglik_predictive", "loglik_filtered", "vol", "vol_std", "h_mean", "bandwidth", "ksd", "stein_steps", "guide_mean", "guide_var", "ess", "mu_state"]


# --- draws: the numbers of fn.uniform_noise and fn.normal_noise -------------------------------------------------------------

# The constants of MD5.
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MESSAGES = 1 << 14  # messages hashed at once


def _md5_words(words: list[np.ndarray | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of n messages of one block each, given as sixteen words (None: zero)."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        turn = k // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[k]
        word = words[(k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16]
        if word is not None:
            f += word
        by = _TURNS[turn][k % 4]
        np.left_shift(f, np.uint32(by), out=g)
        f >>= np.uint32(32 - by)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a, b


@lru_cache(maxsize=256)
def _ends(tails: tuple[bytes, ...], size: int) -> np.ndarray:
    """The words of the one block that each tail ends, after a head of that size."""
    return np.frombuffer(b"".join((b"\0" * size + x + b"\x80").ljust(56, b"\0") + (8 * (size + len(x))).to_bytes(8, "little") for x in tails), "<u4").reshape(-1, 16)


@lru_cache(maxsize=256)
def _tails(many: int, role: str, ends: tuple[str, ...]) -> tuple[bytes, ...]:
    return tuple(f"{i}/{role}{x}".encode() for x in ends for i in range(many))


def hashed_uniforms(heads: list[bytes], tails: tuple[bytes, ...]) -> np.ndarray:
    """Uniform of the text head + tail for all pairs, a row per head: the first 52 bits of its MD5."""
    out = np.empty((len(heads), len(tails)))
    sizes = np.array([len(x) for x in heads])
    longest = max(map(len, tails))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if size + longest > 55:  # more than one block
            for r in rows:
                out[r] = [int(hashlib.md5(heads[r] + x).hexdigest()[:13], 16) for x in tails]
            continue
        ends = _ends(tails, size)
        for at in range(0, len(rows), max(1, MESSAGES // len(tails))):
            some = rows[at : at + max(1, MESSAGES // len(tails))]
            starts = np.frombuffer(b"".join(heads[r].ljust(64, b"\0") for r in some), "<u4").reshape(-1, 16)
            words = []
            for k in range(16):
                if not ends[:, k].any():
                    words.append(np.repeat(starts[:, k], len(tails)) if starts[:, k].any() else None)
                else:
                    words.append((starts[:, None, k] | ends[None, :, k]).ravel())
            a, b = (x.byteswap().astype(float) for x in _md5_words(words, len(some) * len(tails)))
            out[some] = (a * 2.0**20 + np.floor(b / 2.0**12)).reshape(len(some), -1)
    return (out + 0.5) / float(1 << 52)


@dataclass(frozen=True)
class Draws:
    """Draws of n particles by series and tick; ``antithetic``: the second half mirrors the first, (u, 1 - u) and (z, -z)."""

    seed: int
    n: int
    antithetic: bool = False

    def _hashed(self, heads: list[bytes], role: str, ends: tuple[str, ...]) -> list[np.ndarray]:
        own = self.n - self.n // 2 if self.antithetic else self.n
        u = hashed_uniforms(heads, _tails(own, role, ends))
        return [u[:, k * own : (k + 1) * own] for k in range(len(ends))]

    def heads(self, names: list[str], t: np.ndarray) -> list[bytes]:
        """What the texts of the draws of each row start with."""
        return [f"{self.seed}/{name}/{k}/".encode() for name, k in zip(names, t.tolist())]

    def uniform(self, heads: list[bytes], role: str) -> np.ndarray:
        """A row of uniforms per head; ``role`` names the draw, its stage and its iteration."""
        (u,) = self._hashed(heads, role, ("",))
        return np.concatenate([u, 1 - u[:, : self.n // 2]], 1) if self.antithetic else u

    def normal(self, heads: list[bytes], role: str) -> np.ndarray:
        u, v = self._hashed(heads, role, ("/a", "/b"))
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        return np.concatenate([z, -z[:, : self.n // 2]], 1) if self.antithetic else z


def tick_roles(cfg: FilterConfig) -> list[str]:
    """The draws of a tick that no state decides on: of series, tick and particle only."""
    moves = [f"move:{stage}:{it}" for stage, top in enumerate(stage_plan(cfg)) for it in range(top)] if cfg.svld and cfg.temperature > 1e-6 else []
    return ["state:0:0", *(["jump:0:0"] if cfg.guided or cfg.mim else []), *moves]


def draw_role(draws: Draws, heads: list[bytes], role: str) -> np.ndarray:
    return draws.uniform(heads, role) if role.startswith(("jump", "rej_u")) else draws.normal(heads, role)


# --- moves of sets ---------------------------------------------------------------------------------------------------------

PAIRS = 1 << 15  # pairs of a tile: its arrays stay in the processor's cache


def _tiles(sets: int, n: int) -> Iterator[tuple[slice, slice]]:
    """Sets and particles of the tiles of all pairs."""
    many, part = max(1, PAIRS // (n * n)), max(1, min(n, PAIRS // n))
    for s in range(0, sets, many):
        for i in range(0, n, part):
            yield slice(s, s + many), slice(i, i + part)


def _sums(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums over each row of k with every column of x: of a large set one column at a time, which is faster there."""
    if k.shape[2] < 64:
        return np.matmul(k, x)
    return np.concatenate([np.matmul(k, np.ascontiguousarray(x[:, :, c, None])) for c in range(x.shape[2])], 2)


SMALLEST = 45.0  # a share of e^-45 of the largest one, 3e-20, and less does not change the sum of a set in doubles


def _near_prior(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Score of one large set: only means as near that their shares count in a double, which are neighbours once sorted."""
    order, c = np.argsort(x), np.sort(c)
    x = x[order]
    at = np.searchsorted(c, x)
    top = np.minimum(np.abs(x - c[np.maximum(at - 1, 0)]), np.abs(x - c[np.minimum(at, len(c) - 1)])) ** 2
    reach = np.sqrt(SMALLEST + top)
    low, high = np.searchsorted(c, x - reach), np.searchsorted(c, x + reach, "right")
    score = np.empty_like(x)
    for k in range(0, len(x), 32):
        i, j = slice(k, k + 32), slice(low[k : k + 32].min(), high[k : k + 32].max())
        e = x[i, None] - c[j]
        e *= e
        np.subtract(top[i, None], e, out=e)
        w = np.exp(e, out=e).sum(1)
        score[order[i]] = (e @ c[j] - w * x[i]) / (w + 1e-8)
    return score


LARGE = 128  # particles of a set from which on its pairs are summed by cells
PAIR_CELLS, MEAN_CELLS = 32, 128  # cells of such a set at most: others, widely scattered, take pair by pair
EDGE = 2  # cells beyond the outermost means


def _in_order(x: np.ndarray) -> np.ndarray:
    """Flat places of the values of each row in order."""
    return np.argsort(x, 1) + x.shape[1] * np.arange(len(x))[:, None]


def _spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each row."""
    low = np.floor(x.min(1))
    return low, np.floor(x.max(1)) - low + 1


class Prior:
    """The Gaussian mixture over the prior means m of large sets: made once a tick, asked for at each move."""

    def __init__(self, m: np.ndarray, sigma: np.ndarray) -> None:
        self.scale, self.mid = np.sqrt(0.5) / sigma / CELL, m.mean(1, keepdims=True)
        c = np.sort((m - self.mid) * self.scale, 1)
        low, cells = _spans(c)
        self.fits = cells + 2 * EDGE <= MEAN_CELLS
        self.low = np.where(self.fits, low - EDGE, 0)
        self.cells = int((cells + 2 * EDGE)[self.fits].max(initial=1))
        self.c = np.where(self.fits[:, None], c, 0.0)
        self.fields = gauss_fields(Cells(self.c, self.low, self.cells), [gauss, gauss_slope])
        self.m, self.sigma = m, sigma

    def score(self, h: np.ndarray, on: np.ndarray) -> np.ndarray:
        """The score of the sets ``on`` at every h. Where the shares add up to less than one, far from all means, they are
        summed relative to the nearest one."""
        x = (h - self.mid[on]) * self.scale[on]
        fits, low, c = self.fits[on] & np.isfinite(x).all(1), self.low[on, None], self.c[on]
        order = _in_order(x)
        x = np.where(fits[:, None], x.ravel()[order], low)
        share, slope = Cells(x, low[:, 0], self.cells).values(self.fields[:, on])
        far = (x < low) | (x >= low + self.cells) | (share < 1)
        apart = 2 * max(np.abs(x).max(), np.abs(c).max(), 1.0) * np.arange(len(x))[:, None] * 2
        at = np.searchsorted((c + apart).ravel(), (x + apart).ravel()).reshape(x.shape)
        first = c.shape[1] * np.arange(len(x))[:, None]
        ends = (np.clip(at - k, first, first + c.shape[1] - 1) for k in (0, 1))
        top = np.minimum(*(np.square(CELL * (x - c.ravel()[k])) for k in ends))
        score = -slope / (share + 1e-8 * np.exp(-np.minimum(top, 600.0)))
        rows, columns = np.nonzero(far & fits[:, None])
        for k in range(0, len(rows), 64):
            some = rows[k : k + 64], columns[k : k + 64]
            d = CELL * (x[some][:, None] - c[some[0]])
            e = np.exp(top[some][:, None] - d * d)
            score[some] = -np.einsum("ij,ij->i", e, d) / (e.sum(1) + 1e-8)
        out = np.empty_like(h)
        out.ravel()[order] = score
        out *= np.sqrt(2) / self.sigma[on]
        for k in np.flatnonzero(~fits):
            s = on[k]
            scale = CELL * self.scale[s]
            out[k] = _near_prior((h[k] - self.mid[s]) * scale, (self.m[s] - self.mid[s]) * scale) * np.sqrt(2) / self.sigma[s]
        return out


def _prior(h: np.ndarray, m: np.ndarray, sigma: np.ndarray, cfg: FilterConfig, large: Prior | None = None, on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, its derivative) of the mixture over all prior means m at every h. ``large``: the Prior of the block of which
    these are the sets ``on``."""
    score, hess = np.empty_like(h), np.empty_like(h)
    if cfg.t_state:
        n1 = cfg.nu_state + 1
        for s, i in _tiles(*h.shape):
            ns, d = (cfg.nu_state * sigma[s] * sigma[s])[:, :, None], h[s, i, None] - m[s, None, :]
            q = d * d
            e = -0.5 * n1 * np.log1p(q / ns)
            r = np.exp(e - e.max(2, keepdims=True))
            den, w = ns + q, r.sum(2) + 1e-8
            score[s, i] = -n1 * (r * d / den).sum(2) / w
            hess[s, i] = -n1 * (r * (ns - q) / den**2).sum(2) / w
        return score, hess
    hess[:] = -1 / (sigma * sigma)
    if h.shape[1] >= LARGE:
        large, on = (Prior(m, sigma), np.arange(len(h))) if large is None else (large, on)
        return large.score(h, on), hess
    scale, mid = np.sqrt(0.5) / sigma, m.mean(1, keepdims=True)
    x, c = (h - mid) * scale, (m - mid) * scale
    sides = np.stack([np.ones_like(c), c], 2)
    for s, i in _tiles(*h.shape):
        e = x[s, i, None] - c[s, None, :]
        e *= e
        np.subtract(e.min(2, keepdims=True), e, out=e)
        of = _sums(np.exp(e, out=e), sides[s])
        score[s, i] = (of[:, :, 1] - of[:, :, 0] * x[s, i]) / (of[:, :, 0] + 1e-8)
    score *= np.sqrt(2) / sigma
    return score, hess


def _scored(h: np.ndarray, m: np.ndarray, y: np.ndarray, sigma: np.ndarray, beta: np.ndarray, cfg: FilterConfig, *large) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, curvature, log-weight) of every particle of every set; y, sigma and beta are columns."""
    prior, hess = _prior(h, m, sigma, cfg, *large)
    a = y * y / (np.exp(np.minimum(h, 20.0)) + 1e-8) / cfg.nu
    lik = -0.5 + 0.5 * (cfg.nu + 1) * a / (1 + a) - cfg.lik_offset if cfg.exact_gradient else (np.log(y * y + 1e-10) - h + cfg.lik_offset) / 1.4
    score = np.clip(prior + (1.0 if cfg.fan else beta) * lik, -10, 10)
    curv = np.clip(0.5 * (cfg.nu + 1) * a / (1 + a) ** 2 - hess, 0.1, 100) if cfg.newton else np.ones_like(h)
    log_w = np.zeros_like(h) if cfg.fan else log_norm(cfg.nu) - 0.5 * h - (cfg.nu + 1) * 0.5 * np.log1p(a)
    return score, curv, log_w


def _limited(phi: np.ndarray, h_sum: np.ndarray, k_sum: np.ndarray) -> np.ndarray:
    """The direction divided by the kernel's mean of the curvature."""
    return phi / np.clip(h_sum / np.maximum(k_sum, 1e-6), 0.1, 100) * 0.7


def _direction_by_cells(x: np.ndarray, score: np.ndarray, curv: np.ndarray, width: np.ndarray, cfg: FilterConfig, parts: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """``_direction`` of large sets whose x span few cells."""
    order, (low, cells) = _in_order(x), _spans(x)
    full, newton = cfg.newton and cfg.full_newton, cfg.newton and not cfg.full_newton and not cfg.heun
    x, s, c = (a.ravel()[order] for a in (x, score, curv))
    wanted = [(imq, s), (imq_slope, None)]
    wanted += [(imq, None), (imq, c), (imq_bent, None)] if full else [(imq, 0.7 * s / c), (imq_slope, 1 / c)] if newton else []
    wanted += [(imq_slope, s), (imq_mixed, None)] if parts else []
    sums = pair_sums(Cells(x, low, -(-int(cells.max()) // 4) * 4), wanted)
    k_s, g_sum = sums[0], sums[1] / width
    sign = 1.0 if cfg.paper_sign or cfg.fan else -1.0
    phi = (k_s + sign * g_sum) / x.shape[1]
    if full:
        phi = _limited(phi, sums[3] + 2 / (width * width) * (sums[4] + bent_excess(x)), sums[2])
    elif newton:
        phi = (sums[2] + sign * sums[3] / width) / x.shape[1]
    out = np.empty_like(phi)
    out.ravel()[order] = phi
    if not parts:
        return out, None
    u_base = s * k_s + s * g_sum - sums[-2] / width
    return out, (u_base + (-1.0 if cfg.ksd_compat else 1.0) * 2 / (width * width) * sums[-1]).sum(1)


def _direction(h: np.ndarray, score: np.ndarray, curv: np.ndarray, width: np.ndarray, cfg: FilterConfig, parts: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(transport direction, with ``parts`` the sum of each set's discrepancy shares).

    With x = h / width and the kernel k = 1 / (1 + (x_i - x_j)^2), its gradient 2 / width * (x_i - x_j) * k^2 sums up from
    sums with k^2, and (x_i - x_j)^2 * k is 1 - k."""
    n = h.shape[1]
    x = (h - h.mean(1, keepdims=True)) / width
    if n >= LARGE:
        few = (_spans(x)[1] <= PAIR_CELLS) & np.isfinite(score).all(1)
        if few.all():
            return _direction_by_cells(x, score, curv, width, cfg, parts)
        if few.any():
            phi, total = np.empty_like(h), np.empty(len(h)) if parts else None
            for some, by in ((few, lambda k: _direction_by_cells(x[k], score[k], curv[k], width[k], cfg, parts)), (~few, lambda k: _direction_by_pairs(h[k], x[k], score[k], curv[k], width[k], cfg, parts))):
                phi[some], part = by(some)
                if parts:
                    total[some] = part
            return phi, total
    return _direction_by_pairs(h, x, score, curv, width, cfg, parts)


def _direction_by_pairs(h: np.ndarray, x: np.ndarray, score: np.ndarray, curv: np.ndarray, width: np.ndarray, cfg: FilterConfig, parts: bool) -> tuple[np.ndarray, np.ndarray | None]:
    n = h.shape[1]
    full, newton = cfg.newton and cfg.full_newton, cfg.newton and not cfg.full_newton and not cfg.heun
    one = np.ones_like(x)
    near = np.stack([score, *([one, curv] if full else [0.7 * score / curv] if newton else [])], 2)
    far = np.stack([one, x, *([1 / curv, x / curv] if newton else []), *([score, x * score] if parts else [])], 2)
    k_of, k2_of = np.empty(near.shape), np.empty(far.shape)
    bent, cubes = (np.empty_like(x) if full else None), (np.empty_like(x) if parts else None)
    for s, i in _tiles(*x.shape):
        k = x[s, i, None] - x[s, None, :]
        k *= k
        k += 1
        np.reciprocal(k, out=k)
        k_of[s, i] = _sums(k, near[s])
        k2 = k * k
        k2_of[s, i] = _sums(k2, far[s])
        if parts:
            cubes[s, i] = np.einsum("sij,sij->si", k, k2)
        if full:
            bent[s, i] = np.abs(3 * k - 4 * k2).sum(2)
    of_grad = lambda at: 2 / width * (x * k2_of[:, :, at] - k2_of[:, :, at + 1])
    k_s, g_sum = k_of[:, :, 0], of_grad(0)
    sign = 1.0 if cfg.paper_sign or cfg.fan else -1.0
    phi = (k_s + sign * g_sum) / n
    if full:
        h_sum = k_of[:, :, 2] + 2 / (width * width) * bent
        phi = _limited(phi, h_sum, k_of[:, :, 1])
    elif newton:
        phi = (k_of[:, :, 1] + sign * of_grad(2)) / n
    if not parts:
        return phi, None
    u_base = score * k_s + score * g_sum - of_grad(far.shape[2] - 2)
    u_cross = 2 / (width * width) * (4 * cubes - 3 * k2_of[:, :, 0])
    return phi, (u_base + (-1.0 if cfg.ksd_compat else 1.0) * u_cross).sum(1)


def _clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(x, H_MIN, H_MAX)


def move_sets(h, v, m, noise: Callable | None, y, sigma, width, betas, todo, cfg: FilterConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All Stein moves of a block of sets at one tick: ``todo`` iterations in each annealing stage of ``betas``. Arguments
    have a row per set; noise gives the draws of a stage, an iteration and some rows. A set that has fewer iterations than
    others rests meanwhile."""
    y, sigma, width = (x[:, None] for x in (y, sigma, width))
    h, v, log_w, total = h.copy(), v.copy(), np.zeros_like(h), np.zeros(len(h))
    large = Prior(m, sigma) if h.shape[1] >= LARGE and not cfg.t_state else None
    for stage in range(betas.shape[1]):
        last = stage == betas.shape[1] - 1
        for it in range(int(todo[:, stage].max(initial=0))):
            on = np.flatnonzero(todo[:, stage] > it)
            ends = last and bool((todo[on, stage] == it + 1).any())
            h_, v_, m_, y_, s_, w_, beta = h[on], v[on], m[on], y[on], sigma[on], width[on], betas[on, stage, None]
            e = cfg.step_size * (0.5 if cfg.guide else 1.0) * np.sqrt(beta)
            score, curv, lw = _scored(h_, m_, y_, s_, beta, cfg, large, on)
            phi, parts = _direction(h_, score, curv, w_, cfg, ends and not cfg.heun)
            if cfg.heun:
                ahead = _clamp(h_ + e * phi / np.sqrt(v_ + cfg.rmsprop_eps))
                score, curv, lw = _scored(ahead, m_, y_, s_, beta, cfg, large, on)
                other, parts = _direction(ahead, score, curv, w_, cfg, ends)
                phi = 0.5 * (phi + other)
            v_ = cfg.rmsprop_rho * v_ + (1 - cfg.rmsprop_rho) * phi * phi
            kick = np.sqrt(2 * e * cfg.temperature) * noise(stage, it, on) if noise is not None else 0.0
            h[on], v[on], log_w[on] = _clamp(h_ + e * phi / np.sqrt(v_ + cfg.rmsprop_eps) + kick), v_, lw
            if ends:
                done = todo[on, stage] == it + 1
                total[on[done]] = parts[done]
    return h, v, log_w, total


# --- one tick of a block ---------------------------------------------------------------------------------------------------

def _stages(cfg: FilterConfig, ksd: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Temper and number of iterations of each annealing stage of the rows."""
    stages = len(stage_plan(cfg))
    ramp = np.where(ksd > 0.5, 0.3, np.where(ksd < 0.05, 0.8, 0.3 + (0.5 - ksd) / 0.45 * 0.5))
    betas, todo = [], []
    for stage in range(stages):
        last = stage == stages - 1
        if not cfg.annealing or cfg.adaptive_beta and last:
            beta = 1.0
        elif cfg.adaptive_beta:
            beta = np.maximum(0.1, np.fmin(1.0, ramp * (0.5 + 0.5 * (stage + 1) / stages)))
        else:
            beta = (0.3, 0.65, 1.0)[stage % 3]
        per = budget // stages
        betas.append(np.broadcast_to(beta, ksd.shape))
        todo.append(budget - per * (stages - 1) if last else per)
    return np.stack(betas, 1), np.stack(todo, 1)


def _log_mean_exp(lw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = lw.max(1, keepdims=True)
    w = np.exp(lw - top)
    return top[:, 0] + np.log(np.maximum(w.mean(1), 1e-10)), w


def tick(s: dict[str, np.ndarray], y: np.ndarray, names: list[str], cfg: FilterConfig, draws: Draws, given: dict[str, np.ndarray] | None = None
         ) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(state after the tick, estimates) of the rows of state s with the returns y. ``given``: the draws of tick_roles."""
    n, t, off = cfg.n_particles, s["t"], implied_offset(cfg.nu)
    col = lambda x: x[:, None]
    heads: list[bytes] = []

    def drawn(role: str, some: np.ndarray | None = None) -> np.ndarray:
        if given is not None and role in given:
            return given[role] if some is None else given[role][some]
        heads[:] = heads or draws.heads(names, t)
        return draw_role(draws, heads if some is None else [heads[k] for k in some], role)

    # scalars: guide, effective noise, step budget
    mu, rho, sigma_z, ay = s["mu_state"] if cfg.adaptive_mu else s["mu"], s["rho"], s["sigma_z"], np.abs(y)
    vol = np.maximum(s["vol_prev"], 1e-4)
    rz = ay / vol
    sev = lambda thr: np.where(rz > thr, np.fmin((rz - thr) / 3, 1.0), 0.0)
    sigma = np.where(t > 0, sigma_z * (1 + (cfg.sigma_boost_max - 1) * sev(cfg.sigma_threshold)), sigma_z) if cfg.adaptive_sigma else sigma_z
    log_y2 = np.log(y * y + 1e-8) + off
    pp = rho * rho * s["g_var"] + sigma_z * sigma_z
    mp = mu + rho * (s["g_mean"] - mu)
    gain = pp / (pp + OBS_VAR + 1e-8)
    g_mean, g_var = mp + gain * (log_y2 - mp), (1 - gain) * pp
    strength = np.full(len(y), cfg.guide_strength)
    if cfg.adaptive_guide:
        rise = (log_y2 - np.log(vol * vol + 1e-8) > 0) & (t > 0)
        strength += (cfg.guide_strength_max - cfg.guide_strength) * np.where(rise, sev(cfg.guide_threshold), 0.0)
    x = np.maximum(0.0, np.fmin(1.0, (s["ksd_prev"] - 0.05) / 0.45))
    budget = np.where(t < 10, cfg.max_steps, cfg.min_steps + np.floor(x * (cfg.max_steps - cfg.min_steps))).astype(np.int32)

    # prediction and guide
    h, h_bar = s["h"], col(s["h_bar"])
    pull = lambda r: col(mu) + r * (h - col(mu)) + cfg.gamma * col(s["y_prev"]) / (np.exp(np.minimum(h / 2, 20.0)) + 1e-8)
    m, z = pull(col(rho)), drawn("state:0:0")
    if cfg.guided or cfg.mim:
        up, down = (cfg.rho_up, cfg.rho_down) if cfg.asymmetric_rho else (col(rho), col(rho))
        local, noise = np.where(h > s["h_prev"], up, down), col(sigma)
        if cfg.local_params:
            local, noise = local + cfg.delta_rho * np.tanh(h - h_bar), noise * (1 + cfg.delta_sigma * np.abs(h - h_bar))
        mean = pull(np.fmin(np.maximum(local, 0.0), 0.999))
        noise = noise * np.where(drawn("jump:0:0") < cfg.jump_prob, cfg.jump_scale, 1.0) * z
        if cfg.guided:
            implied = col(np.maximum(np.log(y * y + 1e-10) + off, -5.0))
            zs = (implied - mean) / 2.5
            act = np.where(zs > cfg.guided_threshold, np.tanh(zs - cfg.guided_threshold), 0.0)
            alpha = cfg.guided_base + (cfg.guided_shock - cfg.guided_base) * act
            mean = (1 - alpha) * mean + alpha * implied
        h_pred = _clamp(mean + noise)
    else:
        h_pred = _clamp(m + col(sigma) * z)
    start = h_pred
    if cfg.guide:
        k, g = col(strength), col(g_mean)
        start = _clamp((1 - k) * h_bar + k * g + (h_pred - h_bar)) if cfg.guide_preserving else _clamp(h_pred + k * (g - h_pred))

    # bandwidth
    raw = np.maximum(2 * start.var(1) / math.log(n + 1.0), 1e-6)
    ema = np.where(s["ema"] > 0, 0.05 * ay + 0.95 * s["ema"], ay)
    sq = np.where(s["bw_sq"] > 0, 0.3 * raw + 0.7 * s["bw_sq"], raw)
    big = np.maximum(ay / np.maximum(ema, 1e-8), np.fmin((start.max(1) - start.min(1)) * 0.5, 2.0))
    bw_sq = sq * np.maximum(0.5, np.fmin(1.0, 1 - 0.25 * np.fmin(big - 1, 2.0)))
    width = np.maximum(0.01, np.fmin(2.0, np.sqrt(bw_sq)))

    # moves and rejuvenation
    kicks = (lambda stage, it, on: drawn(f"move:{stage}:{it}", on)) if cfg.svld and cfg.temperature > 1e-6 else None
    moved, v, log_w, total = move_sets(start, s["v"], m, kicks, y, sigma, width, *_stages(cfg, s["ksd_prev"], budget), cfg)
    if cfg.rejuvenation and cfg.guide:
        some = np.flatnonzero((t > 10) & (s["ksd_prev"] > cfg.rejuv_ksd))
        if len(some):
            fresh = col(g_mean[some]) + col(np.sqrt(np.maximum(g_var[some], 1e-6))) * drawn("rej_z:0:0", some)
            mixed = _clamp((1 - cfg.rejuv_blend) * moved[some] + cfg.rejuv_blend * fresh)
            moved[some] = np.where(drawn("rej_u:0:0", some) < cfg.rejuv_prob, mixed, moved[some])

    # estimates
    vols, h_mean = np.exp(np.minimum(moved / 2, 20.0)), moved.mean(1)
    a = col(y * y) / (np.exp(np.minimum(h_pred, 20.0)) + 1e-8) / cfg.nu
    predictive, _ = _log_mean_exp(log_norm(cfg.nu) - 0.5 * h_pred - (cfg.nu + 1) * 0.5 * np.log1p(np.maximum(a, -0.999)))
    filtered, w = _log_mean_exp(log_w)
    ksd, vol_new, sum_w = np.sqrt(np.maximum(total / (n * n), 0.0)), vols.mean(1), w.sum(1)
    est = {"t": t, "loglik_predictive": predictive, "loglik_filtered": filtered, "vol": vol_new, "vol_std": vols.std(1), "h_mean": h_mean, "bandwidth": width,
           "ksd": ksd, "stein_steps": budget, "guide_mean": g_mean, "guide_var": g_var, "ess": sum_w * sum_w / ((w * w).sum(1) + 1e-10), "mu_state": mu,
           "h": moved, "log_w": log_w}
    new = s | {"t": t + 1, "h": moved, "h_prev": h, "v": v, "h_bar": h_mean, "g_mean": g_mean, "g_var": g_var, "ema": ema, "bw_sq": bw_sq, "vol_prev": vol_new,
               "ksd_prev": ksd, "y_prev": y}
    if cfg.adaptive_mu:
        pv, on = s["mu_var"] + cfg.mu_process_var, t > 10
        k = pv / (pv + cfg.mu_obs_scale * width * width + 1e-8)
        level = np.fmin(np.maximum(s["mu_state"] + k * (h_mean - s["mu_state"]), cfg.mu_min), cfg.mu_max)
        new |= {"mu_state": np.where(on, level, s["mu_state"]), "mu_var": np.where(on, (1 - k) * pv, s["mu_var"])}
    return new, est


# --- rows of a task --------------------------------------------------------------------------------------------------------

def _lists(x: np.ndarray) -> pa.Array:
    """The rows of an array as a list column."""
    rows, n = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * n, n, dtype=np.int32)), pa.array(x.ravel()))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _block(cfg: FilterConfig) -> int:
    """Rows of a block."""
    return max(16, min(512, 8192 // cfg.n_particles))


@dataclass(frozen=True)
class Tick:
    """The ticks of a run as a function of the rows of a task."""

    cfg: FilterConfig
    draws: Draws
    emit_particles: bool = False

    def advance(self, rows: pa.RecordBatch, ticks: int) -> pa.RecordBatch:
        """State rows with name and ys, where given draws (of each return the roles of tick_roles), after up to ``ticks``
        ticks, and ests, an estimate per tick."""
        cfg, n, size = self.cfg, self.cfg.n_particles, rows.num_rows
        at = {c: rows.schema.get_field_index(c) for c in rows.schema.names}
        flat = lambda c: _numbers(rows.column(at[c]).flatten())
        s = {c: flat(c).reshape(size, n) for c in PARTICLES} | {c: _numbers(rows.column(at[c])) for c in ("rho", "sigma_z", "mu", *SCALARS)}
        names = rows.column(at["name"]).to_pylist()
        ys, lengths = flat("ys"), _numbers(rows.column(at["ys"]).value_lengths())
        first, roles = np.cumsum(lengths) - lengths, tick_roles(cfg)
        given = flat("draws").reshape(-1, len(roles), n) if "draws" in at else None
        kinds = [*ESTIMATES, *(["h", "log_w"] if self.emit_particles else [])]
        ests: list[tuple[np.ndarray, dict]] = []
        for j in range(ticks):
            on = np.flatnonzero(lengths > j)
            if not len(on):
                break
            whole = len(on) == size
            old = s if whole else {c: x[on] for c, x in s.items()}
            some = None if given is None else {role: given[first[on] + j, k] for k, role in enumerate(roles)}
            new, est = tick(old, ys[first[on] + j], names if whole else [names[k] for k in on], cfg, self.draws, some)
            if not whole:
                s = {c: x.copy() for c, x in s.items()}
                for c, x in new.items():
                    s[c][on] = x
            else:
                s = new
            ests.append((on, {c: est[c] for c in kinds}))
        order = np.argsort(np.concatenate([on for on, _ in ests]), kind="stable") if ests else np.empty(0, int)
        fields = []
        for c in kinds:
            x = np.concatenate([e[c] for _, e in ests])[order] if ests else np.empty((0, n) if c in ("h", "log_w") else 0)
            x = x.astype({"t": np.int64, "stein_steps": np.int32}.get(c, float))
            fields.append(_lists(x) if x.ndim == 2 else pa.array(x))
        ends = np.concatenate([[0], np.cumsum(np.minimum(lengths, ticks))]).astype(np.int32)
        out = {c: rows.column(at[c]) for c in ("series_id", "config_id")}
        out |= {c: _lists(s[c]) if c in PARTICLES else pa.array(s[c].astype(np.int64 if c == "t" else float)) for c in ("rho", "sigma_z", "mu", *PARTICLES, *SCALARS)}
        out["ests"] = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=kinds))
        return pa.RecordBatch.from_pydict(out)

    def rows(self, ticks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        block = _block(self.cfg)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    yield self.advance(batch.slice(at, block), ticks)

        return run


def cross_rows(cfg: FilterConfig, draws: Draws, columns: list[str], estimates: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One tick of the rows of a task, a row per series with y, name, the scalars and the set, which is drawn here where it is
    NULL: series_id and ``columns`` of the estimates or of the state after it."""
    n, block = cfg.n_particles, _block(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                size, names, y = rows.num_rows, rows.column("name").to_pylist(), _numbers(rows.column("y"))
                s = {c: _numbers(rows.column(c)).astype(np.int64 if c == "t" else float) for c in SCALARS if c in rows.schema.names}
                s |= {c: np.full(size, float(x)) for c, x in (("rho", cfg.rho), ("sigma_z", cfg.sigma_z), ("mu", cfg.mu), ("mu_state", cfg.mu), ("mu_var", 1.0))}
                new = np.flatnonzero(_numbers(rows.column("h").is_null()))
                old = np.setdiff1d(np.arange(size), new)
                for c in PARTICLES:
                    s[c] = np.zeros((size, n))
                    s[c][old] = _numbers(rows.column(c).flatten()).reshape(len(old), n)
                if len(new):
                    z = draws.normal(draws.heads([names[k] for k in new], np.full(len(new), -1)), "init:0:0")
                    s["h"][new] = s["h_prev"][new] = _clamp(cfg.mu + stationary_var(cfg) ** 0.5 * z)
                    s["h_bar"] = s["h_bar"].copy()
                    s["h_bar"][new] = s["h"][new].mean(1)
                after, est = tick(s, y, names, cfg, draws)
                out = est if estimates else after
                fields = {c: _lists(out[c]) if c in PARTICLES else pa.array(out[c].astype({"t": np.int64, "stein_steps": np.int32}.get(c, float))) for c in columns}
                yield pa.RecordBatch.from_pydict({"series_id": rows.column("series_id")} | fields)

    return run
