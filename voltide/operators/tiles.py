"""Sums over all pairs of a particle set without producing pair rows.

A set is cut into blocks of at most ``BLOCK`` particles held as arrays. Block pairs meet in an equi-join on (set key,
salt): the left blocks of a large set are spread over the salts and its right blocks go to every salt, so one huge set
uses many tasks. Each pair is reduced inside its task to one partial sum per particle, partial sums of the same left
block are added up within a batch, and a group-by merges the rest. A set that fits one block needs no join. Memory per
task is a batch of block pairs for any set size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.session import group_bound

BLOCK = 1024
PAIRS = 1 << 18  # pairs of particles that stacked blocks may have
Kernel = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, float], bool], dict[str, np.ndarray]]


def pairwise(df: DataFrame, keys: list[str], left: list[str], right: list[str], params: list[str], kernel: Kernel,
             fields: list[str], merge: str = "sum", index: str = "i", block: int = BLOCK,
             bound: int | None = None) -> DataFrame:
    """(keys, index, *fields): kernel sums over the whole set for every particle.

    ``merge='sum'`` adds partial sums; ``merge='logsum'`` treats the first field as a running maximum by which the
    others are scaled.
    """
    bound = group_bound(df, keys) if bound is None else bound
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cols = sorted(set(left) | set(right))
    row = F.struct(F.col(index).cast("long").alias("_i"), *[F.col(c).cast("double").alias(c) for c in cols])
    blocks = (
        df.select(*keys, *params, F.floor(F.col(index) / block).cast("long").alias("_b"), row.alias("_r"))
        .repartition(n, *keys, *(["_b"] if bound > block else []))
        .groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_r")).alias("_r"),
                                  *[F.first(p).cast("double").alias(p) for p in params])
    )
    a = blocks.select(*keys, *params, "_b", F.col("_r._i").alias("_i"), *[F.col(f"_r.{c}").alias(f"a_{c}") for c in left])
    if bound > block:  # a set's blocks are copied once for each of its own salts, however large other sets are
        salts = blocks.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(4 * n)).alias("_n"))
        b = blocks.join(salts, keys).select(*keys, F.col("_b").alias("_b2"), *[F.col(f"_r.{c}").alias(f"b_{c}") for c in right],
                                            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_s"))
        tiles = a.join(salts, keys).withColumn("_s", F.pmod("_b", "_n")).drop("_n").join(b, [*keys, "_s"])
    else:
        tiles = blocks.select(*keys, *params, "_b", F.col("_b").alias("_b2"), F.col("_r._i").alias("_i"),
                              *[F.col(f"_r.{c}").alias(f"a_{c}") for c in left],
                              *[F.col(f"_r.{c}").alias(f"b_{c}") for c in right])

    def reduce_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first: dict[tuple, int] = {}
            sums: list[dict[str, np.ndarray]] = []
            rows: list[int] = []
            for at, rec in enumerate(pdf.to_dict("records")):
                res = kernel({c: np.asarray(rec[f"a_{c}"], float) for c in left},
                             {c: np.asarray(rec[f"b_{c}"], float) for c in right},
                             {p: rec[p] for p in params}, rec["_b"] == rec["_b2"])
                slot = first.setdefault((*[rec[k] for k in keys], rec["_b"]), len(sums))
                if slot == len(sums):
                    sums.append(res)
                    rows.append(at)
                else:
                    sums[slot] = _merge(sums[slot], res, fields, merge)
            yield pdf.iloc[rows][[*keys, "_i"]].assign(**{f: [r[f] for r in sums] for f in fields})

    schema = T.StructType([tiles.schema[k] for k in keys] + [T.StructField("_i", T.ArrayType(T.LongType()))]
                          + [T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields])
    done = tiles.mapInPandas(reduce_tiles, schema)
    rows = done.select(*keys, F.inline(F.arrays_zip("_i", *fields)))
    rows = rows.withColumnRenamed("_i", index)
    if bound <= block:
        return rows
    if merge == "sum":
        return rows.groupBy(*keys, index).agg(*[F.sum(f).alias(f) for f in fields])
    top = rows.groupBy(*keys, index).agg(F.max(fields[0]).alias("_m"))
    w = F.exp(F.col(fields[0]) - F.col("_m"))
    return rows.join(top, [*keys, index]).groupBy(*keys, index).agg(
        F.max("_m").alias(fields[0]), *[F.sum(F.col(f) * w).alias(f) for f in fields[1:]])


def set_blocks(df: DataFrame, keys: list[str], value: str, index: str = "i", block: int = BLOCK) -> DataFrame:
    """Sets cut into blocks: keys, _b and the values of a block as the array _x."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    row = F.struct(F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x"))
    d = df.select(*keys, F.floor(F.col(index) / block).cast("long").alias("_b"), row.alias("_r")).repartition(n, *keys, "_b")
    return d.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_r")).alias("_r")).select(*keys, "_b", F.col("_r._x").alias("_x"))


def pair_totals(blocks: DataFrame, keys: list[str], params: list[str], kernel: Callable[..., np.ndarray], fields: list[str], merge: str = "sum") -> DataFrame:
    """(keys, *fields): a kernel that is the same for (x, y) and (y, x), added up over all ordered pairs of a set, or with
    ``merge='max'`` its largest values.

    A pair of blocks is taken once and counts twice. The kernel gets blocks of one size stacked, (pair of blocks, particle),
    and the params, and returns (pair of blocks, field), so that small blocks cost no call each; a batch gives one row a set.
    """
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salted = blocks.join(blocks.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(4 * n)).alias("_n")), keys)
    a = salted.select(*keys, *params, "_b", F.col("_x").alias("_xa"), F.pmod("_b", "_n").alias("_s"))
    b = salted.select(*keys, F.col("_b").alias("_b2"), F.col("_x").alias("_xb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_s"))
    pairs = a.join(b, [*keys, "_s"]).where("_b <= _b2").select(*keys, *params, F.when(F.col("_b") < F.col("_b2"), 2.0).otherwise(1.0).alias("_w"), "_xa", "_xb")
    add = np.add if merge == "sum" else np.maximum

    def reduce_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slot = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            total = np.full((len(np.unique(slot)), len(fields)), 0.0 if merge == "sum" else -np.inf)
            xa, xb, times = (pdf[c].to_numpy() for c in ("_xa", "_xb", "_w"))
            given = {p: pdf[p].to_numpy(float) for p in params}
            sizes = np.array([(len(x), len(y)) for x, y in zip(xa, xb)]).reshape(-1, 2)
            for na, nb in np.unique(sizes, axis=0):
                alike = np.flatnonzero((sizes == (na, nb)).all(1))
                step = max(1, PAIRS // (na * nb))
                for some in (alike[k : k + step] for k in range(0, len(alike), step)):
                    part = kernel(np.stack(xa[some]).astype(float), np.stack(xb[some]).astype(float), **{p: v[some] for p, v in given.items()})
                    add.at(total, slot[some], part * times[some, None] if merge == "sum" else part)
            first = np.unique(slot, return_index=True)[1]
            yield pdf.iloc[first][keys].assign(**{f: total[:, k] for k, f in enumerate(fields)})

    schema = T.StructType([pairs.schema[k] for k in keys] + [T.StructField(f, T.DoubleType()) for f in fields])
    whole = F.sum if merge == "sum" else F.max
    return pairs.mapInPandas(reduce_pairs, schema).groupBy(*keys).agg(*[whole(f).alias(f) for f in fields])


def attach(df: DataFrame, keys: list[str], left: list[str], right: list[str], params: dict[str, Column], kernel: Kernel,
           fields: list[str], merge: str = "sum", index: str = "i", block: int = BLOCK, bound: int | None = None) -> DataFrame:
    """The rows of ``df`` with the kernel sums added as columns. ``params`` are per-set expressions.

    Sets of one block travel once, whole rows in one array per set; only the arrays the kernel reads go to Python.
    Larger sets take the block-pair plan and join the sums back on (set key, index).
    """
    bound = group_bound(df, keys) if bound is None else bound
    names = list(params)
    if bound > block:
        used = sorted(set(left) | set(right))
        sums = pairwise(df.select(*keys, index, *used, *[c.alias(p) for p, c in params.items()]), keys, left, right, names, kernel, fields, merge, index,
                        block, bound)
        return df.join(sums, [*keys, index])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    payload = [c for c in df.columns if c not in keys and c != index]
    rows = df.select(*keys, F.struct(index, *payload).alias("_r"), *[c.cast("double").alias(f"_p_{p}") for p, c in params.items()])
    sets = rows.repartition(n, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("_r"),
                                                         *[F.first(f"_p_{p}").alias(f"_p_{p}") for p in names])
    cols = sorted(set(left) | set(right))
    schema = T.StructType([T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields])

    def run(*series: pd.Series) -> pd.DataFrame:
        arrays, values = series[: len(cols)], series[len(cols):]
        outs = []
        for at in range(len(series[0])):
            x = {c: np.asarray(a.iat[at], float) for c, a in zip(cols, arrays)}
            outs.append(kernel(x, x, {p: v.iat[at] for p, v in zip(names, values)}, True))
        return pd.DataFrame({f: [o[f] for o in outs] for f in fields})

    udf = F.pandas_udf(run, schema)
    given = [F.col(f"_r.{c}").cast("array<double>") for c in cols] + [F.col(f"_p_{p}") for p in names]
    done = sets.select(*keys, "_r", udf(*given).alias("_o"))
    pairs = F.arrays_zip(F.col("_r").alias("_x"), *[F.col(f"_o.{f}").alias(f) for f in fields])
    flat = done.select(*keys, F.explode(pairs).alias("_z"))
    return flat.select(*keys, *[F.col(f"_z._x.{c}").alias(c) for c in [index, *payload]], *[F.col(f"_z.{f}").alias(f) for f in fields])


def _merge(x, y, fields, merge):
    if merge == "sum":
        return {f: x[f] + y[f] for f in fields}
    top = np.maximum(x[fields[0]], y[fields[0]])
    wx, wy = np.exp(x[fields[0]] - top), np.exp(y[fields[0]] - top)
    return {fields[0]: top} | {f: x[f] * wx + y[f] * wy for f in fields[1:]}


def _size(a, b):
    """Particles of the right block, so that the sum over blocks is the set size."""
    return np.full(len(a["h"]), float(len(b["h"])))


def prior_gauss(a, b, p, same):
    """Responsibilities of all prior means for each particle: log-maximum, weight sum, weighted score."""
    d = a["h"][:, None] - b["m"][None, :]
    e = d * d
    e *= -0.5 / p["sigma"] ** 2
    top = e.max(1)
    r = np.exp(e - top[:, None])
    return {"top": top, "w": r.sum(1), "wg": -(r * d).sum(1) / p["sigma"] ** 2}


def prior_t(a, b, p, same):
    """The same for Student-t state noise, with the curvature sum."""
    d = a["h"][:, None] - b["m"][None, :]
    ns = p["nu_state"] * p["sigma"] ** 2
    q = d * d
    e = -0.5 * (p["nu_state"] + 1) * np.log1p(q / ns)
    top = e.max(1)
    r = np.exp(e - top[:, None])
    den = ns + q
    n1 = p["nu_state"] + 1
    return {"top": top, "w": r.sum(1), "wg": -n1 * (r * d / den).sum(1), "wh": -n1 * (r * (ns - q) / den**2).sum(1)}


def imq_sums(a, b, p, same):
    """All sums of the inverse-multiquadric kernel used by the directions and by the discrepancy."""
    d = a["h"][:, None] - b["h"][None, :]
    ib = 1.0 / p["bw"] ** 2
    q = d * d * ib
    k = 1.0 / (1.0 + q)
    k2 = k * k
    gk = 2 * ib * d * k2
    s, si = b["s"], a["s"]
    ks = k @ s
    return {
        "k_s": ks, "g_sum": gk.sum(1), "g_inv": gk @ (1.0 / b["c"]), "k_ps": k @ b["ps"], "k_sum": k.sum(1),
        "h_sum": k @ b["c"] + (2 * ib * k2 * np.abs(3 * q - 1)).sum(1),
        "u_base": si * ks + si * gk.sum(1) - gk @ s, "u_cross": (2 * ib * k2 * (1 - 4 * q * k)).sum(1), "n": _size(a, b),
    }


IMQ_FIELDS = ["k_s", "g_sum", "g_inv", "k_ps", "k_sum", "h_sum", "u_base", "u_cross", "n"]


def rbf_sums(a, b, p, same):
    d = a["h"][:, None] - b["h"][None, :]
    k = np.exp(-d * d / (2 * p["bw"] ** 2))
    return {"k_s": k @ b["s"], "g_sum": (k * d).sum(1) / p["bw"] ** 2, "n": _size(a, b)}


def imq_half_sums(a, b, p, same):
    d = a["h"][:, None] - b["h"][None, :]
    bs = p["bw"] ** 2 + 1e-8
    base = 1.0 + d * d / bs
    return {"k_s": (1 / np.sqrt(base)) @ b["s"], "g_sum": -(d / (bs * base * np.sqrt(base))).sum(1), "n": _size(a, b)}


def near_counts(a, b, p, same):
    """Other particles strictly within the bandwidth, by binary search in the sorted block."""
    x, h, w = np.sort(b["h"]), a["h"], p["bw"]
    near = np.searchsorted(x, h + w, "left") - np.searchsorted(x, h - w, "right") if w > 0 else np.zeros(len(h), np.int64)
    return {"near": near.astype(float) - (float(0 < w) if same else 0.0), "n": _size(a, b)}


CUTS = 32
CUT_FIELDS = [f"n{j}" for j in range(1, CUTS)]


def within_counts(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Pairs of stacked blocks within each of the CUTS-1 inner cuts of [lo, hi]: small blocks by comparing all distances,
    others by binary search in the sorted block."""
    cuts = lo[:, None] + (hi - lo)[:, None] * np.arange(1, CUTS) / CUTS
    if b.shape[1] <= 64:
        x = np.abs(a[:, :, None] - b[:, None, :]).reshape(len(a), -1)
        return np.stack([(x <= c[:, None]).sum(1) for c in cuts.T], 1).astype(float)
    out = np.empty(cuts.shape)
    for k, (x, y, c) in enumerate(zip(a, np.sort(b, axis=1), cuts)):
        out[k] = (np.searchsorted(y, x + c[:, None], "right") - np.searchsorted(y, x - c[:, None], "left")).sum(1)
    return out


def largest_within(a: np.ndarray, b: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of stacked blocks the largest distance that is not beyond the bracket, or -1."""
    x = np.abs(a[:, :, None] - b[:, None, :]).reshape(len(a), -1)
    return np.where(x <= hi[:, None] * (1 + 1e-12), x, -1.0).max(1, keepdims=True)


def joint_sums(a, b, p, same):
    """Four-dimensional diagonal inverse-multiquadric sums of the joint state-parameter step."""
    names = ("h", "mu_t", "rho_t", "sigma_t")
    d = {n: b[n][None, :] - a[n][:, None] for n in names}
    ib = {n: 1.0 / (p[f"bw_{n}"] ** 2 + 1e-8) for n in names}
    k = 1.0 / (1.0 + sum(d[n] ** 2 * ib[n] for n in names))
    k2 = k * k
    out = {f"phi_{n}": k @ b[f"g_{n}"] - 2 * ib[n] * (d[n] * k2).sum(1) for n in names}
    return out | {"k_sum": k.sum(1), "n": _size(a, b)}
