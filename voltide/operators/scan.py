"""Prefix composition of per-tick maps: recursions x_t = f_t(x_{t-1}) without one task per series.

Each tick contributes a small map (a struct of numbers) from a family that is closed under composition. Ticks are
folded in pieces of at most ``PIECE`` rows, piece totals are scanned the same way (recursively), and the full prefix
of a tick is carry followed by local prefix. The result is exact for any series length and needs no start state:
the caller applies the prefix map to its own initial value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.operators.layout import rank_rows
from voltide.session import group_bound

PIECE = 512
FAR = 1e300


@dataclass(frozen=True)
class Family:
    """Field names, the identity map and ``then(f, g)`` = first f, then g."""

    fields: tuple[str, ...]
    identity: tuple[float, ...]
    then: Callable[[Column, Column], list[Column]]

    def pack(self, cols: list[Column]) -> Column:
        return F.struct(*[c.cast("double").alias(n) for n, c in zip(self.fields, cols)])

    def unit(self) -> Column:
        return self.pack([F.lit(float(v)) for v in self.identity])


def _affine(f: Column, g: Column) -> list[Column]:
    return [g.a * f.a, g.a * f.b + g.b]


# x -> a*x + b
AFFINE = Family(("a", "b"), (1.0, 0.0), _affine)


def _clip(g: Column, v: Column) -> Column:
    return F.least(g.hi, F.greatest(g.lo, v))


def _clamped(f: Column, g: Column) -> list[Column]:
    return [g.a * f.a, g.a * f.b + g.b, _clip(g, g.a * f.lo + g.b), _clip(g, g.a * f.hi + g.b)]


# x -> min(hi, max(lo, a*x + b)), a >= 0
CLAMPED = Family(("a", "b", "lo", "hi"), (1.0, 0.0, -FAR, FAR), _clamped)


def _seeded(f: Column, g: Column) -> list[Column]:
    return [F.when(f.z > 0, g.a * f.z + g.b).otherwise(g.z), g.a * f.a, g.a * f.b + g.b]


# 0 -> z, x > 0 -> a*x + b: averages that start from their first positive value
SEEDED = Family(("z", "a", "b"), (0.0, 1.0, 0.0), _seeded)


def _mobius(f: Column, g: Column) -> list[Column]:
    p, q = g.p * f.p + g.q * f.r, g.p * f.q + g.q * f.s
    r, s = g.r * f.p + g.s * f.r, g.r * f.q + g.s * f.s
    norm = p + q + r + s
    return [p / norm, q / norm, r / norm, s / norm]


# x -> (p*x + q) / (r*x + s), non-negative entries: scalar Kalman variance
MOBIUS = Family(("p", "q", "r", "s"), (0.5, 0.0, 0.0, 0.5), _mobius)


def _affine2(f: Column, g: Column) -> list[Column]:
    return [
        g.a11 * f.a11 + g.a12 * f.a21, g.a11 * f.a12 + g.a12 * f.a22,
        g.a21 * f.a11 + g.a22 * f.a21, g.a21 * f.a12 + g.a22 * f.a22,
        g.a11 * f.b1 + g.a12 * f.b2 + g.b1, g.a21 * f.b1 + g.a22 * f.b2 + g.b2,
    ]


# (x1, x2) -> A (x1, x2) + b
AFFINE2 = Family(("a11", "a12", "a21", "a22", "b1", "b2"), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), _affine2)


def dense_rows(df: DataFrame, keys: list[str], t: str, bound: int, piece: int) -> tuple[DataFrame, str]:
    """The rows, and the column by which they are cut into pieces: the position by ``t`` where a series is longer than a
    piece, so that every piece but a series' last one is full however far the ticks are apart."""
    return (df, t) if bound <= piece else (rank_rows(df, keys, [t], "_row", bound), "_row")


def _pieces(df: DataFrame, keys: list[str], t: str, piece: int | None, item: Column, extra: str = "_p") -> DataFrame:
    """One sorted array per key, or per key and piece of the positions in ``t``."""
    cut = [] if piece is None else [F.floor(F.col(t) / piece).cast("long").alias(extra)]
    by = [*keys, *([] if piece is None else [extra])]
    return df.select(*keys, *cut, item.alias("_x")).groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))


def prefix_maps(
    df: DataFrame,
    keys: list[str],
    family: Family,
    maps: list[Column],
    t: str = "t",
    out: str = "m",
    bound: int | None = None,
    piece: int = PIECE,
    before: bool = False,
    dense: bool = False,
) -> DataFrame:
    """Add struct column ``out`` = map_0 then ... then map_t for every row, or with ``before`` of the rows before it.

    ``bound`` is the most rows that a key has. Up to ``piece`` of them are one array, otherwise the rows are cut by their
    position, so that a series may start at any ``t`` and have gaps. ``dense``: ``t`` is that position, from 0.
    """
    if piece < 3:
        raise ValueError("pieces need three rows at least, or their totals don't become fewer")
    bound = group_bound(df, keys) if bound is None else bound
    payload = [c for c in df.columns if c not in keys]
    item = F.struct(F.col(t).alias("_tick"), family.pack(maps).alias("_map"), *payload)
    split = bound > piece
    df, at = (df, t) if dense else dense_rows(df, keys, t, bound, piece)
    arrays = _pieces(df, keys, at, piece if split else None, item)

    def push(acc: Column, x: Column) -> Column:
        return F.array_append(acc, family.pack(family.then(F.element_at(acc, -1), x["_map"])))

    arrays = arrays.withColumn("_fs", F.aggregate("_xs", F.array(family.unit()), push))
    if split:
        totals = arrays.select(*keys, "_p", F.element_at("_fs", -1).alias("_total"))
        carried = prefix_maps(totals, keys, family, [F.col(f"_total.{n}") for n in family.fields], "_p", "_c", bound // piece + 2, piece, True, True)
        arrays = arrays.join(carried.select(*keys, "_p", "_c"), [*keys, "_p"])
    rows = _zip_rows(arrays, keys, "_xs", "_fs", ["_c"] if split else [], 1 if before else 2)
    full = family.pack(family.then(F.col("_c"), F.col("_y"))) if split else F.col("_y")
    return rows.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in payload], full.alias(out))


def state_scan(
    df: DataFrame,
    keys: list[str],
    n_states: int,
    step: Callable[[Column, Column], Column],
    start: int,
    cols: list[str],
    t: str = "t",
    out: str = "state",
    bound: int | None = None,
    piece: int = 4 * PIECE,
) -> DataFrame:
    """Finite-state recursion state_t = step(state_{t-1}, row_t) in the order of ``t``, which may have gaps.

    A piece is summarised by its end state for every start state; the summaries compose by lookup.
    """
    if piece < 3:
        raise ValueError("pieces need three rows at least, or their totals don't become fewer")
    bound = group_bound(df, keys) if bound is None else bound
    payload = [c for c in df.columns if c not in keys]
    split = bound > piece
    df, at = dense_rows(df, keys, t, bound, piece)
    arrays = _pieces(df, keys, at, piece if split else None, F.struct(F.col(t).alias("_tick"), *payload))
    begin: Column = F.lit(start)
    if split:
        ends = arrays.select(
            *keys, "_p",
            F.transform(F.sequence(F.lit(0), F.lit(n_states - 1)),
                        lambda s: F.aggregate("_xs", s, lambda a, x: step(a, x).cast("int"))).alias("_e"),
        )
        starts = _entry_states(ends, keys, n_states, start, bound // piece + 2, piece)
        arrays = arrays.join(starts, [*keys, "_p"])
        begin = F.col("_s")
    states = F.aggregate("_xs", F.array(begin.cast("int")),
                         lambda a, x: F.array_append(a, step(F.element_at(a, -1), x).cast("int")))
    rows = _zip_rows(arrays.withColumn("_ss", states), keys, "_xs", "_ss", [])
    return rows.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in payload], F.col("_y").alias(out))


def _zip_rows(df: DataFrame, keys: list[str], xs: str, ys: str, extra: list[str], first: int = 2) -> DataFrame:
    """Explode (row, prefix) pairs; ``ys`` has one leading start element, and ``first`` is the place of the first row's
    prefix. Zipping keeps the arrays out of the rows."""
    tail = F.slice(F.col(ys), F.lit(first), F.size(xs))
    pairs = F.arrays_zip(F.col(xs).alias("_x"), tail.alias("_y"))
    return df.select(*keys, *extra, F.explode(pairs).alias("_z")).select(*keys, *extra, "_z._x", "_z._y")


def _entry_states(ends: DataFrame, keys: list[str], n_states: int, start: int, bound: int, piece: int) -> DataFrame:
    """State on entry of every piece, from the pieces' end-state tables."""
    split = bound > piece
    grouped = _pieces(ends, keys, "_p", piece if split else None, F.struct("_p", "_e"), "_q").withColumnRenamed("_xs", "_es")
    look = lambda s, x: F.element_at(x["_e"], (s + 1).cast("int")).cast("int")
    begin: Column = F.lit(start)
    if split:
        upper = grouped.select(
            *keys, F.col("_q").alias("_p"),
            F.transform(F.sequence(F.lit(0), F.lit(n_states - 1)), lambda s: F.aggregate("_es", s, look)).alias("_e"),
        )
        entry = _entry_states(upper, keys, n_states, start, bound // piece + 2, piece)
        grouped = grouped.join(entry.select(*keys, F.col("_p").alias("_q"), "_s"), [*keys, "_q"])
        begin = F.col("_s")
    walk = F.aggregate("_es", F.array(begin.cast("int")),
                       lambda a, x: F.array_append(a, look(F.element_at(a, -1), x)))
    pairs = F.arrays_zip(F.col("_es").alias("_x"), F.slice(walk, F.lit(1), F.size("_es")).alias("_y"))
    rows = grouped.select(*keys, F.explode(pairs).alias("_z"))
    return rows.select(*keys, F.col("_z._x._p").alias("_p"), F.col("_z._y").alias("_s"))
