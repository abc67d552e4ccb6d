"""Order-aware layout: dense positions, bounded look-back windows, carried values, order statistics.

None of these puts an unbounded group into one task. Each checks the largest group first: small groups use one
plain window; beyond ``limit`` rows the same result comes from bounded pieces plus a small table of piece totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.session import MAX_GROUP_ROWS, cut_lineage, group_bound

PART_ROWS = 1 << 16  # rows that a part of a split group may always have: a task of fewer costs more than it spreads


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def rank_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "t",
    bound: int | None = None,
    limit: int = MAX_GROUP_ROWS,
    size: str | None = None,
) -> DataFrame:
    """Dense 0-based position of each row in its key group by ``order`` (must be unique per key), and the group's
    ``size`` if asked for.

    Large groups: range partitioning by (key, order) into parts of half of ``limit`` rows (``PART_ROWS`` at least, so that
    the number of parts follows the rows, not a small limit) splits them over tasks, the position inside a partition is a bounded window, and the per-partition counts give the offsets. The partition id is frozen by writing the rows out.
    """
    bound = group_bound(df, keys) if bound is None else bound
    if bound <= limit:
        w = Window.partitionBy(*keys).orderBy(*_order(order))
        d = df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
        return d if size is None else d.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    parts = max(2, -(-df.count() // max(limit // 2, PART_ROWS)))
    n_conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    split = df.repartitionByRange(max(parts, n_conf), *keys, *order).withColumn("_part", F.spark_partition_id())
    split = cut_lineage(split)
    inner = Window.partitionBy(*keys, "_part").orderBy(*_order(order))
    counts = split.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = [] if size is None else [F.sum("_n").over(Window.partitionBy(*keys)).alias(size)]
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *total)
    return (
        split.withColumn("_rn", F.row_number().over(inner) - 1)
        .join(offsets, [*keys, "_part"])
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_rn", "_off", "_part")
    )


def over_time(
    df: DataFrame,
    keys: list[str],
    exprs: dict[str, Callable[[Window], Column]],
    t: str = "t",
    back: int = 1,
    ahead: int = 0,
    bound: int | None = None,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind and ``ahead`` rows ahead on a dense index ``t``.

    A long series is cut into pieces of ``limit`` ticks; the few edge rows are copied to the neighbouring piece, so
    every window sees its full frame and no task holds more than one piece.
    """
    bound = group_bound(df, keys) if bound is None else bound
    if bound <= limit:
        w = Window.partitionBy(*keys).orderBy(t)
        return df.select("*", *[f(w).alias(n) for n, f in exprs.items()])
    size = max(limit, back + ahead + 1)
    piece, pos = F.floor(F.col(t) / size).cast("long"), F.pmod(F.col(t), F.lit(size))
    none = F.lit(None).cast("struct<p:bigint,own:boolean>")
    copies = F.array(
        F.struct(piece.alias("p"), F.lit(True).alias("own")),
        F.when(pos >= size - back, F.struct((piece + 1).alias("p"), F.lit(False).alias("own"))).otherwise(none),
        F.when(pos < ahead, F.struct((piece - 1).alias("p"), F.lit(False).alias("own"))).otherwise(none),
    )
    ext = df.select("*", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("_c"))
    ext = ext.withColumn("_p", F.col("_c.p")).withColumn("_own", F.col("_c.own")).drop("_c")
    w = Window.partitionBy(*keys, "_p").orderBy(t)
    names = [c for c in df.columns]
    return ext.select("*", *[f(w).alias(n) for n, f in exprs.items()]).filter("_own").select(*names, *exprs.keys())


def last_known(
    df: DataFrame,
    keys: list[str],
    cols: list[str],
    t: str = "t",
    bound: int | None = None,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Replace each column by its last non-NULL value at or before ``t`` (forward fill)."""
    bound = group_bound(df, keys) if bound is None else bound
    keep = [c for c in df.columns if c not in cols]
    if bound <= limit:
        w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*keep, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
    d = df.withColumn("_p", F.floor(F.col(t) / limit).cast("long"))
    tails = d.groupBy(*keys, "_p").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(t))).alias(f"_c_{c}") for c in cols])
    prev = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_p", *[F.last(f"_c_{c}", ignorenulls=True).over(prev).alias(f"_c_{c}") for c in cols])
    w = Window.partitionBy(*keys, "_p").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(carry, [*keys, "_p"], "left").select(
        *keep, *[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_c_{c}")).alias(c) for c in cols]
    )


def running_min(df: DataFrame, keys: list[str], col: str, out: str, t: str, strict: bool = True,
                bound: int | None = None, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """Minimum of ``col`` over the rows before ``t`` (``strict``) or up to it, in bounded pieces."""
    bound = group_bound(df, keys) if bound is None else bound
    hi = -1 if strict else 0
    if bound <= limit:
        w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, hi)
        return df.withColumn(out, F.min(col).over(w))
    d = df.withColumn("_p", F.floor(F.col(t) / limit).cast("long"))
    prev = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*keys, "_p").agg(F.min(col).alias("_m")).select(*keys, "_p", F.min("_m").over(prev).alias("_m"))
    w = Window.partitionBy(*keys, "_p").orderBy(t).rowsBetween(Window.unboundedPreceding, hi)
    return d.join(carry, [*keys, "_p"]).withColumn(out, F.least(F.min(col).over(w), F.col("_m"))).drop("_p", "_m")


SALT = 32


def join_back(df: DataFrame, per_key: DataFrame, keys: list[str], salt: int = SALT) -> DataFrame:
    """Inner join of a per-key table (one row per key) to its rows, with a hot key spread over ``salt`` tasks.

    The few per-key rows are repeated once per salt value and the large side picks a salt from the whole row, so that
    equal values don't meet in one task. At run time Spark may still turn this into a broadcast, by the measured size of
    the per-key side.
    """
    big = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)).cast("int"))
    few = per_key.select("*", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt"))
    return big.join(few, [*keys, "_salt"]).drop("_salt")


def order_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    picks: dict[str, Callable[[Column], Column]],
    tie: list[str],
    bound: int | None = None,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact index-based order statistics: ``picks`` maps a name to an index formula of the group size n.

    The rows are ranked (large groups by range partitioning), never collected into an array; the sizes come with the
    ranks, and only rows at a wanted position go on.
    """
    d = df.select(*dict.fromkeys([*keys, value, *tie])).filter(F.col(value).isNotNull())
    ranked = rank_rows(d, keys, [value, *tie], "_rank", bound, limit, "_size")
    at = {name: F.col("_rank") == idx(F.col("_size")) for name, idx in picks.items()}
    wanted = ranked.filter(reduce(lambda a, b: a | b, at.values()))
    return wanted.groupBy(*keys).agg(*[F.max(F.when(hit, F.col(value))).alias(name) for name, hit in at.items()])


def index_at(q: float) -> Callable[[Column], Column]:
    """Index floor(q*n), capped at n-1: the sorted-array pick without interpolation."""
    return lambda n: F.least(F.floor(F.lit(q) * n), n - 1).cast("long")
