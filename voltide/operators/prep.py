"""Preparation of observations: returns, validation, repair, slicing, warm-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.operators.layout import last_known, over_time, rank_rows
from voltide.session import MAX_BROADCAST_ROWS, MAX_GROUP_ROWS, fits_broadcast, group_bound


def index_prices(df: DataFrame, key: str, order: list[str], price: str, bound: int | None = None,
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """Canonical (series_id, k, ts, tie, price) with dense k by (ts, tie). A row without a positive price is no
    observation and is left out; ``bad_prices`` counts those rows."""
    base = df.filter((F.col(price) > 0) & ~F.isnan(price)).select(F.col(key).alias("series_id"), F.col(order[0]).alias("ts"),
                     F.col(order[1] if len(order) > 1 else order[0]).alias("tie"), F.col(price).alias("price"), *extra)
    return rank_rows(base, ["series_id"], ["ts", "tie"], "k", bound)


def bad_prices(df: DataFrame, key: str, price: str) -> DataFrame:
    """Rows per series whose price is missing, not a number or not positive."""
    p = F.col(price)
    return df.groupBy(key).agg(F.count_if(p.isNull() | F.isnan(p) | (p <= 0)).alias("bad_prices"))


def price_returns(df: DataFrame, bound: int | None = None, first: bool = True) -> DataFrame:
    """Simple and log returns per series; the first row has none. ``first=False`` drops it and re-indexes."""
    bound = group_bound(df, ["series_id"]) if bound is None else bound
    if bound <= MAX_GROUP_ROWS:  # the order of the positions, so that both windows share one sort
        prev = df.withColumn("p_prev", F.lag("price").over(Window.partitionBy("series_id").orderBy("ts", "tie")))
    else:
        prev = over_time(df, ["series_id"], {"p_prev": lambda w: F.lag("price").over(w)}, "k", 1, 0, bound)
    out = prev.select(
        *df.columns,
        (F.col("price") / F.col("p_prev") - 1).alias("ret"), F.log(F.col("price") / F.col("p_prev")).alias("y"),
    )
    return out if first else drop_first(out)


def drop_first(df: DataFrame) -> DataFrame:
    """The undefined first row goes; t counts from 0 again."""
    return df.filter("k > 0").withColumn("t", F.col("k") - 1).drop("k")


def observations(df: DataFrame, key: str, order: list[str], price: str, bound: int | None = None,
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """Priced rows to (series_id, ts, tie, price, ret, y, t)."""
    bound = group_bound(df, [key]) if bound is None else bound
    return price_returns(index_prices(df, key, order, price, bound, extra), bound, first=False)


def with_y_prev(df: DataFrame, bound: int | None = None) -> DataFrame:
    return over_time(df, ["series_id"], {"y_prev": lambda w: F.lag("y", 1, 0.0).over(w)}, bound=bound)


def annualise(df: DataFrame, mean: str = "mean", std: str = "std", vol: str | None = None) -> DataFrame:
    out = df.withColumn("mean_ann", F.col(mean) * fn.TRADING_DAYS)
    out = out.withColumn("std_ann", F.col(std) * F.sqrt(F.lit(float(fn.TRADING_DAYS))))
    return out if vol is None else out.withColumn("vol_ann", F.col(vol) * F.sqrt(F.lit(float(fn.TRADING_DAYS))))


def validate_input(df: DataFrame, max_return: float = 0.5) -> DataFrame:
    code = fn.input_status("y", max_return)
    return df.withColumn("status", code).withColumn("status_name", fn.status_name("status"))


def repair_input(df: DataFrame, mode: str, bound: int | None = None) -> DataFrame:
    """Rows with a non-zero status: drop them, carry the last valid value, or take the mean of the neighbours."""
    if mode == "skip":
        return df.filter("status = 0")
    good = F.when(F.col("status") == 0, F.col("y"))
    if mode == "carry":
        return last_known(df.withColumn("y", good), ["series_id"], ["y"], bound=bound)
    if mode == "mean":
        d = df.withColumn("_g", good)
        d = over_time(d, ["series_id"], {"_a": lambda w: F.lag("_g").over(w), "_b": lambda w: F.lead("_g").over(w)},
                      back=1, ahead=1, bound=bound)
        mean = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(
            (F.col("_a") + F.col("_b")) / 2)
        return d.withColumn("y", F.coalesce("_g", mean)).drop("_g", "_a", "_b")
    raise ValueError(f"unknown mode {mode!r}")


def slice_periods(df: DataFrame, periods: DataFrame, key: str = "series_id", ts: str = "ts",
                  limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows inside any (ticker, start, end) period, end exclusive, tagged with period_id.

    An equi-join on the ticker with a range condition. A small period table is broadcast; a large one is joined on
    (ticker, month) so that both sides stay partitioned and a hot ticker spreads over its months.
    """
    p = periods.select("period_id", F.col("ticker").alias(key), "start", "end").filter(F.col("start") < F.col("end"))
    inside = (F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("end"))
    if fits_broadcast(p, limit):
        return df.join(F.broadcast(p), key).filter(inside).drop("start", "end")
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    months = F.explode(F.sequence(month("start"), month("end"), F.expr("interval 1 month")))
    return (df.withColumn("_m", month(ts)).join(p.select("*", months.alias("_m")), [key, "_m"])
            .filter(inside).drop("_m", "start", "end"))


def concat_periods(frames: list[DataFrame]) -> DataFrame:
    """Period tables one after another; the period stays part of the series key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("series_id", F.concat_ws(":", F.col("series_id").cast("string"), F.col("period_id").cast("string")))


def drop_warmup(df: DataFrame, w: int) -> DataFrame:
    return df.filter(F.col("t") >= w)


def relative_spread(bid: str = "bid", ask: str = "ask") -> Column:
    b, a = F.col(bid), F.col(ask)
    return F.try_divide(a - b, (a + b) / 2)
