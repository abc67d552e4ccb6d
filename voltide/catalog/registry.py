"""Registered queries over the driver tables, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.operators import prep
from voltide.operators.layout import over_time
from voltide.session import group_bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals; the SQL twins do the same."""
    return df.select(*[fn.r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# events -> observations: one series per user, ordered by (ts, event_id), log returns of value
OBS = """
p0 AS (SELECT user_id AS series_id, ts, event_id AS tie, event_type, value AS price,
              lag(value) OVER w AS pp, row_number() OVER w - 2 AS t
       FROM events WHERE value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
obs AS (SELECT series_id, t, ts, tie, event_type, price, price / pp - 1 AS ret, ln(price / pp) AS y FROM p0 WHERE t >= 0)
"""


def obs(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    ev = table(spark, sf, "events")
    bound = group_bound(ev, ["user_id"])
    return prep.observations(ev, "user_id", ["ts", "event_id"], "value", bound, ("event_type",)), bound


# orders -> one long daily series per priority
DAILY = """
d0 AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price
       FROM orders GROUP BY 1, 2),
d1 AS (SELECT series_id, day, price, lag(price) OVER w AS pp, row_number() OVER w - 2 AS t
       FROM d0 WHERE price > 0 WINDOW w AS (PARTITION BY series_id ORDER BY day)),
daily AS (SELECT series_id, t, day, price, ln(price / pp) AS y FROM d1 WHERE t >= 0)
"""


def daily_prices(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("day")).agg(
        F.avg("o_totalprice").alias("price"))


def daily(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    d = daily_prices(spark, sf)
    bound = group_bound(d, ["series_id"])
    return prep.observations(d, "series_id", ["day"], "price", bound).select(
        "series_id", "t", F.col("ts").alias("day"), "price", "y"), bound


# observations with a slow (five-tick) and a fast (three-tick) log-variance: stand-ins for truth and estimate
EV = OBS + """,
ev AS (SELECT series_id, t, ts, tie, event_type, y, h_true, h_est, exp(h_true / 2) AS vol_true, exp(h_est / 2) AS vol,
       lgamma(3) - lgamma(2.5) - 0.5 * ln(pi() * 5) - 0.5 * h_true
         - 3 * ln(1 + y * y / (exp(h_true) + 1e-8) / 5) AS loglik
       FROM (SELECT *, ln(avg(y * y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-8) AS h_true,
                       ln(avg(y * y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + 1e-8) AS h_est
             FROM obs))
"""


def estimates(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    o, bound = obs(spark, sf)
    q = F.col("y") * F.col("y")
    d = over_time(o, ["series_id"], {"h_true": lambda w: F.log(F.avg(q).over(w.rowsBetween(-4, 0)) + 1e-8),
                                     "h_est": lambda w: F.log(F.avg(q).over(w.rowsBetween(-2, 0)) + 1e-8)}, back=4, bound=bound)
    d = d.withColumn("vol_true", F.exp(F.col("h_true") / 2)).withColumn("vol", F.exp(F.col("h_est") / 2))
    d = d.withColumn("loglik", fn.t_logpdf("y", "h_true", F.lit(5.0), fn.t_log_norm(F.lit(5.0))))
    return d, bound
