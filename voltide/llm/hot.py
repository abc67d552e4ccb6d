"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
SALTS = 32


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, total: int, size: str, when: Column | None = None) -> DataFrame:
    """Inner join of rows with per_key (one row per key, with ``size``, the number of rows of the key), and ``when`` if given.

    Keys of more than a thousandth of all ``total`` rows are fewer than a thousand, whatever the data: they are named in the
    plan, their rows go to SALTS tasks by a hash of the row, and only their row of per_key is copied. per_key should be a
    written table. Returns the columns of rows and the others of per_key."""
    limit = max(SALTS, total // HOT_SHARE)
    hot = [r[0] for r in per_key.where(F.col(size) > limit).select(key).collect()]
    if hot:
        salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
        rows = rows.withColumn("_salt", salt)
        copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        per_key = per_key.withColumn("_salt", F.explode(copies))
    both = rows.join(per_key.hint("merge"), [key, "_salt"] if hot else key)
    return (both if when is None else both.where(when)).drop("_salt")
