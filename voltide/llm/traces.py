"""Traces of the project's own series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.operators import prep


def traces_of_series(obs: DataFrame) -> DataFrame:
    """series_id and trace: a line per tick of a series in order, its number, return and input status.

    obs: series_id, t, y as from prep.observations; a NULL return is an empty field. A trace is one row, so a series is
    as long as a text may be; cut longer ones by t before."""
    o = prep.validate_input(obs)
    line = F.struct("t", F.concat_ws(",", "t", F.coalesce(F.format_number("y", 4), F.lit("")), "status_name").alias("line"))
    d = o.groupBy("series_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return d.select("series_id", F.array_join(F.col("l.line"), "\n").alias("trace"))
