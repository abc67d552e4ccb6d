"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.hot import join_hot
from voltide.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """links: a, b (orderable, not NULL). Returns node, component: each linked node and the least node that it reaches.

    Alternates the large and the small star: every node sends its larger neighbours, then its smaller ones, to the least
    of its neighbourhood, until nothing moves (about log of the diameter rounds). A round is two joins of the links
    with an aggregate of them, in which the links of a hub stay where they are; nothing is collected but a count and a
    checksum."""
    e = cut_lineage(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    state, total = None, e.count()
    while total:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = join_hot(both.where(F.col("b") > F.col("a")), least, "a", 2 * total, "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where(F.col("a") != F.col("b")).distinct())  # a > b in every row
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.where(F.col("a") != F.col("b")).distinct())
        total, *now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if [total, *now] == state:
            break
        state = [total, *now]
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return found.union(roots)
