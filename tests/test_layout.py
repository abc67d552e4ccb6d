"""The paths for large groups must give exactly what the plain windows give."""

import datetime
import math
import random

import pytest
from conftest import skewed
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltide.operators import layout, windows
from voltide.operators.stats import metric_stats


def table(df):
    return sorted(tuple(r) for r in df.collect())


def test_rank_rows_split_equals_window(spark):
    d = skewed(spark).withColumnRenamed("t", "ts")
    a = layout.rank_rows(d, ["series_id"], ["ts", "tie"], bound=1)
    b = layout.rank_rows(d, ["series_id"], ["ts", "tie"], limit=10)
    assert table(a.select("series_id", "ts", "t")) == table(b.select("series_id", "ts", "t"))
    assert b.filter("t <> ts").count() == 0


def test_rank_rows_parts_follow_the_rows_not_a_small_limit(spark):
    d = skewed(spark).withColumnRenamed("t", "ts")
    b = layout.rank_rows(d, ["series_id"], ["ts", "tie"], limit=2)
    assert b.filter("t <> ts").count() == 0
    assert len(b.select("y").inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_over_time_pieces_equal_window(spark):
    d = skewed(spark)
    exprs = {"a": lambda w: F.lag("y").over(w), "b": lambda w: F.sum("y").over(w.rowsBetween(-4, -1)), "c": lambda w: F.lead("y", 2).over(w)}
    x = layout.over_time(d, ["series_id"], exprs, back=4, ahead=2)
    y = layout.over_time(d, ["series_id"], exprs, back=4, ahead=2, limit=7)
    key = lambda df: table(df.select("series_id", "t", *[F.coalesce(F.round(c, 9), F.lit(-99.0)) for c in "abc"]))
    assert key(x) == key(y)
    assert y.count() == d.count()


def test_last_known_pieces(spark):
    d = skewed(spark).withColumn("v", F.when(F.col("t") % 9 == 4, F.col("y")))
    key = lambda df: table(df.select("series_id", "t", F.coalesce("v", F.lit(-99.0))))
    assert key(layout.last_known(d, ["series_id"], ["v"])) == key(layout.last_known(d, ["series_id"], ["v"], limit=8))


def test_order_stats_split(spark):
    d = skewed(spark)
    key = lambda df: table(df.select(*sorted(df.columns)))
    picks = {"p50": layout.index_at(0.5), "p99": layout.index_at(0.99)}
    a = layout.order_stats(d, ["series_id"], "y", picks, ["tie"])
    b = layout.order_stats(d, ["series_id"], "y", picks, ["tie"], limit=9)
    assert key(a) == key(b)
    rows = [r.y for r in d.filter("series_id = 0").collect()]
    assert a.filter("series_id = 0").first().p50 == sorted(rows)[len(rows) // 2]


def test_asof_pieces(spark, monkeypatch):
    d = skewed(spark).withColumn("ts", F.col("t"))
    left, right = d.filter("tie % 3 > 0").drop("t", "y"), d.filter("tie % 3 = 0").select("series_id", "ts", "tie", F.col("y").alias("s"))
    key = lambda df: table(df.select("series_id", "tie", F.coalesce("s", F.lit(-99.0))))
    a = key(windows.asof(left, right, ["series_id"], "ts", "tie", ["s"]))
    for f in ("rank_rows", "last_known"):
        real = getattr(layout, f)
        monkeypatch.setattr(windows, f, lambda *args, _r=real, **k: _r(*args, **k, limit=11))
    assert key(windows.asof(left, right, ["series_id"], "ts", "tie", ["s"])) == a


@pytest.mark.parametrize("limit", [1 << 20, 6])
def test_pareto_brute_force(spark, limit, monkeypatch):
    for f in ("rank_rows", "running_min"):
        real = getattr(layout, f)
        wrapped = lambda *args, _r=real, **k: _r(*args, **{**k, "limit": limit})
        monkeypatch.setattr(layout, f, wrapped)
        if hasattr(windows, f):
            monkeypatch.setattr(windows, f, wrapped)
    rnd = random.Random(5)
    pts = [(i, float(rnd.randint(0, 12)), float(rnd.randint(0, 12))) for i in range(80)]
    want = [i for i, a, b in pts if not any(x <= a and y <= b and (x < a or y < b) for _, x, y in pts)]
    got = windows.pareto(spark.createDataFrame(pts, "id int, a double, b double"), "a", "b", ["id"])
    assert sorted(r.id for r in got.collect()) == want


def test_metric_stats_matches_sorted_list(spark):
    d = skewed(spark)
    r = metric_stats(d, ["series_id"], "y", ["tie"]).filter("series_id = 0").first()
    v = sorted(x.y for x in d.filter("series_id = 0").collect())
    n = len(v)
    assert (r.median, r.p5, r.p95) == (v[n // 2], v[int(0.05 * n)], v[int(0.95 * n)])


def test_window_needs_no_second_shuffle(spark):
    """Position and look-back share one exchange on the series key."""
    d = skewed(spark).withColumnRenamed("t", "ts")
    r = layout.rank_rows(d, ["series_id"], ["ts", "tie"], bound=10)
    plan = layout.over_time(r, ["series_id"], {"p": lambda w: F.lag("y").over(w)}, bound=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert Window is not None


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from voltide import session

    class Fake:
        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class S:
                        def getCheckpointDir(self):
                            class D:
                                def isDefined(self):
                                    return False
                            return D()
                    return S()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake)


def test_segments_by_series(spark):
    from voltide.operators.windows import segment_of

    d = spark.createDataFrame([(s, t) for s in (1, 2) for t in range(6)], "series_id long, t long")
    starts = spark.createDataFrame([(1, 2, 7, "a"), (1, 4, 8, "b"), (2, 0, 9, "c")], "series_id long, start long, segment_id int, segment_name string")
    got = {(r.series_id, r.t): r.segment_id for r in segment_of(d, starts).collect()}
    assert [got[1, t] for t in range(6)] == [None, None, 7, 7, 8, 8] and {got[2, t] for t in range(6)} == {9}


def test_periods_that_end_before_they_start(spark):
    from voltide.operators.prep import slice_periods

    d = spark.sql("select 'A' series_id, date'2020-01-01' + cast(id as int) ts from range(60)")
    p = spark.sql("select * from values ('x','A',date'2020-02-10',date'2020-01-10'),('y','A',date'2020-01-20',date'2020-02-10') p(period_id,ticker,start,end)")
    a, b = slice_periods(d, p), slice_periods(d, p, limit=0)
    assert a.count() == b.count() == 21 and {r.period_id for r in b.collect()} == {"y"}


def test_a_series_that_has_not_moved_has_no_ratio_of_vols(spark):
    """Zero against zero is neither a ratio nor a rise of volatility; the first move gives both."""
    day = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([(7, day, 0.0), (7, day + datetime.timedelta(hours=1), 0.0), (7, day + datetime.timedelta(hours=30), 0.2)], "series_id long, ts timestamp, y double")
    got = windows.realised_vol_ratio(d).orderBy("hour").collect()
    assert [(r.vol_short, r.vol_long, r.ratio, r.regime_up) for r in got[:2]] == [(0.0, 0.0, None, None)] * 2
    assert got[2].ratio == pytest.approx(math.sqrt(3)) and got[2].regime_up
