"""Files of the shapes the reference data has, made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.operators import prep
from voltide.sources import files


def test_market_csv_bad_cells_become_null(spark, fresh):
    with open(f"{fresh}/spy.csv", "w") as f:
        f.write("date,price,return,log_return\n2020-01-02,100.5,0.01,0.00995\n2020-01-03,junk,,0.5\n")
    d = files.read_market_csv(spark, f"{fresh}/spy.csv")
    rows = sorted(d.collect(), key=lambda r: r.date)
    assert rows[0].dataset == "spy" and rows[0].price == 100.5 and rows[1].price is None and rows[1]["return"] is None
    assert files.rejected_cells(d).first().bad_price == 1


@pytest.mark.parametrize("limit", [None, 50])
def test_returns_csv_line_order(spark, fresh, limit, monkeypatch):
    y = np.random.default_rng(1).normal(size=5000)
    for name in ("a", "b"):
        with open(f"{fresh}/{name}.csv", "w") as f:
            f.write("\n".join(f"{v:.10f}" for v in y) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        if limit:
            real = files.rank_rows
            monkeypatch.setattr(files, "rank_rows", lambda *a: real(*a, limit=limit))
        d = files.read_returns_csv(spark, f"{fresh}/*.csv")
        got = [r.y for r in sorted(d.filter("dataset = 'b'").collect(), key=lambda r: r.t)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and got == pytest.approx(list(np.round(y, 10)), abs=1e-12)


def test_f32_ranges(spark, fresh, monkeypatch):
    monkeypatch.setattr(files, "BLOCK_BYTES", 64)
    y = np.arange(100, dtype="<f4") / 7
    with open(f"{fresh}/r.bin", "wb") as f:
        f.write(y.tobytes() + b"\x01\x02")
    got = {r.t: r.y for r in files.read_returns_f32(spark, f"{fresh}/r.bin").collect()}
    assert len(got) == 100 and all(got[k] == float(y[k]) for k in got)


def test_slice_periods_large_table(spark):
    d = spark.range(400).select((F.col("id") % 4).alias("series_id"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"))
    p = spark.createDataFrame([(f"p{i}", i % 4, 86400 * 10 * i, 86400 * (10 * i + 45)) for i in range(20)], "period_id string, ticker long, a long, b long").select(
        "period_id", "ticker", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    key = lambda df: sorted((r.period_id, r.series_id, r.ts) for r in df.collect())
    assert key(prep.slice_periods(d, p)) == key(prep.slice_periods(d, p, limit=3))


def test_single_row_and_constant_series(spark):
    d = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 3.0), (2, 1, 1, 3.0), (2, 2, 2, 3.0)], "k long, ts long, tie long, p double")
    o = prep.observations(d, "k", ["ts", "tie"], "p")
    assert [(r.series_id, r.t, r.y) for r in o.orderBy("t").collect()] == [(2, 0, 0.0), (2, 1, 0.0)]
