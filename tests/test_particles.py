"""Pair sums in one block, in several blocks, and by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.operators import particles as pt

K = ["k"]


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, float(rng.normal(-3, 0.4)), float(rng.normal(-3, 0.4)), float(rng.normal()), float(rng.uniform(0.5, 3))) for k, n in ((0, 37), (1, 5), (2, 1))
            for i in range(n)]
    return spark.createDataFrame(rows, "k int, i int, h double, m double, grad double, curv double").withColumn("bandwidth", F.lit(0.3)).withColumn(
        "sigma", F.lit(0.2)).cache()


def keyed(df, *cols):
    return {(r.k, r.i): tuple(r[c] for c in cols) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-10)


@pytest.mark.parametrize("mode", ["plain", "newton", "full_newton"])
def test_phi_blocks(sets, mode):
    a, b = pt.stein_phi(sets, K, mode), pt.stein_phi(sets, K, mode, block=8)
    close(keyed(a, "phi", "ksd_part"), keyed(b, "phi", "ksd_part"))


def test_prior_blocks(sets):
    for f in (pt.grad_prior_gauss, pt.grad_prior_t):
        close(keyed(f(sets, K), "g_prior", "hess_prior"), keyed(f(sets, K, block=8), "g_prior", "hess_prior"))


def test_phi_brute_force(sets):
    got = keyed(pt.stein_phi(sets, K), "phi", "ksd_part")
    rows = [r for r in sets.collect() if r.k == 0]
    ib, n = 1 / 0.09, len(rows)
    for x in rows:
        phi = u = 0.0
        for z in rows:
            d = x.h - z.h
            k = 1 / (1 + d * d * ib)
            phi += k * z.grad - 2 * d * ib * k * k
            u += k * x.grad * z.grad + (x.grad - z.grad) * 2 * d * ib * k * k + 2 * ib * k * k * (1 - 4 * d * d * ib * k)
        assert got[(0, x.i)] == pytest.approx((phi / n, u), rel=1e-9, abs=1e-9)


def test_median_bandwidth_by_bisection(sets):
    a = {r.k: r.bandwidth for r in pt.bandwidth_median(sets, K).collect()}
    b = {r.k: r.bandwidth for r in pt.bandwidth_median(sets, K, block=16, rounds=8).collect()}
    assert a == pytest.approx(b, abs=1e-7)


def test_density_and_knn(sets):
    close(keyed(pt.local_density(sets, K).filter("k < 2"), "density"), keyed(pt.local_density(sets, K, block=8).filter("k < 2"), "density"))
    got = keyed(pt.knn_distance(sets, K, 6), "knn")
    for k in (0, 1):
        hs = {r.i: r.h for r in sets.collect() if r.k == k}
        for i, h in hs.items():
            ds = sorted(abs(h - x) for j, x in hs.items() if j != i)
            assert got[(k, i)][0] == pytest.approx(ds[min(6, len(ds)) - 1])
    assert got[(2, 0)][0] is None


def test_edge_sets(spark):
    """Equal weights, underflowing weights, particles at the limits."""
    rows = [(0, i, -15.0, 0.0) for i in range(4)] + [(1, i, 5.0, -1000.0 * i) for i in range(4)]
    p = spark.createDataFrame(rows, "k int, i int, h double, log_w double")
    e = {r.k: r.ess for r in pt.ess(p, K).collect()}
    assert e[0] == pytest.approx(4) and e[1] == pytest.approx(1)
    st = {r.k: r.status for r in pt.health_status(pt.particle_health(p, K)).collect()}
    assert st == {0: 0, 1: 1001} or st == {0: 1001, 1: 1001}
    moved, _ = pt.transport("h", F.lit(0.0), F.lit(100.0), F.lit(0.0), 0.1, 1.0)
    assert all(-15 <= r[0] <= 5 for r in p.select(moved).collect())


def test_null_and_nan_inputs(spark):
    from voltide.operators.prep import validate_input

    ys = [None, float("nan"), float("inf"), -float("inf"), 1e31, 0.5, 0.5000001, -0.49, 0.0]
    d = spark.createDataFrame([(y,) for y in ys], "y double")
    assert [r.status for r in validate_input(d).collect()] == [320, 300, 301, 301, 301, 0, 302, 0, 0]


def test_bandwidth_query_holds_no_share_of_all_events(spark, sf):
    """All rules come from one aggregate, and events meet the ids of the sets in hash tables of the ids, unsorted."""
    from voltide.catalog.particle_sets import bandwidths

    run = bandwidths(spark, sf)._jdf.queryExecution()
    assert run.optimizedPlan().toString().count("Aggregate [") == 1
    assert run.sparkPlan().toString().count("ShuffledHashJoin") == 2


def test_median_of_split_sets_computes_its_input_once(spark):
    """Rounds go over the blocks as written; sets of several sizes, large blocks by binary search as small ones by comparing."""
    import numpy as np

    rng = np.random.default_rng(9)
    data = [(k, i, float(rng.normal())) for k, size in enumerate((300, 90, 41, 7, 1)) for i in range(size)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    sets = spark.createDataFrame(data, "k long, i long, h double").mapInPandas(count, "k long, i long, h double")
    got = [{r.k: r.bandwidth for r in pt.bandwidth_median(sets, ["k"], block=block, rounds=9, bound=300).collect()} for block in (16, 128)]
    assert seen.value == 2 * len(data)
    for k, size in enumerate((300, 90, 41, 7, 1)):
        h = np.array([x for s, _, x in data if s == k])
        d = np.sort(np.abs(h[:, None] - h[None, :]).ravel())[min(int(0.75 * size * size), size * size - 1)]
        want = min(max(min(max(d, 0.01), 10) / np.log(size + 1), 0.01), 10)
        assert [g[k] for g in got] == pytest.approx([want, want], rel=1e-9)
