"""Operators 11 to 13: brute force, hard rows, empty tables, lost runs and the project's own records."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import catalog, divergence, exact, periodic

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def hard_traces(spark):
    long = "one two three four " * 9000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (5, long), (6, long), (None, "a b"), (None, None), (None, "only without id"), (7, "A b"), (8, "a b ")]
    d = spark.createDataFrame(rows, "series_id long, trace string")
    return d.withColumns({c: F.lit(c) for c in ("digest", "keep_id", "group_size", "kept", "batch", "_found", "_old", "runs", "top", "collapsed", "start", "n")}), rows


# --- 11: divergence of sources ---------------------------------------------------------------------------------------------

def brute_divergence(rows, least, top):
    """rows: (scenario, arm, text). The definition in whole numbers of Python."""
    counts, seen, arms = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for scenario, arm, text in ((a or "", b or "", c or "") for a, b, c in rows):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[scenario, arm].update(found)
        seen[scenario].update(set(found))
        arms[scenario].add(arm)
    out = []
    for scenario, names in arms.items():
        terms = [t for t, n in seen[scenario].items() if n >= least]
        size = len(terms)

        def shares(count):
            total = sum(count[t] for t in terms)
            return {t: 1 + (10**9 * (count[t] + 5)) // (total + 5 * size) for t in terms}

        whole = Counter()
        for a in names:
            whole.update(counts[scenario, a])
        q, p = shares(whole), {a: shares(counts[scenario, a]) for a in names}
        for a in names:
            pairs = [(b, sum(abs(p[a][t] - p[b][t]) for t in terms)) for b in names if b != a]
            above = [(t, p[a][t] - q[t]) for t in terms if counts[scenario, a][t] > 0 and p[a][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", above, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(scenario, a, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def audit(spark, rows, **kw):
    d = spark.createDataFrame(rows, "scenario string, arm string, trace string")
    return sorted(tuple(r) for r in divergence.source_divergence(d.withColumns({c: F.lit(c) for c in ("n", "term", "p", "tile", "rank")}), **kw).collect())


def test_divergence_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "straße", "ZZ", "日本"]
    rows = []
    for k in range(400):
        arm = "hot" if k % 3 == 0 else f"arm{rng.randrange(7)}"
        rows.append((rng.choice(["calm", "crisis"]), arm, " ".join(rng.choice(words[: rng.randint(1, len(words))]) + rng.choice(["", "1", ",", "_"]) for _ in range(30))))
    rows += [("calm", "silent", None), ("calm", "silent", ""), ("lone", "one", "x y z"), (None, None, "null text"), (None, "b", "1 2 3"), ("", "b", "again again")]
    want = brute_divergence(rows, 10, 5)
    assert audit(spark, rows, min_traces=10, top=5) == want
    monkeypatch.setattr(divergence, "BLOCK", 16)
    monkeypatch.setattr(divergence, "TILE", 2)
    assert audit(spark, rows, min_traces=10, top=5) == want


def test_divergence_without_terms_and_rows(spark):
    assert audit(spark, [("a", "x", "once"), ("a", "y", None)]) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
    assert divergence.source_divergence(spark.createDataFrame([], "scenario string, arm string, trace string")).count() == 0


def test_large_counts_stay_exact(spark):
    d = spark.createDataFrame([(10**13 + 7, 3 * 10**14 + 1, 10**6)], "n long, total long, size long")
    got = d.select(divergence.scaled_share(F.col("n"), F.col("total"), F.col("size"))).first()[0]
    assert got == 1 + (10**9 * (10**13 + 12)) // (3 * 10**14 + 1 + 5 * 10**6)


def test_run_length_columns():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.sort(rng.integers(0, 4, n)) * 100 if rng.random() < 0.5 else rng.integers(0, 3, n) for _ in range(2))
        (ea, va), (eb, vb) = divergence.run_lengths(a), divergence.run_lengths(b)
        assert np.array_equal(np.repeat(va, np.diff(ea, prepend=0)), a)
        assert divergence.runs_distance(ea, va, eb, vb) == np.abs(a - b).sum()


def test_vocabulary_order_makes_runs(spark):
    """Equal counts stand together: the columns of the largest arm have one run a count."""
    rows = [("s", f"a{k % 3}", " ".join(f"t{chr(97 + j)}" for j in range(20) if (k + j) % 2 or j % 3)) for k in range(60)]
    counts = divergence.term_counts(spark.createDataFrame(rows, "scenario string, arm string, trace string")).where("term is not null")
    groups = spark.createDataFrame([("s", f"a{k}", k, 0, 1, 20, 7) for k in range(3)], "scenario string, arm string, number int, tile int, tiles int, size int, p_none long")
    counted = counts.join(groups.select("arm", "number"), "arm").withColumn("p", F.col("n"))
    for r in divergence._columns(counted, groups).collect():
        different = counted.where(F.col("arm") == r["arm"]).select("n").distinct().count()
        assert r["ends"][-1] == 20 and (r["arm"] != "a0" or len(r["ends"]) <= different + 1)


# --- 12: exact dedup -------------------------------------------------------------------------------------------------------

def test_exact_dedup_on_hard_rows(spark):
    d, rows = hard_traces(spark)
    got = exact.index_traces(d).collect()
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    want = []
    for i, t in rows:
        ids = by_text[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, hashlib.sha256((t or "").encode()).digest(), keep, len(ids), i == keep))
    key = lambda r: repr(tuple(r))
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got), key=key) == sorted(want, key=key)
    assert exact.index_traces(spark.createDataFrame([], "series_id long, trace string")).count() == 0


def test_index_lasts_and_a_lost_call_is_repeated(spark, fresh):
    rows = lambda *r: spark.createDataFrame(list(r), "series_id long, trace string")
    marks = lambda d: sorted((r.series_id, r.keep_id, r.group_size, r.kept) for r in d.collect())
    path = fresh + "/index"
    first = exact.index_traces(rows((1, "x"), (5, "x"), (3, "y")), path)
    assert marks(first) == [(1, 5, 2, False), (3, 3, 1, True), (5, 5, 2, True)]
    later = rows((9, "x"), (8, "z"), (7, "z"), (6, "y"))
    want = [(6, 3, 1, False), (7, 8, 2, False), (8, 8, 2, True), (9, 5, 1, False)]
    assert marks(exact.index_traces(later, path)) == want
    assert marks(exact.index_traces(later, path, call=2)) == want  # as after a loss
    index = exact.open_index(spark, path)
    assert spark.table(index).select("digest").distinct().count() == spark.table(index).count() == 3
    assert marks(exact.index_traces(rows((2, "z")), path)) == [(2, 8, 1, False)]


def test_index_meets_new_rows_without_moving(spark, fresh):
    """The anti-join is a sort-merge join whose index side has no exchange."""
    rows = spark.createDataFrame([(k, str(k % 7)) for k in range(50)], "series_id long, trace string")
    path = fresh + "/index"
    exact.index_traces(rows, path)
    index = exact.open_index(spark, path)
    new = rows.select("series_id", exact.trace_digest(F.col("trace")).alias("digest")).groupBy("digest").agg(F.max("series_id")).repartition(exact.BUCKETS, "digest")
    plan = new.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan[plan.index("SortMergeJoin"):].split("FileScan")[1].split("Sort [")[-1] and f"Bucketed: true" in plan


def test_exact_dedup_of_any_ids(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y")], "series_id string, trace string")
    assert sorted((r.series_id or "", r.keep_id, r.kept) for r in exact.index_traces(d).collect()) == [("", None, True), ("a", "b", False), ("b", "b", True)]


# --- 13: periodic runs -----------------------------------------------------------------------------------------------------

def brute_runs(w):
    """All maximal stretches of smallest period q and max(6, 4 q) words or more."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            x = w[i : i + n]
            if j > i and n >= max(6, 4 * q) and all(any(x[k] != x[k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(0, 5)):
            n, k = rng.randint(0, 40), rng.randint(1, 4)
            w = [rng.choice("abcd"[:k]) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        _, codes, ends = periodic.word_codes([rng.choice(["", " ", "\n"]) + " ".join(w) + rng.choice(["", "\t"]) for w in texts])
        assert periodic.runs_of(codes, ends) == [brute_runs(w) for w in texts]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.integers(0, 12, int(rng.integers(1, 5)))
        codes, ends = rng.integers(0, 2, n.sum()).astype(np.int64), np.cumsum(n)
        sa, isa, lcp = periodic.suffix_array(codes, ends)
        tail = lambda i: [int(np.searchsorted(ends, i, side="right")), *codes[i : ends[np.searchsorted(ends, i, side="right")]].tolist()]
        assert [tail(i) for i in sa] == sorted(tail(i) for i in range(len(codes)))
        assert all(isa[i] == k for k, i in enumerate(sa))
        for k in range(1, len(sa)):
            a, b = tail(sa[k - 1]), tail(sa[k])
            shared = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert lcp[k] == max(0, shared - 1)


def test_each_run_ends_in_one_branching_square():
    codes = np.array([0, 1] * 6 + [2], np.int64)
    start, period = periodic.branching_squares(codes, np.array([13]))
    assert sorted(zip((start + 2 * period).tolist(), period.tolist())) == [(12, 2), (12, 4), (12, 6)]


def test_periodic_query_against_brute_force(spark, sf, docs):
    want = []
    for r in docs:
        w = re.findall(SPACE, r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w)
        top = min(runs, key=lambda x: (-(x[1] / x[2]), x[0], x[2]), default=None)
        want.append((r.doc_id, len(runs), *(top[k] if top else None for k in range(3)), 1000 * top[1] // top[2] if top else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    got = catalog.QUERIES["op13_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 10


def test_runs_on_hard_rows(spark):
    d, rows = hard_traces(spark)
    got = sorted(((r.series_id or -1, [tuple(x) for x in r.runs], r.top and tuple(r.top), r.collapsed) for r in periodic.periodic_runs(d).collect()), key=repr)
    want = []
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        runs = [(0, 36000, 4)] if len(w) == 36000 else []
        want.append((i or -1, runs, runs[0] if runs else None, "one two three four" if runs else " ".join(w)))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], "series_id long, trace string")).count() == 0


def test_ties_of_the_top_run():
    assert periodic.top_run([(0, 8, 2), (9, 4, 1), (20, 12, 3)]) == (0, 8, 2)
    assert periodic.top_run([(3, 10**6 * 4, 10**6), (4, 10**6 * 4 + 1, 10**6)]) == (4, 10**6 * 4 + 1, 10**6)
    assert periodic.top_run([]) is None


def test_stale_feed_of_a_series(spark, sf):
    """The project's own records: returns of a series whose feed repeats its last three ticks."""
    ticks = " ".join(f"{k},{k * k % 17}" for k in range(30)) + " 0.1 0.2 0.3" * 5
    r = periodic.periodic_runs(spark.createDataFrame([(7, ticks)], "series_id long, trace string")).first()
    assert [tuple(x) for x in r.runs] == [(30, 15, 3)] and r.collapsed.endswith("0.1 0.2 0.3")
