"""The pipeline against a brute-force version of its stages, and its stages on hard rows."""

from collections import defaultdict

import corpus_pipeline as pipeline
from test_operators import measures, shingle_set

from voltide.llm import quality


def test_stages_keep_columns_and_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality rules", "language ID", "line dedup", "near duplicates", "packing"]
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut_lineage(stage(spark, docs, sf))
        assert docs.columns == pipeline.COLUMNS
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert all(not measures(texts[d])[5] for d in seen["quality rules"])
    verdict = {r.series_id: r.kept for r in quality.quality_rules(pipeline._traces(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert set(seen["quality rules"]) == {d for d, k in verdict.items() if k}
    # lines: by brute force over what the stage before kept
    of = defaultdict(set)
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    before = seen["language ID"]
    for d, r in before.items():
        for x in r.text.split("\n"):
            of[key(x)].add(d)
    for d, r in before.items():
        want = "\n".join(x for x in r.text.split("\n") if not (len(key(x)) >= 20 and len(of[key(x)]) >= 3 and max(of[key(x)]) != d))
        if want.strip(" \t\n\v\f\r"):
            assert seen["line dedup"][d].text == want and seen["line dedup"][d].n_chars == len(want)
        else:
            assert d not in seen["line dedup"]
    # near duplicates: no two that are clearly alike stay, and what goes has a partner
    stay, all_ = seen["near duplicates"], seen["line dedup"]
    sets = {d: shingle_set(r.text) for d, r in all_.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    kept = sorted(stay)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[:i] if like(a, b) >= 0.82]
    for d in set(all_) - set(stay):
        assert max(like(d, x) for x in all_ if x != d) > 0.7
    pieces = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == set(stay)


def test_run_equals_the_stages(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_on_hard_and_empty_rows(spark, sf):
    s = "doc_id long, text string, lang string, source string, n_chars long"
    long = "the wind of the north was not as strong and it went on to the sea with all of it "
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long * 5, "en", None, 1), (3, long * 5, "en", None, 1), (None, long * 5, None, "s", 1), (4, long * 900, "en", "s", 1),
            (5, "der Hund und die Katze von dem Haus und das Kind mit der Frau auf dem Weg zu den Leuten " * 4, "de", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, s)
        for _, stage in pipeline.STAGES:
            docs = pipeline.cut_lineage(stage(spark, docs, sf))
        docs.collect()


def test_rows_of_one_id_and_different_classes_stay(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, text(0), "en", "s", 1), (1, text(1), "en", "s", 1), (1, text(1), "en", "s", 1), (2, text(0), "en", "s", 1), (2, text(2), "en", "s", 1), (3, text(2), "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = pipeline.near_stage(spark, docs, "")
    assert got.columns == pipeline.COLUMNS
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, text(0)), (1, text(1)), (2, text(2)), (4, "")]
