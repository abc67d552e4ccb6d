"""Each operator against a brute-force version, on hard rows, empty tables and the project's own records."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import catalog, chat, fingerprints, hmm, html, langid, lines, neardup, packing, quality, traces, wordbpe
from voltide.operators import prep


@pytest.fixture(scope="session")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def hard(spark):
    """Traces with NULLs, empty and very long texts, ties, repeated rows, control characters and clashing columns."""
    long = "the quick brown fox of the north " * 4000
    rows = [
        (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (4, "one"), (5, long), (6, long), (None, "no id"), (None, None), (7, "\n\n\n"),
        (8, "x" * 50_000), (9, "a\x1cb \x00   é é \U0001f600 <|im_end|> <|endoftext|>"), (10, "The same line that is long enough\nshort\nThe same line that is long enough"),
        (11, "the same line THAT is long enough  \n"), (12, "\tThe same line that is long enough"),
    ]
    d = spark.createDataFrame(rows, "series_id long, trace string")
    names = ["n_words", "kept", "n_lines", "name", "keys", "words", "length", "piece", "ids", "score", "learn_", "band", "row", "class_id", "n_dropped", "keep_runs"]
    return d.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def traces_of_series(spark, sf):
    """The project's own records as traces: a line per tick of a series, its number, return and input status."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return traces.traces_of_series(prep.observations(e, "user_id", ["ts", "event_id"], "value"))


def empty(spark, schema="series_id long, trace string"):
    return spark.createDataFrame([], schema)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordbpe.tokenizer_path())


def rows_of(hard):
    return [(r.series_id, r.trace or "") for r in hard.select("series_id", "trace").collect()]


# --- 1: hidden Markov scores ---------------------------------------------------------------------------------------------

def test_base_counts(spark, sf, docs):
    got = {r.doc_id: r for r in catalog.QUERIES["op1_lm_scoring"](spark, sf).collect()}
    words = {d: t.encode().lower().split() + [b"\n"] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    better = tokens = 0
    for d, ws in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        if held[d]:
            better, tokens = better + r.score - r.base_score, tokens + r.n_tokens
    assert better / tokens > 0.2  # log10 a token on held-out rows


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    a, p = rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(2))
    m = hmm.Hmm(p, p, a, rng.dirichlet(np.ones(3), 2).T)
    seqs = [np.array(s, np.uint16) for s in ([0, 1, 2, 1], [2], [1, 1, 0])]
    for s, got in zip(seqs, hmm.forward(m, seqs)):
        total = 0.0
        for path in np.ndindex(*[2] * len(s)):
            x = p[path[0]] * m.emit[s[0], path[0]]
            for k in range(1, len(s)):
                x *= a[path[k - 1], path[k]] * m.emit[s[k], path[k]]
            total += x
        assert got == pytest.approx(math.log(total), rel=1e-12)


def test_training_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 6, rng.integers(1, 700)).astype(np.uint16) for _ in range(30)]
    parts, first = hmm.segments(seqs)
    assert sum(map(len, parts)) == sum(map(len, seqs)) and sum(first) == 30 and max(map(len, parts)) <= hmm.SEGMENT
    m, last = hmm.Hmm.initial(np.ones(6), 3), -1e99
    for _ in range(6):
        s, i, mv, e, ll = hmm.expected_counts(m, parts, first)
        assert ll >= last - 1e-3 and e.sum() == pytest.approx(sum(map(len, seqs)), rel=1e-4)
        last = ll
        m = hmm.Hmm(s / s.sum(), (i + 1e-9) / (i + 1e-9).sum(), mv / mv.sum(1, keepdims=True), e / e.sum(0))


def test_the_words_of_a_class_add_up(spark):
    d = spark.createDataFrame([(k, "a b c a b rare%d" % k, True) for k in range(20)], "series_id long, trace string, learn boolean")
    v = hmm.vocabulary(hmm.word_counts(d))
    assert v.n_tokens == 140 and v.n_words == 24 and len(v.head) == 24
    assert (v.unseen > 0).all() and (v.unseen <= 1).all()


def test_tokens_of_a_block():
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice("aB\x1c\x1f \t\n\x0b\x0c\r \x85é|") for _ in range(rng.randint(0, 12))) for _ in range(800)]
    words, codes, ends = hmm.block_words(texts)
    for t, a, z in zip(texts, [0, *ends[:-1]], ends):
        lower = t.translate({i: i + 32 for i in range(65, 91)})
        assert [words[k] for k in codes[a:z]] == [*re.findall(r"[^\x20\x09-\x0D]+", lower), hmm.END]


def test_hmm_hard_rows(spark, hard):
    d = hard.withColumn("learn", F.when(F.col("series_id") % 2 == 0, True).when(F.col("series_id").isNull(), None).otherwise(False))
    got = hmm.score_traces(d, rounds=1).collect()
    assert len(got) == hard.count() and all(math.isfinite(r.score) and r.score < 1e-9 for r in got)
    assert {r.n_tokens for r in got if r.series_id in (1, 2, 3, 7)} == {1}
    assert hmm.score_traces(empty(spark, "series_id long, trace string, learn boolean"), rounds=1).count() == 0
    none = hmm.score_traces(d.withColumn("learn", F.lit(False)), rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) for r in none)


def test_hmm_on_series(traces_of_series):
    got = hmm.score_traces(traces_of_series.withColumn("learn", F.col("series_id") % 5 > 0), rounds=2).collect()
    assert got and all(r.score > r.base_score for r in got if r.learn)


# --- 2: near duplicates --------------------------------------------------------------------------------------------------

def shingle_set(text):
    w = [x for x in (c.strip(neardup.EDGES) for c in text.lower().split()) if x]
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)}


def test_near_pairs_share_a_class(spark, sf, docs):
    got = {r.doc_id: r.class_id for r in catalog.QUERIES["op2_minhash_near_dedup"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    sets = {d: shingle_set(t) for d, t in docs.items()}
    ids, classes = sorted(docs), defaultdict(list)
    for i, a in enumerate(ids):
        classes[got[a]].append(a)
        for b in ids[:i]:
            if len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.82:
                assert got[a] == got[b], (a, b)
    for c, members in classes.items():
        assert c == min(members)
        for a in members if len(members) > 1 else []:
            assert max(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in members if b != a) > 0.7


def test_copies_of_one_origin_are_one_class_and_shared_passages_are_not(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 99999)}" for _ in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(200), 4):
            w[k] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    passage = [f"p{k}" for k in range(60)]
    for i in range(100):
        rows.append((2000 + i, " ".join([f"x{rng.randint(0, 10**6)}" for _ in range(60)] + passage + [f"y{rng.randint(0, 10**6)}" for _ in range(60)])))
    got = neardup.near_classes(spark.createDataFrame(rows, "series_id long, trace string")).collect()
    assert {r.class_id for r in got if r.series_id < 2000} == {0}
    assert len({r.class_id for r in got if r.series_id >= 2000}) == 100


def test_pairs_far_from_the_centre_of_a_large_bucket(spark):
    """Texts of one template (similarity 0.67) of which each has one partner at 0.802."""
    word = lambda *at: "w" + "x".join(map(str, at))
    rows = []
    for i in range(150):
        shared = [word(0, k) for k in range(84)] + [word(1, i, k) for k in range(9)]
        rows += [(2 * i + e, " ".join(shared + [word(2, i, e, k) for k in range(11)])) for e in (0, 1)]
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.81
    got = neardup.near_classes(spark.createDataFrame(rows, "series_id long, trace string")).collect()
    assert [r.series_id for r in got if r.class_id != r.series_id // 2 * 2] == []


def test_recall_at_the_declared_similarity(spark):
    """More than a hundred pairs of similarity 0.80 to 0.82, of several lengths, against brute force: none apart."""
    rng = random.Random(11)
    rows, pairs = [], []
    while len(pairs) < 140:
        n = rng.randint(120, 700)
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        edited = list(w)
        for at in rng.sample(range(2, n - 3), max(1, round(n * 0.0222))):
            edited[at] = f"v{rng.randrange(10**6)}"
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(edited))
        if 0.80 <= len(a & b) / len(a | b) < 0.82:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(edited))]
    got = {r.series_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "series_id long, trace string")).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert len(set(got.values())) == len(pairs)


def test_pairs_by_rare_shingles_are_all_pairs(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 3)] = [f"v{rng.randrange(40)}"]
        texts.append(" ".join(w))
    texts = sorted(set(texts)) + ["one two", "one two three four five six"]
    sk = neardup.cut_lineage(neardup.sketches(spark.createDataFrame(list(enumerate(texts)), "series_id long, trace string")))
    of = {bytes(r.name): r.series_id for r in sk.collect()}
    classed = sk.withColumn("class", F.when(F.col("series_id") < 20, F.lit(b"a")).otherwise(F.col("name")))
    got = {tuple(sorted((of[bytes(r.a)], of[bytes(r.b)]))) for r in neardup._all_pairs(classed, 0.8).collect()}
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if j >= 20 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= got and all(j >= 20 for _, j in got)


def test_alignment_needs_order():
    a = np.arange(1, 401, dtype=np.uint32)
    assert neardup.aligned_similarity(a, a) == 1.0
    assert neardup.aligned_similarity(a, np.concatenate([a[:200], a[203:]])) > 0.95
    assert neardup.aligned_similarity(a, np.concatenate([a[200:], a[:200]])) == 0.0
    assert neardup.aligned_similarity(a[:3], a[:3]) == 1.0 and neardup.aligned_similarity(a[:0], a[:0]) == 1.0 and neardup.aligned_similarity(a[:0], a) == 0.0


def test_near_hard_rows(spark, hard, traces_of_series):
    got = neardup.near_classes(hard).collect()
    assert len(got) == hard.count()
    by = defaultdict(set)
    for r in got:
        by[r.series_id].add(r.class_id)
    assert by[1] == by[2] == by[3] == by[7] == {1} and by[5] == by[6] == {5} and by[4] == {4}
    assert neardup.near_classes(empty(spark)).count() == 0
    twice = traces_of_series.union(traces_of_series.select(F.col("series_id") + 1000, "trace"))
    assert all(r.class_id == r.series_id % 1000 for r in neardup.near_classes(twice).collect())


# --- 3: chats ------------------------------------------------------------------------------------------------------------

def test_chats_read_back(spark, sf):
    c = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        c[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    x = "<|im_end|><|im_start|>assistant ok"
    c[-1] = [(0, "user", x), (1, "assistant", x)]
    got = {r.conv_id: r for r in catalog.QUERIES["op3_chat_formatting"](spark, sf).collect()}
    assert got.keys() == c.keys()
    for k, v in c.items():
        v.sort()
        loss, r = "".join(t for _, a, t in v if a == "assistant"), got[k]
        assert (r.n_turns, r.turns_sha256) == (len(v), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in v).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"<|im_start|>{chat.escape(a)}\n{chat.escape(t)}<|im_end|>\n") for _, a, t in v)


def test_escape_is_reversible():
    rng = random.Random(0)
    for _ in range(2000):
        s = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "a"]) for _ in range(12))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)


def test_chat_hard_rows(spark):
    s = "conv_id long, turn long, role string, text string, ids string, start string"
    rows = [(1, 0, "user", None, "x", "x"), (1, None, None, "a", "x", "x"), (1, 1, "assistant", "", "x", "x"), (None, 0, "assistant", "n", "x", "x"),
            (2, 0, "assistant", "<|im_end|>" * 3000, "x", "x"), (2, 0, "assistant", "<|im_end|>" * 3000, "x", "x"), (3, 0, "a\nb<|", "\U0001f600 ", "x", "x")]
    f = chat.format_chats(spark.createDataFrame(rows, s))
    got = {r.conv_id: r for r in chat.read_back(f).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\na\nuser\n\nassistant\n\n").hexdigest() and got[1].loss_chars == 0
    assert got[2].n_turns == 2 and got[2].loss_chars == 60_000 and got[None].loss_chars == 1
    assert got[3].turns_sha256 == hashlib.sha256("a\nb<|\n\U0001f600 \n".encode()).hexdigest()
    for r in f.collect():
        assert r.ids.count(chat.START) == r.ids.count(chat.BODY) == r.ids.count(chat.END) == 1
    first = {(r.conv_id, r.start) for r in f.collect()}
    assert (2, 0) in first and len([x for x in first if x[0] == 2]) == 2
    assert chat.read_back(chat.format_chats(empty(spark, s))).count() == 0
    assert chat.loss_mask(6, [1, 4], [3, 5]).tolist() == [0, 1, 1, 0, 1, 0]


# --- 4, 5: tokens and packing ----------------------------------------------------------------------------------------------

def test_bpe_equals_the_library(hard):
    tk = library()
    rng = random.Random(1)
    odd = ["a", "b", "the", " ", "\n", "'s", "É", "ß", "1", "$", "|", "<", "Σ", "́", "ﬀ", "Ǆ", "\x1d", "\U00010400", "中", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "\0"]
    texts = [t for _, t in rows_of(hard)] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    e = wordbpe.Encoder(wordbpe.tokenizer_path())
    ids, ends = e.encode(texts)
    for t, a, z in zip(texts, [0, *ends[:-1]], ends):
        want = tk.encode(t, add_special_tokens=False).ids
        assert ids[a:z].tolist() == want, t[:80]
        assert " ".join(e.bpe.decode(ids[a:z])) == tk.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, sf, docs, hard, traces_of_series):
    tk = library()
    for r in catalog.QUERIES["op4_bpe"](spark, sf).collect():
        want = tk.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert wordbpe.bpe_encode(hard).count() == hard.count() and wordbpe.bpe_encode(empty(spark)).count() == 0
    assert wordbpe.bpe_encode(traces_of_series).where("decoded != ''").count() == traces_of_series.count()


def check_places(rows, capacity):
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(seq)


def test_packing_query(spark, sf, docs, hard):
    tk = library()
    rows = catalog.QUERIES["op5_best_fit_packing"](spark, sf).collect()
    want = {}
    for d, t in docs.items():
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        want |= {(d, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_places(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 1
    some = packing.pack(packing.token_pieces(hard)).collect()
    assert {r.length for r in some if r.series_id in (1, 2, 3, 7)} == {1} and check_places(some, 2048)
    assert packing.pack(packing.token_pieces(empty(spark))).count() == 0


@pytest.mark.parametrize("lengths, least", [
    ([10] * 7, 7), ([4, 6] * 50, 50), ([3, 3, 4] * 30, 30), ([1, 2, 3, 4] * 25, 25), ([9, 8, 7, 2, 1, 3] * 10, 30), ([6, 6, 6], 3), ([5] * 9, 5)])
def test_plan(lengths, least):
    p = packing.Plan(np.bincount(lengths, minlength=11))
    assert p.sequences == least
    assert sum(r[1] for runs in p.runs.values() for r in runs) == len(lengths)


def test_packing_ticks_of_series(spark, sf):
    """The project's own records: chunks of series by their number of ticks; repeated rows and a hot length."""
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("series_id")).agg(F.count("*").alias("length"))
    e = e.union(e).union(spark.range(300).select(F.lit(1).cast("long"), F.lit(7).cast("long"))).withColumn("piece", F.lit(0)).withColumn("offset", F.lit("clash"))
    rows = packing.pack(e, 300).collect()
    assert len(rows) == e.count() and check_places(rows, 300) <= -(-sum(r.length for r in rows) // 300) + 1


# --- 6, 10: lines and quality ------------------------------------------------------------------------------------------------

def test_line_dedup_hard_rows(spark, hard, traces_of_series):
    got = defaultdict(list)
    for r in lines.dedup_lines(hard).collect():
        got[r.series_id].append(r)
    assert got[1][0].n_lines == 1 and got[1][0].kept == "" and got[7][0].n_lines == 4 and got[7][0].kept == "\n\n\n"
    assert (got[10][0].n_lines, got[10][0].n_dropped, got[10][0].kept, got[10][0].keep_runs) == (3, 2, "short", [0, 1, 1, 1])
    assert (got[11][0].n_dropped, got[11][0].kept) == (1, "") and got[12][0].kept == "\tThe same line that is long enough"
    assert len(got[None]) == 2 and len(got[4]) == 2 and got[5][0].n_dropped == 0
    assert lines.dedup_lines(empty(spark)).count() == 0
    three = traces_of_series.union(traces_of_series.select(F.col("series_id") + 1000, "trace")).union(traces_of_series.select(F.col("series_id") + 2000, "trace"))
    out = lines.dedup_lines(three, min_chars=5)
    assert out.where("series_id >= 2000 and n_dropped > 0").count() <= out.where("series_id < 2000 and n_dropped > 0").count()
    assert out.where("series_id < 2000 and n_dropped = 0").count() == 0


def test_runs(spark):
    d = spark.createDataFrame([([0, 1, 5],), ([2],), ([0, 1, 2, 3, 4, 5, 6, 7],)], "p array<int>").select("p", lines._runs(F.col("p")).alias("r"))
    text = F.split(F.lit("a,b,c,d,e,f,g,h"), ",")
    got = [(r.r, r.k) for r in d.select("r", lines.apply_runs(text, F.col("r")).alias("k")).collect()]
    assert got == [([0, 2, 3, 1], "c\nd\ne\ng\nh"), ([2, 1], "a\nb\nd\ne\nf\ng\nh"), ([0, 8], "")]


def measures(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(ls) - len(set(ls)), len(covered), base


def test_quality_measures(spark, hard, docs, traces_of_series):
    d = hard.union(spark.createDataFrame([(k, t) for k, t in list(docs.items())[:60]], "series_id long, trace string").select("series_id", "trace", *[F.lit("") for _ in range(16)]))
    got = quality.quality_rules(d)
    want = sorted((str(s), *measures(t)) for s, t in rows_of(d))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r.series_id), *[r[c] for c in cols]) for r in got.collect()) == want
    assert got.where("base_failed and kept").count() == 0 and got.where("kept").count() > 0
    assert quality.quality_rules(empty(spark)).count() == 0
    assert quality.quality_rules(traces_of_series).count() == traces_of_series.count()


def test_quality_is_native(spark, hard):
    plan = quality.quality_rules(hard)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- 7: pages ------------------------------------------------------------------------------------------------------------------

ARTICLE = "The wind of the north was not as strong as it was in the night, and the ships that lay in the bay went on to the sea with it."


def test_pages(spark, sf):
    import html as h
    import re

    got = {r.page_id: r.text for r in catalog.QUERIES["op7_html_extraction"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a, z = r.html.find("<article>"), r.html.find("</article>")
        body = re.sub(r"<[^>]*$", "", r.html[a + 9 : z if z >= 0 else None]) if a >= 0 else ""
        parts = (" ".join(h.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain words", ""), (f"<p>{ARTICLE}", ARTICLE), ("<html><body></body></html>", ""),
    (f"<nav><a href=x>the news of the day and of the night and more of it</a></nav><div><h1>Wind</h1><p>{ARTICLE}</p><p>So it was.</p><p>{ARTICLE}</p></div><footer>all rights of the site</footer>",
     f"Wind\n\n{ARTICLE}\n\nSo it was.\n\n{ARTICLE}"),
    (f"<div class='cookie-banner'>{ARTICLE}</div><article><p>{ARTICLE}</p><p>a &lt;b&gt; &amp; c&nbsp;d</p><aside>{ARTICLE}</aside><section id=comments><p>{ARTICLE}</p></section></article>",
     f"{ARTICLE}\n\na <b> & c d"),
    (f"<article><h1>T</h1><form>{ARTICLE}</form><script>var a='<p>{ARTICLE}</p>';</script><p>{ARTICLE}<br>more</p><!-- <p>x</p> --></article><p>{ARTICLE}</p>", f"T\n\n{ARTICLE} more"),
])
def test_page_parts(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<main class='site-main has-sidebar'><p>{ARTICLE}</p></main>", ARTICLE), (f"<div class='layout no-sidebar'><p>{ARTICLE}</p></div>", ARTICLE),
    (f"<article class='post comments-open'><p>{ARTICLE}</p></article>", ARTICLE), (f"<form><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div></form>", f"{ARTICLE}\n\n{ARTICLE}"),
    (f"<form id=f><nav>a b</nav><article><h1>T</h1><p>{ARTICLE}</p></article></form>", f"T\n\n{ARTICLE}"),
    (f"<div title='the hidden cost'><p>{ARTICLE}</p></div>", ARTICLE), (f"<div data-x='class=ad'><p>{ARTICLE}</p></div>", ARTICLE),
    (f"<div class='left-sidebar'><article><p>{ARTICLE}</p></article></div>", ARTICLE), (f"<main id=content role=main class=widget><p>{ARTICLE}</p></main>", ARTICLE),
    (f"<x-app class=widget><p>{ARTICLE}</p></x-app>", ARTICLE),
    # still boilerplate
    (f"<article><p>{ARTICLE}</p><div class=site-footer>{ARTICLE}</div><section id=comments><p>{ARTICLE}</p><p>{ARTICLE}</p></section></article>", ARTICLE),
    (f"<p>{ARTICLE}</p><div hidden><p>{ARTICLE} {ARTICLE}</p></div><div style='display: none'><h1>T</h1></div><div class='ad-slot'>{ARTICLE}</div>", ARTICLE),
    (f"<div class=post><p>{ARTICLE}</p></div><div id=comments><article class=comment><p>{ARTICLE}</p></article></div>", ARTICLE),
])
def test_wrappers_of_articles_stay(page, want):
    assert html.main_text(page) == want


CHINESE = "这是一篇关于海风的文章。我们在山上看见了大海，也听见了风的声音。城里的人们都说，今年的冬天比往年更冷，但是海边的村子里还很暖和。" * 3
RUSSIAN = "Ветер дул с моря весь день. Люди в городе говорили, что зима будет долгой и холодной. Но у берега ещё было тепло, и лодки выходили на рассвете. " * 2


@pytest.mark.parametrize("page, want", [
    # links say nothing inside an article, nor of a heading
    (f"<article><h1><a href=/x>Title of it</a></h1><p>{ARTICLE}</p></article>", f"Title of it\n\n{ARTICLE}"),
    (f"<div><h1><a href=/x>Title of it</a></h1><p>{ARTICLE}</p></div>", f"Title of it\n\n{ARTICLE}"),
    (f"<article><p><a href=/x>{ARTICLE}</a></p><ul><li><a href=1>first point</a></li><li><a href=2>second point</a></li></ul><p>{ARTICLE}</p></article>",
     f"{ARTICLE}\n\nfirst point\n\nsecond point\n\n{ARTICLE}"),
    # outside it they do
    (f"<p>{ARTICLE}</p><ul><li><a href=1>{ARTICLE}</a></li></ul>", ARTICLE),
    # names written together
    (f"<article><p>{ARTICLE}</p><ol class=commentlist><li>{ARTICLE}</li></ol><div class=rightbar>{ARTICLE}</div><div class=adbox>{ARTICLE}</div></article>", ARTICLE),
    (f"<article class=address><p class=blockquote>{ARTICLE}</p><p id=textlist>short one</p></article>", f"{ARTICLE}\n\nshort one"),
    # other languages
    (f"<ul><li><a href=1>首页</a></li></ul><div><h1>海风</h1><p>{CHINESE}</p><p>短句。</p></div>", f"海风\n\n{CHINESE}\n\n短句。"),
    (f"<div><a href=1>О сайте</a></div><div><p>{RUSSIAN}</p></div><div>© 2020</div><nav>{RUSSIAN}</nav>", RUSSIAN.strip() + "\n\n© 2020"),
    # a quote that never ends
    (f"<article class=\"a><p>{ARTICLE}</p></article>", ARTICLE),
])
def test_links_names_and_languages(page, want):
    assert html.main_text(page) == want


def test_density_decides_on_pages_without_article():
    """Prose between link lists, notices and short lines, with no element that marks an article."""
    rng = random.Random(7)
    for _ in range(50):
        prose = [f"{ARTICLE} Part {k}." for k in range(rng.randint(1, 4))]
        links = "".join(f"<td><a href=/{k}>{rng.choice(['news', 'the sports of the day', 'weather'])}</a></td>" for k in range(rng.randint(3, 9)))
        table = f"<table><tr>{links}</tr></table>"
        body = "".join(f"<div>{p}</div>" for p in prose)
        assert html.main_text(f"{table}<table><tr><td>{body}</td></tr></table>{table}") == "\n\n".join(prose)


@pytest.mark.parametrize("unit", ["<span class=ad>word ", "<head>word ", "<x1 class='ad'><x2 class=ad>", "<svg>", "<div>word</p>", "<a \"", "</b", "<i class=ad>w</i>", "<p class='x\" "])
def test_pages_of_two_megabytes_in_linear_time(unit):
    import time

    def seconds(size):
        t = time.process_time()
        html.main_text(unit * (size // len(unit)))
        return time.process_time() - t

    assert seconds(2_000_000) < 20 * seconds(250_000) + 2


def test_page_hard_rows(spark):
    s = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", f"<p>{ARTICLE}</p>" * 2000, "x"), (2, "u", f"<p>{ARTICLE}</p>" * 2000, "x"), (3, "u", "<" * 5000 + "a" * 5000, "x"),
            (4, "u", "<div>" * 3000, "x"), (5, "u", "<script>" + "x" * 10_000, "x")]
    got = html.extract_pages(spark.createDataFrame(rows, s)).collect()
    assert len(got) == 7 and all(r.text is not None for r in got) and sum(len(r.text) > 200_000 for r in got) == 2
    assert html.extract_pages(empty(spark, s)).count() == 0


# --- 8: languages --------------------------------------------------------------------------------------------------------------

def test_gradients_are_those_of_the_loss():
    net = langid.ByteGru(3, hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 255, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    real = (rng.random((6, 4)) > 0.2).astype(float)
    _, g = net.gradients(x, y, real)
    for k, at in (("Wf", (x[2, 1], 4)), ("Wb", (x[3, 0], 1)), ("Uf", (2, 1)), ("Ub", (7, 0)), ("V", (1, 4)), ("c", (2, 0))):
        kept = net.w[k][at]
        net.w[k][at] = kept + 1e-2
        up = net.gradients(x, y, real)[0]
        net.w[k][at] = kept - 1e-2
        assert g[k][at] == pytest.approx((up - net.gradients(x, y, real)[0]) / 2e-2, rel=2e-2, abs=1e-4)
        net.w[k][at] = kept


def test_languages_of_held_out_documents(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = catalog.QUERIES["op8_language_id"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in got} == set(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_language_hard_rows(spark):
    learn = spark.createDataFrame([("the cat and the dog of the house " * 3, "en"), ("der Hund und die Katze von dem Haus " * 3, "de"), (None, "fr"), ("x", None), ("123", "es")], "text string, lang string")
    s = "text_id long, text string, lang string, score string"
    rows = [(1, None, "x", "x"), (2, "", "x", "x"), (3, "123 !?", "x", "x"), (4, "the dog and the cat " * 3000, "x", "x"), (4, "the dog and the cat " * 3000, "x", "x"), (None, "die Katze und der Hund", "x", "x")]
    d = spark.createDataFrame(rows, s)
    got = langid.identify_languages(d, learn).collect()
    assert [(r.lang_pred, r.score) for r in got if r.text_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in got if r.text_id == 4] == ["en", "en"] and [r.lang_pred for r in got if r.text_id is None] == ["de"]
    assert langid.identify_languages(empty(spark, s), learn).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(d, learn.where("false")).collect()} == {"und"}


def test_every_position_has_a_label():
    net = langid.ByteGru(2, seed=0)
    assert len(langid.position_labels(net, ["a", "b"], "é" * 100)) == 200 and langid.position_labels(net, ["a", "b"], "") == []


# --- 9: fingerprints -----------------------------------------------------------------------------------------------------------

def test_fingerprint_query(spark, sf, docs):
    got = {r.doc_id: r for r in catalog.QUERIES["op9_document_fingerprints"](spark, sf).collect()}
    ids = sorted(docs)
    assert sorted(got) == ids
    by_text = defaultdict(set)
    for k, i in enumerate(ids):
        t, x, r = docs[i], docs[ids[(k + 1) % len(ids)]], got[i]
        q = len(t) // 4
        e = t[: len(t) - q] + x[:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        f = fingerprints.fingerprint_block([t, e, x])
        assert [r.fingerprint, r.edited_fingerprint] == fingerprints.shown(f[:2])
        assert r.near_edited == pytest.approx(fingerprints.likeness(f[:1], f[1:2])[0]) and r.near_next == pytest.approx(fingerprints.likeness(f[:1], f[2:])[0])
        by_text[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r.near_edited for r in got.values()]) > 0.5 > 0.1 > np.mean([r.near_next for r in got.values()])


def test_parsing_does_not_depend_on_the_offset(docs):
    t = max(docs.values(), key=len)
    f = fingerprints.fingerprint_block([t, "some words before " + t, t[::-1], ""])
    assert fingerprints.likeness(f[:1], f[1:2])[0] > 0.9 and fingerprints.likeness(f[:1], f[2:3])[0] < 0.1
    assert not f[3].any() and fingerprints.likeness(f[3:], f[3:])[0] == 1.0
    names, ends = fingerprints.parse(np.frombuffer("aaaaabcabc".encode("utf-32-le"), np.uint32), np.array([10]))
    assert ends[-1] == len(names)


def test_fingerprint_bands_and_hard_rows(spark, hard, traces_of_series):
    whole = {r.series_id: r.asDict() for r in fingerprints.compare_with_next(traces_of_series, rows_a_band=10**6).collect()}
    cut = {r.series_id: r.asDict() for r in fingerprints.compare_with_next(traces_of_series.repartition(5), rows_a_band=2).collect()}
    assert whole == cut and len(whole) == traces_of_series.count()
    got = fingerprints.compare_with_next(hard, rows_a_band=2).collect()
    assert len(got) == hard.count() and all(0 <= r.near_edited <= 1 for r in got)
    assert {r.near_next for r in got if r.series_id is None and r.n_chars == 0} == {1.0}
    assert fingerprints.compare_with_next(empty(spark)).count() == 0 and fingerprints.fingerprints(empty(spark)).count() == 0
    same = {r.series_id: r.fingerprint for r in fingerprints.fingerprints(hard).collect()}
    assert same[5] == same[6] and set(same[1]) == {"0"}
