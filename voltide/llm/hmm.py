"""A hidden Markov language model: Baum-Welch counts from all partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.llm.blocks import named_chunks, text_blocks
from voltide.session import cut_lineage

STATES = 8
OWN_SYMBOLS = 8_191  # the most frequent words, the end among them, each a symbol of its own
CLASSES = 1_024  # other words by a hash of their last three bytes; words of a class share a symbol
HEAD = 131_072  # most frequent words whose counts travel to the tasks; those of others are joined
ROUNDS = 5
SEGMENT = 256  # tokens that a training sequence has at most; longer traces give several
END = "\n"  # no word has white space
GROUP = 4_096  # segments that are trained on side by side
LOG10 = float(np.log10(np.e))


def word_class(word: str) -> int:
    return zlib.crc32(word.encode()[-3:]) % CLASSES


def word_name(word: str) -> int:
    """64 bits, as a signed long."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def block_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of a block, each token's number among them, and where each text's tokens end. Tokens are the
    words between ASCII white space, A-Z in lower case, and an END after each text."""
    words, codes, ends = named_chunks(pc.ascii_lower(pa.array(texts, pa.string())), ascii_only=True)
    if "" in words:
        real = codes != words.index("")
        codes, ends = codes[real], np.append(0, np.cumsum(real))[ends]
    return [*words, END], np.insert(codes, ends, len(words)), ends + np.arange(1, len(texts) + 1)


def word_counts(traces: DataFrame) -> DataFrame:
    """name, cls, count of all words of traces, the end included; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            words = list(found)
            out = pa.RecordBatch.from_arrays(
                [pa.array(map(word_name, words), pa.int64()), pa.array(map(word_class, words), pa.int16()), pa.array(found.values(), pa.int64())],
                ["name", "cls", "count"])
            found.clear()
            return out

        found: Counter = Counter()
        for _, texts in text_blocks(batches, "trace"):
            words, codes, _ = block_words(texts)
            times = np.bincount(codes, minlength=len(words))
            for w, n in zip(words, times.tolist()):
                if n:
                    found[w] += n
            if len(found) > 400_000:
                yield flush()
        if found:
            yield flush()

    c = traces.select("trace").mapInArrow(run, "name long, cls short, count long")
    return c.groupBy("name", "cls").agg(F.sum("count").alias("count"))


@dataclass
class Vocabulary:
    """What the tasks know of the words: sizes, the head's counts and, per class, how its words share a symbol."""

    n_tokens: int
    n_words: int
    head: dict[int, int]  # name: rank
    counts: np.ndarray  # by rank
    mass: np.ndarray  # tokens per class of words without an own symbol
    unseen: np.ndarray  # share of a class's tokens for unknown words

    def share(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a known word's probability within its class."""
        return np.log10(count * (1 - self.unseen[cls]) / self.mass[cls])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver gets HEAD counts and CLASSES sums; an unknown word has, as Good and Turing estimate it, the
    probability of the words seen once."""
    total = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("count"), "name").limit(HEAD).select("name", "cls", "count").toArrow()
    name, cls, count = (top.column(c).to_numpy().astype(np.int64) for c in ("name", "cls", "count"))
    mass, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("count").alias("m"), F.sum(F.when(F.col("count") == 1, 1).otherwise(0)).alias("o")).collect():
        mass[r["cls"]], once[r["cls"]] = r["m"], r["o"]
    np.subtract.at(mass, cls[:OWN_SYMBOLS], count[:OWN_SYMBOLS])
    np.subtract.at(once, cls[:OWN_SYMBOLS], (count[:OWN_SYMBOLS] == 1).astype(float))
    return Vocabulary(int(total["n"] or 0), int(total["v"]), dict(zip(name.tolist(), range(len(name)))), count, np.maximum(mass, 1),
                      np.where(mass > 0, (once + 0.5) / (mass + 1), 1.0))


def symbol_rows(traces: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Traces as symbols: series_id, learn, row, symbols (unsigned 16-bit, the end last), n_tokens, and of the head's
    words n_known, base (sum of log10(count + 0.1)) and share (log10 of words within their class); rare: other words
    as name, cls and how many."""
    head_bc = traces.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = head_bc.value
        log_count = np.log10(np.append(v.counts, 0) + 0.1)  # rank -1: the last
        for b, texts in text_blocks(batches, "trace", 3_000_000):
            words, codes, ends = block_words(texts)
            name = np.fromiter(map(word_name, words), np.int64, len(words))
            cls = np.fromiter(map(word_class, words), np.int64, len(words))
            rank = np.fromiter((v.head.get(x, -1) for x in name.tolist()), np.int64, len(words))
            own = (rank >= 0) & (rank < OWN_SYMBOLS)
            symbol = np.where(own, rank, OWN_SYMBOLS + cls).astype(np.uint16)
            in_class = np.zeros(len(words))
            mid = rank >= OWN_SYMBOLS
            in_class[mid] = v.share(v.counts[rank[mid]], cls[mid])
            starts = np.append(0, ends[:-1])

            def summed(x: np.ndarray) -> np.ndarray:
                return np.add.reduceat(x[codes], starts)

            n_known, base, share = summed((rank >= 0).astype(np.int64)), summed(np.where(rank >= 0, log_count[rank], 0.0)), summed(in_class)
            sym = symbol[codes]
            symbols = [sym[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist())]
            place = np.flatnonzero(rank[codes] < 0)
            text = np.searchsorted(ends, place, side="right")
            pair, times = np.unique(text * len(words) + codes[place], return_counts=True)
            of = pair % len(words)
            rare = pa.ListArray.from_arrays(
                np.searchsorted(pair // len(words), np.arange(len(texts) + 1)).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(name[of]), pa.array(cls[of].astype(np.int16)), pa.array(times.astype(np.int32))], ["name", "cls", "times"]))
            sizes = ends - starts
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(symbols, pa.binary()), pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()),
                 pa.array(base), pa.array(share), rare],
                ["series_id", "learn", "row", "symbols", "n_tokens", "n_known", "base", "share", "rare"])

    d = traces.select("series_id", "learn", F.monotonically_increasing_id().alias("row"), "trace")
    return d.mapInArrow(run, f"series_id {dict(d.dtypes)['series_id']}, learn boolean, row long, symbols binary, n_tokens long, n_known long, base double, "
                             "share double, rare array<struct<name: long, cls: short, times: int>>")


@dataclass
class Hmm:
    start: np.ndarray  # of a trace
    inner: np.ndarray  # of a later segment of a trace, in training
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @staticmethod
    def initial(weight: np.ndarray, states: int = STATES, seed: int = 0) -> Hmm:
        """Symbols by their counts, shaken apart by state; states that last."""
        rng = np.random.default_rng(seed)
        emit = (weight + 0.1)[:, None] * rng.lognormal(0, 1, (len(weight), states))
        even = np.full(states, 1 / states)
        return Hmm(even, even, np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))


def forward(m: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion; sequences run side by side, the longest
    first, those that have ended leave."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    size = np.array([len(sequences[k]) for k in order])
    flat = np.concatenate([sequences[k] for k in order])
    first = np.cumsum(size) - size
    move, emit = m.move, m.emit
    out = np.zeros(len(order))
    a = None
    live = len(order) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    for t in range(size[0]):
        n = live[t]
        e = emit[flat[first[:n] + t]]
        a = m.start * e if t == 0 else (a[:n] @ move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        out[:n] += np.log(scale)
    back = np.empty(len(order))
    back[order] = out
    return back


def segments(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], list[bool]]:
    """Pieces of at most SEGMENT symbols that cover the sequences, and which start one."""
    out, is_first = [], []
    for s in sequences:
        for k in range(0, len(s), SEGMENT):
            out.append(s[k : k + SEGMENT])
            is_first.append(k == 0)
    return out, is_first


def expected_counts(m: Hmm, parts: list[np.ndarray], is_first: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, inner starts, moves and emissions over segments, and their log likelihood."""
    order = np.argsort([-len(s) for s in parts], kind="stable")
    size = np.array([len(parts[k]) for k in order])
    flat = np.concatenate([parts[k] for k in order]).astype(np.int64)
    first = np.cumsum(size) - size
    begins = np.array(is_first)[order]
    k = len(m.start)
    live = (len(order) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")).tolist()
    alpha = np.empty((len(flat), k), np.float32)
    scales = np.empty(len(flat), np.float32)
    emit, move = m.emit.astype(np.float32), m.move.astype(np.float32)
    a = np.where(begins[:, None], m.start, m.inner).astype(np.float32)
    for t, n in enumerate(live):
        at = first[:n] + t
        a = (a if t == 0 else a[:n] @ move) * emit[flat[at]]
        s = a.sum(axis=1)
        a /= s[:, None]
        alpha[at], scales[at] = a, s
    moves = np.zeros((k, k))
    beta = np.ones((len(order), k), np.float32)
    back = np.ascontiguousarray(move.T)
    for t in range(size[0] - 1, -1, -1):
        n, after = live[t], live[t + 1] if t + 1 < len(live) else 0
        at = first[:n] + t
        if after:
            nxt = at[:after] + 1
            e = emit[flat[nxt]] * beta[:after] / scales[nxt][:, None]
            moves += alpha[at[:after]].T.astype(np.float64) @ e
            beta[:after] = e @ back
        alpha[at] *= beta[:n]
    emitted = np.stack([np.bincount(flat, alpha[:, j], len(m.emit)) for j in range(k)], axis=1)
    heads = alpha[first]
    return heads[begins].sum(axis=0), heads[~begins].sum(axis=0), moves * move, emitted, float(np.log(scales).sum())


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _round(rows: DataFrame, m: Hmm) -> tuple[Hmm, float]:
    """One Baum-Welch round: each task adds up its counts, Spark adds up the tasks' by index, the driver gets a row per
    symbol and state."""
    model = rows.sparkSession.sparkContext.broadcast(m)
    k = len(m.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.value.emit) + k + 3, k))
        for big in batches:
            parts, is_first = segments(_sequences(big.column(0)))
            for at in range(0, len(parts), GROUP):
                s, i, mv, e, ll = expected_counts(model.value, parts[at : at + GROUP], is_first[at : at + GROUP])
                total += np.concatenate([e, mv, [s, i, np.append(ll, np.zeros(k - 1))]])
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, j]) for j in range(k))], ["index", *(f"s{j}" for j in range(k))])

    d = rows.select("symbols").mapInArrow(run, "index int, " + ", ".join(f"s{j} double" for j in range(k)))
    total = np.zeros((len(m.emit) + k + 3, k))
    for r in d.groupBy("index").agg(*[F.sum(f"s{j}") for j in range(k)]).collect():
        total[r[0]] = r[1:]
    e, mv, (s, i, ll) = total[: len(m.emit)], total[len(m.emit) : -3], total[-3:]
    e, mv, s, i = e + 1e-3, mv + 1e-3, s + 1e-3, i + 1e-3
    return Hmm(s / s.sum(), i / i.sum(), mv / mv.sum(axis=1, keepdims=True), e / e.sum(axis=0)), float(ll[0])


def _likelihoods(rows: DataFrame, m: Hmm) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(LOG10 * forward(model.value, _sequences(b.column(1))))], ["row", "forward"])

    return rows.select("row", "symbols").mapInArrow(run, "row long, forward double")


def score_traces(traces: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """Log10 probability of whole traces under a hidden Markov model, and under their words' counts alone.

    traces: series_id, trace, learn (whether the model may learn from the row); other columns are ignored. Returns
    series_id, learn, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, base_score (sum of
    log10((count + 0.1) / (all + 0.1 (distinct + 1)))) and score.

    The most frequent words are symbols, others share one with their class, so that a model has a bounded size; a state
    gives a symbol, the symbol's class a word by its count, or an unknown word with the share of words seen once. A
    trace's probability is the forward recursion's over all its symbols times its words' shares. Counts come from all
    rows to learn from, rounds of Baum-Welch read all of them, in segments; scores read traces whole. Counts of the head
    of the vocabulary travel to the tasks, others are joined by name.

    A NULL or empty trace is one end. Repeated rows, NULL ids and ties give a row each, each learned from; NULL learn is
    not learned from. Without any row to learn from the base is log10(0.1 / 0.1) = 0 a token, and the states are even.
    An empty table gives an empty one."""
    d = traces.select("series_id", "trace", F.coalesce("learn", F.lit(False)).alias("learn"))
    counts = cut_lineage(word_counts(d.where("learn")))
    vocab = vocabulary(counts)
    rows = cut_lineage(symbol_rows(d, vocab))
    weight = np.zeros(OWN_SYMBOLS + CLASSES)
    own = vocab.counts[:OWN_SYMBOLS]
    weight[: len(own)] = own
    weight[OWN_SYMBOLS:] = vocab.mass
    m = Hmm.initial(weight, states)
    for _ in range(rounds if vocab.n_tokens else 0):
        m, _ = _round(rows.where("learn"), m)

    rare = rows.select("row", F.explode("rare").alias("w")).select("row", "w.*").join(counts.select("name", "count"), "name", "left")
    seen: Column = F.col("count").isNotNull()
    in_class = F.get(F.lit(vocab.mass.tolist()), F.col("cls"))
    unseen = F.get(F.lit(vocab.unseen.tolist()), F.col("cls"))
    share = F.when(seen, F.log10(F.col("count") * (1 - unseen) / in_class)).otherwise(F.log10(unseen))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("r_known"), F.sum(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + 0.1)).alias("r_base"),
        F.sum(F.col("times") * share).alias("r_share"))
    out = rows.select("row", "series_id", "learn", "n_tokens", "n_known", "base", "share").join(_likelihoods(rows, m), "row").join(rare, "row", "left")
    zero = F.lit(0.0)
    each = float(np.log10(vocab.n_tokens + 0.1 * (vocab.n_words + 1)))
    return out.select(
        "series_id", "learn", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("forward") + F.col("share") + F.coalesce("r_share", zero)).alias("score"))
