"""Divergence of sources: run-length columns over a vocabulary ordered so that equal counts stand together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltide.llm.blocks import text_blocks
from voltide.operators.layout import join_back, rank_rows
from voltide.session import cut_lineage

SCALE = 1_000_000_000
PRIOR = 5  # added to every count
BLOCK = 4096  # places of the vocabulary in one piece of a column
TILE = 64  # columns that meet the columns of another tile in one task
LEADING = 3  # arms, the largest ones, by whose counts the vocabulary is ordered

# Bytes of a term. A-Z become a-z, all other ASCII bytes but a-z separate terms, bytes of longer UTF-8
# characters stay.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def terms(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms, each place's number among them, and the text it is in. Terms are maximal stretches of ASCII
    letters and characters beyond ASCII, only A-Z lower-cased."""
    a = pa.array(texts, pa.string())
    _, offsets, data = a.buffers()
    data = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data is not None and data.size else data
    split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(a), offsets, data))
    named = split.flatten().dictionary_encode()
    codes = named.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(a)), np.diff(split.offsets.to_numpy()))
    real = codes != pc.index(named.dictionary, "").as_py()
    return named.dictionary, codes[real], text[real]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def term_counts(traces: DataFrame) -> DataFrame:
    """scenario, arm, term, n (occurrences), n_traces (traces with the term). A row without term stands for each
    (scenario, arm), so that arms without terms are there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_blocks(batches, "trace", 3_000_000):
            names, codes, text = terms(texts)
            sides = [b.column(k).dictionary_encode() for k in (0, 1)]
            wide = max(len(sides[1].dictionary), 1)
            of_text = sides[0].indices.to_numpy().astype(np.int64) * wide + sides[1].indices.to_numpy()
            width = len(names) + 1  # the last number is no term
            seen, n = _summed(text * width + codes, np.ones(len(codes), np.int64))
            group = np.concatenate([of_text[seen // width] * width + seen % width, of_text * width + len(names)])
            one = np.ones(len(seen), np.int64)
            none = np.zeros(len(of_text), np.int64)
            key, n, n_traces = _summed(group, np.append(n, none), np.append(one, none))
            term = key % width
            yield pa.RecordBatch.from_arrays(
                [sides[0].dictionary.take(pa.array(key // width // wide)), sides[1].dictionary.take(pa.array(key // width % wide)),
                 names.take(pa.array(np.minimum(term, len(names)), mask=term == len(names))), pa.array(n), pa.array(n_traces)],
                ["scenario", "arm", "term", "n", "n_traces"])

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    d = traces.select(empty("scenario"), empty("arm"), "trace")
    d = d.mapInArrow(run, "scenario string, arm string, term string, n long, n_traces long")
    return d.groupBy("scenario", "arm", "term").agg(F.sum("n").alias("n"), F.sum("n_traces").alias("n_traces"))


def scaled_share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR size)) in whole numbers of 38 digits; NULL where size is 0."""
    whole = lambda c: c.cast("decimal(18,0)")
    over = (whole(n) + PRIOR) * F.lit(SCALE)
    under = whole(total) + PRIOR * whole(size)
    # the remainder goes first: a decimal quotient would be rounded
    return F.when(size > 0, 1 + ((over - over % under) / under).cast("bigint"))


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values ends, and its value."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.empty(0, np.int64)
    return ends, values[ends - 1]


def runs_distance(ends_a: np.ndarray, p_a: np.ndarray, ends_b: np.ndarray, p_b: np.ndarray) -> int:
    """Sum of |p_a - p_b| over all places of two run-length columns: their boundaries intersect, and each piece between
    two boundaries counts as often as it is long."""
    ends = np.union1d(ends_a, ends_b)
    f = np.abs(p_a[np.searchsorted(ends_a, ends)] - p_b[np.searchsorted(ends_b, ends)])
    return int((f * np.diff(ends, prepend=0)).sum())


def _columns(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """Run-length pieces of every arm's column: scenario, arm, tile, tiles, block, ends, p.

    The vocabulary of a scenario is ordered by its counts in the LEADING largest arms, so that terms with equal counts
    stand together there and rare terms, absent from most arms, make long runs of zeros in the others."""
    lead = [F.coalesce(F.max(F.when(F.col("number") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(LEADING)]
    vocabulary = counted.groupBy("scenario", "term").agg(*lead)
    placed = rank_rows(vocabulary, ["scenario"], [*[f"c{k}" for k in range(LEADING)], "term"], "place").select("scenario", "term", "place")
    cells = counted.join(placed, ["scenario", "term"]).select(
        "scenario", "arm", F.floor(F.col("place") / BLOCK).cast("int").alias("block"), F.struct((F.col("place") % BLOCK).cast("int").alias("at"), "n", "p").alias("cell"))
    cells = cells.groupBy("scenario", "arm", "block").agg(F.collect_list("cell").alias("cells"))  # BLOCK cells at most
    last = F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int") - 1
    all_pieces = groups.select("scenario", "arm", "tile", "tiles", "size", "p_none", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    d = all_pieces.join(cells, ["scenario", "arm", "block"], "left").select(
        "scenario", "arm", "tile", "tiles", "block", F.least(F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int").alias("places"),
        "p_none", F.col("cells.at").alias("at"), F.col("cells.n").alias("n"), F.col("cells.p").alias("p"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, ps = [], []
            for r in range(b.num_rows):
                places, none, at, n, p = (b.column(k)[r] for k in range(5, 10))
                counts, share = np.zeros(places.as_py(), np.int64), np.full(places.as_py(), none.as_py() or 0, np.int64)
                if at.is_valid:
                    where = at.values.to_numpy()
                    counts[where], share[where] = n.values.to_numpy(), p.values.to_numpy()
                stop, _ = run_lengths(counts)
                ends.append(stop.astype(np.int32))
                ps.append(share[stop - 1])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ends, pa.list_(pa.int32())), pa.array(ps, pa.list_(pa.int64()))],
                                             ["scenario", "arm", "tile", "tiles", "block", "ends", "p"])

    return d.mapInArrow(encode, "scenario string, arm string, tile int, tiles int, block int, ends array<int>, p array<long>")


def _pairs(columns: DataFrame) -> DataFrame:
    """scenario, a, b, value for every pair of arms of a scenario: pieces of one block meet, tile by tile."""

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        scenario, _, low, high = key
        left, right = rows[rows["tile"] == low], rows[rows["tile"] == high]
        out = []
        for i, (a, ends_a, p_a) in enumerate(zip(left["arm"], left["ends"], left["p"])):
            for b, ends_b, p_b in list(zip(right["arm"], right["ends"], right["p"]))[i + 1 if low == high else 0 :]:
                out.append((scenario, a, b, runs_distance(ends_a, p_a, ends_b, p_b)))
        return pd.DataFrame(out, columns=["scenario", "a", "b", "value"])

    d = columns.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    d = d.withColumns({"low": F.least("tile", "_other"), "high": F.greatest("tile", "_other")})
    d = d.select("scenario", "block", "low", "high", "tile", "arm", "ends", "p")
    met = d.groupBy("scenario", "block", "low", "high").applyInPandas(meet, "scenario string, a string, b string, value long")
    # the order in which a task reads two arms isn't fixed, so a pair's pieces are brought to one order
    return met.groupBy("scenario", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))


def source_divergence(traces: DataFrame, min_traces: int = 30, top: int = 50) -> DataFrame:
    """How far the traces of the arms of each scenario differ in their terms.

    traces: scenario, arm, trace (NULL counts as empty); other columns are ignored. Terms are stretches of ASCII letters
    (A-Z as a-z) and characters beyond ASCII: the status names, labels and comments of a trace. A scenario's vocabulary are
    the terms in at least ``min_traces`` of its traces. Each arm, and the scenario as a whole, gives a term with n occurrences
    the share p = 1 + floor(10^9 (n + 5) / (N + 5 V)), N its occurrences of all V terms. All arithmetic is exact.

    Returns scenario, arm, part, item, value, rank. Part 'pair': for every other arm of the scenario the sum of |p - p'|
    over the vocabulary (0 where that is empty). Part 'term': for the arm's terms with greater share than the scenario's,
    the ``top`` with the greatest differences. Ranks count from 1 by value descending, then item ascending in UTF-8.

    Counts are added up per block of texts, then by Spark. An arm's column of counts over the ordered vocabulary is cut
    into blocks and run-length encoded; columns meet in tiles of a block, where the boundaries of their runs intersect.
    So an arm with a third of all traces is as many pieces as any other, and no task has more than two tiles of a block.

    Arms without terms have the share of no occurrence everywhere. Repeated rows count as often as they occur. Empty in,
    empty out; a scenario with one arm has no pairs."""
    counts = cut_lineage(term_counts(traces))
    vocabulary = counts.where(F.col("term").isNotNull()).groupBy("scenario", "term").agg(F.sum("n").alias("n_all"), F.sum("n_traces").alias("in_traces"))
    vocabulary = vocabulary.where(F.col("in_traces") >= min_traces).drop("in_traces")
    kept = cut_lineage(counts.select("scenario", "arm", "term", "n").join(vocabulary, ["scenario", "term"]))

    sizes = kept.select("scenario", "term", "n_all").distinct().groupBy("scenario").agg(F.count(F.lit(1)).alias("size"), F.sum("n_all").alias("total_all"))
    totals = kept.groupBy("scenario", "arm").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("scenario", "arm")
    groups = groups.join(totals, ["scenario", "arm"], "left").join(sizes, "scenario", "left").fillna(0, ["total", "total_all", "size"])
    groups = rank_rows(groups, ["scenario"], [F.desc("total"), F.col("arm")], "number", size="arms")
    groups = cut_lineage(groups.withColumns({
        "tile": F.floor(F.col("number") / TILE).cast("int"), "tiles": F.ceil(F.col("arms") / TILE).cast("int"),
        "p_none": scaled_share(F.lit(0), F.col("total"), F.col("size"))}))

    counted = join_back(kept, groups.select("scenario", "arm", "number", "total", "total_all", "size"), ["scenario", "arm"])
    counted = cut_lineage(counted.select(
        "scenario", "arm", "term", "n", "number", scaled_share(F.col("n"), F.col("total"), F.col("size")).alias("p"),
        scaled_share(F.col("n_all"), F.col("total_all"), F.col("size")).alias("q")))

    met = cut_lineage(_pairs(_columns(counted, groups)))
    both = met.select("scenario", F.col("a").alias("arm"), F.col("b").alias("item"), "value").union(met.select("scenario", "b", "a", "value"))
    pairs = rank_rows(both, ["scenario", "arm"], [F.desc("value"), F.col("item")], "rank")
    pairs = pairs.select("scenario", "arm", F.lit("pair").alias("part"), "item", "value", (F.col("rank") + 1).cast("int").alias("rank"))

    above = counted.where(F.col("p") > F.col("q")).select("scenario", "arm", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    w = Window.partitionBy("scenario", "arm").orderBy(F.desc("value"), "item")
    return pairs.union(above.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))
