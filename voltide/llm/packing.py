"""Best-fit packing: exact complements of one, two or three lengths first, then best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltide.llm.blocks import text_blocks
from voltide.llm.wordbpe import loaded, tokenizer_path
from voltide.session import cut_lineage

CAPACITY = 2048
ROWS_A_BUCKET = 20_000
def token_pieces(traces: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Traces as token ids, an end id 0 after each, cut where they are longer than capacity.

    traces: series_id, trace (NULL: empty). Returns series_id, piece (from 0), start (ids of the trace before it),
    length and ids_crc32 (of little-endian unsigned 32-bit ids), the ids being the tokenizers library's for the file
    at path. No shuffle. White space always ends a token, so a block's distinct chunks are encoded once."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for b, texts in text_blocks(batches, "trace", 10_000_000):
            ids, ends = encoder.encode(texts)
            ended = np.insert(ids, ends, 0).astype("<u4", copy=False)
            ends = (ends + np.arange(1, len(texts) + 1)).tolist()
            row, piece, crc, length = [], [], [], []
            for k, (first, last) in enumerate(zip([0, *ends], ends)):
                for n, p in enumerate(range(first, last, capacity)):
                    cut = ended[p : min(p + capacity, last)]
                    row.append(k)
                    piece.append(n)
                    crc.append(zlib.crc32(cut))
                    length.append(len(cut))
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["series_id", "piece", "start", "length", "ids_crc32"])

    d = traces.select("series_id", "trace")
    return d.mapInArrow(run, f"series_id {dict(d.dtypes)['series_id']}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """How many pieces of each length go where. Runs: pieces `first` to `first + n - 1` of a length go to sequences
    `sequence` to `sequence + n - 1`, at `offset`. The work depends on the distinct lengths, not on the pieces."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.sequences = 0
        self.pairs, self.gone = None, 0
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                self.fill(length)

    def fill(self, length: int) -> None:
        """Sequences with a piece of this length: an exact complement if there is one, else best fit and on."""
        combo, gap = [length], self.capacity - length
        self.left[length] -= 1
        while gap:
            rest = self.exact(gap)
            if not rest:
                fitting = np.flatnonzero(self.left[: gap + 1])
                rest = [int(fitting[-1])] if len(fitting) else []
            if not rest:
                break
            for x in rest:
                self.left[x] -= 1
            combo += rest
            gap -= sum(rest)
        for x in combo:
            self.left[x] += 1
        kinds, times = np.unique(combo, return_counts=True)
        n = int((self.left[kinds] // times).min())
        at = 0
        for x in combo:
            self.runs[x].append((int(self.used[x]), n, self.sequences, at))
            self.used[x] += n
            self.left[x] -= n
            at += x
        self.sequences += n
        self.gone += int((self.left[kinds] == 0).sum())

    def exact(self, gap: int) -> list[int]:
        """One, two or three available lengths that add up to gap, the largest first."""
        if self.left[gap]:
            return [gap]
        pair = self.pair(gap)
        if pair:
            return pair
        if self.pairs is None or self.gone >= 64:  # index of pair sums: what has run out since is checked on use
            has = (self.left > 0).astype(np.float64)
            size = 2 * len(has)
            self.pairs, self.gone = np.fft.irfft(np.fft.rfft(has, size) ** 2, size)[: len(has)] > 0.5, 0
        firsts = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for a in firsts[(self.left[firsts] > 0) & self.pairs[gap - firsts]]:
            self.left[a] -= 1
            pair = self.pair(gap - int(a))
            self.left[a] += 1
            if pair:
                return [int(a), *pair]
        return []

    def pair(self, total: int) -> list[int]:
        a = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        a = a[(self.left[a] > 0) & (self.left[total - a] > (2 * a == total))]
        return [int(a[0]), total - int(a[0])] if len(a) else []


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for pieces in as few sequences of at most capacity as exact complements and best fit find.

    pieces: series_id, piece, length (1 to capacity), and further columns, which are kept; a series' chunks of ticks or
    a trace's tokens alike. Returns them with sequence_id and offset, gapless from 0.

    The driver sees a count per length, at most capacity of them, and plans with those; rows find their place by their
    rank within their length. Ranks are counted in buckets of about 20,000 rows, so that a frequent length is dealt
    over many tasks. Repeated rows are pieces of their own. An empty table gives an empty one.
    """
    pieces = cut_lineage(pieces.drop("sequence_id", "offset"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan = Plan(counts)
    firsts, places = {}, {}
    for length, runs in plan.runs.items():
        firsts[length] = np.array([r[0] for r in runs])
        places[length] = np.array([(r[2] - r[0], r[3]) for r in runs])

    buckets = int(counts.sum()) // ROWS_A_BUCKET + 1
    d = pieces.withColumn("_bucket", F.pmod(F.xxhash64("series_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = Window.partitionBy("length", "_bucket").orderBy(*[c for c in ("series_id", "piece") if c in d.columns])
    d = d.withColumn("_k", F.row_number().over(own)).join(base.drop("_n"), ["length", "_bucket"])
    d = d.withColumn("_rank", (F.col("_base") + F.col("_k") - 1).cast("long")).select(*pieces.columns, "_rank")

    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                of = length == x
                run = places[int(x)][np.searchsorted(firsts[int(x)], rank[of], side="right") - 1]
                sequence[of], offset[of] = run[:, 0] + rank[of], run[:, 1]
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return d.mapInArrow(place, f"{schema}, sequence_id long, offset long")
