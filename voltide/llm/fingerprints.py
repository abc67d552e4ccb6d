"""Document fingerprints by locally consistent parsing: coin tossing cuts phrases, phrases get names, level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.llm.blocks import text_blocks

LEVELS = (2, 3, 4)  # phrases of these levels enter the fingerprint; about 9, 27 and 80 code points long
SLOTS = 64
BLOCK_BYTES = 1_500_000
_LOW = np.array([((1 << k) * 0x077CB531 & 0xFFFFFFFF) >> 27 for k in range(32)])
_LOW_BIT = np.zeros(32, np.uint8)
_LOW_BIT[_LOW] = np.arange(32)  # position of the only set bit, by a de Bruijn product


def _toss(before: int, own: int) -> int:
    """Twice the lowest bit position in which two labels differ, plus the own bit there."""
    d = before ^ own
    k = (d & -d).bit_length() - 1 if d else 0
    return 2 * k + (own >> k & 1)


_AGAIN = np.array([[_toss(a, b) for b in range(64)] for a in range(64)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def parse(names: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases that the texts' names fall into, and where the texts end among them.

    Runs of one name become one symbol. Labels from four rounds of coin tossing differ between neighbours and depend on
    the four symbols before only; a phrase starts where a label is larger than both neighbours'. A text's start starts
    a phrase and tosses against its own first bit, so that other texts of the block don't matter. No text is empty."""
    first = np.zeros(len(names), bool)
    first[0] = True
    first[ends[:-1]] = True
    keep = first.copy()
    keep[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(keep)
    run = np.diff(at, append=len(names))
    x, first = names[at], first[at]
    low = (x ^ (x >> np.uint64(32)) if x.dtype == np.uint64 else x).astype(np.uint32)
    d = low.copy()
    d[1:] ^= low[:-1]
    d[first] = 1
    d &= -d
    k = _LOW_BIT[(d * np.uint32(0x077CB531)) >> np.uint32(27)]
    label = (2 * k + ((low >> k) & np.uint32(1))).astype(np.uint8)
    for _ in range(3):
        own = label
        label = np.empty_like(own)
        label[1:] = _AGAIN[own[:-1], own[1:]]
        label[first] = own[first] & 1
    start = first.copy()
    inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.zeros(len(x), bool)
    last[:-1] = first[1:]
    start[1:-1] |= inner & ~last[1:-1]
    begin = np.flatnonzero(start)
    place = np.arange(len(x)) - np.repeat(begin, np.diff(begin, append=len(x)))
    h = x.astype(np.uint64) + (run.astype(np.uint64) << np.uint64(40))
    h = _mix(h + _mix(place.astype(np.uint64) + np.uint64(1)))
    out = _mix(np.add.reduceat(h, begin))
    text_first = np.flatnonzero(first)
    starts = np.searchsorted(begin, text_first)
    return out, np.append(starts[1:], len(begin))


def fingerprint_block(texts: list[str]) -> np.ndarray:
    """(texts, SLOTS) 16-bit values: per slot the least phrase name of the chosen levels, 0 where there is none."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    full = [k for k, t in enumerate(texts) if t]
    if not full:
        return out
    names = np.frombuffer("".join([texts[k] for k in full]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(texts[k]) for k in full])
    least = np.full(len(full) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for level in range(1, max(LEVELS) + 1):
        names, ends = parse(names, ends)
        if level in LEVELS:
            text = np.repeat(np.arange(len(full)), np.diff(ends, prepend=0))
            v = _mix(names + np.uint64(level))
            np.minimum.at(least, text * SLOTS + (v >> np.uint64(58)).astype(np.int64), v << np.uint64(6))
    got = least != np.iinfo(np.uint64).max
    out[full] = np.where(got, _mix(least) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16).reshape(-1, SLOTS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots with equal values among those that either has; 1 for two empty texts."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(either > 0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(either, 1), 1.0)


def shown(f: np.ndarray) -> list[str]:
    """Four hexadecimal digits per slot; the empty text's fingerprint is all zeros."""
    return [r.astype(">u2").tobytes().hex() for r in f]


def fingerprints(traces: DataFrame) -> DataFrame:
    """series_id, fingerprint of whole traces. Equal texts have equal fingerprints, and equal passages share phrases
    wherever they stand. No shuffle.

    traces: series_id, trace; other columns are ignored. A NULL or empty trace has zeros only. Repeated rows and equal
    or NULL ids give a row each, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_blocks(batches, "trace", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown(fingerprint_block(texts)))], ["series_id", "fingerprint"])

    d = traces.select("series_id", "trace")
    return d.mapInArrow(run, f"series_id {dict(d.dtypes)['series_id']}, fingerprint string")


def _in_bands(traces: DataFrame, rows_a_band: int, most_bands: int) -> DataFrame:
    """band, after, series_id, trace: bands of the order of series_id. Each band also gets, marked as after, the next
    band's first rows (the last band: those of the first), so that a band can be read on its own."""
    ids = traces.select("series_id").where(F.col("series_id").isNotNull())
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.min("series_id").alias("least")).first()
    every = max(rows_a_band, -(-total["n"] // most_bands))
    bounds = ids.where((F.pmod(F.xxhash64("series_id"), F.lit(every)) == 0) & (F.col("series_id") > F.lit(total["least"])))
    bounds = sorted(r[0] for r in bounds.distinct().collect())
    n = len(bounds) + 1
    width = max(1, int(len(bounds) ** 0.5))
    outer = bounds[::width]
    kind = dict(traces.dtypes)["series_id"]

    def listed(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")

    # bounds not above the id, counted in two steps
    coarse = F.size(F.filter(listed(outer), lambda b: b <= F.col("series_id")))
    fine = F.array(listed([]), *[listed(bounds[i : i + width]) for i in range(0, len(bounds), width)])
    d = traces.select("series_id", "trace").withColumn("_coarse", F.when(F.col("series_id").isNotNull(), coarse))
    band = F.when(F.col("series_id").isNull(), F.lit(-1)).when(F.col("_coarse") == 0, F.lit(0)).otherwise(
        (F.col("_coarse") - 1) * width + F.size(F.filter(F.get(fine, F.col("_coarse")), lambda b: b <= F.col("series_id"))))
    d = d.withColumn("band", band)
    head = F.array_contains(F.get(fine, F.col("_coarse")), F.col("series_id")) | (F.col("series_id") == F.lit(total["least"]))
    places = F.array(F.struct(F.col("band").alias("band"), F.lit(False).alias("after")))
    places = F.when(F.coalesce(head, F.lit(False)), F.concat(places, F.array(F.struct(
        F.pmod(F.col("band") - 1, F.lit(n)).alias("band"), F.lit(True).alias("after"))))).otherwise(places)
    return d.select(F.explode(places).alias("p"), "series_id", "trace").select("p.band", "p.after", "series_id", "trace")


def compare_with_next(traces: DataFrame, rows_a_band: int = 200, most_bands: int = 20_000) -> DataFrame:
    """Fingerprints of each trace, of the next one and of the trace as edited with the next one's start.

    traces: series_id, trace (NULL: empty). Returns series_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The edited text: the last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next trace in the order of (series_id, trace); after the last comes the first.

    Rows are dealt once, by bands of the order, and each band is read as a sorted stream. Rows with a NULL id stand
    outside the order: their next text is empty. Repeated rows follow each other. Empty in, empty out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of a band whose next row is known when more comes

        def results(rows: list[tuple], following: str | None) -> pa.RecordBatch:
            texts = [r[2] for r in rows]
            nexts = [*texts[1:], following or ""] if rows[0][0] >= 0 else [""] * len(rows)
            edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, nexts)]
            f = fingerprint_block([*texts, nexts[-1]])
            g = fingerprint_block(edited)
            after = f[1:] if rows[0][0] >= 0 else np.zeros_like(f[1:])
            names = shown(f[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], kind), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(names), pa.array(shown(g)),
                 pa.array(likeness(f[:-1], g)), pa.array(likeness(f[:-1], after))],
                ["series_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        kind, size, closed = None, 0, None
        for b, texts in text_blocks(batches, "trace", BLOCK_BYTES):
            kind = b.schema.field(2).type
            for band, after, series, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts):
                if after:
                    if held and held[0][0] == band:
                        yield results(held, text)
                        held, size = [], 0
                    continue
                if held and (size > BLOCK_BYTES or held[0][0] != band):
                    yield results(held, text if held[0][0] == band else "")
                    held, size = [], 0
                held.append((band, series, text))
                size += len(text)
        if held:
            yield results(held, "")

    d = _in_bands(traces, rows_a_band, most_bands)
    d = d.repartition("band").sortWithinPartitions("band", "after", "series_id", "trace")
    kind = dict(traces.dtypes)["series_id"]
    return d.mapInArrow(run, f"series_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
