"""Periodic runs: branching tandem repeats of an enhanced suffix array, rotated to squares and merged into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from voltide.llm.blocks import text_blocks

LEAST_WORDS = 6
LEAST_EXPONENT = 4
FOUND = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_codes(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words `[^\\x20\\x09-\\x0D]+` of all texts, each word's number among them, and where each text's end."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    named = split.flatten().dictionary_encode()
    codes, ends = named.indices.to_numpy(), split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
    blank = pc.index(named.dictionary, "").as_py()  # a text's ends give empty words
    real = codes != blank
    return named.dictionary, codes[real].astype(np.int64), np.append(0, np.cumsum(real))[ends]


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SA, ISA, LCP) of texts laid end to end, as if no two texts had a word in common: LCP[k] words are shared by
    suffixes SA[k - 1] and SA[k] of one text, none by suffixes of different ones.

    Prefix doubling: in each round only suffixes whose prefix isn't unique yet are sorted again. The names of each round
    give the common prefixes, from the longest power of two down."""
    n = len(codes)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    stop = ends[text] if n else np.empty(0, np.int64)
    key = text * (int(codes.max()) + 2 if n else 1) + codes + 1
    _, name = np.unique(key, return_inverse=True)
    # names are ranks with room: the least position that a suffix of this prefix can have, from 1; 0 is the text's end
    counts = np.bincount(name) if n else np.empty(0, np.int64)
    rank = (np.cumsum(counts) - counts)[name] + 1 if n else name
    levels, width = [rank], 1
    active = np.flatnonzero(counts[name] > 1) if n else name
    while len(active):
        after = active + width
        second = np.where(after < stop[active], rank[np.minimum(after, n - 1)], 0)
        order = np.lexsort((second, rank[active]))
        sorted_, first, second = active[order], rank[active][order], second[order]
        new_group = np.append(True, first[1:] != first[:-1])
        new = new_group | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(order))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        lead = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[sorted_] = first + lead - start
        levels.append(rank)
        width *= 2
        alone = new & np.append(new[1:], True)
        active = np.sort(sorted_[~alone])
    isa = rank - 1
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(np.append(False, text[sa[1:]] == text[sa[:-1]])) if n else sa
    x, y = sa[at - 1], sa[at]
    shared = np.zeros(len(at), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        i, k = x + shared, y + shared
        inside = (i < stop[x]) & (k < stop[y])
        same = inside & (levels[j][np.minimum(i, n - 1)] == levels[j][np.minimum(k, n - 1)])
        # equal names of a round say that the prefixes of its width are equal, as none reaches past a text's end
        shared += np.where(same, 1 << j, 0)
    lcp[at] = shared
    return sa, isa, lcp


def lcp_intervals(inner: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LCP intervals from the places with a common prefix, ascending, and its length there: which interval each place
    splits, and of each interval the depth, the first suffix and the place after the last one. One pass with a stack of
    the open intervals; no tree is built."""
    of = np.empty(len(inner), np.int64)
    depth, low, high = [], [], []
    open_ids: list[int] = []
    before, top = -2, 0  # the place before, the depth of the innermost open interval
    for at in range(0, len(inner), 65_536):
        found = []
        for k, d in zip(inner[at : at + 65_536].tolist(), depths[at : at + 65_536].tolist()):
            first = k - 1
            if k != before + 1:
                for i in open_ids:
                    high[i] = before + 1
                open_ids.clear()
                top = 0
            while d < top:
                i = open_ids.pop()
                high[i], first = k, low[i]
                top = depth[open_ids[-1]] if open_ids else 0
            if d > top:
                open_ids.append(len(depth))
                depth.append(d)
                low.append(first)
                high.append(0)
                top = d
            found.append(open_ids[-1])
            before = k
        of[at : at + len(found)] = found
    for i in open_ids:
        high[i] = before + 1
    return of, np.array(depth, np.int64), np.array(low, np.int64), np.array(high, np.int64)


def branching_squares(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square x x that the word after it doesn't go on: where the suffixes of its two halves
    stand in different children of the LCP interval of depth len(x).

    For each LCP interval the suffixes of all children but the largest ask whether the suffix `depth` words further on,
    or back, stands in the interval and in another child. A suffix is in a smaller child about log n times at most."""
    sa, isa, lcp = suffix_array(codes, ends)
    n = len(sa)
    none = np.empty(0, np.int64)
    inner = np.flatnonzero(lcp > 0)
    if not len(inner):
        return none, none
    interval, depth, low, high = lcp_intervals(inner, lcp[inner])
    # children of an interval: from its start and from each of its places to the next one
    child_from = np.concatenate([low, inner])
    of = np.concatenate([np.arange(len(low)), interval])
    order = np.lexsort((child_from, of))
    child_from, of = child_from[order], of[order]
    last = np.append(of[1:] != of[:-1], True)
    child_to = np.where(last, high[of], np.append(child_from[1:], 0))
    size = child_to - child_from
    most = np.lexsort((-size, of))
    largest = np.zeros(len(of), bool)
    largest[most[np.append(True, of[most][1:] != of[most][:-1])]] = True
    small = np.flatnonzero(~largest)
    child = np.repeat(small, size[small])
    at = np.arange(len(child)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + child_from[child]
    d, lo, hi = depth[of[child]], low[of[child]], high[of[child]]
    i = sa[at]
    starts, periods = [], []
    for shift in (d, -d):
        j = i + shift
        ok = (j >= 0) & (j < n)
        place = isa[np.clip(j, 0, n - 1)]
        ok &= (place >= lo) & (place < hi) & ~((place >= child_from[child]) & (place < child_to[child]))
        starts.append(np.minimum(i, j)[ok])
        periods.append(d[ok])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return both[0], both[1]


def _reach(codes: np.ndarray, first: int, start: int, period: int) -> int:
    """How far to the left of start the words go on with this period, in slices that double."""
    step = 64
    while start > first:
        low = max(first, start - step)
        differs = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(differs):
            return low + int(differs[-1]) + 1
        start, step = low, 2 * step
    return start


def runs_of(codes: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text the runs (start, length, period) by start, then period: maximal stretches with smallest period q of at
    least max(LEAST_WORDS, LEAST_EXPONENT q) words.

    A run ends in exactly one branching square for its smallest period, so that rotating that square to the left gives
    the run. Squares of multiples of the period end at the same word inside a run that is known: periods come in
    ascending order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    start, period = branching_squares(codes, ends)
    order = np.lexsort((period, start + 2 * period))
    begins = ends - np.diff(ends, prepend=0)
    text = np.searchsorted(ends, start, side="right")
    end_before, known = -1, []
    for k in order.tolist():
        s, q, t = int(start[k]), int(period[k]), int(text[k])
        end = s + 2 * q
        if end != end_before:
            end_before, known = end, []
        if any(q % p == 0 and low <= s for low, p in known):
            continue
        low = _reach(codes, int(begins[t]), s, q)
        known.append((low, q))
        if end - low >= max(LEAST_WORDS, LEAST_EXPONENT * q):
            out[t].append((low - int(begins[t]), end - low, q))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def top_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of equal ones the first, then the least period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(traces: DataFrame) -> DataFrame:
    """Periodic runs of words in every trace: a feed that repeats itself, a stale block of ticks, a stuck writer.

    traces: series_id, trace; other columns are ignored. Returns one row per row of traces: series_id, runs (array of
    start, length, period in words, numbered from 0, by start and period), top (the run with the greatest length / period;
    ties: smallest start, then period; NULL without runs) and collapsed (the words joined by one space, without those
    that any run contains after its first period).

    Words are what stands between ASCII white space. A run is a maximal stretch of words with smallest period q and at
    least max(6, 4 q) words. A NULL, empty or blank trace has no words, no runs and an empty collapsed text; repeated
    rows and NULL ids are rows like others; empty in, empty out. Traces are taken in blocks of a few MB, a longer one
    alone, whole: memory grows with the longest trace by about a hundred bytes a word and level of doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_blocks(batches, "trace", 3_000_000):
            words, codes, ends = word_codes(texts)
            found = runs_of(codes, ends)
            keep = np.ones(len(codes), bool)
            for first, rows in zip((ends - np.diff(ends, prepend=0)).tolist(), found):
                for start, length, period in rows:
                    keep[first + start + period : first + start + length] = False
            kept = pa.ListArray.from_arrays(np.append(0, np.append(0, np.cumsum(keep))[ends]).astype(np.int32), words.take(pa.array(codes[keep])))
            as_rows = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
            kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[as_rows(r) for r in rows] for rows in found], pa.list_(kind)),
                 pa.array([as_rows(top_run(rows)) for rows in found], kind), pc.binary_join(kept, " ")],
                ["series_id", "runs", "top", "collapsed"])

    d = traces.select("series_id", "trace")
    return d.mapInArrow(run, f"series_id {dict(d.dtypes)['series_id']}, runs {FOUND}, top struct<start:bigint,length:bigint,period:bigint>, collapsed string")
