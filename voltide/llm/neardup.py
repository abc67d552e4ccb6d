"""Near duplicates: order MinHash over occurrence-labelled word shingles, candidates verified by banded alignment."""

from __future__ import annotations

import hashlib
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.llm.blocks import named_chunks, text_blocks
from voltide.llm.components import components
from voltide.llm.hot import join_hot
from voltide.session import cut_lineage

WORDS = 5  # words in a shingle
SIMILARITY = 0.8
SKETCHES = 14  # tuples of a sketch; at similarity 0.8 a pair shares one with probability 0.9999
MINIMA = 3  # least shingles in a tuple, in text order
SMALL = 16  # buckets of so many texts are compared pair by pair
STEPS = ((0,), tuple(range(1, SKETCHES)))  # tuples by which texts meet the centre of a bucket, step by step
SLOTS = 1 << 20  # counts by which shingles are called rare; shared slots cost speed only
BITS = 512  # of the map that bounds how far two texts differ
SALTED = 256  # texts of a shingle, or of a centre, that meet others in one task
EDGES = string.punctuation + "«»„“”‚‘’…–—¿¡"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_names(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all words (lower case, without punctuation at the ends) and where each text's words end."""
    words, codes, text_ends = named_chunks(pa.array([t.lower() for t in texts], pa.string()))
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in (w.strip(EDGES) for w in words)), np.uint64, len(words))
    w = names[codes]
    real = w > 0
    return w[real], np.append(0, np.cumsum(real))[text_ends]


def shingles(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the WORDS-word shingles and where each text's end; a shorter text with words is one shingle."""
    n = np.diff(ends, prepend=0)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + (ends - n)[text]
    left = (ends[text] - first).astype(np.int64)
    out = np.zeros(len(text), np.uint64)
    for k in range(WORDS):
        at = np.minimum(first + k, len(words) - 1)
        out = _mix(out + np.where(k < left, words[at] if len(words) else np.uint64(0), np.uint64(0)) + np.uint64(k))
    return out, np.cumsum(count)


def occurrences(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The how-manieth occurrence in its text each name is, from 0."""
    own = _mix(names ^ _mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    new = np.append(True, own[order[1:]] != own[order[:-1]])[: len(order)]
    start = np.flatnonzero(new)
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return nth


def labelled(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Names that also tell the how-manieth occurrence in the text it is."""
    return _mix(names + occurrences(names, text))


def first_occurrences(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    return occurrences(names, text) == 0


def order_sketches(names: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES): per hash function a name for the MINIMA least labelled shingles in the order of the text."""
    n = np.diff(ends, prepend=0)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), SKETCHES), np.uint64)
    if not len(full):
        return out
    text = np.repeat(np.arange(len(full)), n[full])
    starts = (ends - n)[full]
    names = labelled(names, text)
    top = np.uint64(2**64 - 1)
    for j in range(SKETCHES):
        h = _mix(names ^ np.uint64(0x1000193 * (j + 1)))
        places = np.full((len(full), MINIMA), len(names), np.int64)
        for k in range(MINIMA):
            least = np.minimum.reduceat(h, starts)
            at = np.flatnonzero(h == least[text])
            at = at[h[at] < top][::-1]
            places[text[at], k] = at
            h[at] = top
        places.sort(axis=1)
        key = np.full(len(full), j + 1, np.uint64)
        for k in range(MINIMA):
            p = places[:, k]
            key = _mix(key + np.where(p < len(names), names[np.minimum(p, len(names) - 1)], np.uint64(0)))
        out[full, j] = key
    return out


def sketches(traces: DataFrame) -> DataFrame:
    """series_id, name (128 bits of the words), keys (order MinHash tuples, empty without words), shingles (32-bit names of
    the different shingles, by first occurrence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_blocks(batches, "trace", 1_500_000):
            words, ends = word_names(texts)
            found, found_ends = shingles(words, ends)
            keys = order_sketches(found, found_ends)
            spans = zip([0, *ends[:-1].tolist()], ends.tolist())
            n = np.diff(found_ends, prepend=0)
            first = first_occurrences(found, np.repeat(np.arange(len(n)), n))
            kept_ends = np.append(0, np.cumsum(first))[found_ends]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.md5(words[a:z]).digest() for a, z in spans], pa.binary()),
                 pa.ListArray.from_arrays(np.append(0, np.cumsum((n > 0) * SKETCHES)).astype(np.int32), pa.array(keys[n > 0].reshape(-1).view(np.int64))),
                 pa.ListArray.from_arrays(np.append(0, kept_ends).astype(np.int32), pa.array(found[first].astype(np.uint32).view(np.int32)))],
                ["series_id", "name", "keys", "shingles"])

    d = traces.select("series_id", "trace")
    return d.mapInArrow(run, f"series_id {dict(d.dtypes)['series_id']}, name binary, keys array<long>, shingles array<int>")


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared shingles of an alignment over all shingles of two word sequences (at least `least`, else 0)."""
    la, lb = (x[first_occurrences(x, np.zeros(len(x), np.int64))] for x in (shingles(w.astype(np.uint64), np.array([len(w)]))[0] for w in (a, b)))
    return aligned(la, lb, least)


def aligned(la: np.ndarray, lb: np.ndarray, least: float = SIMILARITY) -> float:
    """The same of two texts' different shingles by first occurrence.

    Equal shingles may pair up within the band that `least` leaves: a similarity s needs n + m - 2 L <= (1 - s) / (1 + s)
    (n + m) insertions and deletions. L is the longest increasing chain of such pairs, n and m count different shingles,
    so that it is their Jaccard similarity where both texts have them in one order."""
    n, m = len(la), len(lb)
    if not n or not m:
        return float(n == m)
    band = int((1 - least) / (1 + least) * (n + m) + 1e-9)
    if abs(n - m) > band:
        return 0.0
    order = np.argsort(lb)
    at = np.minimum(np.searchsorted(lb, la, sorter=order), m - 1)
    j = order[at]
    i = np.flatnonzero(lb[j] == la)
    j = j[i]
    j = j[np.abs(i - j) <= band]
    if 2 * len(j) < n + m - band:
        return 0.0
    if (np.diff(j) > 0).all():
        length = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        length = len(tails)
    s = length / (n + m - length)
    return s if s >= least else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of names whose shingles align. A text with many partners, as the centre of a bucket, is copied once
    for each SALTED of them, so that they don't meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                keep = []
                cols = [b.column(k) for k in (2, 3)]
                flat = [c.flatten().to_numpy(zero_copy_only=False).view(np.uint32) for c in cols]
                ends = [np.append(0, np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))) for c in cols]
                for k in range(b.num_rows):
                    x, y = (f[e[k] : e[k + 1]] for f, e in zip(flat, ends))
                    keep.append(aligned(x, y, least) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    partners = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    d = pairs.join(partners, "b").withColumn("salt", F.pmod(F.hash("a"), F.ceil(F.col("n") / SALTED).cast("int")))
    d = d.join(texts.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a")
    centres = texts.select(F.col("name").alias("b"), F.col("shingles").alias("y")).join(partners, "b")
    centres = centres.select("b", "y", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALTED).cast("int") - 1)).alias("salt"))
    return d.join(centres, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _members(live: DataFrame, tuples: tuple[int, ...]) -> DataFrame:
    """name, class, key: the texts in the buckets of some tuples."""
    return live.select("name", "class", F.explode(F.array(*[F.get("keys", F.lit(j)) for j in tuples])).alias("key"))


def _stars(live: DataFrame, tuples: tuple[int, ...], total: int) -> DataFrame:
    """Pairs (a, b): every text with the centre of its bucket, where that is of another class. The centre is a text that a
    hash picks from the class with most texts in the bucket, so that a class which has grown sends no rows."""
    d = _members(live, tuples)
    classes = d.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", "name").alias("h"), "name")).alias("text"))
    top = classes.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "text.h", "class", "text.name")).alias("top"))
    top = cut_lineage(top.where(F.col("n") > 1).select("key", "n", "classes", F.col("top.class").alias("other_class"), F.col("top.name").alias("other")))
    met = join_hot(d, top, "key", len(tuples) * total, "n", (F.col("classes") > 1) & (F.col("class") != F.col("other_class")))
    return met.select(F.col("name").alias("a"), F.col("other").alias("b")).distinct()


def _left_apart(live: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Of the buckets that still hold several classes: the pairs (a, b) of different classes in the small ones, and the
    names of the texts in the larger ones."""
    d = _members(live, tuple(range(SKETCHES)))
    sizes = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    sizes = cut_lineage(sizes.where(F.col("low") < F.col("high")).select("key", "n"))
    each = cut_lineage(d.join(sizes.where(F.col("n") <= SMALL).select("key"), "key"))
    other = each.select("key", F.col("name").alias("other"), F.col("class").alias("other_class"))
    near = each.join(other, "key").where((F.col("name") < F.col("other")) & (F.col("class") != F.col("other_class")))
    large = join_hot(d, sizes.where(F.col("n") > SMALL), "key", SKETCHES * total, "n")
    return near.select(*_ordered("name", "other")).distinct(), large.select("name").distinct()


def _shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each slot: a table of fixed size, whatever the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint32) % SLOTS, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    rows = texts.select("shingles").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint32)
    out[rows["slot"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 2**32 - 1)
    return out


def _all_pairs(texts: DataFrame, least: float) -> DataFrame:
    """Every pair (a, b) of texts (name, class, shingles) of different classes whose sets of shingles can have similarity
    `least`, and few others.

    Shingles stand in one order for all texts, rare ones first. Of n shingles a similar text shares ceil(least n) or
    more, so that two similar texts share one of the n - ceil(least n) + 1 first of each. A pair whose first common
    shingle stands at places i and j shares 1 + min(n - i - 1, m - j - 1) at most, and needs least / (1 + least) (n + m).
    A shingle's texts meet in as many tasks as their number asks for."""
    counts = _shingle_counts(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 500):
                b = big.slice(start, 500)
                first, sizes, maps = [], [], []
                flat = b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                ends = np.append(0, np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)))
                for k in range(b.num_rows):
                    x = flat[ends[k] : ends[k + 1]]
                    n = len(x)
                    first.append(x[np.lexsort((x, counts[x % SLOTS]))[: n - int(np.ceil(least * n - 1e-9)) + 1]].astype(np.int64))
                    sizes.append(n)
                    maps.append(np.packbits(np.bincount(x % BITS, minlength=BITS) & 1).view(np.int64))
                rows = np.array([len(x) for x in first])
                of = pa.array(np.repeat(np.arange(b.num_rows), rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(first)),
                     pa.array(np.concatenate([np.arange(k) for k in rows]).astype(np.int32)), pa.array(np.repeat(sizes, rows).astype(np.int32)),
                     *[pa.array(m).take(of) for m in np.stack(maps, axis=1)]], ["name", "class", "key", "at", "size", *bits])

    bits = [f"bits{k}" for k in range(BITS // 64)]
    schema = "name binary, class binary, key long, at int, size int, " + ", ".join(f"{c} long" for c in bits)
    rows = cut_lineage(texts.select("name", "class", "shingles").mapInArrow(run, schema))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    sizes = cut_lineage(sizes.where(F.col("low") < F.col("high")).select("key", "n"))
    b = cut_lineage(join_hot(rows, sizes, "key", rows.count(), "n"))
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    x = b.withColumn("salt", F.pmod(F.hash("name"), salts))
    y = b.select("key", F.col("name").alias("other"), F.col("class").alias("other_class"), F.col("at").alias("other_at"), F.col("size").alias("other_size"),
                 *[F.col(c).alias(f"other_{c}") for c in bits], F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    shared = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))
    both = F.col("size") + F.col("other_size")
    differ = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in bits])
    met = x.join(y, ["key", "salt"]).where(
        (F.col("name") < F.col("other")) & (F.col("class") != F.col("other_class"))
        & (shared >= least / (1 + least) * both - 1e-6) & (differ <= (1 - least) / (1 + least) * both + 1e-6))
    return met.select(*_ordered("name", "other"))


def _merged(live: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """live (name, class, ...) after joining the classes that links connect."""
    sizes = cut_lineage(live.groupBy("class").agg(F.count(F.lit(1)).alias("n")))
    of = lambda side: live.select(F.col("name").alias(side), F.col("class").alias(f"class_{side}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    found = components(joined)
    new = cut_lineage(sizes.join(found, F.col("class") == F.col("node"), "left").select("class", "n", F.coalesce("component", "class").alias("new")))
    d = join_hot(live, new, "class", total, "n")
    return cut_lineage(d.select(*[F.col("new").alias("class") if c == "class" else c for c in live.columns]))


def near_classes(traces: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Classes of near duplicates: one row per row of traces.

    traces: series_id, trace; other columns are ignored. Returns series_id, class_id (the least series_id of the class)
    and n_links (verified links of the row's words to others). Traces with equal words (lower case, without punctuation
    at word ends) are copies and of one class; links join others whose word shingles align with similarity `least` or
    more, and classes are the connected components.

    Copies are folded into one text before anything else, so that a group of copies costs one row. Order MinHash tuples
    deal texts into buckets. Step by step, by a few tuples each, a text meets one centre of its bucket, unless it is of
    the centre's class already; what aligns becomes one class before the next step. So a step makes one row per tuple of
    the texts still apart, however large their bucket. Where classes still meet after all tuples, a small bucket's texts
    are compared pair by pair, and for the texts of larger buckets all pairs of different classes that can be similar are
    found by their rarest shingles: every pair of one bucket is linked, or not similar. No text is dropped, no pair of
    one class is verified, and classes never reach the driver.

    A NULL or empty trace has no words; all such are copies of each other. Rows with NULL ids get their class like
    others; its class_id is NULL only if no row of the class has an id. Repeated rows are copies. Empty in, empty out."""
    sk = cut_lineage(sketches(traces))
    nodes = cut_lineage(sk.groupBy("name").agg(F.min("series_id").alias("least"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")))
    members = nodes.select("name", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    total = nodes.count()
    live = join_hot(members, cut_lineage(shared), "key", SKETCHES * total, "n").select("name").distinct()
    live = cut_lineage(nodes.join(live, "name", "left_semi").select("name", F.col("name").alias("class"), "keys"))
    texts = cut_lineage(sk.groupBy("name").agg(F.first("shingles").alias("shingles")).join(live.select("name").hint("merge"), "name", "left_semi"))
    total, links = live.count(), []

    def compare(pairs: DataFrame, live: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs.distinct())
        if pairs.isEmpty():
            return live
        links.append(cut_lineage(_verified(pairs, texts, least)))
        return live if links[-1].isEmpty() else _merged(live, links[-1], total)

    for tuples in STEPS:
        live = compare(_stars(live, tuples, total), live)
    near, large = _left_apart(live, total)
    large = cut_lineage(large)
    live = compare(near, live)
    if not large.isEmpty():
        rest = texts.join(live.select("name", "class").join(large, "name").hint("merge"), "name")
        live = compare(_all_pairs(cut_lineage(rest.select("name", "class", "shingles")), least), live)

    none = live.select(F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    links = reduce(DataFrame.union, links, none)
    degree = links.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_links"))
    ids = nodes.select("name", "least", "copies").join(live.select("name", "class"), "name", "left")
    ids = cut_lineage(ids.select("name", "least", "copies", F.coalesce("class", "name").alias("class")))
    of_class = cut_lineage(ids.groupBy("class").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n")))
    ids = join_hot(ids, of_class, "class", nodes.count(), "n").join(degree, "name", "left")
    ids = cut_lineage(ids.select("name", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    rows = join_hot(sk.select("series_id", "name"), ids, "name", sk.count(), "copies")
    return rows.select("series_id", "class_id", "n_links")
