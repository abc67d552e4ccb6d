"""BPE with word ends: encoding by an index from pairs to all their positions, and decoding."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voltide.llm.blocks import named_chunks, text_blocks

# The pieces that the tokenizer file's own pattern finds, with white space as Unicode has it.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, Unicode doesn't
MAX_ENTRIES = 160_000
NONE = np.int32(2**31 - 1)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in shown}
    chars |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in chars)}
    return [chars[b] for b in range(256)]


class ChunkTable:
    """What white-space separated chunks become. Two generations are kept, so that frequent chunks stay and memory has
    a bound whatever the texts hold."""

    def __init__(self, encode: Callable[[list[str], dict], list]):
        self.encode, self.known, self.older = encode, {}, {}

    def of(self, chunks: list[str]) -> list[bytes]:
        """What distinct chunks become."""
        if len(self.known) > MAX_ENTRIES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, chunks))
        new = []
        for k in [k for k, v in enumerate(out) if v is None]:
            c = chunks[k]
            v = older.get(c)
            if v is None:
                new.append(k)
            else:
                known[c] = out[k] = v
        names = [chunks[k] for k in new]
        for k, c, v in zip(new, names, self.encode(names, known)):
            known[c] = out[k] = v
        return out


class WordBpe:
    """A tokenizer file of the kind BPE with `</w>` word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab = d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.marked = {"\0" + t.upper(): i for t, i in self.special.items()}
        self.token = [t for t, _ in sorted((vocab | self.special).items(), key=lambda x: x[1])]
        chars = byte_chars()
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in d["model"]["merges"]]
        self.made = np.array([c for _, _, c in self.rules], np.int32)
        keys = np.array([a << 20 | b for a, b, _ in self.rules], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.inner_ids, self.last_ids = (np.array([vocab[c + end] for c in chars], np.int32) for end in ("", "</w>"))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def merge_indexed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as bytes, by an index from each pair's rank to all its positions in the words. Ranks that
        occur are applied in ascending order, each to all its positions at once, and the pairs that its merges make
        are added to the index."""
        if not words:
            return []
        sym, last = self.symbols(words)
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[last] = -1
        prv[0] = -1
        prv[1:][last[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            found = ranks < NONE
            at, ranks = at[found], ranks[found]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
            for a, b, r in zip([0, *cuts], [*cuts, len(at)], ranks[[0, *cuts]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(at[a:b])

        start = np.flatnonzero(nxt >= 0)
        add(start, self.pair_rank(sym[start], sym[start + 1]))
        while heap:
            r = heapq.heappop(heap)
            a, b, c = self.rules[r]
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            q = nxt[at]
            fresh = (sym[at] == a) & (q >= 0) & (sym[q] == b)
            at, q = at[fresh], q[fresh]
            if a == b and len(at) > 1:  # of overlapping pairs, the first, third ... merge
                run = np.flatnonzero(np.append(True, q[:-1] != at[1:]))
                even = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0
                at, q = at[even], q[even]
            if not len(at):
                continue
            sym[at], sym[q] = c, -1
            after, before = nxt[q], prv[at]
            nxt[at] = after
            right, left = after >= 0, before >= 0
            prv[after[right]] = at[right]
            first = np.concatenate([at[right], before[left]])
            if len(first):
                add(first, self.pair_rank(sym[first], sym[nxt[first]]))
        keep = sym >= 0
        return self.cut(sym[keep], np.cumsum(keep)[last.nonzero()[0]])

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte symbols of all words in a row, and which end a word."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner_ids[raw]
        sym[ends - 1] = self.last_ids[raw[ends - 1]]
        last = np.zeros(len(sym), bool)
        last[ends - 1] = True
        return sym, last

    @staticmethod
    def cut(sym: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data, ends = sym.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where no rule has it."""
        key = a.astype(np.int64) << 20 | b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_ranks[k], NONE)

    def chunk_ids(self, chunks: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids per chunk as little-endian unsigned 32-bit integers. known: chunks, and so pieces, of which they are known."""
        cut: dict[str, list[str]] = {}
        pieces = set()
        for c in chunks:
            if c.isalpha():
                pieces.add(c)
            else:
                head = c[:-1]
                cut[c] = parts = [head, c[-1]] if head.isalpha() and not c[-1].isalnum() else [c] if c in self.marked else PIECE.findall(c)
                pieces.update(parts)
        pieces -= self.marked.keys()
        ids = {p: known[p] for p in pieces & known.keys()}
        new = list(pieces - ids.keys())
        ids.update(zip(new, self.merge_indexed([p.encode() for p in new])))
        ids.update((m, np.array([i], "<u4").tobytes()) for m, i in self.marked.items())
        return [b"".join([ids[p] for p in cut[c]]) if c in cut else ids[c] for c in chunks]

    def decode(self, ids: np.ndarray) -> list[str]:
        """Token strings; between spaces they are what the library decodes without a decoder, special tokens included."""
        return list(map(self.token.__getitem__, ids.tolist()))

    @staticmethod
    def lower(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case by character, without context
        return text.lower()

    def chunked(self, text: str) -> str:
        """Lower-cased chunks between spaces; the strings of special tokens are chunks of their own, upper-cased with
        a leading NUL, which no lower-cased chunk equals."""
        if "<|" in text and self.split_special:
            parts = self.split_special.split(text)
            return " ".join("\0" + p.upper() if k % 2 else self.lower(p) for k, p in enumerate(parts))
        return self.lower(text)


class Encoder:
    """Whole texts to ids, a block at a time; chunks' ids are kept between the tasks of a Python worker."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.table = ChunkTable(self.bpe.chunk_ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's end."""
        odd = {k: t for k, t in enumerate(texts) if SEPARATORS.search(t)}
        chunks, codes, ends = named_chunks(pa.array(["" if k in odd else self.bpe.chunked(t) for k, t in enumerate(texts)], pa.string()))
        chunk_ends = np.append(0, ends)
        if odd:
            texts_chunks = [codes[a:b] for a, b in zip(chunk_ends, chunk_ends[1:])]
            place = {c: i for i, c in enumerate(chunks)}
            for k, t in odd.items():
                own = regex.findall(r"\P{White_Space}+", self.bpe.chunked(t))
                texts_chunks[k] = np.array([place.setdefault(c, len(place)) for c in own], np.int32)
            chunks, codes = list(place), np.concatenate(texts_chunks)
            chunk_ends = np.append(0, np.cumsum([len(c) for c in texts_chunks]))
        ids = self.table.of(chunks)
        length = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        data = np.frombuffer(b"".join(ids), "<u4")
        n = length[codes]
        after = np.append(0, np.cumsum(n))
        at = np.repeat(((np.cumsum(length) - length)[codes] - after[:-1]).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return data[at], after[chunk_ends[1:]]


_LOADED: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    """One encoder a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def bpe_encode(traces: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of whole traces and the text that they decode to.

    traces: series_id, trace; other columns are ignored. Returns series_id, ids (little-endian unsigned 32-bit integers)
    and decoded (token strings between spaces, special tokens included). No shuffle.

    The vocabulary is the file at path. A block of a partition's texts is cut into its distinct words; each pair of
    symbols leads to all its positions in those words, ranks are applied in ascending order, each to all its positions,
    and the lists of the pairs around a merge are updated. Words recur, so that their ids are kept up to a bound.

    A NULL or empty trace has no ids. Repeated rows and equal or NULL series_ids give a row each, an empty table none.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for b, texts in text_blocks(batches, "trace"):
            ids, ends = encoder.encode(texts)
            tokens = encoder.bpe.decode(ids)
            spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([ids[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([" ".join(tokens[a:z]) for a, z in spans], pa.string())],
                ["series_id", "ids", "decoded"])

    d = traces.select("series_id", "trace")
    return d.mapInArrow(run, f"series_id {dict(d.dtypes)['series_id']}, ids binary, decoded string")
