"""Arrow helpers for operators that read texts in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 6_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about max_bytes of text each (or one longer row), and their texts, NULL as empty."""
    for b in batches:
        if not b.num_rows:
            continue
        col = pc.fill_null(b.column(b.schema.get_field_index(column)), "")
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(i, j - i), col.slice(i, j - i).to_pylist()
            i = j
        del b, col
        pa.default_memory_pool().release_unused()  # workers live on between tasks


def named_chunks(texts: pa.Array, ascii_only: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Chunks between white space (of ASCII or of Unicode): the distinct ones, each place's number among them, and where
    each text's places end. There may be an empty chunk at a text's ends."""
    split = (pc.ascii_split_whitespace if ascii_only else pc.utf8_split_whitespace)(texts)
    named = split.flatten().dictionary_encode()
    n = len(named.dictionary)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, n], named.dictionary), " ")[0].as_py()
    return joined.split(" ") if n else [], named.indices.to_numpy(), split.offsets.to_numpy()[1:]
