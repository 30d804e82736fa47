"""Vectorised helpers for the operators that read texts in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about `limit` bytes of text; a longer text makes a part of its own, never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.cumsum(size), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20, cut: re.Pattern = _BLANK) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool]]:
    """Slices with their texts (null: empty), and whether the slice goes on: a text longer than limit comes in pieces, cut
    before ASCII white space or what is given, each with the one row it is from. A longer run without any is never cut."""
    for part in slices(batches, column, limit):
        texts = texts_of(part, column)
        raw = texts[0].as_buffer() if part.num_rows == 1 else b""
        if len(raw) <= limit:
            yield part, texts, False
            continue
        raw, at = memoryview(raw), 0
        while at < len(raw):
            found = cut.search(raw, at + limit) if at + limit < len(raw) else None
            stop = found.start() if found else len(raw)
            yield part, pa.array([bytes(raw[at:stop])], pa.large_binary()).view(pa.large_string()), stop < len(raw)
            at = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts, and the offsets of each text's words (one more than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets.to_numpy(), dtype=np.int64)
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        before = np.concatenate([[0], np.cumsum(real)])
        flat, offsets = flat.filter(pa.array(real)), before[offsets]
    return flat, offsets


def joined_words(words: pa.Array, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Each text's words with one blank between, all in one UTF-8 buffer, and where each word starts and ends there."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), pa.scalar(" ", pa.large_string()))
    data = (joined.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    start = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = start[:-1][owner] + total - total[at[:-1][owner]] if len(owner) else np.zeros(0, np.int64)
    return data, first, first + size
