"""Splitting whole texts into words with numpy and Arrow, a chunk of documents at a time.

Words are cut on UTF-8 bytes: every separator used here is an ASCII character, and no byte of a
multi-byte character is ASCII, so cutting bytes equals cutting characters.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk holds at most, unless a single document is longer.
CHUNK_BYTES = 4 << 20

#: The C library's own way to do so, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and everything beyond ASCII.
ALNUM = _table(lambda b: b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122)
#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NON_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def chunks(batches: Iterable[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds at most ``size`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    hand_back()


def hand_back() -> None:
    """Gives freed memory back to the system: a Python worker stays alive for a while after its task, beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and each row's offsets in them; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, table: np.ndarray, lower: bool = True) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of all texts in order, and for each text the number of words up to its end."""
    data, offsets = text_buffers(texts)
    if lower and len(data):
        data = np.frombuffer(data.tobytes().translate(_LOWER), dtype=np.uint8)
    inside = table[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = inside[firsts]
    starts = np.flatnonzero(start)
    compact = data[inside]
    before = np.cumsum(inside, dtype=np.int32)
    ends = np.empty(len(starts) + 1, np.int32)
    ends[:-1] = before[starts] - 1
    ends[-1] = len(compact)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(compact)])
    return found, np.searchsorted(starts, offsets[1:])


def encoded(texts: pa.Array, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """Each word's number in the chunk's dictionary, that dictionary, and the words up to each text's end."""
    found, ends = words(texts, table, lower)
    coded = found.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, ends


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finisher of a public splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every row, one row after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
