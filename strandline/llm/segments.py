"""Texts cut where a space stands between two words: pieces that tokenizers of words with their leading space treat alone.

A cut lies before a space that has a character other than white space on both sides. No token of such a tokenizer spans
a cut, so a text's tokens are its segments' tokens one after the other, and each distinct segment is tokenized once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandline.llm import text as tx

#: Bytes of text whose distinct segments are tokenized at a time, unless one text has more.
CHUNK_BYTES = 4 << 20

_PRINTED = np.array([0x20 < b < 0x7F for b in range(256)])
#: First bytes of characters beyond ASCII, without those that white space (U+0085, U+00A0, U+1680, U+180E, U+2000 to U+205F, U+3000) starts with.
_LEAD = np.array([0xC3 <= b <= 0xF4 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])
_THREE = np.array([b in (0xE1, 0xE2, 0xE3) for b in range(256)])
_BEFORE_NEXT = _PRINTED | _LEAD


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, with one space put before each; a null is empty."""
    data, offsets = tx.text_buffers(texts)
    n = len(offsets) - 1
    moved = offsets + np.arange(n + 1)
    out = np.empty(len(data) + n, np.uint8)
    own = np.ones(len(out), bool)
    own[moved[:-1]] = False
    out[moved[:-1]] = 0x20
    out[own] = data
    return out, moved


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each segment's number in the dictionary of distinct ones, that dictionary, and the segments up to each text's end."""
    ending = np.zeros(len(data) + 1, bool)
    ending[offsets[1:]] = True
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    before, after = data[at - 1], data[at + 1]
    narrow = (before >= 0x80) & (data[np.maximum(at - 2, 0)] != 0xC2) & ~_THREE[data[np.maximum(at - 3, 0)]]
    at = at[_BEFORE_NEXT[after] & (_PRINTED[before] | narrow) & ~ending[at + 1]]
    starting = np.zeros(len(data) + 1, bool)
    starting[at] = True
    starting[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(starting)
    ends = np.append(starts, len(data)).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = found.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.string()), np.searchsorted(starts, offsets[1:])


def expanded(codes: np.ndarray, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and the number of them up to each text's end, from those of the distinct segments."""
    starts = np.cumsum(counts) - counts
    each = counts[codes]
    total = np.concatenate(([0], np.cumsum(each)))
    return ids[tx.ragged(starts[codes], each)], total[ends]
