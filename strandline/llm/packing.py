"""Packing of documents into token sequences along a space-filling curve.

A document's tokens are counted in hashed buckets; the vector is projected to a few dimensions, and its place there gives a
key on a Hilbert curve. Documents are range-sorted by that key, so that neighbours in a sequence are neighbours on the curve,
and each range of the sorted tokens is cut into sequences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import segments as sg
from strandline.llm import text as tx
from strandline.llm import vocabularies as vc
from strandline.llm.work import new_path, saved, small_batches

LENGTH = 2048
END = 1
#: Buckets of the hashed vectors, dimensions of the curve's cube, and bits of each.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12
#: Token bytes of a range of documents, about.
RANGE_BYTES = 32 << 20
#: Ranges at most; beyond, each holds more, as a task passes its range on in batches.
MOST_RANGES = 50_000
_BLOCK = 512
_AXES = [f"c{i}" for i in range(DIMENSIONS)]
#: Sequences of one range are numbered from its number times this.
_RANGE = 1 << 40


def projection(seed: int = 11) -> np.ndarray:
    """Random directions in the space of hashed vectors (BUCKETS x DIMENSIONS)."""
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMENSIONS))


def hashed_vectors(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unit vectors of damped counts of each document's tokens in signed hashed buckets; zero for a document without any."""
    mixed = tx.spread(np.arange(1, int(ids.max(initial=0)) + 2, dtype=np.uint64))
    bucket, sign = (mixed % np.uint64(BUCKETS)).astype(np.int64)[ids], np.where(mixed >> np.uint64(63), 1.0, -1.0)[ids]
    out = np.zeros((len(ends), BUCKETS))
    for k, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        out[k] = np.bincount(bucket[start:end], weights=sign[start:end], minlength=BUCKETS)
    out = np.sign(out) * np.log1p(np.abs(out))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def places(ids: np.ndarray, ends: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Projections of the documents' hashed vectors, made for a few documents at a time."""
    out = np.zeros((len(ends), onto.shape[1]))
    for at in range(0, len(ends), _BLOCK):
        begin = int(ends[at - 1]) if at else 0
        upto = ends[at : at + _BLOCK]
        out[at : at + _BLOCK] = hashed_vectors(ids[begin : int(upto[-1])], upto - begin) @ onto
    return out


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell (rows of whole numbers below 2**bits) along a Hilbert curve through the cube.

    From the highest bit down, the part of the cube that a cell lies in turns or mirrors what is inside it, so that the curve
    through each part starts where the one before ended; the turned bits in Gray code order are the key.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            upper = (x[i] & bit) != 0
            exchanged = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ exchanged)
            if i:
                x[i] ^= exchanged
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flips = np.where((x[n - 1] & bit) != 0, flips ^ (bit - 1), flips)
        bit >>= 1
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenized(vocabulary: Broadcast, kind: np.dtype, end: int):
    """Each document's ids as bytes (with the end id), their number, and its place in the projected space."""
    onto = projection()

    def run(batches):
        v = vc.byte_vocabulary(vocabulary.value, True)
        for part in tx.chunks(batches, "text", sg.CHUNK_BYTES):
            data, offsets = tx.text_buffers(part.column("text"))
            codes, distinct, ends = sg.cut(data, offsets)
            tokens = v.encode(distinct)
            ids, upto = sg.expanded(codes, ends, tokens.ids, tokens.counts)
            place = places(ids, upto, onto)
            n = part.num_rows
            closed = np.full(len(ids) + n, end, kind)
            own = np.ones(len(closed), bool)
            own[upto + np.arange(n)] = False
            closed[own] = ids
            bounds = np.concatenate(([0], (upto + np.arange(1, n + 1)) * kind.itemsize)).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(closed)])
            counts = pa.array(np.diff(bounds).astype(np.int64) // kind.itemsize)
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("key"), counts, blobs, *(pa.array(c) for c in place.T)], names=["_row", "key", "tokens", "ids", *_AXES])

    return run




class _Packer:
    """Where further ids of a range go: sequences are filled one after the other."""

    def __init__(self, first: int, length: int) -> None:
        self.sequence, self.length, self.used = first, length, 0

    def cuts(self, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the parts of so many further ids that lie in one sequence each, and those parts' sequences and offsets."""
        starts = np.concatenate(([0], np.arange(self.length - self.used, total, self.length)))
        place = starts + self.used
        found = self.sequence + place // self.length, place % self.length
        self.sequence, self.used = self.sequence + (self.used + total) // self.length, (self.used + total) % self.length
        return starts, *found


_PIECE = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def _pieces(keys: pa.Array, counts: np.ndarray, before: np.ndarray, whole: np.ndarray, ids: np.ndarray, starts: np.ndarray, sequences: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Rows of documents (or parts of them, with the ids before and in the whole document) cut at the starts of sequences' parts."""
    ends = np.cumsum(counts)
    firsts = ends - counts
    at = np.union1d(firsts, starts)
    document = np.searchsorted(ends, at, side="right")
    part = np.searchsorted(starts, at, side="right") - 1
    sizes = np.diff(np.append(at, ends[-1]))
    bounds = np.concatenate(([0], np.cumsum(sizes) * 4)).astype(np.int32)
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))])
    columns = [keys.take(pa.array(document)), pa.array(before[document] + at - firsts[document]), pa.array(sizes), pa.array(whole[document])]
    return pa.RecordBatch.from_arrays([*columns, pa.array(sequences[part]), pa.array(offsets[part] + at - starts[part]), blobs], names=_PIECE)


def _tail(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The pieces of an unfilled sequence cut anew into sequences whose lengths are powers of two."""
    t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    counts = t.column("length").to_numpy()
    total, first = int(counts.sum()), t.column("sequence_id")[0].as_py()
    sizes = np.array([1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1])
    data, _ = tx.text_buffers(t.column("ids"))
    starts = np.cumsum(sizes) - sizes
    return _pieces(t.column("key"), counts, t.column("start").to_numpy(), t.column("doc_tokens").to_numpy(), data.view("<u4"), starts, first + np.arange(len(sizes)), np.zeros(len(sizes), np.int64))


def _packed(length: int, kind: np.dtype):
    """Pieces of sorted documents: one row for each part of a document that lies in one sequence."""

    def run(batches):
        packer = _Packer(TaskContext.get().partitionId() * _RANGE, length)
        unfilled: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column("tokens").to_numpy()
            data, _ = tx.text_buffers(batch.column("ids"))
            out = _pieces(batch.column("key"), counts, np.zeros_like(counts), counts, data.view(kind), *packer.cuts(int(counts.sum())))
            filled = int(np.searchsorted(out.column("sequence_id").to_numpy(), packer.sequence))
            if filled:
                yield from unfilled
                yield out.slice(0, filled)
                unfilled = []
            if filled < out.num_rows:
                unfilled.append(out.slice(filled))
        if unfilled:
            yield _tail(unfilled)

    return run


def pack(df: DataFrame, vocabulary: Broadcast, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents in sequences: key, start, length, doc_tokens, sequence_id, offset, ids (binary, unsigned 32-bit little-endian).

    vocabulary: a broadcast of a byte-level vocabulary file. A document is its ids and the end id; null and empty texts have the
    end id only. Documents of a range follow one another in the order of their keys on the curve, and every ``length`` ids make
    a sequence; a range's last ids are cut into sequences of powers of two, so nothing is padded. sequence_id is unique, but
    numbers are left out between ranges. Each row is packed, with repeated or null keys too, and rows with equal texts stand
    next to each other; other columns are left out. An empty table gives no pieces.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = df.schema[key].dataType.simpleString()
    kind = np.dtype("<u2" if max(vc.byte_vocabulary(vocabulary.value, True).size - 1, end) < 1 << 16 else "<u4")
    source = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"_row long, key {own}, tokens long, ids binary, " + ", ".join(f"{c} double" for c in _AXES)
    found = saved(source.mapInArrow(_tokenized(vocabulary, kind, end), schema), "tokens", new_path(spark, "tokens"))
    spread = found.agg(F.sum("tokens").alias("tokens"), *[f(c).alias(f"{c}{f.__name__}") for c in _AXES for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([spread[f"{c}avg"] or 0.0 for c in _AXES])
    scale = np.array([spread[f"{c}stddev_pop"] or 1.0 for c in _AXES])

    @F.pandas_udf("long")
    def place(*axes: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy() for c in axes], axis=1) - mean) / scale
        share = 1 / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))  # about the share of documents below, so that cells are used alike
        return pd.Series(hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    ranges = min(max(-(-(spread["tokens"] or 0) * kind.itemsize // RANGE_BYTES), 1), MOST_RANGES)
    along = found.select("_row", "key", "tokens", "ids", place(*_AXES).alias("_key")).repartitionByRange(ranges, "_key", "_row").sortWithinPartitions("_key", "_row")
    out = along.select("key", "tokens", "ids").mapInArrow(_packed(length, kind), f"key {own}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("key", key)
