"""Alignment of two tokenizations of the same text by the byte offsets where both end a token.

Texts are cut into segments that both vocabularies tokenize alone, so a cut is a common end and each distinct segment of a
chunk is aligned once. Cumulative ends of either side are keys of an end-to-index dictionary; the sorted intersection of the
two key sets slices both id lists into groups, and each slice is expanded into the links of its overlapping tokens.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import segments as sg
from strandline.llm import text as tx
from strandline.llm import vocabularies as vc
from strandline.llm.work import Scope, new_path, saved, small_batches

#: Pairs with at least this share of all links are looked up in a broadcast table, which thus has no more rows than 1 / share; others are joined.
HOT_SHARE = 1 / (1 << 19)


class Aligned:
    """The groups and links of a chunk's texts; a is the byte-level vocabulary, b the one of pieces."""

    def __init__(self, texts: pa.Array, a: vc.ByteVocabulary, b: vc.PieceVocabulary) -> None:
        self.a, self.b = a, b
        data, offsets = sg.spaced(texts)
        self.codes, distinct, self.ends = sg.cut(data, offsets)
        tokens_a, tokens_b = a.encode(distinct), b.encode(distinct)
        content, bounds = vc.buffers(distinct)
        same = _spell(tokens_a, a, content, bounds) & _spell(tokens_b, b, content, bounds)
        self.ids_a, self.n_a = _only(tokens_a, same)
        self.ids_b, self.n_b = _only(tokens_b, same)
        # a text counts if it isn't empty and both sides spell each of its segments
        wrong = np.concatenate(([0], np.cumsum(~same[self.codes])))
        starts = np.concatenate(([0], self.ends[:-1]))
        self.counts = (np.diff(offsets) > 1) & (wrong[self.ends] == wrong[starts])
        self._slice()

    def _slice(self) -> None:
        """Ends that both sides have, and how many tokens of a and b, and groups, stand up to each (over all segments in a row)."""
        ends_a, ends_b = np.cumsum(self.a.length[self.ids_a]), np.cumsum(self.b.length[self.ids_b])
        index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
        index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
        common = sorted(index_a.keys() & index_b.keys())
        self.cuts_a = np.fromiter(map(index_a.__getitem__, common), np.int64, len(common))
        self.cuts_b = np.fromiter(map(index_b.__getitem__, common), np.int64, len(common))
        self.end_a, self.end_b = ends_a, ends_b
        upto = np.concatenate(([0], self.cuts_a)).searchsorted(np.cumsum(self.n_a))  # groups up to each segment's end
        self.n_groups = np.diff(upto, prepend=0)

    @cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens of a and of b that each link joins, and the number of links of each segment."""
        size_a, size_b = np.diff(self.cuts_a, prepend=0), np.diff(self.cuts_b, prepend=0)
        from_a, from_b = self.cuts_a - size_a, self.cuts_b - size_b
        n = size_a + size_b - 1  # neither side has an end inside that the other has too
        first = np.cumsum(n) - n
        left, right = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
        for many, one in ((size_a, size_b), (size_b, size_a)):
            g = np.flatnonzero(one == 1)
            at = tx.ragged(first[g], many[g])
            left[at] = tx.ragged(from_a[g], many[g]) if many is size_a else np.repeat(from_a[g], many[g])
            right[at] = tx.ragged(from_b[g], many[g]) if many is size_b else np.repeat(from_b[g], many[g])
        end_a, end_b = self.end_a.tolist(), self.end_b.tolist()
        for g in np.flatnonzero((size_a > 1) & (size_b > 1)).tolist():
            i, j, at = int(from_a[g]), int(from_b[g]), int(first[g])
            for k in range(at, at + int(n[g])):
                left[k], right[k] = i, j
                if end_a[i] <= end_b[j]:
                    i += 1
                else:
                    j += 1
        total = np.concatenate(([0], np.cumsum(n)))
        upto = total[np.cumsum(self.n_groups)]
        return left, right, np.diff(upto, prepend=0)

    def per_text(self, of_segment: np.ndarray) -> np.ndarray:
        """Sums of a number of each segment over each text; zero for texts without tokens."""
        total = np.concatenate(([0], np.cumsum(of_segment[self.codes])))
        return np.where(self.counts, np.diff(total[self.ends], prepend=0), 0)

    def lists(self, values: np.ndarray, of_segment: np.ndarray, running: bool = False) -> pa.ListArray:
        """The texts' lists of values that each segment has of_segment of; running: values count on from segment to segment."""
        flat, ends = sg.expanded(self.codes, self.ends, values, of_segment)
        sizes = np.where(self.counts, np.diff(ends, prepend=0), 0)
        keep = np.repeat(self.counts, np.diff(ends, prepend=0))
        flat = flat[keep]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        if running:  # flat holds sizes
            before = np.concatenate(([0], np.cumsum(flat)))
            flat = before[1:] - np.repeat(before[bounds[:-1]], sizes)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups written as ``a1,a2|b1;a3|b2,b3``; empty for a text without tokens."""
        g = len(self.cuts_a)
        last_a, last_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        last_a[self.cuts_a - 1], last_b[self.cuts_b - 1] = 1, 2
        of_a = np.repeat(np.arange(g), np.diff(self.cuts_a, prepend=0))
        of_b = np.repeat(np.arange(g), np.diff(self.cuts_b, prepend=0))
        size = max(self.a.size, self.b.size)
        written = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        written[np.arange(len(self.ids_a)) + np.concatenate(([0], self.cuts_b))[of_a]] = self.ids_a + size * last_a
        written[np.arange(len(self.ids_b)) + self.cuts_a[of_b]] = self.ids_b + size * last_b
        names, starts, lengths = _numerals(size)
        text = names[tx.ragged(starts[written], lengths[written])]
        total = np.concatenate(([0], np.cumsum(lengths[written])))[np.cumsum(self.n_a + self.n_b)]
        of_segment = np.diff(total, prepend=0)
        flat, ends = sg.expanded(self.codes, self.ends, text, of_segment)
        view, at, out = memoryview(np.ascontiguousarray(flat)), 0, []
        for end, some in zip(ends.tolist(), self.counts.tolist(), strict=True):
            out.append(hashlib.sha256(view[at : end - 1]).hexdigest() if some else "")
            at = end
        return out


def _spell(tokens: vc.Tokens, vocabulary, content: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each segment's tokens, as bytes, are the segment."""
    table, starts = vocabulary.table
    lengths = vocabulary.length[tokens.ids]
    total = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(tokens.counts)))]
    spelt = table[tx.ragged(starts[tokens.ids], lengths)]
    out = np.diff(total) == np.diff(bounds)
    if out.all():
        wrong = np.flatnonzero(spelt != content)
    else:
        size = np.diff(bounds)[out]
        place = tx.ragged(bounds[:-1][out], size)
        wrong = place[spelt[tx.ragged(total[:-1][out], size)] != content[place]]
    out[np.searchsorted(bounds, wrong, side="right") - 1] = False
    return out


def _only(tokens: vc.Tokens, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts without those of other segments, which count none."""
    return tokens.ids[np.repeat(keep, tokens.counts)], np.where(keep, tokens.counts, 0)


_NUMERALS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _numerals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of "0," to "n," , "0|" to "n|" and "0;" to "n;" in a row, with their starts and lengths."""
    if size not in _NUMERALS:
        all_of = [f"{k}{mark}".encode() for mark in ",|;" for k in range(size)]
        lengths = np.array([len(x) for x in all_of], np.int64)
        _NUMERALS[size] = np.frombuffer(b"".join(all_of), np.uint8), np.cumsum(lengths) - lengths, lengths
    return _NUMERALS[size]


def _chunks(batches, text: str, a: Broadcast, b: Broadcast):
    va, vb = vc.byte_vocabulary(a.value, False), vc.piece_vocabulary(b.value)
    for part in tx.chunks(batches, text, sg.CHUNK_BYTES):
        yield part, Aligned(part.column(text), va, vb)


def align(df: DataFrame, a: Broadcast, b: Broadcast, text: str = "text") -> DataFrame:
    """Adds each whole text's ids (a_ids, b_ids) and, for each group, how many of them stand up to its end (a_ends, b_ends).

    a, b: broadcasts of the two vocabulary files' bytes. A text is tokenized with a space before it; strings of special tokens
    are plain text. Null and empty texts, and those that either side doesn't spell byte for byte, get empty lists. Columns of
    these names are replaced; others, repeated rows and nulls in them stay as they are.
    """
    names = ["a_ids", "b_ids", "a_ends", "b_ends"]
    fields = [f for f in df.schema.fields if f.name not in names]

    def run(batches):
        for part, x in _chunks(batches, text, a, b):
            lists = [
                x.lists(x.ids_a, x.n_a),
                x.lists(x.ids_b, x.n_b),
                x.lists(np.diff(x.cuts_a, prepend=0), x.n_groups, running=True),
                x.lists(np.diff(x.cuts_b, prepend=0), x.n_groups, running=True),
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *lists], names=[*(f.name for f in fields), *names])

    small_batches(df.sparkSession)
    return df.select([f.name for f in fields]).mapInArrow(run, T.StructType([*fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names)]))


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = "_row long, _kind int, key {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _distinct(pairs: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each owner: owner, pair and how often it has it; size is more than any pair."""
    found, times = np.unique(owner * size + pairs, return_counts=True)
    return found // size, found % size, times


def _measured(a: Broadcast, b: Broadcast):
    """One row a text with its numbers and its distinct linked id pairs; and one row a chunk with the chunk's pairs (_kind 1)."""

    def run(batches):
        for part, x in _chunks(batches, "text", a, b):
            n, size = part.num_rows, x.a.size * x.b.size
            left, right, per_segment = x.links
            pairs = x.ids_a[left].astype(np.int64) * x.b.size + x.ids_b[right]
            flat, ends = sg.expanded(x.codes, x.ends, pairs, per_segment)
            owner = np.repeat(np.arange(n), np.diff(ends, prepend=0))
            keep = x.counts[owner]
            owner, pair, times = _distinct(flat[keep], owner[keep], size)
            bounds = np.searchsorted(owner, np.arange(n + 1))
            all_pairs, back = np.unique(pair, return_inverse=True)
            all_times = np.bincount(back, weights=times, minlength=len(all_pairs)).astype(np.int64)
            zero = pa.array(np.zeros(1, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"),
                    pa.array(np.zeros(n, np.int32)),
                    part.column("key"),
                    *(pa.array(x.per_text(v)) for v in (x.n_a, x.n_b, x.n_groups, per_segment)),
                    pa.array(x.digests(), pa.string()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pair, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(times, pa.int32())),
                ],
                names=["_row", "_kind", "key", *_NUMBERS, "groups_sha256", "pairs", "times"],
            )
            whole = pa.array([0, len(all_pairs)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    zero,
                    pa.array([1], pa.int32()),
                    pa.nulls(1, part.schema.field("key").type),
                    *([zero] * 4),
                    pa.array([""]),
                    pa.ListArray.from_arrays(whole, pa.array(all_pairs, pa.int64())),
                    pa.ListArray.from_arrays(whole, pa.array(all_times, pa.int32())),
                ],
                names=["_row", "_kind", "key", *_NUMBERS, "groups_sha256", "pairs", "times"],
            )

    return run


def _looked_up(hot: Broadcast):
    """Sums over each text's pairs that the hot table has; the others stay as lists."""

    def run(batches):
        known, n, best = hot.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            sizes = np.asarray(pairs.value_lengths())
            pair, time = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            is_hot = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            sums = []
            for values in (best, n):
                v = np.where(is_hot, values[at] * time, 0) if len(known) else np.zeros(len(pair), np.int64)
                sums.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[bounds])))
            cold = np.concatenate(([0], np.cumsum(~is_hot)))[bounds]
            lists = [pa.ListArray.from_arrays(pa.array(cold, pa.int32()), pa.array(x[~is_hot], x_type)) for x, x_type in ((pair, pa.int64()), (time, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *sums, *lists], names=["_row", "best", "total", "pairs", "times"])

    return run


def report(df: DataFrame, a: Broadcast, b: Broadcast, key: str = "doc_id", text: str = "text", hot_share: float = HOT_SHARE) -> DataFrame:
    """For each row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of token occurrences whose byte ranges overlap; an id pair's count is the number of links of all texts that
    hold it. count_sum adds the counts of a text's links; n_best is the number of its links whose count is the greatest of their
    b id, ties included. Rows without tokens (see align) have zeros and an empty digest. Keys may be null or repeated: every row
    is reported alone. Any other columns are left out. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    size_b = vc.piece_vocabulary(b.value).size
    with Scope(spark) as scope:
        source = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), F.col(text).alias("text"))
        found = scope.saved(source.mapInArrow(_measured(a, b), _ALIGNED.format(key=kind)), "aligned")
        pair = F.explode(F.arrays_zip("pairs", "times")).alias("p")
        counts = found.where("_kind = 1").select(pair).select(F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
        counts = scope.saved(counts, "pair-counts")
        most = counts.groupBy((F.col("pair") % size_b).alias("_b")).agg(F.max("n").alias("_most"))
        # at most one row for each id of b's vocabulary
        ranked = counts.withColumn("_b", F.col("pair") % size_b).join(F.broadcast(most), "_b").select("pair", "n", (F.col("n") == F.col("_most")).cast("long").alias("is_best"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        is_hot = F.col("n") >= F.lit(total * hot_share)
        hot = ranked.where(is_hot).orderBy("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "is_best")))
        texts = found.where("_kind = 0")
        looked = scope.saved(texts.select("_row", "pairs", "times").mapInArrow(_looked_up(table), "_row long, best long, total long, pairs array<long>, times array<long>"), "looked-up")
        cold = looked.select("_row", pair).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).join(ranked.where(~is_hot), "pair")
        cold = cold.select("_row", (F.col("is_best") * F.col("times")).alias("best"), (F.col("n") * F.col("times")).alias("total"))
        sums = looked.select("_row", "best", "total").unionByName(cold).groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
        out = texts.select("_row", F.col("key").alias(key), *_NUMBERS, "groups_sha256").join(sums, "_row")
        out = saved(out.select(key, *_NUMBERS, "n_best", "count_sum", "groups_sha256"), "alignment", new_path(spark, "alignment"))
        table.unpersist()
    return out
