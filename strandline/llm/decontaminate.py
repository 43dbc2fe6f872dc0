"""Benchmark decontamination by a positional inverted index of the training text.

``build_index`` cuts the documents into segments and stores, for each segment, its term dictionary
and every term's token positions. ``search`` takes benchmark windows (runs of consecutive words):
in each segment it starts from a window's rarest term, intersects the offset-adjusted position
lists of the other terms in order of rarity, and keeps exact phrases; on the way it keeps the
proximity matches, in which all of a window's words stand near the rarest one in any order.
Segments are independent, so the index needs no shuffle and a lost task is rebuilt alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import text as tx
from strandline.llm.work import Scope, saved, small_batches

WINDOW = 13
#: Words beyond the window's length over which a proximity match may spread to either side.
SLOP = 7
#: Text of a segment, and benchmark text whose windows (one a word at most) are broadcast at once; a larger benchmark takes more passes.
SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: Candidate positions examined at once.
_CANDIDATES = 1 << 21

INDEX_SCHEMA = "doc_ids array<bigint>, token_ends array<int>, terms array<binary>, term_ends array<int>, steps binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment: its documents, where each ends in the segment's tokens, and its postings.

    Terms are sorted; ``steps`` holds their position lists one after the other as differences (32 bit).
    Every row of docs is in exactly one segment, one with null or wordless text as a document without tokens.
    """

    def run(batches):
        for part in tx.chunks(batches, text, SEGMENT_BYTES):
            ids, terms, ends = tx.encoded(part.column(text), tx.ALNUM)
            order = np.argsort(ids, kind="stable").astype(np.int32)
            counts = np.bincount(ids, minlength=len(terms))
            by = pc.sort_indices(terms).to_numpy()
            starts = np.cumsum(counts) - counts
            positions = order[tx.ragged(starts[by], counts[by])]
            term_ends = np.cumsum(counts[by])
            steps = np.diff(positions, prepend=0)
            first = term_ends - counts[by]
            steps[first] = positions[first]
            one = lambda v, kind: pa.array([v], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([one(part.column(key).cast(pa.int64()), pa.int64()), one(ends, pa.int32()), one(terms.take(pa.array(by)), pa.binary()), one(term_ends, pa.int32()), pa.array([steps.astype(np.int32).tobytes()], pa.binary())], names=["doc_ids", "token_ends", "terms", "term_ends", "steps"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, INDEX_SCHEMA)


@dataclass
class Windows:
    """Distinct windows of a block of items: term numbers (-1 pads), lengths, and the items of each."""

    terms: pa.BinaryArray
    matrix: np.ndarray
    lengths: np.ndarray
    item_ends: np.ndarray
    items: np.ndarray


def windows_of(items: list[tuple[int, str]], size: int = WINDOW) -> Windows:
    """All windows of ``size`` consecutive words; an item with fewer words, but not none, is one window."""
    ids, terms, ends = tx.encoded(pa.array([t for _, t in items], pa.string()), tx.ALNUM)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    words = ends - begins
    count = np.where(words > 0, np.maximum(1, words - size + 1), 0)
    owner = np.repeat(np.arange(len(items)), count)
    start = tx.ragged(begins, count)
    place = np.arange(size)
    inside = place < np.minimum(words[owner], size)[:, None]
    rows = np.where(inside, ids[np.minimum(start[:, None] + place, max(len(ids) - 1, 0))], -1).astype(np.int32) if len(ids) else np.zeros((0, size), np.int32)
    _, first, window = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * size))).ravel(), return_index=True, return_inverse=True)
    item = np.array([i for i, _ in items], np.int64)[owner]
    by = np.lexsort((item, window))
    window, item = window[by], item[by]
    once = np.ones(len(item), bool)
    once[1:] = (window[1:] != window[:-1]) | (item[1:] != item[:-1])
    matrix = rows[first]
    return Windows(terms, matrix, (matrix >= 0).sum(axis=1), np.cumsum(np.bincount(window[once], minlength=len(first))), item[once])


def search_segment(w: Windows, terms: pa.Array, term_ends: np.ndarray, steps: np.ndarray, token_ends: np.ndarray, slop: int = SLOP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact matches (window, first token) and proximity matches (window, token of the rarest term) in one segment."""
    none = np.zeros(0, np.int64)
    n_tokens = int(token_ends[-1]) if len(token_ends) else 0
    if not n_tokens or not len(w.matrix):
        return none, none, none, none
    counts = np.diff(term_ends, prepend=0)
    local = pc.index_in(w.terms, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    pad = w.matrix < 0
    matrix = np.where(pad, -2, local[np.maximum(w.matrix, 0)])
    rows = np.flatnonzero(((matrix >= 0) | pad).all(axis=1))
    if not len(rows):
        return none, none, none, none
    matrix, pad = matrix[rows], pad[rows]
    frequency = np.where(pad, np.iinfo(np.int64).max, counts[np.maximum(matrix, 0)])
    order = np.argsort(frequency, axis=1, kind="stable")
    firsts = term_ends - counts
    positions = np.cumsum(steps, dtype=np.int64)
    base = np.concatenate(([0], positions))[firsts]  # what earlier lists add
    positions -= np.repeat(base, counts)
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * n_tokens + positions
    padded = np.append(keys, np.iinfo(np.int64).max)
    doc_first = np.concatenate(([0], token_ends[:-1])).astype(np.int64)
    rarest = matrix[np.arange(len(rows)), order[:, 0]]
    lists = counts[rarest]
    out: list[list[np.ndarray]] = [[], [], [], []]
    cuts = np.flatnonzero(np.diff(np.cumsum(lists) // _CANDIDATES)) + 1
    for group in np.split(np.arange(len(rows)), cuts):
        owner = np.repeat(group, lists[group])
        anchor = positions[tx.ragged(firsts[rarest[group]], lists[group])]
        doc = np.searchsorted(token_ends, anchor, side="right")
        low, high = doc_first[doc], token_ends[doc] - 1
        span = w.lengths[rows[owner]] - 1 + slop
        near = np.ones(len(owner), bool)
        at = np.arange(len(owner))
        for k in range(1, matrix.shape[1]):
            term = matrix[owner[at], order[owner[at], k]]
            real = term >= 0
            a = at[real]
            if not len(a):
                break
            t = term[real] * n_tokens
            least = t + np.maximum(anchor[a] - span[a], low[a])
            ok = padded[np.searchsorted(keys, least)] <= t + np.minimum(anchor[a] + span[a], high[a])
            near[a[~ok]] = False
            at = at[near[at]]
        owner, anchor, low, high = owner[near], anchor[near], low[near], high[near]
        out[2].append(rows[owner])
        out[3].append(anchor)
        start = anchor - order[owner, 0]
        ok = (start >= low) & (start + w.lengths[rows[owner]] - 1 <= high)
        owner, start = owner[ok], start[ok]
        for k in range(1, matrix.shape[1]):
            place = order[owner, k]
            term = matrix[owner, place]
            wanted = term * n_tokens + start + place
            ok = (term < 0) | (padded[np.searchsorted(keys, wanted)] == wanted)
            owner, start = owner[ok], start[ok]
        out[0].append(rows[owner])
        out[1].append(start)
    return tuple(np.concatenate(x) if x else none for x in out)


def _items(w: Windows, found: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.ListArray:
    """The distinct items of each document's windows."""
    firsts = np.concatenate(([0], w.item_ends[:-1])).astype(np.int64)
    sizes = (w.item_ends - firsts)[found]
    item = w.items[tx.ragged(firsts[found], sizes)]
    doc = np.repeat(doc, sizes)
    by = np.lexsort((item, doc))
    item, doc = item[by], doc[by]
    first = np.ones(len(item), bool)
    first[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=n_docs))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(item[first], pa.int64()))


RESULT_SCHEMA = "segment bigint, place int, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int>>, items array<bigint>, near_items array<bigint>"


def _search(index: DataFrame, w: Windows, slop: int) -> DataFrame:
    """For each document of the index: spans of hit words (last one excluded), items with exact and with proximity matches."""
    shared = index.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name, row=row, batch=batch: batch.column(name)[row]
                doc_ids = cell("doc_ids").values
                ends = cell("token_ends").values.to_numpy().astype(np.int64)
                steps = np.frombuffer(cell("steps").as_py(), np.int32)
                window, start, near, anchor = search_segment(w, cell("terms").values, cell("term_ends").values.to_numpy().astype(np.int64), steps, ends, slop)
                n = len(ends)
                total = int(ends[-1]) if n else 0
                delta = np.zeros(total + 1, np.int64)
                np.add.at(delta, start, 1)
                np.add.at(delta, start + w.lengths[window], -1)
                hit = np.cumsum(delta)[:total] > 0
                doc_first = np.concatenate(([0], ends[:-1])).astype(np.int64)
                begins, stops = hit.copy(), hit.copy()
                begins[1:] &= ~hit[:-1]
                stops[:-1] &= ~hit[1:]
                inner = doc_first[(doc_first > 0) & (doc_first < total)]
                begins[inner] = hit[inner]
                stops[inner - 1] = hit[inner - 1]
                first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                doc = np.searchsorted(ends, first, side="right")
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))), pa.int32())
                spans = pa.StructArray.from_arrays([pa.array(first - doc_first[doc], pa.int32()), pa.array(last - doc_first[doc], pa.int32())], names=["first", "last"])
                exact = _items(w, window, np.searchsorted(ends, start, side="right"), n)
                close = _items(w, near, np.searchsorted(ends, anchor, side="right"), n)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(cell("segment").as_py(), pa.int64()), n), pa.array(np.arange(n), pa.int32()), doc_ids, pa.array(ends - doc_first, pa.int64()), pa.ListArray.from_arrays(offsets, spans), exact, close], names=["segment", "place", "doc_id", "n_words", "spans", "items", "near_items"])
        tx.hand_back()

    return index.mapInArrow(run, RESULT_SCHEMA)


def covered(spans: Column) -> Column:
    """Words in a union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["last"] - F.greatest(x["first"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["last"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def search(index: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact and proximity matches of benchmark items in an index: a row for each document.

    Columns: doc_id, n_words, n_hit (words inside an occurrence of a window), spans (of those words),
    items and near_items (sorted ids of items with an exact, with a proximity match). The benchmark's
    size is measured; beyond ``block_bytes`` it is cut by a hash of the item into blocks that are broadcast
    one after the other, and each document's findings are merged. Items without id or words match nothing.
    """
    bench = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    n_bytes = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    found = None
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        part = _search(index, windows_of([(r["item"], r["text"]) for r in sorted(rows)], size), slop)
        found = part if found is None else found.union(part)
    if blocks > 1:
        flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), flat("items").alias("items"), flat("near_items").alias("near_items"))
    return found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "spans", F.array_sort("items").alias("items"), F.array_sort("near_items").alias("near_items"))


def stored_index(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: Scope | None = None) -> DataFrame:
    """The index as a table in the shared folder, each segment with a number. It lives as long as the scope, if one is given."""
    table = (scope.saved if scope else saved)(build_index(docs, key, text), "postings")
    return table.withColumn("segment", F.monotonically_increasing_id())


def report(docs: DataFrame, benchmark: DataFrame, least_share: int = 20, scope: Scope | None = None) -> DataFrame:
    """For each document: counts, matched items and whether it is contaminated: at least 1/least_share of its words are hit."""
    found = search(stored_index(docs, scope=scope), benchmark)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words")))
