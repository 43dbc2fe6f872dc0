"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row is its set of distinct word n-grams (64-bit hashes). Only the entries that a
size-derived bound leaves are stored: of a set of n, two documents of similarity t share one of the
first n - ceil(t n) + 1 entries in any common order, so the columns' other entries can't be the first
in common. The order puts very frequent n-grams last. The product's blocks are the columns (Spark's
shuffle deals them out); their overlap counts are summed per pair and pairs below the bounds that sizes
give are discarded before whole sets are compared.

Equal sets are one class from the start. The product is taken in rounds, so that groups of many near
copies cost no more than their members:

1. every class against the central rows of its columns; what links is one component from then on;
2. pairs of different components that share columns but no group, and pairs within small groups;
3. pairs of different components within large groups (classes around one central row), as matrix tiles that
   give what may link, or a spanning forest of it where that is much; repeated until no pair is left that isn't
   linked or refuted.

Pairs inside one component need no comparison. No link between components is lost.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import text as tx
from strandline.llm.graph import components
from strandline.llm.work import Scope, released, saved, small_batches

NGRAM = 5
#: Similarity in percent from which documents link.
PERCENT = 75
#: N-grams that stand in this many documents of one chunk are counted over all chunks; the HOT_NGRAMS most frequent come last in the order.
LOCAL_FREQUENCY = 4
HOT_NGRAMS = 200_000
#: Bits of the filter that tells which documents' sets are needed again; when more are needed it lets more pass.
FILTER_BITS = 24
#: Groups of more classes than this are multiplied as matrix tiles; classes and stored entries that a tile holds about; columns multiplied at once.
GROUP_FROM = 8
TILE = 512
TILE_ENTRIES = 500_000
COLUMNS = 4096
#: A tile gives all its pairs if they are at most so many a class, else a forest; after the rounds of forests every pair that is left.
FEW_PAIRS = 4
FOREST_ROUNDS = 3
#: Rows of pairs, classes or group members (a few numbers each), and bytes of sets, that are broadcast at most; more are joined.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 32 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def sets(texts: pa.Array, n: int = NGRAM) -> list[np.ndarray]:
    """Each text's distinct n-gram hashes, ascending; fewer words make one entry, no words none."""
    ids, terms, ends = tx.encoded(texts, tx.NON_SPACE)
    word = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))[ids]
    size = len(word) - n + 1
    if size > 0:
        grams = word[:size].copy()
        for k in range(1, n):
            grams *= _P
            grams += word[k : k + size]
        grams = tx.spread(grams)
    out, start = [], 0
    for end in ends.tolist():
        count = end - start
        if count >= n:
            out.append(np.unique(grams[start : end - n + 1]))
        elif count:
            whole = np.uint64(count)
            for x in word[start:end]:
                with np.errstate(over="ignore"):
                    whole = whole * _P + x
            out.append(tx.spread(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def _class(entries: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(entries.tobytes()) - (1 << 63)


def frequent(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """At most HOT_NGRAMS n-grams that stand in many documents, the most frequent ones; counted over all documents."""

    def run(batches):
        for part in tx.chunks(batches, text):
            found = sets(part.column(text), n)
            entries, count = np.unique(np.concatenate(found), return_counts=True)
            many = count >= LOCAL_FREQUENCY
            yield pa.RecordBatch.from_arrays([pa.array(entries[many].view(np.int64)), pa.array(count[many])], names=["gram", "n"])

    top = docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(HOT_NGRAMS)
    return np.sort(top.select("gram").toArrow().column(0).to_numpy().view(np.uint64))


def sketch(entries: np.ndarray) -> np.ndarray | None:
    """How many of a set's entries have each combination of leading bits, with two to four counters an entry; None if one exceeds a byte."""
    bits = max(6, int(len(entries)).bit_length() + 1)
    counts = np.bincount((entries >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8) if counts.max() < 256 else None


def ruled_out(x: bytes | None, y: bytes | None, size_x: int, size_y: int, percent: int) -> bool:
    """Whether the sketches of two sets prove that they have too little in common: the smaller counts bound that."""
    if x is None or y is None:
        return False
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(axis=1)
    return (100 + percent) * int(np.minimum(x, y).sum()) < percent * (size_x + size_y)


def incidence(docs: DataFrame, key: str, text: str, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """For each document: key, size, class (equal for equal sets), the entries of its set that can be first in
    common, in order, how many of them aren't frequent, and its sketch. Of copies in a chunk one has entries and sketch, the others null."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot = shared.value
        for part in tx.chunks(batches, text):
            size, classes, entries, early, sketches, seen = [], [], [], [], [], set()
            for found in sets(part.column(text), n):
                k = len(found)
                c = _class(found)
                size.append(k)
                classes.append(c)
                if not k or c in seen:
                    entries.append(None)
                    early.append(0)
                    sketches.append(None)
                    continue
                seen.add(c)
                at = np.minimum(np.searchsorted(hot, found), max(len(hot) - 1, 0))
                late = hot[at] == found if len(hot) else np.zeros(k, bool)
                first = _stored(k, percent)
                entries.append(np.concatenate((found[~late], found[late]))[:first].view(np.int64))
                early.append(min(first, k - int(late.sum())))
                counts = sketch(found)
                sketches.append(None if counts is None else counts.tobytes())
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(size, pa.int64()), pa.array(classes, pa.int64()), pa.array(entries, pa.list_(pa.int64())), pa.array(early, pa.int32()), pa.array(sketches, pa.binary())], names=["key", "size", "class", "entries", "early", "sketch"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "key bigint, size bigint, class bigint, entries array<bigint>, early int, sketch binary")


def _stored(size: int, percent: int) -> int:
    """How many entries of a set of this size are stored."""
    return size - -(-percent * size // 100) + 1


def _enough(percent: int, overlap: str = "overlap") -> str:
    """SQL condition: this many common stored entries don't rule the pair out.

    All common entries up to the end of the stored ones of one of both sets are counted; of that set
    ceil(percent / 100 size) - 1 entries follow.
    """
    rest = f"ceil({percent} * greatest(size_a, size_b) / 100) - 1"
    return f"{100 + percent} * ({overlap} + {rest}) >= {percent} * (size_a + size_b) and 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit set of fixed size with the hashes of all ids (column id)."""
    bit = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("bit"))
    words = bit.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets_of(docs: DataFrame, key: str, text: str, n: int, chosen: DataFrame, few: bool) -> DataFrame:
    """Whole sets (class, entries) of chosen documents (class, key), made again from the texts.

    Few documents are picked by a broadcast join; of many, a filter picks those whose texts are split, and a join drops what it let pass.
    """
    spark = docs.sparkSession
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), text)
    if few:
        base, shared = base.join(F.broadcast(chosen.select("key")), "key", "left_semi").withColumn("bit", F.lit(0)), None
    else:
        shared = spark.sparkContext.broadcast(_filter_of(chosen.select(F.col("key").alias("id"))))
        base = base.withColumn("bit", F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS)).cast("int"))

    def run(batches):
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(shared.value[batch.column("bit").to_numpy()]))
            for part in tx.chunks([batch], text):
                found = [(k, _class(x), x.tobytes()) for k, x in zip(part.column("key").to_pylist(), sets(part.column(text), n), strict=True) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], names=["key", "class", "entries"])

    made = base.mapInArrow(run, "key bigint, class bigint, entries binary")
    return made.join(F.broadcast(chosen) if few else chosen, ["key", "class"], "left_semi").select("class", "entries")


def _bounded(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their sketches (class, size, sketch) don't rule out; a few bytes an entry decide instead of whole sets."""

    def run(batches):
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("left", "right", "size_a", "size_b")]
            keep = pa.array([not ruled_out(*row, percent) for row in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    few = pairs.count() <= BROADCAST_ROWS
    pairs0, sketches_of = pairs, sketches
    for side, name in (("a", "left"), ("b", "right")):
        if few:  # only the sketches asked for move
            sketches_of = sketches.join(F.broadcast(pairs0.select(F.col(side).alias("class")).distinct()), "class", "left_semi")
        pairs = sketches_of.select(F.col("class").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(name)).join(F.broadcast(pairs) if few and side == "a" else pairs, side)
    return pairs.select("a", "b", "left", "right", "size_a", "size_b").mapInArrow(run, "a bigint, b bigint")


def _verified(docs: DataFrame, key: str, text: str, n: int, percent: int, classes: DataFrame, pairs: DataFrame, scope: Scope) -> DataFrame:
    """Candidate pairs (a, b) of classes with whether their whole sets are similar enough (linked).

    classes: class, size and the key of one document. If pairs are few, the set of a stays where it is made; if those of all b together
    are small, every task has them and only the sets of a are written, else the sets meet in a join that isn't written. So a set
    moves once for each pair at most. One row of a class is used, so repeated keys do no harm.
    """
    spark = docs.sparkSession
    few = pairs.count() <= BROADCAST_ROWS
    asked = lambda side: F.broadcast(pairs.select(F.col(side).alias("class"))) if few else pairs.select(F.col(side).alias("class")).distinct()
    left, right = (classes.select("class", "size", "key").join(asked(side), "class", "left_semi") for side in "ab")
    light = 8 * (right.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_BYTES
    right_sets = _sets_of(docs, key, text, n, right.select("class", "key"), few).select(F.col("class").alias("b"), F.col("entries").alias("right"))
    left_sets = _sets_of(docs, key, text, n, left.select("class", "key"), few).select(F.col("class").alias("a"), F.col("entries").alias("left"))
    sided = left_sets.join(F.broadcast(pairs) if few else pairs, "a").select("a", "b", "left")

    def similar(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * common >= percent * (len(x) + len(y) - common)

    def rows(batch, linked):
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    out = "a bigint, b bigint, linked boolean"
    if light:
        found = right_sets.toArrow()
        shared = spark.sparkContext.broadcast(dict(zip(found.column("b").to_pylist(), found.column("right").to_pylist(), strict=True)))

        def against_shared(batches):
            for batch in batches:
                batch = batch.filter(pa.array([b in shared.value for b in batch.column("b").to_pylist()], pa.bool_()))
                yield rows(batch, [similar(x.as_buffer(), shared.value[b]) for x, b in zip(batch.column("left"), batch.column("b").to_pylist(), strict=True)])

        # written first, so that a task needs one Python worker at a time
        return scope.saved(sided, "left-sets", codec="lz4").mapInArrow(against_shared, out)

    def against_joined(batches):
        for batch in batches:
            yield rows(batch, [similar(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("left"), batch.column("right"), strict=True)])

    return sided.join(right_sets, "b").select("a", "b", "left", "right").mapInArrow(against_joined, out)


def tile_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, size_left: np.ndarray, size_right: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles (of one tile with itself if right is None) whose stored entries don't rule them out, by a blocked product.

    Columns that stand in one row alone can't add to a pair and are left out; the others are multiplied COLUMNS at a time.
    """
    both = left + (right or [])
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    n = len(left)
    overlap = np.zeros((n, len(both) - n if right is not None else n), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        block = np.zeros((len(both), min(COLUMNS, int(column[hi - 1]) + 1 - at)), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        overlap += block[:n] @ (block[n:] if right is not None else block).T
    a, b = size_left[:, None], (size_right if right is not None else size_left)[None, :]
    rest = -(-percent * np.maximum(a, b) // 100) - 1
    near = (overlap > 0) & ((100 + percent) * (overlap.astype(np.int64) + rest) >= percent * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    if right is None:
        near &= np.tri(n, k=-1, dtype=bool)
    return np.nonzero(near)


def _group_pairs(packed: DataFrame, sketches: DataFrame, large: DataFrame, labels: DataFrame, refuted: DataFrame | None, percent: int, whole: bool, scope: Scope) -> DataFrame:
    """Pairs (a, b, group, more) of different components within large groups that their stored entries don't rule out.

    The classes of a group's most frequent component needn't meet each other. The others, and those against them, are dealt to tiles
    of about TILE classes or TILE_ENTRIES entries; a task holds two tiles. Unless whole, a task gives all its pairs if they are few, else
    a spanning forest of them (more is true then), so that its rows are in proportion to its classes. Refuted pairs are left out.
    """
    hint = F.broadcast if large.count() <= BROADCAST_ROWS else lambda groups: groups  # there are fewer groups than classes
    labelled = large.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    counts = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("group").agg(F.max(F.struct("n", "label"))["label"].alias("major"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = labelled.join(hint(major), "group").withColumn("minor", F.col("label") != F.col("major"))
    tiles = lambda minor: F.ceil(F.greatest(F.count(F.when(F.col("minor") == minor, 1)) / TILE, F.coalesce(F.sum(F.when(F.col("minor") == minor, F.col("stored"))), F.lit(0)) / TILE_ENTRIES)).cast("int")
    grid = rows.groupBy("group").agg(tiles(True).alias("minors"), tiles(False).alias("majors"), ((F.count(F.lit(1)) <= TILE) & (F.sum("stored") <= TILE_ENTRIES)).alias("one"))
    dealt = rows.join(hint(grid), "group").withColumns({"minor": F.col("minor") | F.col("one"), "majors": F.when(F.col("one"), 0).otherwise(F.col("majors"))}).withColumn("tile", F.when(F.col("minor"), F.pmod(F.xxhash64("class"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("class"), F.col("majors"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1))
    dealt = dealt.select("class", "label", "group", "tile", other.alias("other")).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other")
    dealt = scope.saved(dealt, "dealt")

    def run(table: pa.Table) -> pa.Table:
        def out(a: np.ndarray, b: np.ndarray, more: bool) -> pa.Table:
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "group": pa.repeat(table.column("group")[0], len(a)), "more": pa.repeat(pa.scalar(more), len(a))})

        tile, i, j = table.column("tile").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, label, size = (table.column(c).to_numpy() for c in ("class", "label", "size"))
        found = [x.values.to_numpy() for x in table.column("entries")]
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        if not len(left) or not len(right):
            return out(ids[:0], ids[:0], False)
        x, y = tile_pairs([found[k] for k in left], None if i == j else [found[k] for k in right], size[left], None if i == j else size[right], percent)
        a, b = left[x], (left if i == j else right)[y]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        drawn = table.column("sketch").to_pylist()
        close = np.fromiter((not ruled_out(drawn[c], drawn[d], int(size[c]), int(size[d]), percent) for c, d in zip(a, b, strict=True)), bool, len(a))
        a, b = a[close], b[close]
        known = {(c, d) for c, near in zip(ids, table.column("refuted"), strict=True) for d in near.as_py() or ()}
        if known:
            fresh = np.fromiter(((int(c), int(d)) not in known and (int(d), int(c)) not in known for c, d in zip(ids[a], ids[b], strict=True)), bool, len(a))
            a, b = a[fresh], b[fresh]
        more = not whole and len(a) > FEW_PAIRS * (len(left) + len(right))
        if more:
            # classes of one component are one node of the forest
            up: dict[int, int] = {}

            def root(v: int) -> int:
                while up.setdefault(v, v) != v:
                    up[v] = v = up[up[v]]
                return v

            tree = []
            for k, (c, d) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
                c, d = root(c), root(d)
                if c != d:
                    up[c] = d
                    tree.append(k)
            a, b = a[tree], b[tree]
        return out(ids[a], ids[b], more)

    few = dealt.count() <= BROADCAST_ROWS
    own = lambda table: table.join(F.broadcast(dealt.select("class")), "class", "left_semi") if few else table
    cells = dealt.join(own(packed.select("class", "size", "entries")), "class").join(own(sketches.select("class", "sketch")), "class")
    if refuted is None:
        cells = cells.withColumn("refuted", F.array().cast("array<bigint>"))
    else:
        cells = cells.join(refuted.groupBy(F.col("a").alias("class")).agg(F.collect_set("b").alias("refuted")), "class", "left")
    return cells.groupBy("group", "i", "j").applyInArrow(run, "a bigint, b bigint, group bigint, more boolean")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """For each row of docs: key, n_shingles (set size) and component (smallest key reachable by links).

    Two rows link when 100 * intersection >= percent * union of their sets. Keys are integers. A row without words links with
    nothing and is its own component; so is a row with a null key, whose component is null. Rows that share
    a key are rows of their own; repeated rows are copies of each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(key, text)
    with Scope(spark) as scope:
        stored = scope.saved(incidence(docs, key, text, n, percent, frequent(docs, text, n)), "incidence", codec="lz4")
        rows = saved(stored.select("key", "size", "class"), "classes")
        # of copies in several chunks the one with the smallest key brings the entries
        first = stored.where("entries is not null").groupBy("class").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("class", "first")
        first = _small(scope.saved(first, "first-keys"))
        again = scope.saved(stored.where("entries is not null").select("class", "key").join(first, "class").where("not key <=> first").select("class", "key"), "again")
        mark = _small(again).select(F.col("class").alias("_class"), F.col("key").alias("_key"))
        once = stored.where("entries is not null").join(mark, (F.col("class") == F.col("_class")) & F.col("key").eqNullSafe(F.col("_key")), "left_anti")
        each = once.select("class", "size", "early", F.posexplode("entries").alias("rank", "gram"))
        sketches = scope.saved(once.select("class", "size", "sketch"), "sketches")
        # frequent n-grams are known to stand in several documents; of the others, columns of one class give no pair
        column = Window.partitionBy("gram")
        rare = each.where("rank < early").select("gram", "class", "size", F.min("class").over(column).alias("low"), F.max("class").over(column).alias("high")).where("low <> high")
        entries = rare.select("class", "size", "gram").union(each.where("rank >= early").select("class", "size", "gram"))
        packed = scope.saved(entries.groupBy("class", "size").agg(F.collect_set("gram").alias("entries")), "packed", codec="lz4")
        scope.dropped(stored)
        released(spark)

        # a column's pivot: the row with most of its set in common with others (of copies, the original); a row's group: the pivot it meets most often
        single = packed.select("class", "size", (F.size("entries") / F.col("size")).alias("met"), F.size("entries").alias("stored"), F.explode("entries").alias("gram"))
        pivots = single.groupBy("gram").agg(F.max(F.struct("met", F.xxhash64("class").alias("h"), F.col("class").alias("pivot"), F.col("size").alias("pivot_size"))).alias("p")).select("gram", "p.pivot", "p.pivot_size")
        met = scope.saved(single.select("gram", "class", "size", "stored").join(pivots, "gram").groupBy("class", "size", "stored", "pivot", "pivot_size").agg(F.count(F.lit(1)).alias("overlap")), "met")
        released(spark)
        members = scope.saved(met.groupBy("class", "stored").agg(F.max_by("pivot", F.struct("overlap", "pivot")).alias("group")), "members")
        large = members.groupBy("group").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP_FROM).select("group")
        large = scope.saved(members.join(large, "group"), "large-groups")
        chosen = scope.saved(rows.where("key is not null and size > 0").groupBy("class", "size").agg(F.min("key").alias("key")), "representatives")
        stars = met.where("class <> pivot").withColumnsRenamed({"class": "a", "pivot": "b", "size": "size_a", "pivot_size": "size_b"}).where(_enough(percent)).select("a", "b")
        released(spark)

        def verified(pairs: DataFrame) -> DataFrame:
            return scope.saved(_verified(docs, key, text, n, percent, chosen, pairs, scope), "verified")

        done = [verified(scope.saved(_bounded(scope.saved(stars, "stars"), sketches, percent), "stars"))]
        labels = scope.saved(components(done[0].where("linked").select("a", "b")), "labels").select(F.col("node").alias("class"), F.col("component").alias("label"))
        released(spark)

        marks = members.join(_small(labels), "class", "left").join(_small(large.select("class", F.lit(True).alias("large"))), "class", "left").select("class", F.coalesce("label", "class").alias("label"), F.when(F.col("large"), F.col("group")).alias("group"))
        cells = packed.join(_small(scope.saved(marks, "marks")), "class").select("class", "size", "label", "group", F.explode("entries").alias("gram"))
        many = cells.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.coalesce("group", "class")).alias("g"), F.max(F.coalesce("group", "class")).alias("h")).where("low <> high and g <> h").select("gram")
        cells = scope.saved(cells.join(many, "gram", "left_semi"), "cells", codec="lz4")
        x, y = (cells.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "size", "label", "group")]) for s in "ab")
        pairs = x.join(y, "gram").where(f"class_a < class_b and label_a <> label_b and not coalesce(group_a = group_b, false) and 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
        pairs = scope.saved(pairs.groupBy(F.col("class_a").alias("a"), F.col("class_b").alias("b")).agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.count(F.lit(1)).alias("overlap")).where(_enough(percent)).select("a", "b"), "across")
        inside = scope.saved(_group_pairs(packed, sketches, large, labels, None, percent, False, scope), "inside")
        pairs = scope.saved(_bounded(pairs, sketches, percent).union(inside.select("a", "b")).distinct(), "pairs")
        scope.dropped(cells)
        released(spark)
        step = 0
        while pairs.head(1):
            done.append(verified(pairs))
            found = functools.reduce(DataFrame.union, done)
            labels = scope.saved(components(found.where("linked").select("a", "b")), "labels").select(F.col("node").alias("class"), F.col("component").alias("label"))
            released(spark)
            step += 1
            large = scope.saved(large.join(_small(scope.saved(inside.where("more").select("group").distinct(), "unfinished")), "group", "left_semi"), "large-groups")
            if not large.head(1):
                break
            inside = scope.saved(_group_pairs(packed, sketches, large, labels, found.where("not linked"), percent, step > FOREST_ROUNDS, scope), "inside")
            pairs = scope.saved(inside.select("a", "b").distinct(), "pairs")
        return _rows_out(rows, saved(labels, "component-labels"), key)


def _rows_out(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Each row (key, size, class) with its component's smallest key.

    Only classes with copies or links are looked up, by a broadcast if they are few; other rows are their own component.
    """
    classes = rows.where("size > 0 and key is not null").groupBy("class").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    labelled = classes.join(labels, "class", "left").where("n > 1 or label is not null").select("class", "least", F.coalesce("label", "class").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    touched = saved(labelled.join(least, "label").select("class", "component"), "touched")
    out = rows.join(_small(touched), "class", "left")
    linked = (F.col("size") > 0) & F.col("key").isNotNull() & F.col("component").isNotNull()
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("key")).alias("component"))
