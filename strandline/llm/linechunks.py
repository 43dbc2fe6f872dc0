r"""Line deduplication by content-defined chunks of lines, in DataFrame expressions only.

A text's lines (cut at \n) are hashed. A rolling hash over two line hashes cuts the text into chunks of CHUNK_LINES
lines on average, so boundaries depend on nearby lines alone and survive insertions elsewhere. Since a passage may be too
short to hold a whole chunk, every line also ends a window: the fewest lines that hold over PASSAGE_WORDS words,
WINDOW_LINES at most; any repeated passage of over PASSAGE_WORDS words contains such a window.

Chunks and windows whose hash occurs again tell which two texts have lines in common, and at which shift. The two texts' lines
are compared byte for byte at that shift, beyond the chunk's own edges. A run of equal lines is removed from
the later text if it has over PASSAGE_WORDS words or PASSAGE_LINES lines that aren't blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.work import Scope, released, saved

#: Lines of a chunk on average.
CHUNK_LINES = 4
#: A run of repeated lines goes if it has more words than this, or so many lines with words.
PASSAGE_WORDS = 50
PASSAGE_LINES = 3
WINDOW_LINES = 5
#: Repeated hashes or matches (a few numbers each) and texts' runs that are broadcast at most; more are joined.
BROADCAST_ROWS = 300_000
BROADCAST_SPANS = 100_000


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often lambdas of later columns read them."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", row.alias("_row")).select(*[F.col(c) for c in df.columns], *[F.col(f"_row.{n}").alias(n) for n in columns])


def _words(line: Column) -> Column:
    solid = F.length(F.translate(line, " \t\r\f\x0b", ""))
    return F.when(solid == 0, 0).otherwise(F.length(line) - solid + 1)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every chunk of several lines and every window with words: key, version (a hash of the text), first line, and hash h."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.split(text, "\n", -1).alias("lines"))
    lines = _bound(lines, hashes=F.transform("lines", lambda x: F.xxhash64(x)), words=F.transform("lines", _words), rolled=F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))
    starts = F.expr(f"filter(sequence(0, size(hashes) - 1), i -> i = 0 or (rolled[i - 1] + 31L * coalesce(get(rolled, i - 2), 0L)) % {CHUNK_LINES} = 0)")
    lines = _bound(lines.drop("lines"), starts=starts).drop("rolled")
    back = [" + ".join(f"coalesce(get(words, i - {j}), 0)" for j in range(k)) for k in range(1, WINDOW_LINES)]
    length = "case " + " ".join(f"when {total} > {PASSAGE_WORDS} then {k}" for k, total in enumerate(back, 1)) + f" else {WINDOW_LINES} end"
    some = "exists(slice(words, first + 1, n), w -> w > 0)"
    windows = f"transform(sequence(0, size(words) - 1), i -> named_struct('first', i + 1 - {length}, 'n', {length}))"
    chunks = "transform(starts, (s, k) -> named_struct('first', s, 'n', coalesce(get(starts, k + 1), size(words)) - s))"
    pieces = F.expr(f"filter(concat({windows}, filter({chunks}, c -> c.n > 1)), p -> p.first >= 0)")
    found = lines.select("key", "version", "hashes", "words", F.explode(pieces).alias("p")).select("key", "version", "hashes", "words", "p.first", "p.n")
    return found.where(some).select("key", "version", "first", F.expr("xxhash64(n, slice(hashes, first + 1, n))").alias("h"))


def matches(marks: DataFrame, scope: Scope) -> DataFrame:
    """Of fingerprints, the texts with lines in common and how far they are shifted: key, version, key0, version0, shift.

    A chunk or window that stands earlier in the same text is matched with its last place there, any other with the first
    place of all, in order of key, version and line; nulls sort first among keys. Hashes are counted first, and only repeated ones keep their places.
    """
    again = scope.saved(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-hashes")
    found = scope.saved(marks.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "h", "left_semi").distinct(), "repeated-places")
    own = Window.partitionBy("h", "key", "version").orderBy("first")
    found = found.withColumn("before", F.lag("first").over(own))
    inside = found.where("before is not null").select("key", "version", F.col("key").alias("key0"), F.col("version").alias("version0"), (F.col("first") - F.col("before")).alias("shift"))
    heads = found.where("before is null")
    low = scope.saved(heads.groupBy("h").agg(F.min(F.struct("key", "version", "first")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "low"), "first-places")
    heads = heads.join(F.broadcast(low) if low.count() <= BROADCAST_ROWS else low, "h").where("not (key <=> low.key and version = low.version)")
    across = heads.select("key", "version", F.col("low.key").alias("key0"), F.col("low.version").alias("version0"), (F.col("first") - F.col("low.first")).alias("shift"))
    return inside.union(across).distinct()


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each text that has some: key, version and the runs of lines (first, last) to remove."""
    with Scope(docs.sparkSession) as scope:
        marks = scope.saved(fingerprints(docs, key, text), "fingerprints")
        pairs = scope.saved(matches(marks, scope), "matches")
        few = pairs.count() <= BROADCAST_ROWS
        small = lambda df: F.broadcast(df) if few else df
        texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
        same = lambda a, b: (a["key"].eqNullSafe(b["k"])) & (a["version"] == b["v"])
        wanted = pairs.select(F.col("key0").alias("k"), F.col("version0").alias("v")).distinct()
        scope.dropped(marks)
        released(docs.sparkSession)
        first = scope.saved(texts.join(small(wanted), same(texts, wanted), "left_semi").dropDuplicates(["key", "version"]).select(F.col("key").alias("k"), F.col("version").alias("v"), F.col("text").alias("text0")), "first-texts")
        asked = pairs.select(F.col("key").alias("k"), F.col("version").alias("v"), "key0", "version0", "shift")
        left = texts.join(small(asked), same(texts, asked)).select("key", "version", "text", "key0", "version0", "shift")
        both = left.join(first, left["key0"].eqNullSafe(first["k"]) & (left["version0"] == first["v"]))
        both = _bound(both.select("key", "version", "key0", "version0", "shift", F.split("text", "\n", -1).alias("lines"), F.split("text0", "\n", -1).alias("lines0")), low=F.expr("greatest(0, shift)"), high=F.expr("least(size(lines), size(lines0) + shift) - 1"))
        equal = F.expr("filter(sequence(low, high), i -> lines[i] = lines0[i - shift])")
        lines = both.where("high >= low").select("key", "version", "key0", "version0", "shift", "lines", F.posexplode(equal).alias("k", "line"))
        lines = lines.select("key", "version", "key0", "version0", "shift", "line", (F.col("line") - F.col("k")).alias("run"), _words(F.col("lines")[F.col("line")]).alias("words"))
        runs = lines.groupBy("key", "version", "key0", "version0", "shift", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("words").alias("words"), F.count(F.when(F.col("words") > 0, 1)).alias("lines"))
        runs = runs.where(f"words > {PASSAGE_WORDS} or lines >= {PASSAGE_LINES}")
        spans = saved(runs.groupBy("key", "version").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")), "spans")
    released(docs.sparkSession)
    return spans


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "n_removed_lines") -> DataFrame:
    """docs with repeated runs of lines taken out of their text, and the number of lines removed.

    Of copies the one in the smallest key stays, so every line stays somewhere. A null text stays null and an empty one empty;
    a text of which every line goes becomes empty. Rows equal in key and text are one text and are treated
    alike. A column named as ``removed`` is replaced.
    """
    names = [c for c in docs.columns if c != removed]
    found = repeated(docs, key, text)
    spans = found.select(F.col("key").alias("_key"), F.col("version").alias("_version"), F.col("spans").alias("_spans"))
    rows = docs.select(*[F.col(c) for c in names], F.xxhash64(text).alias("_hash"))
    rows = rows.join(F.broadcast(spans) if found.count() <= BROADCAST_SPANS else spans, rows[key].eqNullSafe(spans["_key"]) & (rows["_hash"] == spans["_version"]), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("_spans", lambda s: (i >= s["first"]) & (i <= s["last"])))
    some = F.col("_spans").isNotNull()
    rows = _bound(rows, _kept=F.when(some, kept))
    new = {text: F.when(some, F.array_join("_kept", "\n")).otherwise(F.col(text)), removed: F.when(some, F.size(lines) - F.size("_kept")).otherwise(0).cast("long")}
    return rows.select(*[new[c].alias(c) if c == text else F.col(c) for c in names], new[removed].alias(removed))


_TOTALS = [" + ".join(["words", *(f"coalesce(lag(words, {j}) OVER w, 0)" for j in range(1, k))]) for k in range(1, WINDOW_LINES)]
#: The same in DuckDB, over documents(doc_id, text) with distinct doc_ids; {docs} is the table's name.
SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {{docs}} WHERE text IS NOT NULL),
s AS (SELECT *, length(translate(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11), '')) AS solid, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
t AS (SELECT doc_id, i, line, h, CASE WHEN solid = 0 THEN 0 ELSE length(line) - solid + 1 END AS words FROM s),
b AS (SELECT *, list(line) OVER w AS lines, CASE {" ".join(f"WHEN {x} > {PASSAGE_WORDS} THEN {k}" for k, x in enumerate(_TOTALS, 1))} ELSE {WINDOW_LINES} END AS n,
        i = 0 OR (lag(h) OVER w + 31 * coalesce(lag(h, 2) OVER w, 0)) % {CHUNK_LINES} = 0 AS begins
      FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW_LINES - 1} PRECEDING AND CURRENT ROW)),
c AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM b),
f AS (SELECT doc_id, i + 1 - n AS first, n, lines[len(lines) - n + 1:] AS piece FROM c WHERE i + 1 >= n
      UNION SELECT doc_id, min(i), count(*), list(line ORDER BY i) FROM c GROUP BY doc_id, chunk HAVING count(*) > 1),
p AS (SELECT doc_id, first, lag(first) OVER (PARTITION BY doc_id, piece ORDER BY first) AS before, first_value(doc_id) OVER o AS d0, first_value(first) OVER o AS f0
      FROM f WHERE translate(array_to_string(piece, ''), ' ' || chr(9) || chr(13) || chr(12) || chr(11), '') <> '' WINDOW o AS (PARTITION BY piece ORDER BY doc_id, first)),
m AS (SELECT DISTINCT doc_id, CASE WHEN before IS NULL THEN d0 ELSE doc_id END AS doc0, first - coalesce(before, f0) AS shift FROM p WHERE before IS NOT NULL OR d0 <> doc_id),
e AS (SELECT m.*, a.i, a.words, a.i - row_number() OVER (PARTITION BY m.doc_id, m.doc0, m.shift ORDER BY a.i) AS run
      FROM m JOIN t a ON a.doc_id = m.doc_id JOIN t z ON z.doc_id = m.doc0 AND z.i = a.i - m.shift AND z.line = a.line),
r AS (SELECT doc_id, min(i) AS first, max(i) AS last FROM e GROUP BY doc_id, doc0, shift, run HAVING sum(words) > {PASSAGE_WORDS} OR count(*) FILTER (WHERE words > 0) >= {PASSAGE_LINES}),
gone AS (SELECT DISTINCT t.doc_id, i FROM t JOIN r ON r.doc_id = t.doc_id AND i BETWEEN first AND last),
kept AS (SELECT t.doc_id, count(gone.i) AS n_removed_lines, string_agg(line, chr(10) ORDER BY t.i) FILTER (WHERE gone.i IS NULL) AS text
         FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(kept.n_removed_lines, 0)::BIGINT AS n_removed_lines
FROM {{docs}} d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
