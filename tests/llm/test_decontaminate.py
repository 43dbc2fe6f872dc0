import re

from strandline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    found |= s
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


PHRASE = "The quick brown fox jumps over the lazy dog while seven wise owls watch closely"
DOCS = [
    (1, f"Lead in. {PHRASE.upper()} and out"), (2, None), (3, ""), (4, "...!"), (5, PHRASE.replace("fox", "cat")), (6, "short item"), (7, "short short item item"),
    (8, " ".join(["filler"] * 3000) + " " + PHRASE), (1, "same key other text"), (9, "aa aa aa aa"), (9, "aa aa aa aa"), (None, PHRASE), (10, "é日本 x1"), (11, PHRASE + " " + PHRASE),
]
ITEMS = [(1, PHRASE), (2, "Short, item"), (3, None), (4, ""), (5, "aa aa"), (None, "filler filler"), (6, "É日本"), (7, PHRASE), (1, "x1")]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as segment", "'x' as items")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def key(rows):
    return sorted(rows, key=str)


def test_equals_brute_force(spark):
    docs, items = frames(spark)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in d.search(d.stored_index(docs), items).collect()]
    assert key(got) == key(brute(DOCS, ITEMS))


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, items = frames(spark)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in d.search(d.stored_index(docs), items, block_bytes=40).collect()]
    assert key(got) == key(brute(DOCS, ITEMS))


def test_proximity_finds_reordered_words(spark):
    docs = spark.createDataFrame([(1, "owls seven wise watch"), (2, "seven " + "x " * 30 + "wise owls")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "seven wise owls")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in d.search(d.stored_index(docs), items).collect()}
    assert got == {1: ([], [1]), 2: ([], [])}


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert d.report(docs.limit(0), items).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in d.report(docs, items.limit(0)).collect())
