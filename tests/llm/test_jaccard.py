import random
import re

import numpy as np

from strandline.llm import jaccard as j

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    s = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            common = len(s[a] & s[b])
            if s[a] and s[b] and 100 * common >= 75 * (len(s[a]) + len(s[b]) - common):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s[k]), least[root(k)] if s[k] else i) for k, (i, _) in enumerate(docs))


def made(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    docs = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (1005, "one two"), (1006, "one two three four five")]
    for base in range(8):
        text = [word() for _ in range(rng.randrange(30, 120))]
        for copy in range(rng.choice([1, 2, 3, 30, 40])):
            t = list(text)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = word()
            docs.append((len(docs), " ".join(t)))
    passage = " ".join(word() for _ in range(60))
    docs += [(2000 + k, passage + " " + " ".join(word() for _ in range(15))) for k in range(25)]
    return docs


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(j, "TILE", 16)
    monkeypatch.setattr(j, "COLUMNS", 64)
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as class", "2 as size", "3 as component", "4 as key")
    got = sorted((r.doc_id, r.n_shingles, r.component) for r in j.groups(df.repartition(5)).collect())
    assert got == brute(docs)


def test_repeated_and_null_keys(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text), (None, None), (7, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component) for r in j.groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (None, None), (3, 3), (None, None), (7, 7)], key=str)
    assert j.groups(df.limit(0)).count() == 0


def test_product_of_blocks():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    rows = [np.unique(np.concatenate((base[rng.random(80) < 0.93], rng.integers(0, 1 << 60, 3, dtype=np.uint64)))) for _ in range(30)]
    rows += [rng.integers(0, 1 << 60, 70, dtype=np.uint64) for _ in range(5)] + [np.unique(np.concatenate((base[:3], rng.integers(0, 1 << 60, 70, dtype=np.uint64))))]
    size = np.array([len(x) for x in rows])
    stored = [np.sort(x)[: j._stored(len(x), 75)] for x in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(np.intersect1d(rows[a], rows[b])) >= 75 * len(np.union1d(rows[a], rows[b]))}
    x, y = j.tile_pairs(stored, None, size, None, 75)
    got = set(zip(x.tolist(), y.tolist(), strict=True))
    assert want and want <= got and max(map(max, got)) < 30
    x, y = j.tile_pairs(stored[:10], stored[10:], size[:10], size[10:], 75)
    assert {(a, b + 10) for a, b in zip(x.tolist(), y.tolist(), strict=True)} == {(b, a) for a, b in got if a >= 10 > b}


def test_groups_whose_centre_links_with_nothing(spark, monkeypatch):
    """Rounds of forests and refuted pairs end with every link found."""
    monkeypatch.setattr(j, "TILE", 8)
    for rounds, few in ((0, 0), (3, 0), (3, 4)):
        monkeypatch.setattr(j, "FOREST_ROUNDS", rounds)
        monkeypatch.setattr(j, "FEW_PAIRS", few)
        rng = random.Random(3)
        core = [f"c{k}" for k in range(40)]
        docs = [(0, " ".join(core + [f"z{k}" for k in range(40)]))]
        for k in range(40):
            own = [f"f{k % 4}x{i}" for i in range(25)]
            t = core + own
            for _ in range(k % 3):
                t[rng.randrange(len(t))] = f"n{rng.randrange(1000)}"
            docs.append((k + 1, " ".join(t)))
        got = sorted((r.doc_id, r.n_shingles, r.component) for r in j.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect())
        assert got == brute(docs)
