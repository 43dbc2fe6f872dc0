import random

import duckdb

from strandline.llm import linechunks as c

PASSAGE = [f"shared line {k} of the passage" for k in range(6)]
LONG = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (1, "\n".join(["start one", *PASSAGE, "end one"])), (2, "\n".join(["another start", "more", *PASSAGE, "tail two"])), (3, None), (4, ""), (5, "single"), (6, "single"),
    (7, "a\n\n\nb"), (8, f"x\n{LONG}\ny"), (9, f"p\nq\n{LONG}"), (10, "\n".join(PASSAGE)), (11, "\n".join(f"line {k}" for k in range(3000))), (12, "one\ntwo\none\ntwo\none\ntwo"),
]


def test_equals_sql(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed_lines) for r in c.deduplicated(docs).collect())
    con = duckdb.connect()
    con.execute("create table docs (doc_id bigint, text varchar)")
    con.executemany("insert into docs values (?, ?)", DOCS)
    assert got == sorted(con.execute("select doc_id, text, n_removed_lines from (" + c.SQL.format(docs="docs") + ")").fetchall())


def texts_of(spark, rows):
    return {r.doc_id: r.text for r in c.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_repeated_passage_goes_but_the_first_stays(spark):
    got = texts_of(spark, DOCS)
    assert got[1] == DOCS[0][1] and got[5] == got[6] == "single"
    assert not any(line in got[2].split("\n") for line in PASSAGE)
    assert LONG in got[8] and LONG not in got[9]


def test_lines_that_never_stand_together_elsewhere_stay(spark):
    rows = []
    for k in range(12):
        a, b = f"alpha {k} said this once before", f"beta {k} answered it in other words"
        rows += [(3 * k, f"{a}\nown {k}"), (3 * k + 1, f"own too {k}\n{b}"), (3 * k + 2, f"{a}\n{b}")]
    assert texts_of(spark, rows) == dict(rows)


def test_every_copy_of_a_passage_of_over_fifty_words_goes_whole(spark):
    rng, rows, passages = random.Random(4), [], []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for lines, size in ((1, 60), (2, 30), (3, 20), (4, 15), (6, 9), (12, 5), (26, 2)):
        passages.append("\n".join(" ".join(word() for _ in range(size)) for _ in range(lines)))
    own = lambda: [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
    for k in range(6 * len(passages)):
        before, after = own(), own()
        rows.append((k, "\n".join([*before, passages[k % len(passages)], *after]), "\n".join([*before, *after])))
    got = texts_of(spark, [r[:2] for r in rows])
    for k, whole, rest in rows:
        assert got[k] == (whole if k < len(passages) else rest)


def test_equals_a_search_for_repeated_passages_by_definition(spark):
    """Of random texts over few lines, every line that goes stands in an earlier text or earlier in its own, and every removed or kept long run is as defined."""
    rng = random.Random(8)
    lines = [" ".join(f"w{k}x{j}" for j in range(rng.choice([1, 4, 12, 30]))) for k in range(60)]
    rows = [(k, "\n".join(rng.choice(lines) if rng.random() < 0.3 else f"own {k} {j}" for j in range(30))) for k in range(20)]
    block = [lines[k] for k in (3, 9, 27, 31, 40, 41)]
    rows += [(100 + k, "\n".join([f"head {k}", *block[: 3 + k % 4], f"tail {k}"])) for k in range(8)]
    got = texts_of(spark, rows)
    seen: dict[str, list] = {}
    for key, text in rows:
        seen.setdefault(key, text.split("\n"))
    for key, text in rows:
        own, left = text.split("\n"), got[key].split("\n")
        earlier = [seen[k] for k in seen if k < key]
        for i, line in enumerate(own):
            if line not in left:
                assert any(line in e for e in earlier) or line in own[:i]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                part = own[i:j]
                if sum(len(x.split()) for x in part) > 50 and any(part == e[k : k + len(part)] for e in earlier for k in range(len(e))):
                    assert not any(x in left for x in part if own.count(x) == 1)


def test_periodic_lines_and_tabs(spark):
    tabbed = "\t".join(f"t{k}" for k in range(60))
    got = texts_of(spark, [(1, "\n".join(["again"] * 2000)), (2, f"a\n{tabbed}"), (3, f"b\n{tabbed}\nc")])
    assert got[1].count("again") <= 5 and got[3] == "b\nc"


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame(DOCS + DOCS[:1], "doc_id long, text string").selectExpr("*", "1 as key", "2 as version", "3 as spans", "4 as first", "5 as n_removed_lines")
    got = c.deduplicated(docs)
    assert got.columns == ["doc_id", "text", "key", "version", "spans", "first", "n_removed_lines"]
    assert [r.text for r in got.where("doc_id = 1").collect()] == [DOCS[0][1]] * 2
    assert c.deduplicated(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "\n".join(PASSAGE)), (1, "\n".join(PASSAGE))], "doc_id long, text string")
    assert sorted(len(r.text) for r in c.deduplicated(nulls).collect())[1] == len("\n".join(PASSAGE))
