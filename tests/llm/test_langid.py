import random
import zlib

import numpy as np

from strandline.llm import langid as g


def made(n=120, seed=2):
    rng = random.Random(seed)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ung", "er"], "zz": ["é", "ñ", "que", "ción"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_gradients_equal_differences():
    net = g.new_network(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (10, 6)), rng.integers(0, 3, 6)
    _, grads = g._gradients(net, x, y)
    for v, d in zip(net.arrays, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(d)), v.shape)
        old, e = v[at], np.float32(1e-2)
        v[at] = old + e
        up, _ = g._gradients(net, x, y)
        v[at] = old - e
        down, _ = g._gradients(net, x, y)
        v[at] = old
        assert abs(d[at] - (up - down) / (2 * e)) < 2e-3


def test_held_out_accuracy_and_odd_rows(spark):
    rows = made()
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !!", "zz"), (1003, "ka lo mi", None), (1004, "kalo " * 20000, "xx"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as lang_pred")
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    net = g.fit(df.where(~df.doc_id.isin(held)), rows_per_label=40)
    assert net.labels == ["xx", "yy", "zz"]
    got = g.predict(df, net).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[k].lang_pred == rows[k][2] for k in held]) >= 0.95
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    assert by[1004].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert g.fit(df) is None and g.fit(df.limit(0)) is None
    assert g.predict(df, None).first().lang_pred == "und"
