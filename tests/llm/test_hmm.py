import collections
import math
import re

import numpy as np
import pytest

from strandline.llm import hmm as h

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_likelihood_equals_the_plain_recursion(monkeypatch):
    monkeypatch.setattr(h, "PIECE", 4)
    rng = np.random.default_rng(3)
    m = h.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(12), 3))
    lengths = [1, 3, 4, 5, 9, 17, 2]
    ends = np.cumsum(lengths)
    s = rng.integers(0, 12, ends[-1])

    def plain(x):
        a = m.start * m.emit[:, x[0]]
        for v in x[1:]:
            a = (a @ m.move) * m.emit[:, v]
        return math.log10(a.sum())

    want = [plain(s[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
    assert np.allclose(h.likelihood(m, ends, s), want)


def test_expected_counts_equal_enumeration():
    rng = np.random.default_rng(1)
    m = h.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2))
    x = np.array([[0], [2], [1]])
    total, starts, moves, emissions = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for path in np.ndindex(2, 2, 2):
        p = m.start[path[0]] * m.emit[path[0], 0] * m.move[path[0], path[1]] * m.emit[path[1], 2] * m.move[path[1], path[2]] * m.emit[path[2], 1]
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += p
        for state, symbol in zip(path, (0, 2, 1), strict=True):
            emissions[state, symbol] += p
    got = h.expected(m, x, np.array([True]))
    assert np.allclose(got[0], starts / total, atol=1e-5) and np.allclose(got[1], moves / total, atol=1e-5) and np.allclose(got[2], emissions / total, atol=1e-5)
    assert math.isclose(got[3], math.log10(total), abs_tol=1e-5)


def test_scores(spark):
    texts = ["The cat sat on the mat"] * 30 + ["der hund sitzt auf der matte"] * 30 + [None, "", "  ", "new words here", "x " * 3000]
    rows = [(k, t, k % 7 != 2) for k, t in enumerate(texts)] + [(500, "null train", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").selectExpr("*", "1 as tokens", "2 as chunk", "3 as counts").repartition(3)
    got = {r.doc_id: r for r in h.score_documents(df).collect()}
    words = {k: [*WORD.findall((t or "").lower()), None] for k, t, _ in rows}
    c = collections.Counter(w for k, _, learn in rows if learn for w in words[k])
    n, v = sum(c.values()), len(c)
    for k, _, learn in rows:
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words[k]), sum(c[w] > 0 for w in words[k]), n, not learn)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[k]))
        assert r.score < 0
    assert np.mean([got[k].score - got[k].base_score for k in range(60) if not rows[k][2]]) > 0
    assert h.score_documents(df.limit(0)).count() == 0
    assert h.score_documents(df.where("doc_id = 500")).first().n_known == 0


def test_training_goes_on_for_six_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{v}" for v in rng.integers(0, 40, 200) + 40 * (k % 3)), True) for k in range(40)]
    chunks = h.prepare(spark.createDataFrame(rows, "doc_id long, text string, train boolean"))
    counts, symbols, totals = h.statistics(chunks)
    coded = h.looked_up(chunks, counts, symbols).cache()
    total = lambda **rounds: sum(r.score for r in h.score(coded, h.fit(coded, symbols, **rounds), symbols, totals).collect())
    assert total() == pytest.approx(total(rounds=6), abs=1e-6)
    assert total() > total(rounds=4) + 1
