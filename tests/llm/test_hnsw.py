import numpy as np

from strandline.llm import hnsw as h


def made(seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 16))
    near = x[:20] + 0.02 * rng.normal(size=(20, 16))
    crowd = x[50] + 0.01 * rng.normal(size=(120, 16))
    return np.concatenate((x, near, crowd)).astype(np.float32)


def test_equals_brute_force(spark):
    x = made()
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, x[0].tolist()), (901, x[0].tolist()), (902, None), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, [None] * 16), (906, []), (907, [1.0, 2.0]), (908, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as copies", "3 as shard", "4 as component")
    got = {r.vec_id: (r.n_links, r.component) for r in h.near_duplicates(df).collect()}
    y = np.concatenate((x, x[:1], x[:1])).astype(np.float64)
    ids = np.array([*range(len(x)), 900, 901])
    u = y / np.linalg.norm(y, axis=1)[:, None]
    near = u @ u.T >= 0.9
    comp = ids.copy()
    for _ in range(50):
        comp = np.array([comp[row].min() for row in near])
    want = {int(i): (int(near[k].sum()) - 1, int(comp[k])) for k, i in enumerate(ids)}
    found = sum(got[i][0] for i in want)
    assert found >= 0.98 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98
    assert [got[i] for i in (902, 903, 904, 905, 906)] == [(0, i) for i in (902, 903, 904, 905, 906)]
    assert got[907] == (1, 907) and got[908] == (1, 907)
    assert h.near_duplicates(df.limit(0)).count() == 0


def test_audit_widens_the_beam():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = h.audited(h.build(x), recall=0.999)
    x = g.vectors  # in the graph's order
    found = h.query(g, x)
    truth = [np.flatnonzero(row) for row in x @ x.T >= 0.9]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True)) >= 0.97 * sum(map(len, truth))
