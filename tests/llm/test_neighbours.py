import numpy as np

from sessionlake.llm.neighbours import fit_centroids, mutual_pairs, nearest_neighbours

SCHEMA = "id long, model string, vector array<float>, _v string, rank string"


def _brute(rows, k, least=-1.0):
    out = {}
    usable = {}
    for i, model, v, *_ in rows:
        if i is None or model is None or v is None or len(v) != 8 or any(x is None for x in v):
            continue
        a = np.array(v, dtype=np.float32).astype(np.float64)
        if np.isfinite(a).all() and a.any():
            usable.setdefault(model, {})[i] = a / np.linalg.norm(a)
    for model, by in usable.items():
        for i, a in by.items():
            near = sorted(((-float(np.float64(a @ b)), j) for j, b in by.items() if j != i))
            out[model, i] = [j for s, j in near[:k] if -s >= least]
    return out


def _half(x):
    return [float(v) for v in np.array(x, dtype=np.float16)]


def _rows(seed=0, n=150):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((i, "ab"[i % 2], _half(rng.normal(size=8)), "x", "y"))
    base = _half(rng.normal(size=8))
    rows += [(1000 + i, "a", base, None, None) for i in range(40)]  # copies
    rows += [(2000 + i, "a", _half(np.array(base) + rng.normal(size=8) * 0.05), None, None) for i in range(6)]
    rows += [(3000, "a", None, None, None), (3001, "a", [1.0] * 7, None, None), (3002, "a", [0.0] * 8, None, None), (3003, "a", [float("nan")] + [1.0] * 7, None, None), (3004, "a", [float("inf")] + [1.0] * 7, None, None), (3005, None, [1.0] * 8, None, None), (None, "a", [1.0] * 8, None, None), (3006, "c", [1.0] * 8, None, None), (3007, "a", [None] + [1.0] * 7, None, None)]
    return rows + rows[:20]


def test_agrees_with_brute_force_when_it_looks_at_all(spark):
    rows = _rows()
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "model", "vector", k=5, dimensions=8, enough=10_000, occupancy=5).orderBy("model", "id", "rank").collect():
        got.setdefault((r["model"], r["id"]), []).append(r["neighbour_id"])
    want = {k: v for k, v in _brute(rows, 5).items() if v}
    assert set(got) == set(want)
    for key, near in want.items():
        assert len(got[key]) == len(near)
        assert got[key] == near or len(set(got[key]) & set(near)) >= 4  # equal similarities may differ in the last bit


def test_near_pairs_are_found_among_few(spark):
    rows = _rows(3)
    near = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "model", "vector", k=10, dimensions=8, least=0.9, enough=40, occupancy=5, every_member=False)
    got = {(r["id_a"], r["id_b"]) for r in mutual_pairs(near, 0.9).collect()}
    lists = _brute(rows, 10, 0.9)
    want = {(i, j) for (m, i), near_i in lists.items() for j in near_i if i < j and i in lists.get((m, j), [])}
    assert len(got & want) >= 0.95 * len(want) and len(want) >= 55 and all(a < b for a, b in got)


def test_recall_of_a_share(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", _half(rng.normal(size=8)), None, None) for i in range(1200)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "model", "vector", k=10, dimensions=8, enough=10, share=0.3, occupancy=5, queries_of=lambda i: i % 50 == 0).collect():
        got.setdefault(r["id"], set()).add(r["neighbour_id"])
    want = {i: set(v) for (_, i), v in _brute(rows, 10).items() if i % 50 == 0}
    assert set(got) == set(want) and sum(len(got[i] & want[i]) for i in want) >= 0.9 * 10 * len(want)


def test_later_copies_have_their_neighbours(spark):
    rows = [(i, "a", [1.0] * 8, None, None) for i in range(100, 160)]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "model", "vector", k=3, dimensions=8, queries_of=lambda i: i % 50 == 0).collect()
    assert sorted((r["id"], r["neighbour_id"]) for r in got) == [(100, 101), (100, 102), (100, 103), (150, 100), (150, 101), (150, 102)]


def test_empty(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), "id", "model", "vector", dimensions=8).count() == 0


def test_centroids_cover_every_cluster():
    x = np.repeat(np.eye(4, dtype=np.float32), 10, axis=0)
    assert len(np.unique(fit_centroids(x, 4).round(3), axis=0)) == 4
