import random

import pytest

from sessionlake.operators.lineage import below, components, descendants, hierarchy, lineage_of_requests, links, walk

SCHEMA = "session_id string, parent_session_id string, ingested_at timestamp, id string, path string, root string"


def _brute(parents):
    out = {}
    for node in parents:
        seen, at = [], node
        while at is not None and at not in seen:
            seen.append(at)
            at = parents[at]
        out[node] = (seen[-1], len(seen) - 1) if at is None else (min(seen[seen.index(at) :]), -1)
    return out


def _forest(seed, n=120):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(n)]
    rng.shuffle(names)
    parents = {}
    for i, name in enumerate(names):
        r = rng.random()
        parents[name] = None if r < 0.1 else rng.choice(names) if r < 0.3 else names[max(0, i - rng.choice([1, 1, 1, 5]))] if i else None
        if parents[name] == name and rng.random() < 0.5:
            parents[name] = None
    return parents


@pytest.mark.parametrize("seed,walked", [(0, 50_000), (1, 1), (2, 20), (3, 50_000)])
def test_agrees_with_brute_force(spark, seed, walked):
    parents = _forest(seed)
    rows = [(n, p, None, "x", "y", "z") for n, p in parents.items()]
    tree = hierarchy(links(spark.createDataFrame(rows + rows[:30], SCHEMA)), walked).cache()
    got = {r["id"]: r for r in tree.collect()}
    assert {n: (r["root"], r["depth"]) for n, r in got.items()} == _brute(parents)
    for n, r in got.items():
        assert r["path"][0] == r["root"] and r["path"][-1] == n and all(parents[b] == a for a, b in zip(r["path"], r["path"][1:]))
    ancestors = {}
    for n in parents:
        at, i, seen = n, 0, set()
        while at is not None and at not in seen:
            ancestors[at, n] = i
            seen.add(at)
            at, i = parents[at], i + 1
    assert {(r["ancestor"], r["id"]): r["distance"] for r in descendants(tree).collect()} == ancestors
    if walked > 1000:
        for n, r in got.items():
            inside = {m for m, q in got.items() if q["root"] == r["root"] and r["entered"] < q["entered"] < r["left"]}
            assert len(inside) == r["n_descendants"] and all((n, m) in ancestors for m in inside)


def test_below_is_what_descendants_has(spark):
    parents = _forest(4)
    nodes = links(spark.createDataFrame([(n, p, None, "x", "y", "z") for n, p in parents.items()], SCHEMA))
    roots = spark.createDataFrame([("n001",), ("n017",), ("n033",), ("n033",), ("absent",), (None,)], "ancestor string")
    want = {tuple(r) for r in descendants(hierarchy(nodes), roots).collect()}
    got = [tuple(r) for r in below(nodes, roots).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_long_paths_are_not_walked(spark, monkeypatch):
    from sessionlake.operators import lineage

    rows = [(f"{i:03d}", f"{i - 1:03d}" if i else None, None, None, None, None) for i in range(40)]
    plain = sorted(map(str, hierarchy(links(spark.createDataFrame(rows, SCHEMA))).collect()))
    monkeypatch.setattr(lineage, "WALKED_LINKS", 100)
    monkeypatch.setattr(lineage, "walk", None)  # would fail if it were called
    assert sorted(map(str, hierarchy(links(spark.createDataFrame(rows, SCHEMA))).collect())) == plain


def test_a_long_chain(spark):
    n = 700
    rows = [(f"{i:05d}", f"{i - 1:05d}" if i else None, None, None, None, None) for i in range(n)]
    got = {r["id"]: (r["root"], r["depth"]) for r in components(links(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {f"{i:05d}": ("00000", i) for i in range(n)}


def test_a_wide_tree_and_odd_rows(spark):
    rows = [("top", None, None, None, None, None), (None, "top", None, None, None, None), ("", "top", None, None, None, None), ("self", "self", None, None, None, None), ("lost", "nowhere", None, None, None, None), ("blank", "", None, None, None, None)]
    rows += [(f"c{i}", "top", None, None, None, None) for i in range(500)]
    tree = hierarchy(links(spark.createDataFrame(rows, SCHEMA))).cache()
    got = {r["id"]: r for r in tree.collect()}
    assert len(got) == 504 and got["top"]["n_descendants"] == 500 and got["c7"]["path"] == ["top", "c7"]
    assert got["self"]["depth"] == -1 and got["self"]["on_cycle"] and got["self"]["back_edge"]
    assert got["lost"]["depth"] == got["blank"]["depth"] == 0 and got["lost"]["parent"] is None
    requests = spark.createDataFrame([("r1", "top"), ("r2", "absent"), ("r3", None), ("r1", "top")], "request_id string, lineage_root_session_id string")
    assert lineage_of_requests(tree, requests).groupBy("request_id").count().collect() == [("r1", 501)]


def test_the_newest_delivery_counts(spark):
    import datetime as d

    rows = [("a", "b", d.datetime(2024, 1, 1), None, None, None), ("a", None, d.datetime(2024, 1, 2), None, None, None), ("b", None, None, None, None, None)]
    assert {tuple(r) for r in links(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", None), ("b", None)}


def test_empty(spark):
    assert hierarchy(links(spark.createDataFrame([], SCHEMA))).count() == 0


def test_walk_marks_the_back_edge():
    rows = {r[0]: r for r in walk({"a": "c", "b": "a", "c": "b", "d": "a"})}
    assert {n for n, r in rows.items() if r[5]} == {"a", "b", "c"} and [n for n, r in rows.items() if r[6]] == ["a"] and rows["d"][4] == ["a", "d"]
