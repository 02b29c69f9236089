import random
from collections import Counter

import numpy as np
import pytest

from sessionlake.llm.packing import container_fill, pack, plan_packing


def _loads(histogram, plan):
    load = Counter()
    for size in np.flatnonzero(histogram):
        for c in plan.container(np.full(histogram[size], size), np.arange(histogram[size])):
            load[int(c)] += int(size)
    return load


@pytest.mark.parametrize("seed", range(6))
def test_plans_fit_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 200))
    h = np.zeros(capacity + 1, dtype=np.int64)
    for s in rng.integers(1, capacity + 1, size=int(rng.integers(0, 500))):
        h[s] += 1
    if seed == 3:
        h[capacity // 3 + 1] += 5000  # a third of all have one size
    plan = plan_packing(h, capacity)
    load = _loads(h, plan)
    assert len(load) == plan.containers and all(v <= capacity for v in load.values())
    assert sum(load.values()) == int((h * np.arange(capacity + 1)).sum())


def test_fills_well_against_the_bound():
    rng = np.random.default_rng(1)
    h = np.bincount(np.minimum(rng.gamma(2.0, 60.0, 4000).astype(int) + 1, 512), minlength=513)
    total = int((h * np.arange(513)).sum())
    assert plan_packing(h, 512).containers <= 1.01 * -(-total // 512) + 1


def test_assignment_agrees_with_the_documents(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 7, 7, 7, 33, rng.randint(1, 260)]), "x", "y") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, n long, container_no string, _n string")
    got = pack(df, "doc_id", "n", {1: 50, 2: 100}).collect()
    for pack_id, capacity in ((1, 50), (2, 100)):
        mine = [r for r in got if r["pack_id"] == pack_id]
        load, covered = Counter(), Counter()
        for r in mine:
            load[r["container_no"]] += r["token_end"] - r["token_start"]
            covered[r["doc_id"]] += r["token_end"] - r["token_start"]
        assert all(v <= capacity for v in load.values()) and min(load) >= 1
        assert covered == Counter({i: n or 0 for i, n, *_ in rows}) and set(covered) == {i for i, *_ in rows}
        assert all((r["piece_no"] == 1 and r["token_start"] == 0) or dict(enumerate(map(lambda x: x[1], rows)))[r["doc_id"]] > capacity for r in mine)
        places = sorted(load)
        assert [p for p in range(1, max(places) + 1) if p not in load] == []
    fill = {r["pack_id"]: r["fill_share"] for r in container_fill(spark.createDataFrame(got), {1: 50, 2: 100}).collect()}
    assert fill[1] > 0.9 and fill[2] > 0.9


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, n long")
    assert pack(empty, "doc_id", "n", {1: 10}).count() == 0
    blank = spark.createDataFrame([(1, None), (2, 0), (2, 0)], "doc_id long, n long")
    assert sorted((r["doc_id"], r["container_no"]) for r in pack(blank, "doc_id", "n", {1: 10}).collect()) == [(1, 1), (2, 1), (2, 1)]
    with pytest.raises(ValueError):
        pack(empty, "doc_id", "n", {1: 0})
