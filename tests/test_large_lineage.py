"""Components too large for one task get the rows that the walk of one task gives."""

import pytest

from sessionlake.operators.lineage import hierarchy, links
from tests.test_lineage import SCHEMA, _forest


@pytest.mark.parametrize("seed,walked", [(1, 0), (2, 20)])
def test_same_rows_as_the_walk(spark, seed, walked):
    rows = [(n, p, None, "x", "y", "z") for n, p in _forest(seed).items()] + [(f"w{i}", "top", None, None, None, None) for i in range(60)] + [("top", None, None, None, None, None)]
    nodes = links(spark.createDataFrame(rows, SCHEMA))
    plain = [tuple(r) for r in hierarchy(nodes).collect()]
    joined = [tuple(r) for r in hierarchy(nodes, walked).collect()]
    assert sorted(map(str, joined)) == sorted(map(str, plain)) and all(r[7] is not None for r in joined)
