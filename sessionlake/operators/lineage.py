"""Parent-child links as full hierarchies: path, depth, root, descendants and cycles.

Pointer jumping over the whole table gives every node its component: after round k a node knows its
ancestor 2**k links up, so a tree of depth d is done after log2(d) rounds, and what never ends is on or
below a cycle. Components are then co-located and walked depth-first, without recursion, with node
colours; the walk gives paths, the numbering in which a node's descendants are one interval, their
count, and the back edges that close cycles. A component above a bounded size is never gathered: its
paths and counts come from the same joins that found it, its numbering from prefix sums over siblings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.runtime import checkpoint

#: Nodes of the largest component that one task walks, and the links of all paths of such a component together.
WALKED, WALKED_LINKS = 50_000, 5_000_000


def links(sessions: DataFrame, key: str = "session_id", parent: str = "parent_session_id", version: str | None = "ingested_at") -> DataFrame:
    """``id, parent``: each node once, with its parent where that is a node here; otherwise null.

    Of re-delivered rows the newest counts, of equally new ones that with the greatest parent, null being
    the least. Rows with a null or empty key are no nodes; a null, empty or unknown parent is none.
    """
    named = sessions.where(F.col(key).isNotNull() & (F.col(key) != ""))
    age = F.col(version).cast("timestamp") if version else F.lit(None).cast("timestamp")
    newest = named.groupBy(F.col(key).alias("id")).agg(F.max(F.struct(age.alias("age"), F.when(F.col(parent) != "", F.col(parent)).alias("parent"))).alias("_r"))
    nodes = newest.select("id", F.col("_r.parent").alias("_p"))
    present = nodes.select(F.col("id").alias("parent"))
    return nodes.join(present, F.col("_p") == F.col("parent"), "left").select("id", "parent")


def components(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id, parent, root, depth, cyclic`` for the nodes and parents of ``links``.

    For a node whose chain of parents ends, ``root`` is its end and ``depth`` the number of links to it; for
    one on or below a cycle ``root`` is the smallest id of that cycle and ``depth`` is -1. Only nodes whose
    end is not yet known take part in a round. A chain longer than 2**most_rounds is not expected to exist.
    """
    base = checkpoint(nodes)
    # jump: the ancestor 2**k links up, or the end; least: the smallest id among those ancestors
    state = checkpoint(base.select("id", F.coalesce("parent", "id").alias("jump"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("parent").isNull().alias("done"), F.coalesce("parent", "id").alias("least")))
    done = state.where("done")
    open_ = state.where(~F.col("done"))
    left, reach, stuck = open_.count(), 1, False
    for _ in range(most_rounds):
        if left == 0 or stuck and reach >= left:
            break
        known = done.unionByName(open_).select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"), F.col("done").alias("_done"), F.col("least").alias("_least"))
        # many nodes may share an ancestor: that side is the one adaptive execution splits, the other has a row for each id
        stepped = checkpoint(open_.join(known, "jump").select("id", F.col("_jump").alias("jump"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"), F.least("least", "_least").alias("least")))
        ended = stepped.where("done")
        if not ended.isEmpty():
            done = done.unionByName(ended)
        open_ = stepped.where(~F.col("done"))
        reach *= 2
        # chains have nodes at each depth, so a round that ends none leaves only cycles and what hangs on them
        now = open_.count()
        stuck, left = stuck or now == left, now
    trees = done.select("id", F.col("jump").alias("root"), F.col("steps").alias("depth"), F.lit(False).alias("cyclic"))
    if left:
        # 2**k >= nodes left: the jump lies on the cycle, and the least of its ancestors is the least of the cycle
        on_cycle = open_.select(F.col("id").alias("jump"), F.col("least").alias("root"))
        cycles = open_.select("id", "jump").join(on_cycle, "jump").select("id", "root", F.lit(-1).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
        trees = trees.unionByName(cycles)
    return checkpoint(base.join(trees, "id").select("id", "parent", "root", "depth", "cyclic"))


_WALK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("depth", T.LongType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("on_cycle", T.BooleanType()),
        T.StructField("back_edge", T.BooleanType()),
        T.StructField("entered", T.LongType()),
        T.StructField("left", T.LongType()),
        T.StructField("n_descendants", T.LongType()),
    ]
)
WHITE, GREY, BLACK = range(3)


def walk(parents: dict[str, str | None]) -> list[tuple]:
    """Depth-first walk of one component: rows of ``_WALK``.

    A component has one root, or one cycle; that is entered at its smallest node. A grey node met again is
    the end of a back edge, and the nodes from there to the end of the path are the cycle.
    """
    children: dict[str, list[str]] = {}
    for node, parent in parents.items():
        if parent is not None:
            children.setdefault(parent, []).append(node)
    for below in children.values():
        below.sort(reverse=True)
    roots = [n for n, p in parents.items() if p is None]
    if roots:
        start = roots[0]
    else:
        seen: set[str] = set()
        node = min(parents)
        while node not in seen:
            seen.add(node)
            node = parents[node]
        cycle, at = [node], parents[node]
        while at != node:
            cycle.append(at)
            at = parents[at]
        start = min(cycle)
    colour = dict.fromkeys(parents, WHITE)
    clock, path, back, on_cycle = 0, [], set(), set()
    entered: dict[str, int] = {}
    left: dict[str, int] = {}
    paths: dict[str, list[str]] = {}
    stack = [(start, False)]
    while stack:
        node, leaving = stack.pop()
        if leaving:
            colour[node] = BLACK
            left[node] = clock
            path.pop()
            continue
        if colour[node] != WHITE:
            if colour[node] == GREY:  # its parent link, taken downwards, closes the cycle
                back.add(node)
                on_cycle.update(path[path.index(node) :])
            continue
        colour[node] = GREY
        entered[node] = clock
        clock += 1
        path.append(node)
        paths[node] = list(path)
        stack.append((node, True))
        stack += [(c, False) for c in children.get(node, ())]
    cyclic = not roots
    return [(n, parents[n], start, -1 if cyclic else len(paths[n]) - 1, paths[n], n in on_cycle, n in back, entered[n], left[n], left[n] - entered[n] - 1) for n in parents]


def _walk_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the components of one partition, whose rows come sorted by component."""
    current, parents = None, {}
    rows: list[tuple] = []
    for pdf in batches:
        for node, parent, root in zip(pdf["id"], pdf["parent"], pdf["root"]):
            if root != current:
                if parents:
                    rows += walk(parents)
                current, parents = root, {}
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=_WALK.names)
                    rows = []
            parents[node] = parent if isinstance(parent, str) else None
    if parents:
        rows += walk(parents)
    if rows:
        yield pd.DataFrame(rows, columns=_WALK.names)


def hierarchy(nodes: DataFrame, walked: int = WALKED) -> DataFrame:
    """Every node of ``links`` with its place: ``id, parent, root, depth, path, on_cycle, back_edge, entered, left, n_descendants``.

    ``path`` leads from the root (on or below a cycle: from its smallest node) to the node. The descendants
    of a node are the nodes of its root with ``entered`` between its own and ``left``. A component above
    ``walked`` nodes, or with longer paths than a task can hold, gets the same rows from joins. On or
    below a cycle ``depth`` is -1; ``back_edge`` marks the node at which the cycle is closed, its counts are
    those of the walk, which cuts the cycle there. An empty table gives an empty result.
    """
    placed = components(nodes)
    # only the few sizes above the bound are carried on; partial counts are made before the shuffle
    # on or below a cycle no depth is known; the longest path a component of n nodes can have stands for each
    links_of = F.sum(F.when(F.col("depth") >= 0, F.col("depth")).otherwise(0)) + F.count_if(F.col("depth") < 0) * F.count_if(F.col("depth") < 0)
    large = placed.groupBy("root").agg(F.count("*").alias("_nodes"), links_of.alias("_links")).where((F.col("_nodes") > walked) | (F.col("_links") > WALKED_LINKS)).select("root")
    large = checkpoint(large)
    small = placed.join(large, "root", "left_anti").select("id", "parent", "root")
    found = small.repartition("root").sortWithinPartitions("root").mapInPandas(_walk_sorted, _WALK)
    if large.isEmpty():
        return found
    return found.unionByName(_large_components(placed.join(large, "root", "left_semi")))


def _large_components(placed: DataFrame) -> DataFrame:
    """The rows of components too large for one task, by doubling of paths: after round k a path has 2**k links."""
    cut = F.col("id") == F.col("root")  # where a cycle is entered; a tree ends there anyway
    state = checkpoint(placed.select("id", F.when(~cut, F.col("parent")).alias("jump"), F.when(~cut, F.array("parent", "id")).otherwise(F.array("id")).alias("path")))
    while not state.where(F.col("jump").isNotNull()).isEmpty():
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("path").alias("_path"))
        longer = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat(F.slice("_path", 1, F.size("_path") - 1), F.col("path")))
        state = checkpoint(state.join(above, "jump", "left").select("id", F.col("_jump").alias("jump"), longer.alias("path")))
    below = state.select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("id")).groupBy("id").count()
    cycle_nodes = placed.where("cyclic").join(state, "id").where(F.col("id") == F.col("root")).select(F.col("root"), F.col("parent").alias("_last"))
    ends = cycle_nodes.join(state.select(F.col("id").alias("_last"), F.col("path").alias("_cycle")), "_last").select("root", "_cycle")
    ring = ends.select(F.explode("_cycle").alias("id"), F.lit(True).alias("_ring"))
    sized = checkpoint(placed.join(below, "id", "left").select("id", F.when(~cut, F.col("parent")).alias("parent"), F.coalesce("count", F.lit(0)).alias("n")))
    return (
        placed.join(state.select("id", "path"), "id")
        .join(sized.select("id", "n"), "id")
        .join(_entered(sized), "id")
        .join(ring, "id", "left")
        .select(
            "id",
            "parent",
            "root",
            "depth",
            "path",
            F.coalesce("_ring", F.lit(False)).alias("on_cycle"),
            (F.col("cyclic") & (F.col("id") == F.col("root"))).alias("back_edge"),
            "entered",
            (F.col("entered") + F.col("n") + 1).alias("left"),
            F.col("n").alias("n_descendants"),
        )
    )


def _entered(sized: DataFrame) -> DataFrame:
    """``id, entered``: the place of each node in the walk of its tree, from ``id, parent, n``, n being its descendants.

    A node comes after its parent and all that hangs on its lesser siblings. Siblings may be many: they are
    numbered within parts of a range partitioning, of which only the totals of a parent meet. The numbers are
    then summed up to the root by pointer jumping.
    """
    ranged = checkpoint(sized.where(F.col("parent").isNotNull()).repartitionByRange("parent", "id").withColumn("_part", F.spark_partition_id()))
    size = F.col("n") + 1
    before = Window.partitionBy("parent", "_part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("parent", "_part").agg(F.sum(size).alias("_total"))
    parts = Window.partitionBy("parent").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = totals.select("parent", "_part", (F.sum("_total").over(parts) - F.col("_total")).alias("_earlier"))
    within = ranged.select("id", "parent", "_part", (F.sum(size).over(before) - size).alias("_within"))
    steps = within.join(earlier, ["parent", "_part"]).select("id", F.col("parent").alias("jump"), (F.col("_earlier") + F.col("_within") + 1).alias("entered"))
    state = checkpoint(steps.unionByName(sized.where(F.col("parent").isNull()).select("id", F.lit(None).cast("string").alias("jump"), F.lit(0).cast("long").alias("entered"))))
    while not state.where(F.col("jump").isNotNull()).isEmpty():
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("entered").alias("_entered"))
        state = checkpoint(state.join(above, "jump", "left").select("id", F.col("_jump").alias("jump"), (F.col("entered") + F.coalesce("_entered", F.lit(0))).alias("entered")))
    return state.select("id", "entered")


def descendants(tree: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``ancestor, id, distance``: each node under each of its ancestors, itself at distance 0.

    With ``roots`` (a column ``ancestor``) only under those. On or below a cycle a node is also under the
    nodes of the cycle that its path, cut at the smallest node, leaves out; the distance is then the way round.
    """
    if roots is not None:  # only the components that have one of them
        met = tree.join(roots.select(F.col("ancestor").alias("id")), "id", "left_semi").select("root").distinct()
        tree = tree.join(met, "root", "left_semi")
    along = tree.select("id", "root", "on_cycle", F.size("path").alias("_n"), F.posexplode("path").alias("_p", "ancestor"))
    pairs = along.select("ancestor", "id", (F.col("_n") - F.col("_p") - 1).cast("long").alias("distance"))
    cyclic = tree.where(F.col("depth") == -1)
    # the ring of a cycle in order, from its smallest node: the longest path among its nodes
    ring = cyclic.where("on_cycle").groupBy("root").agg(F.max_by("path", F.size("path")).alias("_ring"))
    around = cyclic.join(ring, "root").withColumn("_entry", F.size(F.array_intersect("path", "_ring")))
    rest = around.select("id", F.size("path").alias("_n"), F.size("_ring").alias("_r"), "_entry", F.posexplode("_ring").alias("_p", "ancestor"))
    beyond = rest.where(F.col("_p") >= F.col("_entry")).select("ancestor", "id", (F.col("_n") - 1 + F.col("_r") - F.col("_p")).cast("long").alias("distance"))
    every = pairs.unionByName(beyond)
    return every if roots is None else every.join(roots.select("ancestor").distinct(), "ancestor", "left_semi")


def below(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``ancestor, id, distance``: the nodes at and below each of a few ``roots`` (a column ``ancestor``), as ``descendants`` has them.

    The links are followed downwards, a join for each level, so trees without a root asked for are not touched.
    A node met again, on a cycle, is not followed twice; a root that is no node gives no row.
    """
    held = checkpoint(nodes.select("id", "parent"))
    found = front = checkpoint(roots.select("ancestor").distinct().join(held.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("ancestor", F.col("ancestor").alias("id"), F.lit(0).cast("long").alias("distance")))
    while not front.isEmpty():
        next_ = front.select("ancestor", F.col("id").alias("parent"), "distance").join(held.where(F.col("parent").isNotNull()), "parent").select("ancestor", "id", (F.col("distance") + 1).alias("distance"))
        front = checkpoint(next_.join(found.select("ancestor", "id"), ["ancestor", "id"], "left_anti"))
        found = found.unionByName(front)
    return found


def lineage_of_requests(tree: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, session_id, distance``: the requested root and all below it; an absent root gives no row."""
    wanted = requests.where(F.col("lineage_root_session_id").isNotNull()).select("request_id", F.col("lineage_root_session_id").alias("ancestor")).distinct()
    return descendants(tree, wanted).join(wanted, "ancestor").select("request_id", F.col("id").alias("session_id"), "distance")
