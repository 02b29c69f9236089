"""Filling fixed-capacity containers with documents: pattern packing by non-negative least squares.

Only the histogram of sizes, at most ``capacity`` numbers, reaches the driver. There, patterns of a few
sizes that nearly fill a container are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left over is packed by the largest size that
fits, again on counts. The plan says which ranks of each size go to which containers; the documents are
ranked within their size without any task holding all documents of a size, and look up their container.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists
from sessionlake.runtime import checkpoint

#: Partial ranks a size: a size that a third of all documents share is ranked in so many parts.
RANK_BUCKETS = 64


@dataclass
class Plan:
    """Slots of a packing, ordered by size and first rank: ranks from ``first`` on of ``size`` fill ``each`` places a container from ``base`` on."""

    size: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    containers: int

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container, from 0, of each document by its size and its rank, from 0, within the size."""
        wide = np.int64(1) << 40
        at = np.searchsorted(self.size * wide + self.first, size * wide + rank, side="right") - 1
        return self.base[at] + (rank - self.first[at]) // self.each[at]


def candidate_patterns(histogram: np.ndarray, capacity: int, grid: int = 12, slack: float = 0.02) -> list[tuple[int, ...]]:
    """Sets of two to four sizes that fill a container up to ``slack``; the last size is always the best fit."""
    sizes = np.flatnonzero(histogram)
    sizes = sizes[(sizes > 0) & (sizes <= capacity)]
    if not len(sizes):
        return []
    weights = np.cumsum(histogram[sizes])
    picks = np.unique(sizes[np.searchsorted(weights, np.linspace(1, weights[-1], grid))])
    least = capacity - max(1, int(slack * capacity))
    largest = np.full(capacity + 1, 0)
    largest[sizes] = sizes
    largest = np.maximum.accumulate(largest)
    found: set[tuple[int, ...]] = set()
    for a in sizes.tolist():
        if a >= least:
            found.add((a,))
        for b in picks.tolist():
            rest = capacity - a - b
            if rest < 0:
                continue
            if a + b >= least:
                found.add(tuple(sorted((a, b), reverse=True)))
            if (c := int(largest[rest])) and a + b + c >= least:
                found.add(tuple(sorted((a, b, c), reverse=True)))
            for c in picks.tolist():
                if c <= b and rest - c > 0 and (d := int(largest[rest - c])) and a + b + c + d >= least:
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
        if (b := int(largest[capacity - a])) and a + b >= least:
            found.add(tuple(sorted((a, b), reverse=True)))
    return sorted(found)


def fit_repeats(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - h|, by multiplicative updates; A counts the sizes in each pattern."""
    width = max(map(len, patterns))
    rows = np.zeros((len(patterns), width), dtype=np.int64)
    for i, p in enumerate(patterns):
        rows[i, : len(p)] = p
    h = histogram.astype(float).copy()
    h[0] = 0.0
    x = np.full(len(patterns), max(1.0, h.sum() / (2.0 * len(patterns))))
    top = np.maximum(h[rows].sum(axis=1), 1e-9)
    for _ in range(steps):
        made = np.bincount(rows.ravel(), weights=np.repeat(x, width), minlength=len(h))
        made[0] = 0.0
        x *= top / np.maximum(made[rows].sum(axis=1), 1e-9)
    return x


def plan_packing(histogram: np.ndarray, capacity: int) -> Plan:
    """The packing of ``histogram[s]`` documents of each size ``s`` from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[: min(len(histogram), capacity + 1)] = histogram[: capacity + 1]
    left[0] = 0
    used = np.zeros(capacity + 1, dtype=np.int64)
    slots: list[tuple[int, int, int, int]] = []
    containers = 0

    def place(pattern: dict[int, int], repeats: int) -> None:
        nonlocal containers
        for size, each in pattern.items():
            slots.append((size, int(used[size]), each, containers))
            used[size] += repeats * each
            left[size] -= repeats * each
        containers += repeats

    patterns = candidate_patterns(left, capacity)
    if patterns:
        x = fit_repeats(patterns, left)
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] < 1.0:
                break
            pattern: dict[int, int] = {}
            for s in patterns[i]:
                pattern[s] = pattern.get(s, 0) + 1
            if (repeats := min(int(x[i]), *(int(left[s]) // n for s, n in pattern.items()))) > 0:
                place(pattern, repeats)
    below = list(range(capacity + 1))  # the next size not above that is left, found with halved paths

    def largest(size: int) -> int:
        while size and not left[size]:
            below[size] = below[below[size] - 1] if below[size] == size else below[below[size]]
            size = below[size] if below[size] != size else size - 1
        return size

    size = largest(capacity)
    while size:
        pattern, room = {}, capacity
        at = size
        while at:
            each = min(room // at, int(left[at]))
            pattern[at] = each
            room -= each * at
            at = largest(min(room, at - 1))
        place(pattern, max(1, min(int(left[s]) // n for s, n in pattern.items())))
        size = largest(size)
    slots.sort()
    columns = np.array(slots, dtype=np.int64).reshape(-1, 4).T
    return Plan(columns[0], columns[1], columns[2], columns[3], containers)


def pack(sizes: DataFrame, key: str, size: str, capacities: dict[int, int], group: str = "pack_id") -> DataFrame:
    """The containers of the documents for each capacity: ``group, key, piece_no, token_start, token_end, container_no``.

    ``capacities`` maps the id of a packing to its capacity, which must be at least 1. A document above the
    capacity is cut into full containers and a rest; no other is split. Containers count from 1. Documents
    of null or no size take no space; they are spread over the containers by a hash of the key. Ties between
    documents of a size go by key; repeated rows are documents of their own; other columns are ignored.
    """
    spark = sizes.sparkSession
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be at least 1")
    kind = sizes.schema[key].dataType.simpleString()
    documents = checkpoint(sizes.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_n")))
    packs = F.create_map(*[F.lit(x) for pair in capacities.items() for x in (int(pair[0]), int(pair[1]))])
    per_pack = documents.select(key, "_n", F.explode(packs).alias(group, "_c")).withColumns({"_full": F.floor(F.col("_n") / F.col("_c")), "_rest": F.col("_n") % F.col("_c")})
    # at most capacity rows a packing, whatever the number of documents
    plans: dict[int, Plan] = {}
    for pack_id, rows in _histograms(per_pack, group).items():
        capacity = capacities[pack_id]
        histogram = np.zeros(capacity + 1, dtype=np.int64)
        for s, n in rows:
            histogram[s] = n
        plans[pack_id] = plan_packing(histogram, capacity)
    bucketed = per_pack.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(RANK_BUCKETS)))
    place = ["_bucket", group, "_rest"]
    counts = bucketed.groupBy(*place).agg(F.count("*").alias("_count"), F.sum("_full").alias("_fulls"))
    by_size = Window.partitionBy(group, "_rest").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # the full containers of all documents are numbered after those of the plan: by size, bucket and document
    per_size = counts.groupBy(group, "_rest").agg(F.sum("_fulls").alias("_of_size"))
    before = Window.partitionBy(group).orderBy("_rest").rowsBetween(Window.unboundedPreceding, -1)
    size_base = per_size.select(group, "_rest", F.coalesce(F.sum("_of_size").over(before), F.lit(0)).alias("_size_base"))
    offsets = counts.select(*place, F.coalesce(F.sum("_count").over(by_size), F.lit(0)).alias("_offset"), F.coalesce(F.sum("_fulls").over(by_size), F.lit(0)).alias("_full_offset")).join(size_base, [group, "_rest"])
    own = Window.partitionBy(*place).orderBy(key)
    ranked = (
        bucketed.withColumns({"_own": F.row_number().over(own) - 1, "_own_full": F.coalesce(F.sum("_full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        .join(offsets, place)
        .select(key, group, "_n", "_c", "_full", "_rest", (F.col("_own") + F.col("_offset")).alias("_rank"), (F.col("_own_full") + F.col("_full_offset") + F.col("_size_base")).alias("_first_full"), F.xxhash64(key).alias("_hash"))
    )
    # a plan has a few slots for each size, so its length is bounded by the capacity
    shared = spark.sparkContext.broadcast(plans)
    fulls = {p: n for p, n in ((r[0], r[1]) for r in counts.groupBy(group).agg(F.sum("_fulls")).collect())}

    def make():
        def run(rows: dict) -> dict:
            group_of = np.array(rows[group], dtype=np.int64)
            rest, rank = np.array(rows["_rest"], dtype=np.int64), np.array(rows["_rank"], dtype=np.int64)
            container = np.zeros(len(rest), dtype=np.int64)
            for p, plan in shared.value.items():
                mine = (group_of == p) & (rest > 0)
                if mine.any():
                    container[mine] = plan.container(rest[mine], rank[mine])
            out: dict[str, list] = {group: [], key: [], "piece_no": [], "token_start": [], "token_end": [], "container_no": []}
            for i, (p, k, n, c, full) in enumerate(zip(rows[group], rows[key], rows["_n"], rows["_c"], rows["_full"])):
                planned = shared.value[p].containers
                pieces = [(j * c, (j + 1) * c, planned + rows["_first_full"][i] + j) for j in range(full)]
                if rest[i]:
                    pieces.append((full * c, n, int(container[i])))
                elif not n:
                    pieces.append((0, 0, rows["_hash"][i] % max(1, planned + fulls.get(p, 0))))
                for j, (a, b, where) in enumerate(pieces, 1):
                    for name, value in ((group, p), (key, k), ("piece_no", j), ("token_start", a), ("token_end", b), ("container_no", where + 1)):
                        out[name].append(value)
            return out

        return run

    return map_lists(ranked, make, f"`{group}` bigint, `{key}` {kind}, piece_no int, token_start bigint, token_end bigint, container_no bigint")


def _histograms(per_pack: DataFrame, group: str) -> dict[int, list[tuple[int, int]]]:
    found: dict[int, list[tuple[int, int]]] = {}
    for p, s, n in per_pack.groupBy(group, "_rest").count().collect():
        found.setdefault(p, []).append((s, n))
    return found


def container_fill(assigned: DataFrame, capacities: dict[int, int], group: str = "pack_id") -> DataFrame:
    """``group, capacity, n_containers, n_tokens, fill_share``: how full the containers of each packing are."""
    packs = F.create_map(*[F.lit(x) for pair in capacities.items() for x in (int(pair[0]), int(pair[1]))])
    tokens, containers = F.sum(F.col("token_end") - F.col("token_start")), F.max("container_no")
    capacity = F.first(packs[F.col(group)])
    return assigned.groupBy(group).agg(capacity.alias("capacity"), containers.alias("n_containers"), tokens.alias("n_tokens"), F.round(tokens / (containers * capacity), 6).alias("fill_share"))
