"""The most similar vectors of every vector: an inverted multi-index.

Each half of the unit vectors has a codebook of its own, fitted by k-means on a bounded sample; a vector
lies in the cell of its two nearest centroids. A query walks pairs of centroids in the order of summed
distance, with a heap, until the cells seen hold enough vectors, and the vectors of those cells are
ranked by their exact similarity. Equal vectors are indexed once, with the smallest ids that share them,
so a group of copies costs one entry however large it is.

For the ranking, index and queries meet by groups of near first centroids: an entry is sent once, a query
once for each group among its cells. A group with many entries is cut into parts of bounded size. Where
every vector is a query, a pair that one of its sides finds counts for the other too.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.runtime import checkpoint

#: Vectors of one model that fit the codebooks, about as many, picked by a hash of the vector.
SAMPLE = 20_000
#: Index entries that one task ranks against at a time, about as many.
PART = 20_000
#: Centroids of a half: what the driver and the tasks hold grows with their square. Beyond it the cells hold more.
MOST_CENTROIDS = 512
#: Entries a query looks at: LOOKED * n ** GROWTH of its model's n, LEAST_LOOKED at least. Fitted to the rank of near partners at three sizes.
LOOKED, GROWTH, LEAST_LOOKED = 0.2, 0.75, 500


@dataclass
class Codebooks:
    """Centroids of both halves, how many entries each cell holds, and the group of each first centroid with the parts it is cut into."""

    first: np.ndarray
    second: np.ndarray
    cells: np.ndarray
    group: np.ndarray
    parts: np.ndarray

    def fill(self, cells: np.ndarray) -> None:
        """Takes the entries a cell, and forms groups of near first centroids with about PART entries each."""
        self.cells = cells
        held = cells.reshape(len(self.first), -1).sum(axis=1)
        centred = self.first - self.first.mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
        order = np.argsort(along, kind="stable")
        before = np.cumsum(held[order]) - held[order]
        self.group = np.zeros(len(self.first), dtype=np.int64)
        self.group[order] = np.unique(before // PART, return_inverse=True)[1]
        self.parts = np.maximum(1, -(-np.bincount(self.group, weights=held).astype(np.int64) // (2 * PART)))

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(unit[:, :half], self.first), _nearest(unit[:, half:], self.second)

    def walk(self, unit: np.ndarray, enough: int, most_cells: int | None = None) -> list[list[int]]:
        """For each query the cells (first * K + second), by summed distance, until they hold ``enough`` entries."""
        half = self.first.shape[1]
        k = len(self.second)
        near = _distances(unit[:, :half], self.first), _distances(unit[:, half:], self.second)
        orders = [np.argsort(d, axis=1, kind="stable") for d in near]
        sorted_near = [np.take_along_axis(d, o, axis=1) for d, o in zip(near, orders)]
        counts = self.cells
        out = []
        for da, db, oa, ob in zip(sorted_near[0].tolist(), sorted_near[1].tolist(), orders[0].tolist(), orders[1].tolist()):
            heap, seen, held, cells = [(da[0] + db[0], 0, 0)], {(0, 0)}, 0, []
            while heap and held < enough and (most_cells is None or len(cells) < most_cells):
                _, i, j = heapq.heappop(heap)
                cell = oa[i] * k + ob[j]
                if counts[cell]:
                    cells.append(cell)
                    held += counts[cell]
                for a, b in ((i + 1, j), (i, j + 1)):
                    if a < len(da) and b < len(db) and (a, b) not in seen:
                        seen.add((a, b))
                        heapq.heappush(heap, (da[a] + db[b], a, b))
            out.append(cells)
        return out


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :], 0.0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return _distances(x, centroids).argmin(axis=1)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k-means (Lloyd) from ``k`` distinct rows; an empty cluster takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centroids = x[rng.choice(len(x), size=k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        d = _distances(x, centroids)
        label = d.argmin(axis=1)
        order = np.argsort(label, kind="stable")
        found, begin = np.unique(label[order], return_index=True)
        centroids[found] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
        if len(found) < k:
            far = np.argsort(-d[np.arange(len(x)), label])
            for c, row in zip(np.setdiff1d(np.arange(k), found), far):
                centroids[c] = x[row]
    return centroids


def _units(packed: pd.Series, dimensions: int, kind: type = np.float32) -> np.ndarray:
    """Unit vectors of packed half-precision vectors."""
    raw = np.frombuffer(b"".join(packed), dtype=np.float16).astype(np.float64).reshape(-1, dimensions)
    return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).astype(kind)


def usable(df: DataFrame, key: str, model: str, vector: str, dimensions: int) -> DataFrame:
    """``_model, _id, _v``: vectors of the right length, all finite and not all zero, packed in half precision.

    The stored vectors are rounded to half precision, so packing loses nothing; a value beyond its range
    would become infinite and takes the vector out.
    """

    def make(batches):
        for pdf in batches:
            keep = pdf["_vector"].map(lambda v: v is not None and len(v) == dimensions).to_numpy(dtype=bool)
            pdf = pdf[keep]
            if pdf.empty:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                grid = np.stack(pdf["_vector"].to_numpy()).astype(np.float64).astype(np.float16)
            good = np.isfinite(grid).all(axis=1) & (grid != 0).any(axis=1)
            grid[grid == 0] = 0.0  # no negative zeros: equal vectors have equal bytes
            yield pd.DataFrame({"_model": pdf["_model"][good], "_id": pdf["_id"][good], "_v": [r.tobytes() for r in grid[good]]})

    source = df.select(F.col(model).alias("_model"), F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vector")).where((F.size("_vector") == dimensions) & F.col("_id").isNotNull() & F.col("_model").isNotNull())
    return source.mapInPandas(make, "_model string, _id long, _v binary")


def representatives(vectors: DataFrame, kept: int) -> DataFrame:
    """``_model, _v, _ids``: each different vector with the ``kept`` smallest ids that have it.

    More ids are never among the neighbours of a copy. The rank filter works before the shuffle too, so a
    group of copies sends ``kept`` rows a task; re-delivered rows share a rank.
    """
    copies = Window.partitionBy("_model", "_v").orderBy("_id")
    few = vectors.withColumn("_r", F.dense_rank().over(copies)).where(F.col("_r") <= kept)
    return few.groupBy("_model", "_v").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))


def codebooks_for(entries: DataFrame, dimensions: int, occupancy: int) -> dict[str, Codebooks]:
    """Codebooks of each model, fitted on about SAMPLE of its vectors; a cell holds about ``occupancy`` entries.

    The number of centroids grows with the square root of the entries. Models are few and named; the driver
    holds the sample of each.
    """
    sizes = {r[0]: r[1] for r in entries.groupBy("_model").count().collect()}
    if not sizes:
        return {}
    # a threshold on the hash, so that no partition sends more than its share
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(min(1.0, SAMPLE / n) * (1 << 30)))]), F.col("_model"))
    sample = entries.where(F.pmod(F.xxhash64("_v", F.lit(7)), F.lit(1 << 30)) < share).select("_model", "_v").toPandas()
    books: dict[str, Codebooks] = {}
    for name, rows in sample.groupby("_model"):
        unit = _units(rows["_v"].sort_values(), dimensions)  # in a fixed order, so that the same rows give the same centroids
        k = int(np.clip(np.sqrt(sizes[name] / occupancy), 1, MOST_CENTROIDS))
        half = dimensions // 2
        first, second = fit_centroids(unit[:, :half], k), fit_centroids(unit[:, half:], k)
        books[name] = Codebooks(first, second, np.zeros(len(first) * len(second), dtype=np.int64), np.zeros(len(first), dtype=np.int64), np.ones(1, dtype=np.int64))
    return books


def _top(similar: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest values of each row and all that tie with the last."""
    if similar.shape[1] <= k:
        return np.ones(similar.shape, dtype=bool)
    last = np.partition(similar, -k, axis=1)[:, -k]
    return similar >= last[:, None]


def nearest_neighbours(
    df: DataFrame,
    key: str,
    model: str,
    vector: str,
    k: int = 10,
    dimensions: int = 64,
    least: float = -1.0,
    enough: int | None = None,
    share: float = 0.0,
    occupancy: int = 50,
    queries_of: Callable[[Column], Column] | None = None,
    every_member: bool = True,
) -> DataFrame:
    """``model, id, neighbour_id, similarity, rank``: the ``k`` most similar other vectors of the same model.

    Ties in similarity go to the smaller id. Vectors that are null, of another length, zero or not finite
    take no part, nor do rows without id or model; re-delivered rows count once. ``least`` leaves out less
    similar pairs before they are sent; a query looks at ``enough`` entries, by default at LOOKED * n ** GROWTH of
    its model's n, or at ``share`` of them if those are more, which sets the accuracy (near-duplicates are found among few, a full
    list needs a share; a share of 1 is exact); ``queries_of`` is a condition on the id that picks the queries, all rows being indexed. Without
    ``every_member`` only the k + 1 smallest ids of a group of copies are asked for: for mutual pairs that is
    enough, since a later copy's neighbours are the first k, which do not have it among theirs. Other columns are ignored. An empty table gives an empty result.
    """
    entries = checkpoint(representatives(usable(df, key, model, vector, dimensions), k + 1))
    books = codebooks_for(entries, dimensions, occupancy)
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("id", T.LongType()), T.StructField("neighbour_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    spark = df.sparkSession
    if not books:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(books)  # at most 2 * MOST_CENTROIDS centroids a model

    def place(batches):
        for pdf in batches:
            for name, part in pdf.groupby("_model"):
                book = shared.value[name]
                a, b = book.assign(_units(part["_v"], dimensions))
                yield part.assign(_cell=(a * len(book.second) + b).astype(np.int32))

    placed = checkpoint(entries.mapInPandas(place, "_model string, _v binary, _ids array<long>, _cell int"))
    cells = {name: np.zeros(len(book.cells), dtype=np.int64) for name, book in books.items()}
    for r in placed.groupBy("_model", "_cell").count().collect():  # at most a row for each cell
        cells[r[0]][r[1]] = r[2]
    for name, book in books.items():
        book.fill(cells[name])
    shared = spark.sparkContext.broadcast(books)

    def ask(batches):
        for pdf in batches:
            for name, part in pdf.groupby("_model"):
                book = shared.value[name]
                width, n = len(book.second), int(book.cells.sum())
                looked = max(enough or max(LEAST_LOOKED, int(LOOKED * n**GROWTH)), int(share * n))
                rows: dict[str, list] = {c: [] for c in ("_model", "_group", "_part", "_q", "_v", "_cells")}
                for v, ids, seen in zip(part["_v"], part["_ids"], book.walk(_units(part["_v"], dimensions), looked)):
                    by_group: dict[int, list[int]] = {}
                    for cell in seen:
                        by_group.setdefault(int(book.group[cell // width]), []).append(cell)
                    for g, own in by_group.items():
                        for p in range(int(book.parts[g])):
                            for c, x in zip(rows, (name, g, p, ids[0], v, own)):
                                rows[c].append(x)
                yield pd.DataFrame(rows)

    def lay(batches):
        for pdf in batches:
            for name, part in pdf.groupby("_model"):
                book = shared.value[name]
                g = book.group[part["_cell"].to_numpy() // len(book.second)]
                yield pd.DataFrame({"_model": name, "_group": g.astype(np.int32), "_part": (part["_hash"].to_numpy() % book.parts[g]).astype(np.int32), "_e": part["_e"], "_v": part["_v"], "_cell": part["_cell"]})

    asking, members = placed, None
    if every_member:
        members = usable(df, key, model, vector, dimensions).distinct()
        if queries_of is not None:
            members = members.where(queries_of(F.col("_id")))
            asking = placed.join(members.select("_model", "_v").distinct(), ["_model", "_v"], "left_semi")
    questions = asking.mapInPandas(ask, "_model string, _group int, _part int, _q long, _v binary, _cells array<int>")
    index = placed.select("_model", F.element_at("_ids", 1).alias("_e"), "_v", "_cell", F.pmod(F.xxhash64("_v"), F.lit(1 << 30)).alias("_hash")).mapInPandas(lay, "_model string, _group int, _part int, _e long, _v binary, _cell int")

    def rank(question: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(question) and len(entry):
            entry = entry.sort_values("_cell", kind="stable")
            cells = entry["_cell"].to_numpy()
            ids = entry["_e"].to_numpy()
            have64, asked64 = (_units(x["_v"], dimensions, np.float64) for x in (entry, question))
            have, asked = have64.astype(np.float32), asked64.astype(np.float32)
            who = question["_q"].to_numpy()
            sizes = question["_cells"].map(len).to_numpy()
            row = np.repeat(np.arange(len(question)), sizes)
            cell = np.concatenate(question["_cells"].to_numpy()).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            row, cell = row[order], cell[order]
            found_cells, begin = np.unique(cell, return_index=True)
            for c, a, b in zip(found_cells, begin, [*begin[1:], len(cell)]):
                lo, hi = np.searchsorted(cells, c), np.searchsorted(cells, c, side="right")
                for s in range(a, b, 4096):
                    mine = row[s : min(b, s + 4096)]
                    similar = asked[mine] @ have[lo:hi].T
                    good = (similar >= least - 1e-3) & _top(similar, k + 1)
                    i, j = np.nonzero(good & (who[mine][:, None] != ids[None, lo:hi]))
                    if len(i):
                        exact = (asked64[mine[i]] * have64[lo + j]).sum(axis=1)
                        found.append(pd.DataFrame({"_q": who[mine[i]], "_e": ids[lo + j], "_s": exact}))
            if found:
                all_found = pd.concat(found)
                all_found = all_found[all_found["_s"] >= least].sort_values(["_q", "_s", "_e"], ascending=[True, False, True])
                found = [all_found[all_found.groupby("_q").cumcount() < k]]
        out = pd.concat(found) if found else pd.DataFrame({"_q": [], "_e": [], "_s": []})
        return out.assign(_model=question["_model"].iloc[0] if len(question) else "")[["_model", "_q", "_e", "_s"]]

    by = ["_model", "_group", "_part"]
    pairs = questions.groupBy(*by).cogroup(index.groupBy(*by)).applyInPandas(rank, "_model string, _q long, _e long, _s double")
    if queries_of is None:  # both sides asked: what one has found the other has too
        both = pairs.select("_model", "_q", F.explode(F.array(F.struct(F.col("_q").alias("q"), F.col("_e").alias("e")), F.struct(F.col("_e").alias("q"), F.col("_q").alias("e")))).alias("_way"), "_s")
        pairs = both.select("_model", F.col("_way.q").alias("_q"), F.col("_way.e").alias("_e"), "_s").repartition("_model", "_q").groupBy("_model", "_q", "_e").agg(F.max("_s").alias("_s"))
    # copies of a vector are neighbours of similarity 1 of each other; entries expand to the ids they stand for
    ids_of = placed.select("_model", F.element_at("_ids", 1).alias("_first"), "_ids")
    best = Window.partitionBy("_model", "_q").orderBy(F.desc("_s"), "_e")
    few = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    others = few.join(ids_of.select("_model", F.col("_first").alias("_e"), F.col("_ids").alias("_theirs")), ["_model", "_e"]).select("_model", F.col("_q").alias("_first"), F.struct(F.col("_s"), F.col("_theirs").alias("_them")).alias("_near"))
    gathered = others.groupBy("_model", "_first").agg(F.collect_list("_near").alias("_near"))
    joined = placed.select("_model", F.element_at("_ids", 1).alias("_first"), "_ids", "_v").join(gathered, ["_model", "_first"], "left")
    distance_and_id = "array<struct<s:double,i:bigint>>"
    theirs = F.flatten(F.transform("_near", lambda n: F.transform(n["_them"], lambda i: F.struct((-n["_s"]).alias("s"), i.alias("i")))))
    copies = F.transform("_ids", lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("i")))
    near_all = joined.select("_model", "_v", "_ids", F.sort_array(F.concat(F.coalesce(theirs, F.array().cast(distance_and_id)), copies)).alias("_all"))
    each = near_all.select("_model", "_all", F.explode("_ids").alias("_id")) if members is None else members.join(near_all, ["_model", "_v"])
    top = F.slice(F.filter("_all", lambda x: x["i"] != F.col("_id")), 1, k)
    listed = each.select("_model", "_id", F.posexplode(top).alias("_p", "_n"))
    similar = F.least(-F.col("_n.s"), F.lit(1.0))
    return listed.where(similar >= least).select(F.col("_model").alias("model"), F.col("_id").alias("id"), F.col("_n.i").alias("neighbour_id"), similar.alias("similarity"), (F.col("_p") + 1).cast("int").alias("rank"))


def mutual_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """``id_a, id_b, similarity``, smaller id first: pairs of at least ``least`` in which each is among the other's neighbours."""
    close = neighbours.where(F.col("similarity") >= least)
    pair = close.groupBy("model", F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b"))
    return pair.agg(F.countDistinct("id").alias("_sides"), F.max("similarity").alias("similarity")).where(F.col("_sides") == 2).select("id_a", "id_b", "similarity")
