"""Approximate nearest neighbours: hierarchical k-means tree, searched best bin first, as wide as calibration says.

The tree is fitted on a bounded sample and broadcast; every vector is put into the leaf that greedy descent gives.  A query walks the tree with a
priority queue of the branches that it has passed by, nearest centre first, and so gets the leaves in the order it should visit them.  How many
it visits follows from a calibration: for a bounded set of calibration queries the exact neighbours are found among all rows, and
the visits are widened until the wanted recall is reached.  Equal vectors are one point with its smallest ids, so copies never meet as pairs.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import workspace

#: Rows that fit the tree; queries that calibrate it; rows of neighbouring leaves that are compared at once; queries compared with them at once.
SAMPLE, CALIBRATION, BLOCK, QUERIES = 20_000, 64, 4096, 256


class Tree:
    """Centres of all nodes; `child[i]` are the first child and the number of children of node i, (0, 0) for a leaf."""

    def __init__(self, x: np.ndarray, branch: int, leaf: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centres, self.child = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [(0, 0)]
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            centres, label = _kmeans(rows, branch, rng)
            if len(centres) < 2:
                continue
            self.child[node] = (len(self.centres), len(centres))
            for j, c in enumerate(centres):
                todo.append((len(self.centres), rows[label == j]))
                self.centres.append(c)
                self.child.append((0, 0))
        self.centres = np.array(self.centres)
        self.leaves = sum(n == 0 for _, n in self.child)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        todo = [0]
        while todo:
            n = todo.pop()
            first, count = self.child[n]
            own = np.flatnonzero(node == n)
            if not count or not len(own):
                continue
            node[own] = first + squared(x[own], self.centres[first : first + count]).argmin(1)
            todo += range(first, first + count)
        return node

    def visit(self, q: np.ndarray):
        """Yields leaves, best bin first: go down to the nearest child, queue the others, go on with the nearest that waits."""
        heap = [(0.0, 0)]
        while heap:
            node = heappop(heap)[1]
            while self.child[node][1]:
                first, count = self.child[node]
                d = ((self.centres[first : first + count] - q) ** 2).sum(1)
                best = int(d.argmin())
                for j in range(count):
                    if j != best:
                        heappush(heap, (float(d[j]), first + j))
                node = first + best
            yield node


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        label = squared(x, centres).argmin(1)
        kept = np.unique(label)
        centres = np.array([x[label == j].mean(0) for j in kept])
    return centres, squared(x, centres).argmin(1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, term by term."""
    out = np.empty((len(q), len(x)))
    for i in range(len(q)):
        out[i] = np.sqrt(((x - q[i]) ** 2).sum(1))
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, branch: int = 8, leaf: int = 64, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, itself left out, nearest first, ties to the smaller id.

    queries: SQL condition on rows.  score: Euclidean distance in double precision.  Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows with a null id; lengths other than the most common one neither.  Rows with one id and one vector are one
    candidate; an id with several vectors has several, and as a query it is one: no row of its own id is a candidate, and each candidate counts at its least
    distance to any of the query's vectors.  Fewer candidates than k: all of them.  No usable rows: an empty result.
    """
    spark = vectors.sparkSession
    folder = workspace(spark, "kmtree")
    cast = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(F.expr(queries), F.lit(False)).alias("q"))
    fine = cast.where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = int(sizes["d"])
    fine = fine.where(F.size("v") == dim)
    # One point for each vector, with the k + 1 smallest ids that carry it: no query needs more of them.  The limit holds in each task before
    # the shuffle, so a vector that a third of all rows carry is never gathered.
    place_of = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    firsts = fine.select("v", "id").distinct().withColumn("n", place_of).where(F.col("n") <= k + 1)
    firsts.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).write.parquet(f"{folder}/points")
    points = spark.read.schema("v array<double>, ids array<long>").parquet(f"{folder}/points")
    # A query is a vector, with the id that asks and how many vectors that has only where it has several: equal vectors of other ids ask once.
    asking = fine.where("q").select(F.col("id").alias("query_id"), "v").distinct()
    several = asking.groupBy("query_id").agg(F.count("*").alias("own_vectors")).where("own_vectors > 1")
    asking = asking.join(several, "query_id", "left").withColumn("own", F.when(F.col("own_vectors") > 1, F.col("query_id")))
    asking.write.parquet(f"{folder}/asking")
    asking = spark.read.schema("query_id long, v array<double>, own_vectors long, own long").parquet(f"{folder}/asking")
    asked = asking.select("v", "own", "own_vectors").distinct()
    total = points.count()
    fit_rows = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE)
    sample = fit_rows.toArrow()
    x = _matrix(sample.column("v").combine_chunks(), dim)
    target = max(4, int(leaf * min(1.0, len(x) / max(total, 1))))
    tree = spark.sparkContext.broadcast(Tree(x, branch, target, seed))  # SAMPLE rows at most
    del sample, x

    def place(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(tree.value.descend(_matrix(batch.column(0), dim)), pa.int64()), *batch.columns], names=["leaf", "v", "ids"])

    points.mapInArrow(place, "leaf long, v array<double>, ids array<long>").write.parquet(f"{folder}/index")
    index = spark.read.schema("leaf long, v array<double>, ids array<long>").parquet(f"{folder}/index")
    counts = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf: bounded by SAMPLE
    trial = asked.select("v").distinct().orderBy(F.xxhash64("v")).limit(CALIBRATION).toArrow()
    trial = _matrix(trial.column("v").combine_chunks(), dim) if trial.num_rows else np.zeros((0, dim))
    visits = _calibrate(index, trial, tree.value, counts, k, dim, recall)

    groups = _groups(tree.value, counts)
    home = {leaf: (g, parts) for leaf, g, parts in groups}

    def route(batches):
        t = tree.value
        for batch in batches:
            q = _matrix(batch.column(0), dim)
            rows = []
            for i in range(len(q)):
                wanted: dict[tuple[int, int], list[int]] = {}
                for n in _leaves(t, q[i], counts, visits, k + (batch.column(2)[i].as_py() or 0)):
                    wanted.setdefault(home[n], []).append(n)
                rows += [(g, p, i, leaves) for (g, parts), leaves in wanted.items() for p in range(parts)]
            group, part, row, leaves = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(group, pa.int64()), pa.array(part, pa.int32()), batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())), pa.array(leaves, pa.list_(pa.int64()))], names=["group", "part", "v", "own", "leaves"])

    dealt = spark.createDataFrame(groups, "leaf long, group long, parts int")  # one row a leaf
    rows = index.join(F.broadcast(dealt), "leaf").select("group", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "leaf", "v", F.xxhash64("v").alias("point"), "ids")
    sent = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(route, "group long, part int, v array<double>, own long, leaves array<long>")

    def compare(key, left, right):
        x, leaf = _matrix(left.column("v").combine_chunks(), dim), left.column("leaf").to_numpy()
        q, wanted = _matrix(right.column("v").combine_chunks(), dim), right.column("leaves").to_pylist()
        known, of = np.unique(leaf, return_inverse=True)
        ids = left.column("ids").combine_chunks()
        alone, first = np.asarray(pc.list_value_length(ids)) == 1, np.asarray(pc.list_element(ids, 0)) if len(ids) else np.zeros(0, np.int64)
        askers = right.column("own").to_pylist()
        own, at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for lo in range(0, len(q) if len(x) else 0, QUERIES):
            part = q[lo : lo + QUERIES]
            visited = np.zeros((len(part), len(known)), bool)
            for i, leaves in enumerate(wanted[lo : lo + QUERIES]):
                visited[i] = np.isin(known, leaves)
            rough = np.where(visited[:, of], squared(part, x), np.inf)
            for i, asker in enumerate(askers[lo : lo + QUERIES]):
                if asker is not None:
                    rough[i, alone & (first == asker)] = np.inf
            # Products of matrices are rough in the last digits: what is near the limit is measured exactly.
            limit = np.partition(rough, k, axis=1)[:, k] if rough.shape[1] > k + 1 else np.full(len(part), np.inf)
            slack = 1e-9 * ((part * part).sum(1) + (x * x).sum(1).max())
            for i in range(len(part)):
                near = np.flatnonzero((rough[i] <= limit[i] + slack[i]) & np.isfinite(rough[i]))
                own.append(np.full(len(near), lo + i))
                at.append(near)
                far.append(exact(part[i : i + 1], x[near])[0])
        rows, places = pa.array(np.concatenate(own), pa.int64()), pa.array(np.concatenate(at), pa.int64())
        return pa.table({"v": right.column("v").combine_chunks().take(rows), "own": right.column("own").combine_chunks().take(rows), "d": np.concatenate(far), "point": left.column("point").combine_chunks().take(places), "ids": ids.take(places)})

    near = rows.groupBy("group", "part").cogroup(sent.groupBy("group", "part")).applyInArrow(compare, "v array<double>, own long, d double, point long, ids array<long>")
    pairs = near.select("v", "own", "point", F.explode("ids").alias("vec_id"), "d").where("own IS NULL OR own <> vec_id")
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id", "point"))), 1, k + 1)
    found = pairs.groupBy("v", "own").agg(best.alias("best"))  # k + 1 rows from each block visited
    mine = asking.join(found.withColumnRenamed("v", "fv").withColumnRenamed("own", "fown"), (F.col("v") == F.col("fv")) & F.col("own").eqNullSafe(F.col("fown")))
    mine = mine.select("query_id", F.explode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)).alias("b"))
    # The vectors of one id find the same candidates: each candidate counts once, at its least distance.
    once = mine.groupBy("query_id", "b.vec_id", "b.point").agg(F.min("b.d").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _groups(tree: Tree, counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(leaf, group, parts): neighbouring leaves in groups of about BLOCK rows; a larger leaf is a group of its own, dealt out in parts."""
    order, todo = [], [0]
    while todo:
        n = todo.pop()
        first, count = tree.child[n]
        if count:
            todo += reversed(range(first, first + count))
        elif n in counts:
            order.append(n)
    out, group, held = [], 0, 0
    for leaf in order:
        if held and held + counts[leaf] > BLOCK:
            group, held = group + 1, 0
        out.append((leaf, group, max(1, -(-counts[leaf] // BLOCK))))
        held += counts[leaf]
    return out


def _leaves(tree: Tree, q: np.ndarray, counts: dict[int, int], visits: int, k: int):
    """The first `visits` leaves that hold rows, and more until they hold k + 1."""
    seen = rows = 0
    for n in tree.visit(q):
        if n in counts:
            yield n
            seen += 1
            rows += counts[n]
            if seen >= visits and rows > k:
                return


def _calibrate(index: DataFrame, trial: np.ndarray, tree: Tree, counts: dict[int, int], k: int, dim: int, recall: float) -> int:
    """Leaves to visit for the wanted recall, from the exact neighbours of the calibration queries among all rows."""
    if not len(trial):
        return 1

    def scan(batches):
        for batch in batches:
            d = exact(trial, _matrix(batch.column(1), dim))
            leaf = batch.column(0).to_numpy(zero_copy_only=False)
            own, far, at = [], [], []
            for i in range(len(trial)):
                near = np.argsort(d[i], kind="stable")[: k + 1]
                own += [i] * len(near)
                far.append(d[i][near])
                at.append(leaf[near])
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array(np.concatenate(far)), pa.array(np.concatenate(at), pa.int64())], names=["i", "d", "leaf"])

    near = index.select("leaf", "v").mapInArrow(scan, "i int, d double, leaf long")
    rows = near.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "leaf"))), 2, k).alias("near")).collect()  # CALIBRATION rows
    need = []
    for r in rows:
        order = {}
        for n in tree.visit(trial[r["i"]]):
            if n in counts:
                order[n] = len(order) + 1
        need += [order[x["leaf"]] for x in r["near"]]
    need.sort()
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))] if need else 1
