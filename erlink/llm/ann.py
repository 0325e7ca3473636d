"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a sample of about SAMPLE rows (by a hash of the id) and has leaves for LEAF_ROWS rows each, as far
as the sample has LEAF_SAMPLE of them for each leaf; every row is filed in a leaf. A query walks the tree with a priority
queue, nearest centroid first, and visits leaves in that order. How many it visits is calibrated: for CALIBRATION queries
the true neighbours are found by brute force over all rows, and visits widen until RECALL of them lie in visited leaves.

Neighbouring leaves make a bin of about INDEX_BLOCK rows, the unit that is shipped: a query goes once to each bin it visits,
with the leaves it visits there, and is compared with those leaves' rows alone. A bin that holds more rows, or that more
queries visit, is many blocks. Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erlink.llm.common import map_batches, materialize

SAMPLE = 20_000
CALIBRATION = 200
RECALL = 0.96
LEAF_ROWS, LEAF_SAMPLE = 64, 8
BRANCH = 16
INDEX_BLOCK, QUERY_BLOCK = 4096, 4096
#: Queries compared at once with a leaf.
TILE = 1024


class KMeansTree:
    """Nodes hold centroids; leaves are numbered in order, so that those of one branch are neighbours. rows: what a leaf should hold of x."""

    def __init__(self, x: np.ndarray, rows: int = LEAF_SAMPLE, branch: int = BRANCH, seed: int = 7):
        self.children: list[list[int]] = [[]]
        centres: list[np.ndarray] = [x.mean(0)]
        self.leaf_of: dict[int, int] = {}
        rng, todo = np.random.default_rng(seed), [(0, x)]
        while todo:
            node, held = todo.pop()
            n = min(branch, -(-len(held) // rows))
            parts = self._split(held, n, rng) if n > 1 else []
            if len(parts) < 2:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            for part in parts:
                self.children[node].append(len(centres))
                self.children.append([])
                centres.append(part.mean(0))
            todo += [(child, part) for child, part in zip(reversed(self.children[node]), reversed(parts), strict=True)]
        self.centres = np.stack(centres)
        self.n_leaves = len(self.leaf_of)
        self.leaf_nodes = np.array(sorted(self.leaf_of, key=self.leaf_of.get))
        self._settle(x)

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng, steps: int = 12) -> list[np.ndarray]:
        centres = np.unique(x[rng.choice(len(x), branch, replace=False)], axis=0)
        for _ in range(steps):
            near = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
            centres = np.stack([x[near == k].mean(0) for k in range(len(centres)) if (near == k).any()])
        near = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
        return [x[near == k] for k in range(len(centres)) if (near == k).any()]

    def _settle(self, x: np.ndarray, steps: int = 6) -> None:
        """Moves the leaves' centroids to the rows that are nearest to them among all leaves, and sets those of inner nodes and their radii."""
        for _ in range(steps):
            leaf = self.file(x)
            count = np.bincount(leaf, minlength=self.n_leaves)
            sums = np.zeros((self.n_leaves, x.shape[1]))
            np.add.at(sums, leaf, x)
            held = count > 0
            self.centres[self.leaf_nodes[held]] = sums[held] / count[held, None]
        self.radius = np.zeros(len(self.centres))
        below: dict[int, list[int]] = {}
        for node in reversed(range(len(self.centres))):  # children have greater numbers
            below[node] = [node] if node in self.leaf_of else [leaf for child in self.children[node] for leaf in below[child]]
            if node not in self.leaf_of:
                self.centres[node] = self.centres[below[node]].mean(0)
                self.radius[node] = np.sqrt(((self.centres[below[node]] - self.centres[node]) ** 2).sum(1).max())

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centroid."""
        c = self.centres[self.leaf_nodes]
        half = (c**2).sum(1) / 2
        return np.concatenate([(half - x[lo : lo + TILE] @ c.T).argmin(1) for lo in range(0, len(x), TILE)]).astype(np.int32)

    def queues(self, q: np.ndarray) -> list[list[float]]:
        """Of each query and node, the greatest inner product of the query with a leaf's centroid below the node, at most."""
        return (q @ self.centres.T + np.sqrt((q**2).sum(1))[:, None] * self.radius).tolist()

    def visits(self, near: list[float]):
        """Leaves, best bin first: a queue of nodes by near, their row of queues()."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node in self.leaf_of:
                yield self.leaf_of[node]
            for child in self.children[node]:
                heapq.heappush(queue, (-near[child], child))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def top_pairs(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, index rows and scores of each query's k best in the block, its own id left out; ties to smaller ids.

    seen: which rows each query may see, equal vectors alike; None: all.
    """
    order = np.argsort(x_ids, kind="stable")
    _, same, size = np.unique(np.ascontiguousarray(x[order]).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True, return_counts=True)
    if size.max() > k + 1:  # of equal vectors no more than the k + 1 smallest ids can count
        by = np.argsort(same, kind="stable")
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        order = order[np.sort(by[(np.arange(len(by)) - first[same[by]]) <= k])]
    x, x_ids = x[order], x_ids[order]
    rough = q @ x.T
    rough[q_ids[:, None] == x_ids[None, :]] = -np.inf
    if seen is not None:
        rough[~seen[:, order]] = -np.inf
    n = min(k, len(x_ids))
    bound = np.partition(rough, len(x_ids) - n, axis=1)[:, len(x_ids) - n]
    slack = 1e-12 * np.abs(q).sum(1) * np.abs(x).max()
    qi, xi = np.nonzero((rough >= (bound - slack)[:, None]) & np.isfinite(rough))
    score = np.zeros(len(qi))
    for d in range(x.shape[1]):  # one order of summing, whatever the block
        score += q[qi, d] * x[xi, d]
    best = np.lexsort((x_ids[xi], -score, qi))
    qi, xi, score = qi[best], xi[best], score[best]
    start = np.searchsorted(qi, np.arange(len(q)))
    keep = np.arange(len(qi)) - start[qi] < k
    return qi[keep], order[xi[keep]], score[keep]


def top_in_leaves(q: np.ndarray, q_ids: np.ndarray, leaves: list[list[int]], x: np.ndarray, x_ids: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As top_pairs, but each query sees the rows of its own leaves only. TILE queries at once are compared with the block."""
    names, place = np.unique(leaf, return_inverse=True)
    found = []
    for lo in range(0, len(q), TILE):
        visited = np.zeros((min(TILE, len(q) - lo), len(names) + 1), bool)
        at = np.repeat(np.arange(len(visited)), [len(v) for v in leaves[lo : lo + TILE]])
        wanted = np.concatenate([np.asarray(v, np.int64) for v in leaves[lo : lo + TILE]])
        slot = np.searchsorted(names, wanted)
        visited[at, np.where(names[np.minimum(slot, len(names) - 1)] == wanted, slot, len(names))] = True  # the last: not in this block
        qi, xi, score = top_pairs(q[lo : lo + TILE], q_ids[lo : lo + TILE], x, x_ids, k, visited[:, place])
        found.append((qi + lo, xi, score))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def bins_of(sizes: np.ndarray, block: int) -> np.ndarray:
    """The bin of each leaf: neighbours share one while their rows fit in a block."""
    out, held, at = np.zeros(len(sizes), np.int32), 0, 0
    for leaf, n in enumerate(sizes):
        if held and held + n > block:
            at, held = at + 1, 0
        out[leaf] = at
        held += int(n)
    return out


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, branch: int = BRANCH, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, among all other rows.

    Null and zero vectors, and such with a null or non-finite component or of another length than most (of two equally
    common lengths, the longer), take no part. Rows that share the query's id count as its own; a repeated query row
    counts once; repeated candidates each count. Queries see all candidates if there are fewer than k. An empty table, or
    one without a query, gives no rows. Other columns are not read, so they may have any name. report, if given, takes
    the numbers of rows, leaves and visits and the share of all rows in the visited leaves.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), is_query.alias("is_query"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    rows = rows.where(F.size("v") == dim)

    whole, h = 1_000_000, F.xxhash64("vec_id", F.lit(1))
    sample = rows.where(F.pmod(h, F.lit(whole)) < max(1, whole * SAMPLE // max(n, SAMPLE))).select("vec_id", "v").toArrow()
    if not sample.num_rows:
        sample = rows.select("vec_id", "v").orderBy(h, "vec_id").limit(LEAF_SAMPLE).toArrow()
    x = np.array(sample.column(1).to_pylist(), float)
    x = x[np.lexsort((*x.T[::-1], sample.column(0).to_numpy()))]  # reruns agree
    tree = KMeansTree(x, max(LEAF_SAMPLE, -(-leaf_rows * len(x) // n)), branch)
    shared = spark.sparkContext.broadcast(tree)  # SAMPLE / LEAF_SAMPLE leaves at most

    def file_rows():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.asarray(batch.column(2).flatten(), float).reshape(batch.num_rows, -1)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.file(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "is_query", "leaf", "v"])

        return one

    index = materialize(map_batches(rows, file_rows, "vec_id bigint, is_query boolean, leaf int, v binary"), "ann-index")
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row a leaf
        sizes[r["leaf"]] = r["count"]
    bins = bins_of(sizes, INDEX_BLOCK)
    queries = index.where("is_query").select(F.col("vec_id").alias("query_id"), "v").distinct()

    # Calibration: where do the true neighbours of some queries lie?
    some = queries.orderBy(F.xxhash64("query_id", F.lit(2)), "query_id", "v").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    probe, probe_ids = _matrix(some.column(1)), some.column(0).to_numpy()
    probes = spark.sparkContext.broadcast((probe, probe_ids))

    def exact(batches):
        q, q_ids = probes.value
        for batch in batches:
            if batch.num_rows:
                qi, xi, score = top_pairs(q, q_ids, _matrix(batch.column(2)), batch.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), batch.column(0).take(pa.array(xi)), batch.column(1).take(pa.array(xi)), pa.array(score)], ["q", "vec_id", "leaf", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    truth = index.select("vec_id", "leaf", "v").mapInArrow(exact, "q bigint, vec_id bigint, leaf int, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "leaf").toArrow()
    place, passed = np.empty((2, len(probe), tree.n_leaves), np.int64)
    for i, near in enumerate(tree.queues(probe)):
        order = list(tree.visits(near))
        place[i, order] = np.arange(tree.n_leaves)
        passed[i] = np.cumsum(sizes[order])
    needed = np.sort(place[truth.column(0).to_numpy(), truth.column(1).to_numpy()]) if truth.num_rows else np.zeros(1, np.int64)
    n_visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    if report is not None:
        report |= {"rows": n, "leaves": tree.n_leaves, "bins": int(bins[-1]) + 1, "visits": n_visits, "scanned": float(passed[:, n_visits - 1].mean() / n)}

    def walk():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            tree, at, bin_, leaves = shared.value, [], [], []
            for i, near in enumerate(tree.queues(_matrix(batch.column(1)))):
                seen, mine = 0, {}
                for j, leaf in enumerate(tree.visits(near)):
                    if j >= n_visits and seen > k:
                        break
                    seen += sizes[leaf]
                    mine.setdefault(int(bins[leaf]), []).append(leaf)
                at += [i] * len(mine)
                bin_ += mine
                leaves += mine.values()
            at = pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(bin_, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "v", "bin", "leaves"])

        return one

    walked = materialize(map_batches(queries, walk, "query_id bigint, v binary, bin int, leaves array<int>"), "ann-walks")
    loads = {r["bin"]: r["count"] for r in walked.groupBy("bin").count().collect()}  # a row a bin

    def blocks(counts: dict[int, int], block: int) -> Column:
        case = F.lit(1)
        for at, c in sorted(counts.items()):
            if c > block:
                case = F.when(F.col("bin") == at, -(-c // block)).otherwise(case)
        return case

    n_index, n_query = blocks(dict(enumerate(np.bincount(bins, sizes).astype(int).tolist())), INDEX_BLOCK), blocks(loads, QUERY_BLOCK)
    own_index, own_query = F.pmod(F.xxhash64("vec_id", F.lit(3)), n_index).cast("int"), F.pmod(F.xxhash64("query_id", F.lit(3)), n_query).cast("int")
    left = walked.select("query_id", F.xxhash64("v").alias("q"), "v", "leaves", "bin", own_query.alias("qb"), F.explode(F.sequence(F.lit(0), n_index - 1)).alias("ib"))
    binned = index.withColumn("bin", F.get(F.array(*map(F.lit, bins.tolist())), F.col("leaf")))
    right = binned.select("vec_id", "v", "leaf", "bin", own_index.alias("ib"), F.explode(F.sequence(F.lit(0), n_query - 1)).alias("qb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qi, xi, score = top_in_leaves(_matrix(a.column("v")), a.column("query_id").to_numpy(), a.column("leaves").to_pylist(), _matrix(b.column("v")), b.column("vec_id").to_numpy(), b.column("leaf").to_numpy(), k)
        qi, xi = pa.array(qi), pa.array(xi)
        return pa.table({"query_id": a.column("query_id").take(qi), "q": a.column("q").take(qi), "vec_id": b.column("vec_id").take(xi), "score": pa.array(score)})

    key = ["bin", "ib", "qb"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id bigint, q bigint, vec_id bigint, score double")
    nearest = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
