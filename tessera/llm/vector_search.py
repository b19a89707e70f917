"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and broadcast; every row is filed under its leaf. A query takes leaves from a
priority queue by distance to the nodes' centres; how many it visits is calibrated on the sample against brute force.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.vectors import matrix, usable_rows

#: Documented bounds: rows the tree is fitted on, its leaves, calibration queries, and rows or queries of one search task.
SAMPLE_ROWS, MOST_SAMPLE_ROWS = 20_000, 131_072
MAX_LEAVES = 8192
LEAF_ROWS = 64
CALIBRATION_QUERIES = 400
TASK_ROWS = 16_384
TASK_QUERIES = 2048


@dataclass(frozen=True)
class Tree:
    """centres: one row per node. children: node -> first child and number of them (0: leaf). leaf: leaf number or -1."""

    centres: np.ndarray
    first: np.ndarray
    n: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down to the nearest child until there is none."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.n[node] > 0)
            if len(inner) == 0:
                return self.leaf[node]
            for v in np.unique(node[inner]):
                own = inner[node[inner] == v]
                a, k = self.first[v], self.n[v]
                node[own] = a + _squares(x[own], self.centres[a : a + k]).argmin(axis=1)

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first traversal."""
        queue = [(0.0, 0)]
        while queue:
            _, v = heapq.heappop(queue)
            if self.n[v] == 0:
                yield int(self.leaf[v])
                continue
            a, k = self.first[v], self.n[v]
            gap = ((self.centres[a : a + k] - q) ** 2).sum(axis=1)
            for d, c in zip(gap.tolist(), range(a, a + k)):
                heapq.heappush(queue, (d, c))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _squares(x, centres).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres, _squares(x, centres).argmin(axis=1)


def fit_tree(sample: np.ndarray, leaf_rows: float, branching: int = 8, seed: int = 3) -> Tree:
    """Split nodes by k-means, the fullest first, while they hold more than leaf_rows sample rows and leaves remain."""
    rng = np.random.default_rng(seed)
    centres, first, n = [sample.mean(axis=0)], [0], [0]
    queue, leaves = [(-len(sample), 0, np.arange(len(sample)))], 1
    while queue:
        size, v, rows = heapq.heappop(queue)
        k = min(branching, math.ceil(-size / leaf_rows))
        if k < 2 or leaves + k - 1 > MAX_LEAVES:
            continue
        c, at = _means(sample[rows], k, rng)
        used = np.unique(at)
        if len(used) < 2:  # copies of one vector
            continue
        first[v], n[v] = len(centres), len(used)
        leaves += len(used) - 1
        for u in used:
            own = rows[at == u]
            heapq.heappush(queue, (-len(own), len(centres), own))
            centres.append(c[u])
            first.append(0)
            n.append(0)
    n_ = np.array(n)
    leaf = np.where(n_ == 0, np.cumsum(n_ == 0) - 1, -1)
    return Tree(np.array(centres), np.array(first), n_, leaf)


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, seed: int = 4) -> int:
    """Fewest leaf visits that find `recall` of the k nearest of sample queries, by brute force over the sample."""
    rng = np.random.default_rng(seed)
    filed, needed = tree.file(sample), []
    different = np.unique(sample, axis=0, return_index=True)[1]  # copies of one vector find each other in a single visit
    for q in rng.choice(different, min(CALIBRATION_QUERIES, len(different)), replace=False):
        near = _squares(sample[q : q + 1], sample)[0]
        near[q] = np.inf
        rank = np.empty(tree.leaves, np.int64)
        rank[list(tree.best_bins(sample[q]))] = np.arange(tree.leaves)
        needed += rank[filed[np.argsort(near)[: min(k, len(sample) - 1)]]].tolist()
    return int(np.quantile(needed, recall, method="higher")) + 1 if needed else tree.leaves


def _best(q: np.ndarray, x: np.ndarray, qid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of at least the k rows nearest to each query, never the query's own id.

    Squares of distances by one product pick the rows, with room for its rounding; those rows' distances are then exact.
    """
    rough = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :]
    room = 1e-10 * rough.max(initial=0.0)
    rough = np.where(qid[:, None] == ids[None, :], np.inf, rough - 2 * q @ x.T)
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if rough.shape[1] > k else np.full((len(q), 1), np.inf)
    i, j = np.nonzero((rough <= cut + room) & (rough < np.inf))
    score = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        gap = x[j[a : a + (1 << 16)]] - q[i[a : a + (1 << 16)]]
        score[a : a + (1 << 16)] = np.sqrt((gap * gap).sum(axis=1))
    return _first(qid[i], ids[j], score, k)


def _first(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k smallest scores, ties by id."""
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[place < k], ids[place < k], score[place < k]


def _nearest(k: int):
    """Queries and rows of some leaves -> each query's k nearest of the rows in its leaves."""

    def run(_key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            by_leaf = dict(tuple(rows.groupby("leaf")))
            for leaf, asked in queries.groupby("leaf"):
                if (own := by_leaf.get(leaf)) is not None:
                    found.append(_best(matrix(asked["embedding"]), matrix(own["embedding"]), asked["query_id"].to_numpy(), own["vec_id"].to_numpy(), k))
        query, ids, score = (np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), _first(query, ids, score, k))))

    return run


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`.

    Candidates are all other rows; score is the Euclidean distance in double precision, ties go to the smaller id. A query
    visits the calibrated number of leaves and goes on until they hold more than k rows, so it gets k rows or all there are.
    Rows without id, null or zero vectors and vectors with null or non-finite components take no part; vectors of different
    lengths aren't compared. The commonest length and all of more than TASK_ROWS rows have a tree each, the others are searched
    exactly, one length in a task. Repeated rows are candidates each; an id is never its own candidate. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    fit = usable_rows(vectors, id_col, vector_col)
    size = F.size("embedding")
    lengths = dict(fit.groupBy(size).count().collect())  # one row a length
    if not lengths:
        return spark.createDataFrame([], schema)
    commonest = min(lengths, key=lambda d: (-lengths[d], d))
    treed = [commonest, *sorted(d for d, n in lengths.items() if n > TASK_ROWS and d != commonest)]
    found = _by_tree(fit.filter(size == commonest), lengths[commonest], every, k, recall)
    for d in treed[1:]:
        found = found.unionByName(_by_tree(fit.filter(size == d), lengths[d], every, k, recall))
    if len(treed) < len(lengths):
        rest = fit.filter(~size.isin(treed))
        rows = rest.select("vec_id", "embedding", size.alias("d"), F.lit(0).alias("leaf"))
        asked = rest.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding"), size.alias("d"), F.lit(0).alias("leaf"))
        found = found.unionByName(asked.groupBy("d").cogroup(rows.groupBy("d")).applyInPandas(_nearest(k), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_tree(fit: DataFrame, total: int, every: int, k: int, recall: float) -> DataFrame:
    """query_id, vec_id, score: at least the k nearest found by a tree over rows of one length, before they are ranked."""
    spark = fit.sparkSession
    leaves = min(MAX_LEAVES, max(1, total // LEAF_ROWS))
    wanted = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, 16 * leaves))
    share = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / total) * (1 << 30)))
    drawn = [r[0] for r in fit.filter(share).select("embedding").limit(wanted + wanted // 4).collect()]
    sample = matrix(drawn if drawn else [fit.first()["embedding"]])
    tree = fit_tree(sample, max(2.0, len(sample) / leaves))
    visits = calibrate(tree, sample, k, recall)
    shipped = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES * 2 centres

    def file(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=shipped.value.file(matrix(pdf["embedding"])))

    filed = stored(fit.mapInPandas(file, "vec_id long, embedding array<float>, leaf int"), "leaves")
    held = dict(filed.groupBy("leaf").count().collect())  # one row a leaf

    def traverse(batches):
        for pdf in batches:
            out = []
            for q, v in zip(pdf["vec_id"], pdf["embedding"]):
                rows = 0
                for at, leaf in enumerate(shipped.value.best_bins(np.asarray(v, np.float64))):
                    if at >= visits and rows > k:
                        break
                    if held.get(leaf):
                        out.append((q, leaf, v))
                        rows += held[leaf]
            yield pd.DataFrame(out, columns=["query_id", "leaf", "embedding"])

    asked = filed.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding")
    asked = stored(asked.mapInPandas(traverse, "query_id long, leaf int, embedding array<float>"), "asked")
    # leaves are dealt out in groups of about TASK_ROWS rows, so that a query's best of several leaves is settled in a task; a group
    # whose leaves have more rows or visitors is dealt out in parts. Leaves that no query visits drop out.
    visitors = dict(asked.groupBy("leaf").count().collect())
    groups, rows_in = 0, 0
    dealt = []
    for leaf in sorted(visitors):
        if rows_in and rows_in + held[leaf] > TASK_ROWS:
            groups, rows_in = groups + 1, 0
        rows_in += held[leaf]
        dealt.append((leaf, groups, -(-held[leaf] // TASK_ROWS), -(-visitors[leaf] // TASK_QUERIES)))
    row_side, query_side = (F.broadcast(spark.createDataFrame(dealt, "leaf int, bunch int, row_parts int, query_parts int")) for _ in range(2))
    rows = (
        filed.join(row_side, "leaf")
        .withColumn("row_part", F.pmod(F.xxhash64("vec_id"), F.col("row_parts")))
        .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    )
    asked = (
        asked.join(query_side, "leaf")
        .withColumn("row_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_parts").cast("long") - 1)))
        .withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int"))
    )
    key = ["bunch", "row_part", "query_part"]
    return asked.groupBy(*key).cogroup(rows.select("vec_id", "embedding", "leaf", *key).groupBy(*key)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
