"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where the straight distance orders as the cosine does and keeps the triangle
inequality.  Each shard builds a tree over its rows; a block of queries goes through it together, and a subtree is
left out for the queries whose nearest found so far cannot be beaten there.  ``factor`` scales the distance that must
be in the way: 1 is exact, less is faster and may miss some.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brooklog.llm.common import through_table

LEAF = 256
SHARD_ROWS = 20_000
BLOCK_QUERIES = 20_000
#: Against rounding: distances closer than this count as equal, so that ties are all looked at.
SLACK = 1e-7


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of equal rows, in double precision, added up in the order of the dimensions.

    Equal vectors give equal results wherever they stand, and the same as a plain loop.
    """

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1]

    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


class Tree:
    """A tree over unit vectors; nodes are (vantage point, inner radius, outer radius, inside, outside) or leaves."""

    def __init__(self, unit: np.ndarray) -> None:
        self.unit = unit
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF:
            return (rows,)
        # The vantage point: of a few rows that from which the others' distances spread most.
        tries = rows[:: max(1, len(rows) // 5)][:5]
        sample = self.unit[rows[:: max(1, len(rows) // 500)]]
        point = max(tries.tolist(), key=lambda r: np.linalg.norm(sample - self.unit[r], axis=1).std())
        away = np.linalg.norm(self.unit[rows] - self.unit[point], axis=1)
        order = np.argsort(away, kind="stable")
        rows, away = rows[order], away[order]
        half = len(rows) // 2
        if away[0] == away[-1]:
            return (rows,)
        return (point, float(away[half - 1]), float(away[half]), self._build(rows[:half]), self._build(rows[half:]))


class Search:
    """The nearest ``k`` of a tree for a block of queries."""

    def __init__(self, tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.vectors, self.ids, self.queries, self.query_ids, self.k, self.factor = tree, vectors, ids, queries, query_ids, k, factor
        self.unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        self.found: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        self.limit = np.full(len(query_ids), np.inf)
        if len(query_ids) and len(ids):
            self._visit(tree.root, np.arange(len(query_ids)))

    def _visit(self, node: tuple, active: np.ndarray) -> None:
        if not len(active):
            return
        if len(node) == 1:
            self._leaf(node[0], active)
            return
        point, inner, outer, inside, outside = node
        away = np.linalg.norm(self.unit[active] - self.tree.unit[point], axis=1)
        near = away <= (inner + outer) / 2
        self._visit(inside, active[near])
        self._visit(outside, active[~near])
        # The other side is at least this far: everything inside is within inner, everything outside beyond outer.
        self._visit(outside, active[near][self.factor * (outer - away[near]) <= self.limit[active[near]] + SLACK])
        self._visit(inside, active[~near][self.factor * (away[~near] - inner) <= self.limit[active[~near]] + SLACK])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            for b in range(0, len(active), 1024):
                some = active[b : b + 1024]
                squares = np.maximum(2 - 2 * (self.unit[some] @ self.tree.unit[part].T), 0)
                bound = (self.limit[some] + SLACK) ** 2 + SLACK
                q, r = np.nonzero(squares <= bound[:, None])
                keep = self.ids[part[r]] != self.query_ids[some[q]]
                q, r = some[q[keep]], part[r[keep]]
                if len(q):
                    self._take(q, r, cosine(self.queries[q], self.vectors[r]))

    def _take(self, q: np.ndarray, r: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((self.ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        first = rank < self.k
        for i, row, s in zip(q[first].tolist(), r[first].tolist(), score[first].tolist(), strict=True):
            self.found[i].append((-s, int(self.ids[row])))
        for i in np.unique(q).tolist():
            best = sorted(self.found[i])[: self.k]
            self.found[i] = best
            if len(best) == self.k:
                self.limit[i] = np.sqrt(max(0.0, 2 + 2 * best[-1][0]))


def first_of_equals(vectors: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only the ``most`` smallest ids (given in order): further ones are never among the nearest."""
    if not len(ids):
        return vectors, ids
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    keep = rank < most
    return vectors[keep], ids[keep]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Only rows whose vector is there, holds finite numbers only, and is not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` rows of ``vectors`` of largest cosine for each row of ``queries`` (fewer if there are fewer).

    Returns ``query_id, rank, vec_id, score``, ties to the smaller id; a row with the query's own id is no candidate.
    Vectors that are null, zero or hold null or non-finite numbers, and rows with a null id, take no part; repeated
    candidates with equal ids count once; vectors of unequal lengths are never neighbours.  Empty tables give no
    rows; other columns are left out.  Rows are spread over shards and queries over blocks of bounded size; each
    pair of shard and block is one task's group, so no group grows with the tables.
    """
    rows = usable(vectors.select(vectors[key].cast("bigint").alias("id"), vectors[vector].cast("array<double>").alias("v")).filter("id is not null"), "v")
    asked = usable(queries.select(queries[key].cast("bigint").alias("id"), queries[vector].cast("array<double>").alias("v")).filter("id is not null"), "v")
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    # Every shard meets every block of queries.
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.dropDuplicates(["id"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.diff(table.column("v").combine_chunks().offsets.to_numpy())
        part = table.filter(pa.array(lengths == dims))
        ids, first = np.unique(part.column("id").to_numpy(), return_index=True)
        values = part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)[first]
        # Scaling by powers of two changes no cosine and keeps squares in range.
        return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True, initial=0))[1]), ids

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, float, int]] = []
        if shard.num_rows and block.num_rows:
            for dims in np.unique(np.diff(block.column("v").combine_chunks().offsets.to_numpy())).tolist():
                v, ids = first_of_equals(*matrix(shard, dims), k + 1)
                q, query_ids = matrix(block, dims)
                if len(ids):
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    for query, found in zip(query_ids.tolist(), Search(Tree(unit), v, ids, q, query_ids, k, factor).found, strict=True):
                        out += [(query, -s, i) for s, i in found]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "score": pa.array(columns[1], pa.float64()), "vec_id": pa.array(columns[2], pa.int64())})

    grid = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = grid.applyInArrow(search, "query_id bigint, score double, vec_id bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Part of the true neighbours (query_id, vec_id) that were found."""
    both = through_table(truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left"), "recall")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


