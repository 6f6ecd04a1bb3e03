"""Hard negatives by inner product, found in cover trees over norm-augmented candidates.

A vector gets one more dimension that brings all candidates of a shard to one length; then the straight distance to an
anchor (which has 0 there) tells the inner product, and the triangle inequality holds.  A cover tree halves the
covering radius from level to level; a node's centre and radius bound the inner products of all its points from above
and below.  Anchors go down best bound first: nodes outside the wanted window of scores, or under the last place, are
skipped, and the points of leaves are verified in whole numbers.  A leaf meets all anchors that want it in one product.

Rows are dealt over shards, and each shard is one run of one partition, sorted so that its candidates come first and
all anchors follow in a stream: its tree is built once, and a task holds one shard and one batch of anchors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brooklog.llm.common import through_table

LEAF = 64
#: Children of a node at most, and points of a child at least.  Points that no child's radius covers go to the nearest
#: child, whose radius is then larger.
FAN, LEAST = 32, 16
#: Shards are few enough that each is worth a tree, and never larger than ``SHARD_ROWS``.
SHARD_SHARE, SHARD_ROWS = 256, 200_000
#: Anchors that go down a tree together.
BLOCK = 1024
#: Against rounding of distances, as a part of the lengths.
SLACK = 1e-6

NO_LOW, NO_HIGH = -(2**63), 2**63 - 1


def first_members(point: np.ndarray, label: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows that can ever be found: of those with one vector and one label the ``most`` smallest ids."""
    order = np.lexsort((ids, label, point))
    new = np.append(True, (np.diff(point[order]) != 0) | (np.diff(label[order]) != 0))
    begin = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < most]


class CoverTree:
    """A tree over the different vectors of a shard; ``members`` are the rows that hold them."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, most: int) -> None:
        rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, point = np.unique(rows, return_index=True, return_inverse=True)
        kept = first_members(point, labels, ids, most)
        self.vectors, self.labels, self.ids = vectors[first], labels[kept], ids[kept]
        self.member_at = np.searchsorted(point[kept], np.arange(len(first) + 1))
        self.largest = int(np.abs(self.vectors.astype(object)).max()) if vectors.size else 0
        self.x = self.vectors.astype(float)
        squares = np.einsum("ij,ij->i", self.x, self.x)
        self.square = float(squares.max(initial=0))
        self.augmented = np.sqrt(np.maximum(self.square - squares, 0))
        self._build()

    def _away(self, points: np.ndarray, centre: int) -> np.ndarray:
        gap = self.x[points] - self.x[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.augmented[points] - self.augmented[centre]) ** 2)

    def _build(self) -> None:
        """Nodes in order of level; the children of a node are neighbours, and so are the points of a leaf."""
        centres, radii, children, leaves = [0], [0.0], [(0, 0)], [(0, 0)]
        order, filled = np.zeros(len(self.x), np.int64), 0
        waiting = [(0, np.arange(len(self.x)), self._away(np.arange(len(self.x)), 0))]
        for node, points, away in waiting:  # grows while it is read
            radii[node] = float(away.max())
            if len(points) <= LEAF or not radii[node]:
                order[filled : filled + len(points)] = points
                leaves[node] = (filled, filled + len(points))
                filled += len(points)
                continue
            nearest, child, chosen = away.copy(), np.zeros(len(points), np.int64), [centres[node]]
            while nearest.max() > radii[node] / 2 and len(chosen) < FAN:
                chosen.append(int(points[nearest.argmax()]))
                other = self._away(points, chosen[-1])
                closer = other < nearest
                nearest[closer], child[closer] = other[closer], len(chosen) - 1
            large = np.flatnonzero(np.bincount(child, minlength=len(chosen)) >= LEAST)
            if len(large) < 2:
                # One crowd and strays: the nearer half stays with the centre, the farther half goes to its farthest point.
                half = np.argsort(away, kind="stable")[len(points) // 2 :]
                chosen, child = [centres[node], int(points[half[-1]])], np.zeros(len(points), np.int64)
                child[half] = 1
                nearest = np.where(child == 0, away, self._away(points, chosen[1]))
            elif len(large) < len(chosen):
                chosen = [chosen[i] for i in large.tolist()]
                apart = np.stack([self._away(points, c) for c in chosen])
                child = apart.argmin(axis=0)
                nearest = apart[child, np.arange(len(points))]
            children[node] = (len(centres), len(centres) + len(chosen))
            for i, centre in enumerate(chosen):
                mine = child == i
                waiting.append((len(centres), points[mine], nearest[mine]))
                centres.append(centre)
                radii.append(0.0)
                children.append((0, 0))
                leaves.append((0, 0))
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.child_at, self.child_to = np.array(children).T
        self.leaf_at, self.leaf_to = np.array(leaves).T
        self.order = order
        self.leaves = np.flatnonzero(self.leaf_to > self.leaf_at)

    def reach(self, queries: np.ndarray) -> int:
        """No inner product with queries is larger."""
        return int(np.abs(queries.astype(object)).max(initial=0)) * self.largest * max(1, queries.shape[1])

    def dots(self, points: np.ndarray, queries: np.ndarray, reach: int) -> np.ndarray:
        """Inner products (point, query) in whole numbers; what is beyond 64 bits becomes the largest or smallest of them."""
        if reach < 2**53:
            return (self.x[points] @ queries.T.astype(float)).astype(np.int64)
        if reach < 2**63:
            return self.vectors[points] @ queries.T
        exact = self.vectors[points].astype(object) @ queries.T.astype(object)
        return np.clip(exact, NO_LOW, NO_HIGH).astype(np.int64)


class Descent:
    """The first ``k`` members in the windows of a block of queries, of the same or of other labels."""

    def __init__(self, tree: CoverTree, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.tree, self.queries, self.labels, self.own, self.low, self.high, self.k, self.same = tree, queries, labels, own, low, high, k, same
        self.x = queries.astype(float)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        # A bound that says "none" must not stop scores beyond 64 bits.
        self.least, self.most = np.where(low == NO_LOW, -np.inf, low - 1.0), np.where(high == NO_HIGH, np.inf, high + 1.0)
        self.limit = np.full(len(queries), NO_LOW)
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)  # query, score, id: in order of query, falling score, id
        if len(queries):
            self.reach = tree.reach(queries)
            self._descend()

    def _bounds(self, nodes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all inner products of queries with the points under nodes (query, node), at least and at most."""
        tree = self.tree
        both = tree.square + self.square[q][:, None]
        away = np.sqrt(np.maximum(both - 2 * (self.x[q] @ tree.x[tree.centre[nodes]].T), 0))
        slack = SLACK * np.sqrt(both)
        near, far = np.maximum(away - tree.radius[nodes] - slack, 0), away + tree.radius[nodes] + slack
        return (both - far**2) / 2, (both - near**2) / 2

    def _descend(self) -> None:
        """Down the levels, for each query only below nodes that may hold scores in its window; then the leaves that are
        left, best bound first, as long as they may hold a score over the last place."""
        tree = self.tree
        best = np.full((len(self.x), len(tree.leaves)), -np.inf)
        place = np.full(len(tree.centre), -1)
        place[tree.leaves] = np.arange(len(tree.leaves))
        everyone = np.arange(len(self.x))
        level = [(np.array([0]), everyone)]
        while level:
            below = []
            for nodes, q in level:
                least, most = self._bounds(nodes, q)
                inside = (most >= self.least[q][:, None] - SLACK * np.abs(most)) & (least <= self.most[q][:, None] + SLACK * np.abs(least))
                for i, child in enumerate(nodes.tolist()):
                    some = inside[:, i]
                    if not some.any():
                        continue
                    if place[child] >= 0:
                        best[q[some], place[child]] = most[some, i]
                    else:
                        below.append((np.arange(tree.child_at[child], tree.child_to[child]), q[some]))
            level = below
        order = np.argsort(-best, axis=1, kind="stable")
        start, step = 0, 1
        while start < order.shape[1]:
            rank = order[:, start : start + step]
            bound = np.take_along_axis(best, rank, axis=1)
            limit = np.where(self.limit == NO_LOW, -np.inf, self.limit - 1.0)[:, None]
            open_ = (bound > -np.inf) & (bound >= limit - SLACK * np.abs(bound))
            if not open_.any():
                break
            q, at = np.nonzero(open_)
            self._verify(q, tree.leaves[rank[q, at]])
            start, step = start + step, 2 * step

    def _verify(self, q: np.ndarray, leaves: np.ndarray) -> None:
        """Exact scores of queries with the points of leaves; each leaf meets all its queries at once."""
        tree, found = self.tree, []
        by_leaf = np.argsort(leaves, kind="stable")
        q, leaves = q[by_leaf], leaves[by_leaf]
        cuts = np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(leaves)], strict=True):
            some, points = q[a:b], tree.order[tree.leaf_at[leaves[a]] : tree.leaf_to[leaves[a]]]
            score = tree.dots(points, self.queries[some], self.reach)
            fit = (score >= np.maximum(self.low[some], self.limit[some])) & (score <= self.high[some])
            p, i = np.nonzero(fit)
            found.append((some[i], points[p], score[p, i]))
        q, points, score = (np.concatenate(c) for c in zip(*found, strict=True))
        counts = tree.member_at[points + 1] - tree.member_at[points]
        ends = np.cumsum(counts)
        members = np.arange(ends[-1] if len(ends) else 0) + np.repeat(tree.member_at[points] - (ends - counts), counts)
        q, score = np.repeat(q, counts), np.repeat(score, counts)
        fit = ((tree.labels[members] == self.labels[q]) == self.same) & (tree.ids[members] != self.own[q])
        if not fit.any():
            return
        q, score, ids = (np.concatenate([old, new]) for old, new in zip(self.found, (q[fit], score[fit], tree.ids[members][fit]), strict=True))
        # Falling scores without changing their sign, which the smallest number would not stand.
        order = np.lexsort((ids, ~score, q))
        q, score, ids = q[order], score[order], ids[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        first = rank < self.k
        self.found = (q[first], score[first], ids[first])
        last = rank == self.k - 1
        self.limit[q[last]] = score[last]


def matrix(values: pa.Array, dims: int) -> np.ndarray:
    return values.flatten().to_numpy().reshape(-1, dims)


def search(rows: DataFrame, asked: DataFrame, k: int, same: bool, most: int, shards: int) -> DataFrame:
    """(anchor, window, id, score): in every shard the first ``k`` rows in each window of each anchor.

    ``rows`` are (id, label, v), ``asked`` (id, label, v, lows, highs) with a pair of bounds per window.
    """
    none = F.lit(None).cast("array<bigint>")
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "label", "v", none.alias("lows"), none.alias("highs"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    copies = asked.select(every, F.lit(1).alias("kind"), "id", "label", "v", "lows", "highs")
    stream = dealt.unionByName(copies).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], None

        def tree_of(dims: int) -> CoverTree | None:
            table = pa.Table.from_batches(held)
            v = table.column("v").combine_chunks()
            fit = pa.array(np.diff(v.offsets.to_numpy()) == dims)
            table = table.filter(fit)
            if not table.num_rows:
                return None
            return CoverTree(matrix(table.column("v").combine_chunks(), dims), table.column("label").to_numpy(), table.column("id").to_numpy(), most)

        def found(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lengths = np.diff(block.column("v").offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                if dims not in trees:
                    trees[dims] = tree_of(dims) if held else None
                tree = trees[dims]
                if tree is None:
                    continue
                part = block.filter(pa.array(lengths == dims))
                windows = np.diff(part.column("lows").offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), windows)
                window = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                low, high = part.column("lows").flatten().to_numpy(), part.column("highs").flatten().to_numpy()
                descent = Descent(tree, matrix(part.column("v"), dims)[row], labels[row], ids[row], low, high, k, same)
                q, score, other = descent.found
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[q]]), pa.array(window[q], pa.int32()), pa.array(other), pa.array(score)], names=["anchor", "window", "id", "score"])

        for batch in batches:
            keys = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                here, kind = divmod(int(keys[a]), 2)
                if here != shard:
                    shard, held, trees = here, [], {}
                part = pa.RecordBatch.from_pydict({n: batch.column(i).slice(a, b - a) for i, n in enumerate(batch.schema.names) if i > 1})
                if kind == 0:
                    held.append(part)
                else:
                    for start in range(0, part.num_rows, BLOCK):
                        yield from found(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.slice(start, BLOCK).columns], names=part.schema.names))

    return stream.mapInArrow(run, "anchor bigint, window int, id bigint, score bigint")


def foremost(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of all shards, numbered from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vectors: DataFrame, vector: str, label: str, key: str, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, their components as whole numbers; one row per id."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[key].cast("bigint").alias("id"), vectors[label].cast("bigint").alias("label"), vectors[vector].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))
    one = rows.select("id", F.struct("label", whole.alias("v")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return one.select("id", "row.label", "row.v")


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, scale: int = 256,
    vector: str = "embedding", label: str = "label", key: str = "vec_id",
) -> DataFrame:
    """Hard negatives of the anchors: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` are the ids (column ``key``) of rows of ``vectors`` that take part.  A score is the inner product of
    two vectors whose components x became floor(scale * x); higher ones come first, ties by the smaller id.  The
    positives of an anchor are its first other rows of its label; for each, the negatives are the first rows of other
    labels with lowest * positive score <= 100 * score <= highest * positive score.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; of rows with
    one id the one with the smallest label, then vector, does; vectors of unequal lengths are never compared; an
    anchor without positives, and a positive without negatives, give no rows; empty tables give none; other columns
    are left out.  Scores are exact up to 64 bits and stop at their bounds beyond.
    """
    rows = through_table(usable(vectors, vector, label, key, scale), "mining-rows")
    n = rows.count()
    shards = max(1, math.ceil(math.sqrt(n / SHARD_SHARE)), math.ceil(n / SHARD_ROWS))
    asked = through_table(rows.join(anchors.select(anchors[key].cast("bigint").alias("id")).distinct(), "id", "left_semi"), "mining-anchors")
    most = max(positives, negatives) + 1
    no_window = [F.array(F.lit(bound).cast("bigint")).alias(name) for bound, name in ((NO_LOW, "lows"), (NO_HIGH, "highs"))]
    near = through_table(foremost(search(rows, asked.select("*", *no_window), positives, True, most, shards), positives), "mining-positives")
    # Windows in order of the positive's rank; whole bounds: not under the lowest, not over the highest share.
    score = lambda p: p["score"].cast("decimal(38,0)")
    window = near.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("near"))
    windows = window.select(
        "id",
        F.transform("near", lambda p: F.ceil(score(p) * lowest / 100).cast("bigint")).alias("lows"),
        F.transform("near", lambda p: F.floor(score(p) * highest / 100).cast("bigint")).alias("highs"),
    )
    far = foremost(search(rows, asked.join(windows, "id"), negatives, False, most, shards), negatives)
    positive = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(positive, ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
