"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample: each inner node splits its sample at
the median along the difference of two random points. Every row is indexed,
under the leaf it reaches in each tree. A query walks all trees through one
shared priority queue, always opening the branch with the best margin so far,
until the leaves it took hold its share of the rows. The rows of those leaves
are scored exactly, and the best of all leaves remain.

Leaves hold as many rows as the data puts there. So each is dealt into blocks
of bounded size; a block sees all queries that chose the leaf, in bounded
chunks, and a leaf that a third of the rows share only has more blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.llm.common import materialise


def usable(vector: Column, zero: bool) -> Column:
    """True for vectors without null or non-finite components; zero: also for those without a length."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = vector.isNotNull() & ~F.coalesce(odd, F.lit(True))
    return F.coalesce(good if zero else good & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_per_id(vectors: DataFrame, zero: bool) -> DataFrame:
    """The usable rows (vec_id, embedding), of a repeated id that with the smallest vector."""
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), zero))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


@dataclass
class Tree:
    """Inner node i: normals[i], offsets[i], children[i] = (not above, above); ~k is leaf k."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    shares: np.ndarray  # of the sample, by leaf

    @classmethod
    def fit(cls, sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
        normals, offsets, children, shares = [], [], [], []

        def grow(at: np.ndarray) -> int:
            if len(at) > leaf:
                a, b = sample[rng.choice(at, 2, replace=False)]
                side = sample[at] @ (a - b)
                cut = float(np.median(side))
                above = side > cut
                if above.any():
                    i = len(normals)
                    normals.append(a - b)
                    offsets.append(cut)
                    children.append((0, 0))
                    children[i] = (grow(at[~above]), grow(at[above]))
                    return i
            shares.append(len(at) / max(1, len(sample)))
            return ~(len(shares) - 1)

        grow(np.arange(len(sample)))
        return cls(np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(shares))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.normals) else ~0, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            above = np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.offsets[node]
            at[inner] = self.children[node, above.astype(int)]
        return ~at


@dataclass
class Forest:
    trees: list[Tree]

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, leaf: int, seed: int = 7) -> Forest:
        return cls([Tree.fit(sample, leaf, np.random.default_rng([seed, t])) for t in range(trees)])

    def choose(self, x: np.ndarray, share: float) -> list[list[tuple[int, int]]]:
        """Per row the (tree, leaf) pairs taken from the shared queue until their shares of the rows add up to `share`."""
        margins = [(x @ t.normals.T - t.offsets) / np.maximum(np.linalg.norm(t.normals, axis=1), 1e-12) if len(t.normals) else np.zeros((len(x), 0)) for t in self.trees]
        chosen = []
        for r in range(len(x)):
            queue = [(-np.inf, t, 0 if len(tree.normals) else ~0) for t, tree in enumerate(self.trees)]
            heapq.heapify(queue)
            taken, held = [], 0.0
            while queue and held < share:
                bound, t, node = heapq.heappop(queue)
                if node < 0:
                    taken.append((t, ~node))
                    held += self.trees[t].shares[~node]
                    continue
                m = margins[t][r, node]
                low, high = self.trees[t].children[node]
                heapq.heappush(queue, (max(bound, m), t, int(low)))
                heapq.heappush(queue, (max(bound, -m), t, int(high)))
            chosen.append(taken)
        return chosen


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled with zeros, longer ones fail."""
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    trees: int = 4,
    share: float = 1.5,
    leaves: int = 64,
    sample_rows: int = 16_384,
    block_rows: int = 4_096,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` holds, its k nearest rows by cosine.

    vectors: (vec_id, embedding). share: the rows that a query scores, counted
    once per tree, as a multiple of all rows. The sample for the forest is the
    sample_rows rows of the smallest hash. Vectors that are null, zero or hold
    null or non-finite components, and rows without an id, take no part;
    shorter vectors count as filled with zeros. Of rows that repeat an id the
    smallest vector counts. Fewer rows than k give all of them; no rows, none.
    """
    spark = vectors.sparkSession
    rows = materialise(one_per_id(vectors, zero=False), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n, width = facts["n"], facts["width"] or 1
    # a bound on the hash lets about twice the sample through, however many tasks there are
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    some = rows.where(h < int((1 << 40) * min(1.0, 2 * sample_rows / max(1, n)))).orderBy(h, "vec_id").limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks()
    sample = matrix(some, width) if len(some) else np.zeros((0, width))
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    forest = Forest.fit(sample, trees, max(8, -(-len(sample) // leaves)))
    leaves = max(len(t.shares) for t in forest.trees)  # halving gives up to twice as many
    blocks = max(1, -(-n // (leaves * block_rows)))
    number = max(1, trees * leaves * blocks)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree: the leaf and the block of it that the candidate lies in."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), width)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            block = batch.column(2).to_numpy() % blocks
            for t, tree in enumerate(forest.trees):
                key = (t * leaves + tree.leaf_of(unit)) * blocks + block
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(x), bool)), batch.column(0), batch.column(1)], ["key", "asks", "id", "embedding"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of each leaf that the query takes."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), width)
            taken = forest.choose(x / np.linalg.norm(x, axis=1, keepdims=True), share)
            pairs = [(r, (t * leaves + leaf) * blocks + b) for r, some in enumerate(taken) for t, leaf in some for b in range(blocks)]
            for at in range(0, len(pairs), 20_000):
                own, key = np.array(pairs[at : at + 20_000], np.int64).T
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(len(own), bool)), batch.column(0).take(own), batch.column(1).take(own)], ["key", "asks", "id", "embedding"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, candidates before queries: one block and one batch of queries are held."""
        key, held = None, []
        ids = x = None
        for batch in batches:
            keys, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(keys) | np.diff(asks.astype(np.int8))) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    key, held, ids = keys[a], [], None
                part = batch.column(2).slice(a, b - a).to_numpy(), matrix(batch.column(3).slice(a, b - a), width)
                if not asks[a]:
                    held.append(part)
                elif held:
                    if ids is None:
                        ids, x = (np.concatenate(h) for h in zip(*held, strict=True))
                    yield best(*part, ids, x)

    def best(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        length_q, length_x = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        rough = (q / length_q[:, None]) @ (x / length_x[:, None]).T
        rough[own[:, None] == ids[None, :]] = -np.inf
        few = min(k, len(ids))
        # all near the k-th score are scored again, pair by pair: equal vectors then have equal scores
        floor = np.partition(rough, len(ids) - few, axis=1)[:, len(ids) - few] - 1e-9
        r, c = np.nonzero((rough >= floor[:, None]) & np.isfinite(rough))
        s = np.concatenate([(q[r[i : i + 8192]] * x[c[i : i + 8192]]).sum(axis=1) for i in range(0, max(1, len(r)), 8192)]) / (length_q[r] * length_x[c])
        order = np.lexsort((ids[c], -s, r))
        keep = order[np.arange(len(r)) - np.searchsorted(r, r[order]) < k]
        return pa.RecordBatch.from_arrays([pa.array(own[r[keep]]), pa.array(ids[c[keep]]), pa.array(s[keep])], ["query_id", "vec_id", "score"])

    part = "key long, asks boolean, id long, embedding " + rows.schema["embedding"].dataType.simpleString()
    placed = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(route, part)
    asked = rows.where(queries).mapInArrow(ask, part)
    tasks = min(number, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = placed.unionByName(asked).repartitionById(tasks, (F.col("key") % tasks).cast("int")).sortWithinPartitions("key", "asks")
    found = dealt.mapInArrow(score, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
