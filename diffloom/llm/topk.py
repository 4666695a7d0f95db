"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt evenly into blocks. For a block each dimension has its
list of candidates sorted by that component. A query reads all its lists in
step, from the top where its own component is positive and from the bottom
where it is negative; whatever appears is scored in full. The sum of the
query's components times the values last read bounds every candidate not seen
yet: once it is below the k-th best score, the block is done. A bound equal to
that score goes on, since an unseen tie with a smaller id would win.

All queries meet all blocks, each once; a block's k best per query are
merged by a window. Blocks are of bounded size and queries come in chunks, so
no task holds more than one block and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.llm.common import materialise
from diffloom.llm.neighbours import one_per_id

LARGEST, SMALLEST = 2**63 - 1, -(2**63)


class Block:
    """Candidates with their sorted lists. Scores are exact: in floats while these hold all sums, else in Python's integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], x[by_id]
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)
        self.largest = int(np.abs(self.x.astype(object)).max(initial=0))
        self.doubles, self.singles = self.x.astype(np.float64), self.x.astype(np.float32)

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int], int]:
        """Ids and scores of the k best, best first, ties to smaller ids; and how many candidates were scored."""
        most = len(q) * self.largest * int(np.abs(q.astype(object)).max(initial=0))
        small = most < 2**53
        q = q.astype(np.float32 if most < 2**24 else np.float64) if small else q.astype(object)
        rows, values = (self.x.astype(object), self.sorted.astype(object)) if not small else (self.singles if most < 2**24 else self.doubles, self.sorted)
        n, used = len(self.ids), np.flatnonzero(q != 0)
        down = used[(q > 0)[used]]
        up = used[(q < 0)[used]]
        new, done = np.zeros(n, bool), self.ids == own
        others = n - int(done.sum())
        scores = np.full(n, -np.inf) if small else np.full(n, None, object)
        every, seen = np.zeros(0, np.int64), []
        depth, step = 0, max(4, k)
        while len(every) < others:
            upto = min(n, depth + step) if len(used) else n
            if len(used):
                new[self.order[n - upto : n - depth, down]] = True
                new[self.order[depth:upto, up]] = True
            else:
                new[:] = True
            at = np.flatnonzero(new & ~done)
            scores[at] = rows[at] @ q if 4 * len(at) < n else (rows @ q)[at]
            done[at] = True
            new[:] = False
            seen.append(at)
            every = np.concatenate(seen)
            depth, step = upto, step * 3
            if k <= len(every) < others:
                bound = values[n - depth, down] @ q[down] + values[depth - 1, up] @ q[up]
                if bound < self._kth(scores[every], k):
                    break
        every = np.sort(every)
        if len(every) > 4 * k and small:  # the k best and their ties
            every = every[scores[every] >= self._kth(scores[every], k)]
        best = every[np.argsort(-scores[every], kind="stable")[:k]]
        return self.ids[best], [min(LARGEST, max(SMALLEST, int(s))) for s in scores[best]], sum(map(len, seen))

    @staticmethod
    def _kth(scores: np.ndarray, k: int):
        return np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]


def quantised(vector: Column) -> Column:
    """floor(64 * x) of each component, x as a double; beyond 64 bits the nearest integer of 64 bits."""
    return F.transform(vector, lambda x: F.floor(F.lit(64.0) * x.cast("double")))


def search(vectors: DataFrame, queries: Column, k: int = 20, block_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` holds, the k other rows of the largest inner products.

    vectors: (vec_id, embedding of integers). Vectors that are null or hold
    null or non-finite components (test them before quantising), and rows
    without an id, take no part; shorter vectors count as filled with zeros. Of
    rows that repeat an id the smallest vector counts. Fewer rows than k give
    all of them; no rows, none. Scores beyond 64 bits are cut to 64 bits: for 64
    dimensions that takes components above 2^23 before they are quantised.
    """
    spark = vectors.sparkSession
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.count_if(queries).alias("asked")).first()
    width = facts["width"] or 1
    # every query meets every block, so blocks are as large as memory allows (some 2.5 KB a row at 64 dimensions), unless cores would idle
    spread = min(2 * spark.sparkContext.defaultParallelism, -(-facts["n"] // 1024))
    blocks, chunks = max(1, -(-facts["n"] // block_rows), spread), max(1, -(-facts["asked"] // 65_536))
    tasks = min(blocks * chunks, max(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), width), np.int64)
        out[np.arange(width)[None, :] < np.diff(column.offsets.to_numpy())[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block and chunk, candidates before queries."""
        key, held, block = None, [], None
        for batch in batches:
            keys, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(keys) | np.diff(asks.astype(np.int8))) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    key, held, block = keys[a], [], None
                part = batch.column(2).slice(a, b - a).to_numpy(), matrix(batch.column(3).slice(a, b - a))
                if not asks[a]:
                    held.append(part)
                elif held:
                    block = block or Block(*(np.concatenate(h) for h in zip(*held, strict=True)))
                    out: tuple[list, list, list] = ([], [], [])
                    for own, q in zip(*part, strict=True):
                        ids, scores, _ = block.top(own, q, k)
                        for column, more in zip(out, ([int(own)] * len(ids), ids.tolist(), scores), strict=True):
                            column.extend(more)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    sides = []
    for asks in (False, True):
        side = vectors.where(queries) if asks else vectors
        lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks if asks else blocks))
        side = side.select("vec_id", "embedding", lot.alias("lot"), F.lit(asks).alias("asks")).select("*", every(blocks if asks else chunks).alias("other"))
        key = F.col("other") * chunks + F.col("lot") if asks else F.col("lot") * chunks + F.col("other")
        sides.append(side.select(key.cast("long").alias("key"), "asks", "vec_id", "embedding"))
    dealt = sides[0].unionByName(sides[1]).repartitionById(tasks, (F.col("key") % tasks).cast("int")).sortWithinPartitions("key", "asks")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_quantised(vectors: DataFrame, queries: Column, k: int = 20, **options) -> DataFrame:
    """search() over floor(64 * x) of real vectors (vec_id, embedding)."""
    rows = one_per_id(vectors, zero=True).select("vec_id", quantised(F.col("embedding")).alias("embedding"))
    return search(materialise(rows, "quantised"), queries, k, **options)


def search_sql(table: str = "embeddings", every: int = 20, k: int = 20) -> str:
    """search_quantised() for tables without repeated ids or vectors of unequal length: all pairs, fit for small tables."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM {table}
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
