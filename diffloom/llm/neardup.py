"""Near-duplicate documents by min-max hashing, confirmed on full sets.

1. One pass makes each text's set of word shingles, its min-max signature and
   the keys of the signature's bands (minmax.py). Equal sets form a class; from
   here on a class is one node, however many copies it has.
2. Nodes with equal band keys are candidates. No pairs are listed: each bucket
   names its smallest node as leader, and the nodes that share a leader form
   its group. Two nodes of a bucket are always together in some group.
3. A group is dealt into blocks of bounded size. A block resolves all pairs in
   it by an inverted index over the full sets, and reports for each node the
   smallest one it is joined with, so that components() has few rounds to go.
4. Nodes of groups of more than one block are grouped anew, by the rarest part
   of their sets: two sets above the threshold share at least one item among
   the first of each, in any common order (the prefix filter, which is exact).
   Groups whose nodes are all joined already are left out, so neither a large
   family of copies nor one of texts that only share a frame is compared again.
5. What is left of more than one block is settled between blocks: only nodes
   outside the group's largest component are compared with the other blocks.
6. Components of all links, and their smallest document.

Tables that grow with the corpus are joined by merge joins at every size. The
table of groups of several blocks is the planner's to broadcast, by its
measured size; so a leader that many nodes share doesn't gather them in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import Scratch, fresh, materialise, sieved, sliced
from diffloom.llm.components import components
from diffloom.llm.minmax import MinMax, WordHashes, shingles

BLOCK_NODES, BLOCK_SHINGLES = 256, 1 << 19
SLOTS = 1 << 18  # counters by which items count as rare: they only decide on the order, so that they may be shared


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, width: int, hashing: MinMax, row: str | None = None) -> DataFrame:
    """doc_id, row (unique), h (of the text), n (shingles), digest (of the set) and keys (of the bands) per row; without shingles the last two are null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in sliced(batches):
            sets = [shingles(t.as_py(), words, width) for t in batch.column(3)]
            keys = [hashing.keys(hashing.signature(s)) if len(s) else None for s in sets]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "row", "h", "n", "digest", "keys"])

    rows = docs.select("doc_id", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row long, h long, n long, digest binary, keys array<long>")


def sets_of(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(node, items) for the nodes in needed (node, doc_id, h, digest): the sets' bytes, made again from the texts.

    Id and hash of the text find it, so that rows which share or lack an id
    don't meet. Rows that repeat both lie side by side behind the merge join,
    and all but the first of them are passed over. Most texts aren't needed:
    they are sieved out where they are read. needed is a written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = WordHashes(), None
        for batch in sliced(batches):
            own, made = [], []
            for i, (node, want, text) in enumerate(zip(*batch.columns, strict=True)):
                if node == last or digest(s := shingles(text.as_py(), words, width)) != want.as_py():  # else another text of that hash
                    continue
                last = node
                own.append(i)
                made.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(made, pa.binary())], ["node", "items"])

    texts = sieved(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), "h", needed, "h")
    needed = needed.select("node", F.col("doc_id").alias("needed_id"), F.col("h").alias("needed_h"), "digest")
    texts = texts.join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("needed_id")) & (F.col("h") == F.col("needed_h")))
    return texts.select("node", "digest", "text").mapInArrow(run, "node long, items binary")


class Index:
    """An inverted index over sets: links() finds all of them that are similar to a set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(items, kind="stable")
        self.items, self.owners = items[order], owners[order]

    def links(self, s: np.ndarray, percent: int) -> np.ndarray:
        low = np.searchsorted(self.items, s, side="left")
        n = np.searchsorted(self.items, s, side="right") - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero((100 * both >= percent * (self.sizes + len(s) - both)) & (both > 0))


def _sets(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in table.column(name)]


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def resolve_block(table: pa.Table, percent: int) -> pa.Table:
    """What is similar among the block's nodes (node, items), directly or by others: each node with the smallest of its part."""
    first = {node: i for i, node in reversed(list(enumerate(table.column("node").to_pylist())))}
    nodes = sorted(first)
    every = _sets(table, "items")
    sets = [every[first[node]] for node in nodes]
    index, part = Index(sets), np.arange(len(nodes))
    for i, s in enumerate(sets):
        if (part == part[i]).all():
            continue
        for j in index.links(s, percent):
            if part[j] != part[i]:
                part[part == max(part[i], part[j])] = min(part[i], part[j])
    return _edges([(node, nodes[k]) for node, k in zip(nodes, part, strict=True) if node != nodes[k]])


def resolve_between(table: pa.Table, percent: int) -> pa.Table:
    """Links between the block's nodes (asks false) and nodes of other blocks (asks true) of another component (root)."""
    asks = table.column("asks").to_numpy()
    here, there = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
    index, pairs = Index(_sets(here, "items")), []
    nodes, roots = here.column("node").to_numpy(), here.column("root").to_numpy()
    for node, root, s in zip(there.column("node").to_pylist(), there.column("root").to_pylist(), _sets(there, "items"), strict=True):
        met = set()
        for j in index.links(s, percent):
            if roots[j] != root and roots[j] not in met:
                met.add(roots[j])
                pairs.append((node, int(nodes[j])))
    return _edges(pairs)


def groups_of(nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(leader, node, n), leaders among them, of all buckets that can hold a link. nodes: (node, n, keys), and root if they are joined in part.

    Left out are buckets whose nodes are all joined, and those of two nodes
    whose sizes rule out a link. The buckets that stay are a table of their own,
    so that its join with the rows is a plain one, and is split where a bucket
    is hot.
    """
    root = ["root"] if "root" in nodes.columns else []
    rows = nodes.select("node", F.col("n").cast("int").alias("n"), *root, F.explode("keys").alias("key"))
    r = root[0] if root else "node"
    buckets = rows.groupBy("key").agg(F.min("node").alias("leader"), F.min(r).alias("r"), F.max(r).alias("s"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("members"))
    able = (F.col("r") < F.col("s")) & ((F.col("members") > 2) | (100 * F.col("least").cast("long") >= percent * F.col("most").cast("long")))
    buckets = scratch(buckets.where(able).select("key", "leader"), "buckets")
    rows = sieved(rows.select("node", "n", "key"), "key", buckets, "key")  # few keys are shared
    return scratch(rows.join(buckets.hint("merge"), "key").select("leader", "node", "n").distinct(), "groups")


def deal(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(leader, node, blocks, block): the groups in blocks of bounded size."""
    enough = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    large = scratch(members.groupBy("leader").agg(enough.alias("blocks")).where("blocks > 1"), "large")
    dealt = members.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return scratch(dealt.select("leader", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")), "dealt")


def within(dealt: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): nodes of a block with the smallest that they are joined with."""
    found = dealt.select("leader", "block", "node").join(sets.hint("merge"), "node").groupBy("leader", "block").applyInArrow(lambda t: resolve_block(t, percent), "a long, b long")
    return scratch(found, "inside")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, root, keys): of each set (node, root, items) the items that a similar one must share one of, the rarest.

    How often items occur is counted in SLOTS counters, so the driver gets a
    table of bounded size; whatever they hold, the order is the same for all.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(iter([batch])):
                slots, n = np.unique(np.concatenate(_sets(part, "items")) & np.uint64(SLOTS - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n)], ["slot", "n"])

    counted = sets.select("items").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.ones(SLOTS, np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, sizes = [], []
            for s in _sets(batch, "items"):
                order = np.lexsort((s, counts[s & np.uint64(SLOTS - 1)]))
                keys.append(s[order[: len(s) + 1 - -(-percent * len(s) // 100)]].view(np.int64))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["node", "n", "root", "keys"])

    return sets.select("node", "root", "items").mapInArrow(first, "node long, n long, root long, keys array<long>")


def between(wide: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """(a, b): links between blocks of the groups in wide (leader, node, blocks, block), whose blocks are settled in themselves; None if all are joined."""
    wide = scratch(_rooted(wide, roots), "wide")
    largest = wide.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("leader").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    strays = scratch(wide.join(scratch(largest, "largest"), "leader").where("root <> main").drop("main"), "strays")
    if strays.isEmpty():
        return None
    chunks = scratch(strays.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_NODES)).cast("long").alias("chunks")), "chunks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = strays.withColumnRenamed("block", "own").join(chunks, "leader").select(
        "leader", "node", "root", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).alias("chunk"), "own", every("blocks").alias("block"), F.lit(True).alias("asks")
    ).where("block <> own").drop("own")
    asked = wide.join(chunks, "leader").select("leader", "node", "root", every("chunks").alias("chunk"), "block", F.lit(False).alias("asks"))
    sets = sieved(sets, "node", wide, "node")
    across = asking.unionByName(asked).join(sets.hint("merge"), "node").groupBy("leader", "block", "chunk").applyInArrow(lambda t: resolve_between(t, percent), "a long, b long")
    return scratch(across, "across")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def joined(docs: DataFrame, nodes: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component. nodes: (node, doc_id, h, digest, n, keys)."""
    dealt = deal(groups_of(nodes.select("node", "n", "keys"), percent, scratch), scratch)
    needed = nodes.select("node", "doc_id", "h", "digest").join(dealt.select("node").distinct().hint("merge"), "node")
    sets = scratch(sets_of(docs, scratch(needed, "needed"), width), "sets")
    roots, wide = components(within(dealt, sets, percent, scratch), scratch), dealt.where("blocks > 1")
    if wide.isEmpty():
        return roots
    sets = scratch(sieved(sets, "node", wide, "node").join(wide.select("node").distinct().hint("merge"), "node"), "wide-sets")
    dealt = deal(groups_of(scratch(rarest(_rooted(sets, roots), percent), "fine"), percent, scratch), scratch)
    if dealt.isEmpty():
        return roots
    edges, wide = within(dealt, sieved(sets, "node", dealt, "node"), percent, scratch), dealt.where("blocks > 1")
    roots = components(_edges_of(roots).unionByName(edges), scratch)
    if wide.isEmpty():
        return roots
    edges = between(wide, sets, roots, percent, scratch)
    return components(_edges_of(roots).unionByName(edges), scratch) if edges is not None else roots


def _edges_of(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def find(docs: DataFrame, percent: int = 80, width: int = 2, hashing: MinMax | None = None, row: str | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept, first: a row per row of docs.

    Two texts are linked if the intersection of their shingle sets is at least
    `percent` (1 to 100) of the union, and share a band of `hashing`, by default one
    that misses 3 in a million at `percent`; component_id is the smallest doc_id reachable, kept
    tells whether it is the document's own. row numbers the rows of docs, by the
    unique column of that name if one is given, and first marks one row per component, also where ids repeat. Null and empty
    texts and texts of white space have no shingles and no links; long texts are
    taken whole. Equal texts are one class, however many. Null ids never are the smallest unless all in
    a component are null. Other columns are ignored; no rows, no result.
    """
    signed = materialise(signatures(docs, width, hashing or MinMax.of(percent), row), "signatures")
    full = signed.where("digest is not null")
    with Scratch(docs.sparkSession) as scratch:
        # the node is the smallest row of its class, and that row's id and keys come along, so that they aren't looked up again
        own = F.min(F.struct("row", "doc_id", "h", "n", "keys")).alias("own")
        classes = scratch(full.groupBy("digest").agg(own, F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("best")).select(F.col("own.row").alias("node"), "digest", "best", "own.doc_id", "own.h", "own.n", "own.keys"), "classes")
        nodes = classes.select("node", "doc_id", "h", "digest", "n", "keys")
        roots = joined(docs, nodes, percent, width, scratch)
        rooted = scratch(classes.select("node", "digest", "best").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        best = scratch(rooted.groupBy("root").agg(F.min("best").alias("of_all")), "best")  # apart, so that the join is a plain one and is split at a hot root
        found = materialise(rooted.join(best.hint("merge"), "root").select(F.col("digest").alias("d"), "of_all"), "class-components")
    out = signed.join(found.hint("merge"), F.col("digest") == F.col("d"), "left")
    alone = F.col("of_all").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("of_all.doc_id"))
    return out.select(
        "doc_id",
        "row",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (alone | (F.col("of_all.row") == F.col("row"))).alias("first"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each component one row, that of the smallest doc_id, with all columns.

    Columns of any name and type stay as they are. Rows without words, null
    texts among them, all stay; rows that repeat an id are told apart; no rows,
    no result.
    """
    row = fresh(docs.columns, "row_")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = find(numbered, row=row, **options)
    dropped = materialise(found.where(~F.col("first")).select(F.col("row").alias(row)), "dropped")
    return numbered.join(dropped, row, "left_anti").drop(row)


def find_sql(table: str = "documents", percent: int = 80) -> str:
    """doc_id, n_shingles, component_id, kept of find() for a table with distinct ids: all pairs that share a shingle of two words, fit for small tables."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table}),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b),
m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.m AS component_id, m.m = w.doc_id AS kept FROM w JOIN m ON m.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""
