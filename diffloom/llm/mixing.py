"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key -ln(u) / w: u is uniform from a keyed hash of the
document, w its quality weight. A source takes complete epochs first (every
document floor(target / size) times); the fraction that is left is filled with
the documents of the smallest keys, in key order, until the prefix sum of their
sizes is nearest to the budget.

Rows that are equal in all that is hashed are told apart by their number among
these, so that neither null ids nor repeated rows share a draw. The numbers
are counted within and then over input partitions, never by one task for a
whole group.

Prefix sums never sort a whole source in one task either. Keys become whole
numbers of 62 bits in the same order; sums over their first 16 bits find where
the budget ends, those over the next 16 and the next refine it, and only the
documents that share 48 bits with the end are ordered by a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.llm.common import Scratch, fresh, hashable, materialise, n_words

#: Bits of a key by which the end of the budget is looked for, first to last.
SHIFTS = (46, 30, 14)
#: The range of ln(key) that is told apart: keys of positive weights; those of the others lie beyond.
SPAN = 1024.0


def letter_share(text: Column) -> Column:
    """A plain quality weight in [0.1, 1]: the share of letters and ASCII spaces."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    other = F.length(F.regexp_replace(text, r"[\p{L} \t\n]+", ""))
    return F.when(n > 0, F.lit(1.0) - F.lit(0.9) * other / n).otherwise(F.lit(0.1))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, scratch: Scratch) -> DataFrame:
    """sizes (source, source_size, ...) with `target`: one row per source.

    Sources are ordered by code point, null last, and weigh `weights` in turn.
    Together they share `share` of all sizes; a target stops at `most` times
    its source's size and what is over goes to the others by weight. Each round
    fixes all targets that are over, so the rounds are at most as many as the
    sources, and each is one small aggregate.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    sizes = scratch(sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).coalesce(1), "mix-sources")  # a row per source
    budget = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * level >= F.col("cap")
        row = sizes.agg(
            F.sum(F.when(over, F.col("cap"))).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("n")
        ).first()
        if row["n"] == stopped or not row["open"]:
            break
        level, stopped = (budget - (row["fixed"] or 0.0)) / row["open"], row["n"]
    return sizes.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def _numbered(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows (a written table with tag and part) with `turn`: their number, from 0, among rows of equal tag.

    Only tags that repeat are counted: per input partition (part), then over
    the partitions.
    """
    more = keep(rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("tag").alias("tag_")), "mix-repeated")
    if more.isEmpty():
        return rows.withColumn("turn", F.lit(0).cast("long"))
    marked = rows.join(more, F.col("tag") == F.col("tag_"), "left")
    alone = marked.where(F.col("tag_").isNull()).drop("tag_").withColumn("turn", F.lit(0).cast("long"))
    again = marked.where(F.col("tag_").isNotNull()).drop("tag_")
    tally = again.groupBy("tag", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("tag").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tally.select(F.col("tag").alias("tag_"), F.col("part").alias("part_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_"))
    firsts = keep(firsts, "mix-repeated-parts")
    placed = again.withColumn("turn", F.row_number().over(Window.partitionBy("tag", "part").orderBy(F.lit(0))) - 1)
    joined = placed.join(firsts, (F.col("tag") == F.col("tag_")) & (F.col("part") == F.col("part_")))
    return alone.unionByName(joined.withColumn("turn", F.col("first_") + F.col("turn")).drop("tag_", "part_", "first_"))


def _ordered_key(u: Column, w: Column) -> Column:
    """-ln(u) / w as a whole number of 62 bits in the same order; weights of zero and less, and null ones, come behind all others, by u."""
    log = F.log(-F.log(u)) - F.log(w)
    within = F.floor((F.least(F.greatest(log, F.lit(-SPAN)), F.lit(SPAN - 1e-9)) + SPAN) * F.lit(2.0**61 / SPAN))
    return F.when(w > 0, within).otherwise(F.lit(1 << 62).cast("long") + F.floor((1 - u) * F.lit(2.0**60))).cast("long")


def mix(
    docs: DataFrame,
    size: Column,
    quality: Column,
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """`keep` columns with source, size, source_size, target, copies and taken.

    copies is how often the mix takes the document, taken = copies * size.
    Documents are whole, so a source misses its target by at most half of one
    document. Null sources form one source, null or non-positive weights come
    last, null sizes count 0. A draw depends on the kept columns, source, size
    and weight; rows that are equal in all of them draw by their number among
    their like, so any order of them gives the same mix. No rows in, no rows
    out. Equal input and seed give equal output.
    """
    clash = {c: f"kept_{i}" for i, c in enumerate(keep)}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    slim = docs.select(
        *[F.col(c).alias(a) for c, a in clash.items()],
        F.col("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.coalesce(quality, F.lit(0.0)).cast("double").alias("w"),
        F.xxhash64(F.lit(seed), *(hashable(c, kinds[c]) for c in keep)).alias("tag"),
    )
    slim = materialise(slim.withColumns({"tag": F.xxhash64("tag", "source", "size", "w"), "part": F.spark_partition_id()}), "mix-docs")
    u = (F.shiftrightunsigned(F.xxhash64("tag", "turn"), 11) + F.lit(0.5)) / F.lit(2.0**53)
    drawn = _numbered(slim, materialise).withColumn("key", _ordered_key(u, F.col("w")))
    with Scratch(docs.sparkSession) as scratch:
        sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = source_targets(sizes, weights, share, most, scratch)
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        plan = plan.select("source", "source_size", "target", epochs.alias("epochs"))
        plan = plan.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))

        keyed = scratch(drawn.select("source", "size", "tag", "turn", "key"), "mix-keys")
        end = plan.select("source", "left", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
        above = 63
        for level, shift in enumerate(SHIFTS):
            inside = _with_source(keyed, end).where((F.col("left") > 0) & (F.shiftright("key", above) == F.col("bin")))
            bins = inside.groupBy("source", "left", "before", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("n"))
            end, above = scratch(_end_bin(bins).coalesce(1), f"mix-end-{level}"), shift
        running = Window.partitionBy("source").orderBy("key", "tag", "turn").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
        nearest = (F.col("before") < F.col("left")) & (F.col("before") + F.col("size") - F.col("left") <= F.col("left") - F.col("before"))
        edge = _with_source(keyed, end).where(F.shiftright("key", above) == F.col("bin")).withColumn("before", before)
        edge = edge.where(nearest | (F.col("before") + F.col("size") <= F.col("left")))
        edge = materialise(edge.select(F.col("tag").alias("edge_tag"), F.col("turn").alias("edge_turn")), "mix-edge")
        plan = materialise(_with_source(plan, end.select("source", F.col("bin").alias("end_bin"))).coalesce(1), "mix-plan")  # a row per source

    joined = _with_source(drawn, plan).join(edge, (F.col("tag") == F.col("edge_tag")) & (F.col("turn") == F.col("edge_turn")), "left")
    chosen = F.coalesce(F.shiftright("key", SHIFTS[-1]) < F.col("end_bin"), F.lit(False)) | F.col("edge_tag").isNotNull()
    copies = F.col("epochs") + chosen.cast("long")
    out = [F.col(a).alias(c) for c, a in clash.items()]
    return joined.select(*out, *([] if "source" in clash else ["source"]), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _with_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """left join on the source, null matching null; the small side has a row per source."""
    right = right.withColumnRenamed("source", "source_")
    return left.join(right, left["source"].eqNullSafe(right["source_"]), "left").drop("source_")


def _end_bin(bins: DataFrame) -> DataFrame:
    """(source, left, bin, before): per source the bin in which the budget ends, and the sum before it.

    bins: (source, left, before, part, n), before for the whole of them. The
    budget may end behind the last bin by rounding; then that one is taken.
    """
    upto = bins.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("part")))
    at = F.struct(F.col("part").alias("bin"), (F.col("upto") - F.col("n")).alias("before"))
    ends = upto.groupBy("source", "left").agg(F.min(F.when(F.col("upto") >= F.col("left"), at)).alias("hit"), F.max(at).alias("final"))
    return ends.select("source", "left", F.coalesce("hit", "final").alias("end")).select("source", "left", "end.bin", "end.before")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """mix() of a documents table: words as sizes, share of letters as quality; edge cases as there. Very long texts are counted whole."""
    return mix(docs, n_words(F.col("text")), letter_share(F.col("text")), **options)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with all columns of docs: each as often as the mix takes it.

    Columns of any name and type stay as they are. Null texts have no words, so
    they come in complete epochs and, where their key is small enough, once
    more; null ids and repeated rows are documents of their own; no rows, no
    result.
    """
    # as one column, so that none of them can clash with a figure of the mix
    whole = fresh(("doc_id", "source", "text"), "all_")
    packed = docs.select("doc_id", "source", "text", F.struct(*("`" + c.replace("`", "``") + "`" for c in docs.columns)).alias(whole))
    mixed = mix_documents(packed, keep=(whole,), **options).where("copies > 0")
    return mixed.select(whole, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(f"{whole}.*")
