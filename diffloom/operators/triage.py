"""Triage: which rows are on one side only, which changed, and in which column groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions.canon import ColumnPair
from diffloom.functions.names import chunks, col
from diffloom.operators.joins import on_columns
from diffloom.operators.screen import MASK_BITS
from diffloom.spec import CompareSpec


def reconcile(left: DataFrame, right: DataFrame, groups: int, columns: int, spec: CompareSpec) -> DataFrame:
    """keys…, row_status, row_identical, gh_i_match, nulls_j: the full outer join of two hashed sides.

    A side is present where all its keys are not null, so a row with a null in
    its key meets nothing and is unknown. nulls_j has the bits of columns that
    are null on either side; it and the match flags are null unless matched.
    """
    masks = -(-columns // MASK_BITS)
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, reduce(lambda a, b: a & b, (col(k, "l") == col(k, "r") for k in spec.keys)), "full_outer")
    present = {s: reduce(lambda a, b: a & b, (col(k, s).isNotNull() for k in spec.keys)) for s in "lr"}
    matched = present["l"] & present["r"]
    status = F.when(matched, "matched").when(present["l"], "left_only").when(present["r"], "right_only").otherwise("unknown")
    same = [F.col(f"l.gh_{i}") == F.col(f"r.gh_{i}") for i in range(groups)]
    every = reduce(lambda a, b: a & b, same) if same else F.lit(True)
    return joined.select(
        *(F.coalesce(col(k, "l"), col(k, "r")).alias(k) for k in spec.keys),
        status.alias("row_status"),
        F.when(matched, every).alias("row_identical"),
        *(F.when(matched, m).alias(f"gh_{i}_match") for i, m in enumerate(same)),
        *(F.when(matched, F.col(f"l.nulls_{j}").bitwiseOR(F.col(f"r.nulls_{j}"))).alias(f"nulls_{j}") for j in range(masks)),
    )


def row_status_counts(reconciled: DataFrame, status: DataFrame, spec: CompareSpec) -> DataFrame:
    """(batch, row_status, row_count) of all batches: changed ones by their rows, the others by their counts."""
    rows = reconciled.groupBy(col(spec.batch), "row_status").agg(F.count(F.lit(1)).alias("row_count"))
    whole = status.where("batch_status <> 'changed'").select(
        col(spec.batch),
        F.when(F.col("batch_status") == "identical", "matched").otherwise(F.col("batch_status")).alias("row_status"),
        F.coalesce("left_row_count", "right_row_count").alias("row_count"),
    )
    return rows.unionByName(whole)


def row_status_detail(reconciled: DataFrame, spec: CompareSpec) -> DataFrame:
    """keys…, row_status of every row of the changed batches."""
    return reconciled.select(*(col(k) for k in spec.keys), "row_status")


def changed_keys(reconciled: DataFrame, groups: int, spec: CompareSpec) -> DataFrame:
    """keys…, gh_i_match of matched rows that differ somewhere."""
    rows = reconciled.where((F.col("row_status") == "matched") & ~F.col("row_identical"))
    return rows.select(*(col(k) for k in spec.keys), *(f"gh_{i}_match" for i in range(groups)))


def group_changes(reconciled: DataFrame, groups: int, spec: CompareSpec) -> DataFrame:
    """(batch, group_index, changed_row_count) of groups with changes: one pass for all groups."""
    counts = F.array(*(F.struct(F.lit(i).alias("group_index"), F.count_if(~F.col(f"gh_{i}_match")).alias("n")) for i in range(groups)))
    by_batch = changed_keys(reconciled, groups, spec).groupBy(col(spec.batch)).agg(counts.alias("groups"))
    long = by_batch.select(col(spec.batch), F.explode("groups").alias("g"))
    return long.select(col(spec.batch), "g.group_index", F.col("g.n").alias("changed_row_count")).where("changed_row_count > 0")


def _bit_counts(df: DataFrame, columns: list[str], spec: CompareSpec, size: int) -> DataFrame:
    """(batch, column, nonnull_count): per column the rows whose mask has a zero in its place."""
    parts = []
    for at, some in enumerate(chunks(columns, size)):
        places = [at * size + i for i in range(len(some))]
        counts = [
            F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"nulls_{p // MASK_BITS}").bitwiseAND(F.lit(1 << p % MASK_BITS)) == 0).alias("nonnull_count"))
            for c, p in zip(some, places, strict=True)
        ]
        long = df.groupBy(col(spec.batch)).agg(F.array(*counts).alias("c")).select(col(spec.batch), F.explode("c").alias("c"))
        parts.append(long.select(col(spec.batch), "c.column", "c.nonnull_count"))
    return reduce(DataFrame.unionByName, parts)


def nonnull_counts(reconciled: DataFrame, left: DataFrame, status: DataFrame, pairs: list[ColumnPair], spec: CompareSpec) -> DataFrame:
    """(batch, column, nonnull_count): matched rows in which both sides have a value, for every batch on both sides.

    The masks of the narrow rows suffice: no wide table is joined. In identical
    batches both sides have the same nulls, so the left masks are counted.
    """
    names = [p.name for p in pairs]
    rows = _bit_counts(reconciled.where("row_status = 'matched'"), names, spec, spec.columns_per_pass)
    identical = status.where("batch_status = 'identical'").select(col(spec.batch))
    return rows.unionByName(_bit_counts(on_columns(left, identical, [spec.batch], "left_semi"), names, spec, spec.columns_per_pass))


def duplicate_keys(df: DataFrame, spec: CompareSpec) -> DataFrame:
    """keys…, n of keys that occur more than once on a side; a null in a key equals a null here."""
    return df.groupBy(*(col(k) for k in spec.keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
