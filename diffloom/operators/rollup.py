"""Rollups: complete summaries by batch and over all batches, and columns that changed nearly everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.functions.canon import ColumnPair, batch_key
from diffloom.functions.names import col
from diffloom.spec import CompareSpec

NOISY_REASON = "change_rate_above_threshold"


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def matched_rows(status: DataFrame, row_counts: DataFrame, spec: CompareSpec) -> DataFrame:
    """(batch, matched_row_count) of batches on both sides with a matched row: identical ones count as matched whole."""
    return row_counts.where("row_status = 'matched' AND row_count > 0").select(col(spec.batch), F.col("row_count").alias("matched_row_count"))


def summary_by_batch(matched: DataFrame, cells: DataFrame | None, nonnull: DataFrame, pairs: list[ColumnPair], kind: T.DataType, spec: CompareSpec) -> DataFrame:
    """One row for every batch with matched rows and every compared column, zeros where nothing changed."""
    about = F.array(
        *(F.struct(F.lit(p.name).alias("column"), F.lit(p.left.simpleString()).alias("left_type"), F.lit(p.right.simpleString()).alias("right_type"), F.lit(p.is_numeric).alias("is_numeric"), F.lit(p.tolerance).alias("tolerance")) for p in pairs)
    )
    every = matched.select(col(spec.batch).alias("b"), "matched_row_count", F.explode(about).alias("c")).select("b", "matched_row_count", "c.*")
    keyed = lambda df: df.withColumnRenamed(spec.batch, "b")
    rows = every.join(keyed(nonnull), ["b", "column"], "left")
    if cells is not None:
        rows = rows.join(keyed(cells), ["b", "column"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("changed_row_count", "long"), ("mismatch_count", "long"), ("null_mismatch_count", "long"), ("max_abs_diff", "double"))})
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(
        batch_key(F.col("b"), kind).alias("batch_key"),
        "column",
        "left_type",
        "right_type",
        "is_numeric",
        "tolerance",
        count("changed_row_count").alias("changed_row_count"),
        count("nonnull_count").alias("nonnull_compared_count"),
        count("mismatch_count").alias("mismatch_count"),
        count("null_mismatch_count").alias("null_mismatch_count"),
        "max_abs_diff",
        "matched_row_count",
        share(count("mismatch_count"), F.col("matched_row_count")).alias("mismatch_pct"),
        share(count("null_mismatch_count"), F.col("matched_row_count")).alias("null_mismatch_pct"),
    )


def summary_of_all(by_batch: DataFrame) -> DataFrame:
    total = by_batch.groupBy("column", "left_type", "right_type", "is_numeric", "tolerance").agg(
        *(F.sum(c).alias(c) for c in ("matched_row_count", "nonnull_compared_count", "mismatch_count", "null_mismatch_count")), F.max("max_abs_diff").alias("max_abs_diff")
    )
    return total.select(
        "column",
        "left_type",
        "right_type",
        "is_numeric",
        "tolerance",
        "matched_row_count",
        "nonnull_compared_count",
        "mismatch_count",
        share(F.col("mismatch_count"), F.col("matched_row_count")).alias("mismatch_pct"),
        "null_mismatch_count",
        share(F.col("null_mismatch_count"), F.col("matched_row_count")).alias("null_mismatch_pct"),
        "max_abs_diff",
    )


def noisy_columns(total: DataFrame, threshold: float) -> DataFrame:
    """Columns whose share of mismatches reaches the threshold."""
    noisy = total.where((F.col("matched_row_count") > 0) & (F.col("mismatch_pct") >= threshold))
    return noisy.select("column", "matched_row_count", "mismatch_count", "mismatch_pct", F.lit(NOISY_REASON).alias("suspected_reason"))
