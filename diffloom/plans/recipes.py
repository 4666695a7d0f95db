"""Reports on the results of comparisons: all take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.operators.rollup import share


def top_columns(total: DataFrame, n: int = 10, source_label: str | None = None) -> DataFrame:
    """The n columns with the most mismatches, ties by name; of persisted totals only those of a source, if one is named."""
    if source_label is not None:
        total = total.where(F.col("source_label") == source_label)
    return total.orderBy(F.desc("mismatch_count"), "column").limit(n)


def by_rate(total: DataFrame) -> DataFrame:
    """Columns by their share of mismatches, highest first, ties by name."""
    return total.select("column", "mismatch_pct", "mismatch_count", "matched_row_count").orderBy(F.desc_nulls_last("mismatch_pct"), "column")


def without_noise(by_batch: DataFrame, noisy: DataFrame) -> DataFrame:
    return by_batch.join(noisy.select("column"), "column", "left_anti").select(*by_batch.columns)


def cell_rollup(by_batch: DataFrame) -> DataFrame:
    """(batch_key, cells, mismatches, mismatch_pct): differing cells of all compared ones."""
    total = by_batch.groupBy("batch_key").agg(F.sum("matched_row_count").alias("cell_count"), F.sum("mismatch_count").alias("mismatch_count"))
    return total.withColumn("mismatch_pct", share(F.col("mismatch_count"), F.col("cell_count")))


def samples_of(samples: DataFrame, column: str) -> DataFrame:
    return samples.where(F.col("column") == column)


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs' totals side by side: how each column's mismatches moved."""
    b = before.select("column", F.col("mismatch_count").alias("before_count"), F.col("mismatch_pct").alias("before_pct"))
    a = after.select("column", F.col("mismatch_count").alias("after_count"), F.col("mismatch_pct").alias("after_pct"))
    return b.join(a, "column").withColumn("count_delta", F.col("after_count") - F.col("before_count"))


def scaling_fit(runs: DataFrame) -> DataFrame:
    """runs (label, n_rows, seconds) -> label, slope, intercept, r2 of the straight line through them."""
    x, y = F.col("n_rows").cast("double"), F.col("seconds").cast("double")
    return runs.groupBy("label").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def scaling_fit_by_cells(runs: DataFrame) -> DataFrame:
    """runs (label, n_rows, n_columns, seconds) -> label, slope, intercept, r2 over rows times columns."""
    return scaling_fit(runs.withColumn("n_rows", F.col("n_rows").cast("double") * F.col("n_columns")))


def phase_table(timings: DataFrame) -> DataFrame:
    """timings (run_id, phase, seconds) -> a row per run with a column per phase, and the total."""
    return timings.groupBy("run_id").pivot("phase").agg(F.sum("seconds")).join(timings.groupBy("run_id").agg(F.sum("seconds").alias("total_seconds")), "run_id")
