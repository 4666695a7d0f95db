"""A comparison as a set of lazy results that share their intermediate tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from contextlib import contextmanager
from functools import cached_property, reduce
from time import perf_counter

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.functions.canon import batch_key
from diffloom.functions.names import chunks, col
from diffloom.operators import cells, rollup, screen, triage
from diffloom.operators.joins import on_columns
from diffloom.sources.tables import column_groups, column_pairs, resolve, schema_of, validate
from diffloom.spec import CompareSpec


logger = logging.getLogger(__name__)


class Comparison:
    """Every result is a property, computed when first asked for.

    The hashed sides, the reconciled rows and the small tables made of them are
    kept (in memory and on disk) from their first use until close(), so that no
    source is read twice for the same purpose. Use as a context manager.
    """

    def __init__(self, spark: SparkSession, spec: CompareSpec):
        self.spark, self.spec = spark, spec
        self.left_rows, self.right_rows = (resolve(spark, s, spec.table_format) for s in (spec.left, spec.right))
        validate(self.left_rows, self.right_rows, spec)
        self.pairs_by_name = {p.name: p for p in column_pairs(self.left_rows, self.right_rows, spec)}
        if not self.pairs_by_name:
            raise ValueError("there is no column to compare")
        names = column_groups(list(self.pairs_by_name), spec.critical, spec.group_size)
        self.groups = [[self.pairs_by_name[c] for c in g] for g in names]
        self.pairs = [p for g in self.groups for p in g]
        self.batch_type = schema_of(self.left_rows)[spec.batch]
        self.timings: list[tuple[str, float]] = []
        self._kept: list[DataFrame] = []

    def __enter__(self) -> Comparison:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Let go of what is kept. Results can still be read, at the cost of computing it again; a session that is gone already is no error."""
        while self._kept:
            kept = self._kept.pop()
            try:
                kept.unpersist()
            except Exception:
                logger.warning("an intermediate table could not be let go", exc_info=True)

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(df)
        return df

    @contextmanager
    def timed(self, phase: str):
        began = perf_counter()
        try:
            yield
        finally:
            self.timings.append((phase, perf_counter() - began))

    @cached_property
    def _hashed(self) -> tuple[DataFrame, DataFrame]:
        return tuple(self._keep(screen.hash_rows(df, s, self.groups, self.spec)) for s, df in (("left", self.left_rows), ("right", self.right_rows)))

    @cached_property
    def _status(self) -> DataFrame:
        sides = [screen.batch_checksums(h, len(self.groups), self.spec) for h in self._hashed]
        return self._keep(screen.batch_status(*sides, self.spec))

    @property
    def batch_status(self) -> DataFrame:
        """batch_key, left_checksum, right_checksum, left_row_count, right_row_count, batch_status."""
        return self._status.select(
            batch_key(col(self.spec.batch), self.batch_type).alias("batch_key"), "left_checksum", "right_checksum", "left_row_count", "right_row_count", "batch_status"
        )

    @cached_property
    def _reconciled(self) -> DataFrame:
        changed = self._status.where("batch_status = 'changed'").select(col(self.spec.batch))
        sides = [on_columns(h, changed, [self.spec.batch], "left_semi") for h in self._hashed]
        return self._keep(triage.reconcile(*sides, len(self.groups), len(self.pairs), self.spec))

    @cached_property
    def _row_counts(self) -> DataFrame:
        return self._keep(triage.row_status_counts(self._reconciled, self._status, self.spec))

    def _keyed(self, df: DataFrame) -> DataFrame:
        rest = [col(c) for c in df.columns if c != self.spec.batch]
        return df.select(batch_key(col(self.spec.batch), self.batch_type).alias("batch_key"), *rest)

    @property
    def row_status_counts(self) -> DataFrame:
        """batch_key, row_status, row_count."""
        return self._keyed(self._row_counts)

    @property
    def row_status_totals(self) -> DataFrame:
        """row_status, row_count over all batches."""
        return self._row_counts.groupBy("row_status").agg(F.sum("row_count").alias("row_count"))

    @property
    def row_status_detail(self) -> DataFrame:
        return triage.row_status_detail(self._reconciled, self.spec)

    @property
    def changed_keys(self) -> DataFrame:
        return triage.changed_keys(self._reconciled, len(self.groups), self.spec)

    @cached_property
    def _group_changes(self) -> DataFrame:
        return self._keep(triage.group_changes(self._reconciled, len(self.groups), self.spec))

    @property
    def group_changes(self) -> DataFrame:
        """batch_key, group_index, changed_row_count of groups with changes."""
        return self._keyed(self._group_changes)

    @property
    def nonnull_counts(self) -> DataFrame:
        """batch_key, column, nonnull_count."""
        return self._keyed(self._nonnull)

    @cached_property
    def _nonnull(self) -> DataFrame:
        return triage.nonnull_counts(self._reconciled, self._hashed[0], self._status, self.pairs, self.spec)

    @property
    def duplicate_keys(self) -> tuple[DataFrame, DataFrame]:
        """Keys that occur more than once, left and right. Such rows match all their counterparts."""
        return tuple(triage.duplicate_keys(h, self.spec) for h in self._hashed)

    def _among(self, batches: DataFrame) -> Column:
        """A predicate on the batch column for the (batch-sized) list of batches, as constants that scans can use."""
        kind, b = self.batch_type, col(self.spec.batch)
        shown = F.unix_micros(b) if isinstance(kind, T.TimestampType) else b.cast("string") if isinstance(kind, T.TimestampNTZType) else b
        values = [r[0] for r in batches.select(shown).distinct().collect()]
        make = F.timestamp_micros if isinstance(kind, T.TimestampType) else lambda v: v.cast(kind)
        return b.isin(*(make(F.lit(v)) for v in values)) if values else F.lit(False)

    @cached_property
    def _joined(self) -> list[tuple[DataFrame, list[cells.Lot]]]:
        """The changed rows, read once for each pass over columns of changed groups."""
        keys, spec = [col(k) for k in self.spec.keys], self.spec
        changed = {r["group_index"] for r in self._group_changes.select("group_index").distinct().collect()}  # at most one row per group
        if not changed:
            return []
        batches = self._among(self._group_changes)
        rows = self._reconciled.where((F.col("row_status") == "matched") & ~F.col("row_identical"))
        masks = [c for c in rows.columns if c.startswith("nulls_")]
        # a key that occurs more than once on a side would come back once for each of its pairs
        rows = rows.groupBy(*keys).agg(*(F.min(f"gh_{i}_match").alias(f"gh_{i}_match") for i in range(len(self.groups))), *(F.bit_and(m).alias(m) for m in masks))
        out = []
        for part in chunks(cells.places(self.groups, changed), spec.columns_per_pass):
            some, flags = cells.lots(part), list(dict.fromkeys(x.flag for x in part))
            wanted = cells.of_flags(rows, flags).select(*keys, *flags, *masks)
            out.append((self._keep(cells.changed_rows(self.left_rows, self.right_rows, wanted, some, batches, spec)), some))
        return out

    def _union(self, make: Callable) -> DataFrame | None:
        parts = [make(df, some, self.spec) for df, some in self._joined]
        return reduce(DataFrame.unionByName, parts) if parts else None

    @cached_property
    def summary_by_batch(self) -> DataFrame:
        matched = rollup.matched_rows(self._status, self._row_counts, self.spec)
        made = rollup.summary_by_batch(matched, self._union(cells.summarise), self._nonnull, self.pairs, self.batch_type, self.spec)
        return self._keep(made)

    @cached_property
    def summary_of_all(self) -> DataFrame:
        return self._keep(rollup.summary_of_all(self.summary_by_batch))

    @property
    def noisy_columns(self) -> DataFrame:
        return rollup.noisy_columns(self.summary_of_all, self.spec.noisy_threshold)

    def _mismatches(self, most: int | None = None) -> DataFrame:
        found = self._union(lambda df, some, spec: cells.mismatches(df, some, spec, most))
        if found is not None:
            return found
        kinds = schema_of(self.left_rows)
        keys = ", ".join(f"`{k.replace('`', '``')}` {kinds[k].simpleString()}" for k in self.spec.keys)
        return self.spark.createDataFrame(
            [], f"{keys}, column string, `{self.spec.left_label}` string, `{self.spec.right_label}` string, null_mismatch boolean, diff double, abs_diff double, pct_diff double, pct_diff_pct double, tolerance_used double"
        )

    @property
    def mismatch_detail(self) -> DataFrame:
        """Every differing cell."""
        return self._mismatches()

    @property
    def mismatch_sample(self) -> DataFrame:
        """The first differing cells of each batch and column."""
        return self._mismatches(self.spec.sample_per_column)
