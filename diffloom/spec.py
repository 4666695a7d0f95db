"""What to compare and how: a frozen, validated description of one run."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame

DETAIL_MODES = ("summary", "sample", "full")


@dataclass(frozen=True)
class CompareSpec:
    """left, right: a table or view name, a path, or a DataFrame.

    keys identify a row and include batch, the column by which tables are
    screened. critical columns come first in column groups. columns names the
    columns to compare; without it all common columns are, or with
    compare_all=False only the critical ones.
    """

    left: str | DataFrame
    right: str | DataFrame
    keys: tuple[str, ...]
    batch: str
    critical: tuple[str, ...]
    columns: tuple[str, ...] | None = None
    compare_all: bool = True
    strict_columns: bool = True
    run_id: str | None = None
    source_label: str | None = None
    left_label: str = "old_value"
    right_label: str = "new_value"
    tolerances: Mapping[str, float] = field(default_factory=dict)
    default_tolerance: float = 0.0
    group_size: int = 100
    columns_per_pass: int = 200
    sample_per_column: int = 10
    detail: str = "sample"
    row_detail: bool = False
    noisy_threshold: float = 0.95
    trim_strings: bool = False
    lower_strings: bool = False
    round_floats: int | None = None
    database: str = "default"
    prefix: str = "diff"
    table_format: str = "parquet"
    cleanup_on_success: bool = True
    cleanup_on_failure: bool = False

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("keys", tuple(self.keys or ()))
        put("critical", tuple(self.critical or ()))
        put("columns", None if self.columns is None else tuple(self.columns))
        put("tolerances", dict(self.tolerances))
        if not (self.run_id or "").strip():
            # a second can see many runs, so the time alone does not name one
            put("run_id", f"{datetime.now(UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}")
        for name in ("left", "right", "batch", "database", "prefix"):
            if isinstance(value := getattr(self, name), str) and not value.strip() or value is None:
                raise ValueError(f"{name} must not be empty")
        if not self.keys:
            raise ValueError("keys must not be empty")
        if self.batch not in self.keys:
            raise ValueError(f"the batch column {self.batch!r} must be one of the keys")
        if not self.critical:
            raise ValueError("critical must not be empty")
        if overlap := set(self.keys) & set(self.critical):
            raise ValueError(f"keys can't be compared as critical columns: {sorted(overlap)}")
        if self.left_label == self.right_label:
            raise ValueError("left_label and right_label must differ")
        taken = {*self.keys, "run_id", "source_label", "column", "null_mismatch", "diff", "abs_diff", "pct_diff", "pct_diff_pct", "tolerance_used"}
        if clash := taken & {self.left_label, self.right_label}:
            raise ValueError(f"labels clash with output columns: {sorted(clash)}")
        for name in ("group_size", "columns_per_pass", "sample_per_column"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.detail not in DETAIL_MODES:
            raise ValueError(f"detail must be one of {DETAIL_MODES}")
        if not 0 < self.noisy_threshold <= 1:
            raise ValueError("noisy_threshold must be in (0, 1]")
        if min([self.default_tolerance, *self.tolerances.values()]) < 0:
            raise ValueError("tolerances must not be negative")

    def using(self, **changes) -> CompareSpec:
        return replace(self, **changes)
