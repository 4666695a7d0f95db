"""Tables to compare: resolution, validation, and the columns to compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from diffloom.functions.canon import BATCH_TYPES, ColumnPair, pair
from diffloom.functions.names import chunks, col
from diffloom.operators.joins import on_columns
from diffloom.spec import CompareSpec


class SchemaError(ValueError):
    """The tables don't fit the spec."""


def resolve(spark: SparkSession, source: str | DataFrame, table_format: str = "parquet") -> DataFrame:
    """A DataFrame as it is, a path (with a slash or backslash) by its format, anything else as a table or view."""
    if isinstance(source, DataFrame):
        return source
    if "/" in source or "\\" in source:
        return spark.read.format(table_format).load(source)
    return spark.table(source)


def schema_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def validate(left: DataFrame, right: DataFrame, spec: CompareSpec) -> None:
    """Keys, critical columns and, if strict, columns asked for must be on both sides; the batch type must have a text form."""
    needed = [*spec.keys, *spec.critical, *(spec.columns or () if spec.strict_columns else ())]
    for name, df in (("left", left), ("right", right)):
        if missing := [c for c in dict.fromkeys(needed) if c not in df.columns]:
            raise SchemaError(f"the {name} table lacks {missing[:50]}")
        kind = schema_of(df)[spec.batch]
        if not isinstance(kind, BATCH_TYPES):
            raise SchemaError(f"batch column {spec.batch!r} of the {name} table has type {kind.simpleString()}, which can't name a batch")
    if spec.strict_columns and spec.columns is not None and (absent := sorted(set(spec.critical) - set(spec.columns))):
        raise SchemaError(f"critical columns that are not among those to compare: {absent[:50]}")


def compared_columns(left: DataFrame, right: DataFrame, spec: CompareSpec) -> list[str]:
    """Names are told apart by case. Sorted."""
    common = set(left.columns) & set(right.columns)
    if not spec.compare_all:
        wanted = set(spec.critical)
    else:
        wanted = common if spec.columns is None else set(spec.columns) & common
    return sorted(wanted - set(spec.keys))


def column_pairs(left: DataFrame, right: DataFrame, spec: CompareSpec) -> list[ColumnPair]:
    l, r = schema_of(left), schema_of(right)
    return [pair(c, l[c], r[c], spec) for c in compared_columns(left, right, spec)]


def column_groups(columns: Sequence[str], critical: Sequence[str], size: int) -> list[list[str]]:
    """Critical columns first, as given, then the others; in chunks of `size`."""
    first = [c for c in dict.fromkeys(critical) if c in set(columns)]
    return chunks(first + [c for c in columns if c not in set(first)], size)


def newest_batches(df: DataFrame, batch: str, n: int) -> DataFrame:
    """The rows of the n newest batches: the batches are found from one column and joined back, as the planner sees fit."""
    newest = df.select(col(batch)).where(col(batch).isNotNull()).distinct().orderBy(col(batch).desc()).limit(n)
    return on_columns(df, newest, [batch], "left_semi")
