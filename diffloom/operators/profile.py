"""Profiles of two tables: rows, columns, and what is on one side only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised_names(columns: list[str], ignore_case: bool, strip: bool) -> dict[str, str]:
    """Normalised name -> name as spelt; of names that meet, the last counts."""
    form = lambda c: (c.strip() if strip else c).lower() if ignore_case else (c.strip() if strip else c)
    return {form(c): c for c in columns}


def profile(left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right", ignore_case: bool = True, strip: bool = True) -> DataFrame:
    """One row: names, row and column counts, absolute differences, shared columns and those of one side."""
    l, r = (normalised_names(df.columns, ignore_case, strip) for df in (left, right))
    only = lambda a, b: [a[k] for k in sorted(a.keys() - b.keys())]
    texts = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    counts = left.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("side"), "n").unionByName(right.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("side"), "n"))
    rows = counts.agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("left_row_count"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("right_row_count"))
    width = {"left_column_count": len(left.columns), "right_column_count": len(right.columns), "shared_column_count": len(l.keys() & r.keys())}
    left_only, right_only = only(l, r), only(r, l)
    return rows.select(
        F.lit(left_name).alias("left_name"),
        F.lit(right_name).alias("right_name"),
        "left_row_count",
        "right_row_count",
        *(F.lit(n).cast("long").alias(name) for name, n in width.items()),
        F.lit(len(left_only)).cast("long").alias("left_only_column_count"),
        F.lit(len(right_only)).cast("long").alias("right_only_column_count"),
        F.abs(F.col("left_row_count") - F.col("right_row_count")).alias("row_delta"),
        F.lit(abs(len(left.columns) - len(right.columns))).cast("long").alias("column_delta"),
        texts(left_only).alias("left_only_columns"),
        texts(right_only).alias("right_only_columns"),
    )


def schema_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column, left_type, right_type, drift) of columns that are missing on a side or differ in type."""
    l, r = ({f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (left, right))
    rows = []
    for c in sorted(l.keys() | r.keys()):
        if l.get(c) != r.get(c):
            rows.append((c, l.get(c), r.get(c), "right_only" if c not in l else "left_only" if c not in r else "type"))
    return left.sparkSession.createDataFrame(rows, "column string, left_type string, right_type string, drift string")
