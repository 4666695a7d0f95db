"""Cells: the changed rows of both tables, compared column by column.

Columns of equal types are handled as one lot: each side carries a lot as one
array, the joined arrays are taken apart into a row per cell, and what is said
of a cell is written once for the lot. So plans don't grow with the number of
columns, and only cells whose values differ go further than one comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.functions.canon import INTEGRAL, ColumnPair, as_text, canonical
from diffloom.functions.names import col
from diffloom.operators.joins import on_columns
from diffloom.operators.screen import MASK_BITS
from diffloom.spec import CompareSpec


@dataclass(frozen=True)
class Place:
    """A compared column: its group's match flag and its bit in the null masks."""

    pair: ColumnPair
    flag: str
    at: int


Lot = list[Place]  # of the same types, flag and exactness


def places(groups: list[list[ColumnPair]], changed: set[int]) -> list[Place]:
    """The columns of changed groups."""
    every = [(p, i) for i, group in enumerate(groups) for p in group]
    return [Place(p, f"gh_{i}_match", at) for at, (p, i) in enumerate(every) if i in changed]


def lots(some: Sequence[Place]) -> list[Lot]:
    found: dict[tuple, Lot] = {}
    for x in some:
        found.setdefault((x.pair.left.json(), x.pair.right.json(), x.pair.is_exact, x.flag), []).append(x)
    return list(found.values())


@dataclass(frozen=True)
class Cell:
    """Expressions on the values l and r of a lot's cell; all but one_null and mismatch are null where they don't apply."""

    one_null: Column
    mismatch: Column
    diff: Column
    abs_diff: Column
    pct_diff: Column
    pct_diff_pct: Column


def cell(p: ColumnPair, left: Column, right: Column, tolerance: Column, spec: CompareSpec) -> Cell:
    """Compare raw values left and right of columns with p's types.

    Numbers differ if their distance is over the tolerance; NaN equals NaN, and
    an infinity itself. Without tolerance whole and decimal numbers are
    compared exactly. Other values differ unless equal, null equal to null.
    What spec normalises is compared normalised; differences are of raw values.
    """
    a, b = canonical(left, p.left, p.right, spec), canonical(right, p.right, p.left, spec)
    one_null, both = a.isNull() != b.isNull(), a.isNotNull() & b.isNotNull()
    if not p.is_numeric:
        none = F.lit(None).cast("double")
        return Cell(one_null, ~a.eqNullSafe(b), none, none, none, none)
    x, y = left.cast("double"), right.cast("double")
    if p.is_exact:
        mismatch = ~a.eqNullSafe(b)
    else:
        far = ~a.eqNullSafe(b) & (F.abs(b.cast("double") - a.cast("double")) > tolerance)
        mismatch = one_null | F.coalesce(both & far, F.lit(False))
    # doubles of large whole numbers lose digits: their distance is taken before the cast where it can't overflow
    whole = isinstance(p.left, INTEGRAL) and isinstance(p.right, INTEGRAL)
    distance = (right.cast(T.DecimalType(20, 0)) - left.cast(T.DecimalType(20, 0))).cast("double") if whole else y - x
    diff = F.when(both, distance)
    ratio = F.when(both & (x != 0), distance / x)
    return Cell(one_null, mismatch, F.round(diff, 4), F.round(F.abs(diff), 4), F.round(ratio, 4), F.round(100 * ratio, 4))


def changed_rows(left: DataFrame, right: DataFrame, keys: DataFrame, some: list[Lot], batches: Column, spec: CompareSpec) -> DataFrame:
    """The changed rows of both sides: keys' columns, then l_k and r_k, the arrays of the k-th lot.

    Only the named columns of the given batches are read: batches is a
    predicate on the batch column, so partitions and row groups without a
    change are passed over. The keys restrict each side before the sides meet;
    how they are joined is left to the planner, which knows how many there are.
    """
    side = lambda df, s: df.where(batches).select(*(col(k) for k in spec.keys), *(F.array(*(col(x.pair.name) for x in lot)).alias(f"{s}_{k}") for k, lot in enumerate(some)))
    return on_columns(on_columns(keys, side(left, "l"), spec.keys, "inner"), side(right, "r"), spec.keys, "inner")


def _of(values: Sequence, at: Column) -> Column:
    """The at-th of the values, which don't depend on at if they are all the same."""
    return F.lit(values[0]) if len(set(values)) == 1 else F.element_at(F.array(*map(F.lit, values)), at + 1)


def _differing(joined: DataFrame, k: int, lot: Lot, spec: CompareSpec) -> tuple[DataFrame, ColumnPair, Column]:
    """A row per cell of the lot whose raw values aren't equal: keys…, i, l, r; with a pair of its types and the tolerance of i."""
    p = lot[0].pair
    cells = joined.where(~F.col(lot[0].flag)).select(*(col(c) for c in spec.keys), F.posexplode(F.arrays_zip(f"l_{k}", f"r_{k}")).alias("i_", "c_"))
    cells = cells.select(*(col(c) for c in spec.keys), "i_", F.col(f"c_.l_{k}").alias("l_"), F.col(f"c_.r_{k}").alias("r_"))
    if p.left == p.right and "map<" not in p.left.simpleString():
        cells = cells.where(~F.col("l_").eqNullSafe(F.col("r_")))
    return cells, p, _of([x.pair.tolerance for x in lot], F.col("i_"))


def summarise(joined: DataFrame, some: list[Lot], spec: CompareSpec) -> DataFrame:
    """(batch, column, changed_row_count, mismatch_count, null_mismatch_count, max_abs_diff) of columns with changed rows.

    Counts of changed rows, and whether a column has two values in any of them,
    come from the rows' flags and null masks; cells with equal values matter no
    further, as their distance is zero.
    """
    flags = list(dict.fromkeys(lot[0].flag for lot in some))
    masks = [c for c in joined.columns if c.startswith("nulls_")]
    of_flags = [
        F.struct(
            F.lit(f).alias("flag"), F.count_if(~F.col(f)).alias("n"), F.array(*(F.bit_and(F.when(~F.col(f), F.col(m))) for m in masks)).alias("nulls")
        )
        for f in flags
    ]
    base = joined.groupBy(col(spec.batch).alias("b_")).agg(F.array(*of_flags).alias("f")).select("b_", F.explode("f").alias("f")).where("f.n > 0")
    about = [F.struct(F.lit(x.pair.name).alias("column"), F.lit(x.flag).alias("flag"), F.lit(x.pair.is_numeric).alias("numeric"), F.lit(x.at).alias("at")) for lot in some for x in lot]
    base = base.select("b_", "f", F.explode(F.array(*about)).alias("c")).where("c.flag = f.flag")
    null = F.getbit(F.element_at("f.nulls", (F.floor(F.col("c.at") / MASK_BITS) + 1).cast("int")), F.pmod(F.col("c.at"), F.lit(MASK_BITS))) == 1
    base = base.select("b_", "c.column", F.col("f.n").alias("changed_row_count"), F.when(F.col("c.numeric") & ~null, F.lit(0.0)).alias("least_"))
    found = []
    for k, lot in enumerate(some):
        cells, p, tolerance = _differing(joined, k, lot, spec)
        c = cell(p, F.col("l_"), F.col("r_"), tolerance, spec)
        counted = cells.groupBy(col(spec.batch).alias("b_"), "i_").agg(
            F.count_if(c.mismatch).alias("mismatch_count"), F.count_if(c.one_null).alias("null_mismatch_count"), F.max(c.abs_diff).alias("most_")
        )
        found.append(counted.withColumn("column", _of([x.pair.name for x in lot], F.col("i_"))).drop("i_"))
    rows = base.join(reduce(DataFrame.unionByName, found), ["b_", "column"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select(
        F.col("b_").alias(spec.batch), "column", "changed_row_count", count("mismatch_count"), count("null_mismatch_count"), F.greatest("least_", "most_").alias("max_abs_diff")
    )


def mismatches(joined: DataFrame, some: list[Lot], spec: CompareSpec, most: int | None = None) -> DataFrame:
    """A row per differing cell: keys…, column, both values as text, null_mismatch, diff, abs_diff, pct_diff, pct_diff_pct, tolerance_used.

    most: only so many cells of each batch and column, the first ones by key;
    they are chosen before texts and differences are made of them.
    """
    found = []
    for k, lot in enumerate(some):
        cells, p, tolerance = _differing(joined, k, lot, spec)
        c = cell(p, F.col("l_"), F.col("r_"), tolerance, spec)
        cells = cells.where(c.mismatch)
        if most is not None:
            order = F.row_number().over(Window.partitionBy(col(spec.batch), F.col("i_")).orderBy(*(col(x) for x in spec.keys)))
            cells = cells.withColumn("place_", order).where(F.col("place_") <= most).drop("place_")
        found.append(
            cells.select(
                *(col(x) for x in spec.keys),
                _of([x.pair.name for x in lot], F.col("i_")).alias("column"),
                as_text(F.col("l_"), p.left).alias(spec.left_label),
                as_text(F.col("r_"), p.right).alias(spec.right_label),
                c.one_null.alias("null_mismatch"),
                c.diff.alias("diff"),
                c.abs_diff.alias("abs_diff"),
                c.pct_diff.alias("pct_diff"),
                c.pct_diff_pct.alias("pct_diff_pct"),
                tolerance.alias("tolerance_used"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def of_flags(keys: DataFrame, flags: list[str]) -> DataFrame:
    """The rows in which a group behind one of the flags changed."""
    return keys.where(reduce(lambda a, b: a | b, (~F.col(f) for f in dict.fromkeys(flags))))
