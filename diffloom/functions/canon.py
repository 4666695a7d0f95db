"""Canonical values: one form for hashing and for comparing, and the text form of batch keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.spec import CompareSpec

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = (*INTEGRAL, *FLOATING, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType)
BATCH_TYPES = (T.StringType, T.DateType, *INTEGRAL, *TIMES)
SECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class ColumnPair:
    """A compared column with its types on both sides and its tolerance."""

    name: str
    left: T.DataType
    right: T.DataType
    tolerance: float

    @property
    def is_numeric(self) -> bool:
        return isinstance(self.left, NUMERIC) and isinstance(self.right, NUMERIC)

    @property
    def is_exact(self) -> bool:
        """Whole or decimal numbers without tolerance are compared without going through doubles."""
        return self.is_numeric and self.tolerance == 0 and not isinstance(self.left, FLOATING) and not isinstance(self.right, FLOATING)


def pair(name: str, left: T.DataType, right: T.DataType, spec: CompareSpec) -> ColumnPair:
    numeric = isinstance(left, NUMERIC) and isinstance(right, NUMERIC)
    return ColumnPair(name, left, right, float(spec.tolerances.get(name, spec.default_tolerance if numeric else 0.0)))


def as_text(value: Column, kind: T.DataType) -> Column:
    """A text form that does not depend on the session: dates and times in ISO form, others as Spark casts them."""
    if isinstance(kind, TIMES):
        return F.date_format(value, SECONDS)
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(value)).cast("string")
    return value.cast("string")


def canonical(value: Column, kind: T.DataType, other: T.DataType, spec: CompareSpec) -> Column:
    """The value as both hashing and comparison see it.

    Equal types keep their type. Different numeric types meet in a common one,
    other different types meet as text. Negative zero is zero.
    """
    if isinstance(kind, T.StringType) and spec.trim_strings:
        value = F.trim(value)
    if isinstance(kind, T.StringType) and spec.lower_strings:
        value = F.lower(value)
    if isinstance(kind, FLOATING):
        value = value.cast("double")
        if spec.round_floats is not None:
            value = F.round(value, spec.round_floats)
        value = value + F.lit(0.0)
    if kind == other:
        return F.array_sort(F.map_entries(value)) if isinstance(kind, T.MapType) else value
    if isinstance(kind, NUMERIC) and isinstance(other, NUMERIC):
        if isinstance(kind, FLOATING) or isinstance(other, FLOATING):
            return value.cast("double")
        if isinstance(kind, INTEGRAL) and isinstance(other, INTEGRAL):
            return value.cast("long")
        scale = max(getattr(kind, "scale", 0), getattr(other, "scale", 0))
        return value.cast(T.DecimalType(38, scale))
    return as_text(value, kind)


def hash_parts(value: Column, kind: T.DataType, other: T.DataType, spec: CompareSpec) -> list[Column]:
    """Inputs of a hash: whether the value is null, then the value. No text can be taken for a null."""
    canon = canonical(value, kind, other, spec)
    return [canon.isNull(), canon]


def batch_key(value: Column, kind: T.DataType) -> Column:
    """The text under which a batch is reported; null stays null."""
    if not isinstance(kind, BATCH_TYPES):
        raise TypeError(f"a batch column can't be of type {kind.simpleString()}")
    return as_text(value, kind)


def wrapping_sum(h: Column) -> Column:
    """The sum of 64-bit hashes modulo 2**64, without overflow: halves are summed apart and put together."""
    high, low = F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    carried = (high + F.shiftright(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))
