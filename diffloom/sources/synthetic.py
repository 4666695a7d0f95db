"""Wide synthetic tables and exact mutations of them, for tests and benchmarks: all by expressions over spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions.names import col

KINDS = ("number", "text", "date", "flag")


def _draw(*parts) -> Column:
    """Uniform in [0, 1), the same for the same parts."""
    return F.shiftrightunsigned(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), 11) / F.lit(2.0**53)


def _value(kind: str, name: str, seed: int) -> Column:
    u, v = _draw(seed, name, F.col("row_id")), _draw(seed, name, F.col("row_id"), "second")
    made = {
        "number": F.round(F.lit(100.0) + F.lit(50.0) * F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(6.283185307179586) * v), 4),
        "text": F.translate(F.lpad(F.conv(F.floor(u * F.lit(10.0**8)).cast("string"), 10, 26), 8, "0"), "0123456789", "QRSTUVWXYZ"),
        "date": F.date_add("batch_date", F.floor(u * 731).cast("int") - 365),
        "flag": u < 0.5,
    }[kind]
    return F.when(_draw(seed, name, F.col("row_id"), "null") >= 0.05, made).alias(name)


def wide_table(spark: SparkSession, batches: int, rows: int, numbers: int = 10, texts: int = 3, dates: int = 2, flags: int = 2, seed: int = 42) -> DataFrame:
    """row_id, batch_date (quarter starts from 2020), number_000…, text_000…, date_000…, flag_000…; rows in each batch, 5 % nulls."""
    base = spark.range(1, batches * rows + 1).select(
        F.col("id").alias("row_id"), F.add_months(F.lit("2020-01-01").cast("date"), (3 * F.floor((F.col("id") - 1) / rows)).cast("int")).alias("batch_date")
    )
    columns = [_value(k, f"{k}_{i:03d}", seed) for k, n in zip(KINDS, (numbers, texts, dates, flags), strict=True) for i in range(n)]
    return base.select("row_id", "batch_date", *columns)


def mutate_table(df: DataFrame, key: str, columns: list[str], every: int, step: float = 1.0) -> DataFrame:
    """A second version of any table: columns changed as by mutate(), in about one of `every` rows, chosen by a hash of the key."""
    row_id = F.pmod(F.xxhash64(col(key)), F.lit(1 << 40)).alias("row_id")
    return mutate(df.select(row_id, *(col(c) for c in df.columns)), columns, every, step).drop("row_id")


def mutate(df: DataFrame, columns: list[str], every: int, step: float = 1.0, drop: int = 0, add: int = 0) -> DataFrame:
    """Change the columns of each row whose id is divisible by every (0: none); drop the first rows, add copies of the last under new ids.

    Numbers move by step, texts get a mark, dates a day, flags flip.
    """
    kinds = dict(df.dtypes)
    moved = {"double": lambda c: c + F.lit(step), "string": lambda c: F.concat(c, F.lit("*")), "date": lambda c: F.date_add(c, 1), "boolean": lambda c: ~c, "bigint": lambda c: c + F.lit(1), "int": lambda c: c + F.lit(1)}
    hit = (F.col("row_id") % every == 0) if every else F.lit(False)
    out = df.select(*(F.when(hit, moved[kinds[c]](col(c))).otherwise(col(c)).alias(c) if c in columns else col(c) for c in df.columns))
    added = out.where(F.col("row_id") <= add).withColumn("row_id", F.col("row_id") + 1_000_000_000)
    return out.where(F.col("row_id") > drop).unionByName(added)
