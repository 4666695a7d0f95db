"""Screening: one scan of each side gives row hashes, from which batches are judged as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions.canon import ColumnPair, canonical, hash_parts, wrapping_sum
from diffloom.functions.names import chunks, col
from diffloom.spec import CompareSpec

#: Columns a word of the null mask stands for; the sign bit stays free.
MASK_BITS = 62


def hash_rows(df: DataFrame, side: str, groups: list[list[ColumnPair]], spec: CompareSpec) -> DataFrame:
    """keys…, gh_i (hash of column group i), nulls_j (bit masks of null values): the narrow form of a wide table.

    Everything up to the comparison of cells is computed from it, so the wide
    table is scanned once here and then only for rows that changed. Bit k of
    mask j stands for the compared column 62 j + k, in the order of the groups.
    """
    types = lambda p: (p.left, p.right) if side == "left" else (p.right, p.left)
    pairs = [p for group in groups for p in group]
    hashes = [F.xxhash64(*(part for p in g for part in hash_parts(col(p.name), *types(p), spec))).alias(f"gh_{i}") for i, g in enumerate(groups)]
    masks = []
    for j, part in enumerate(chunks(pairs, MASK_BITS)):
        mask = F.lit(0).cast("long")
        for k, p in enumerate(part):
            mask = mask.bitwiseOR(F.when(canonical(col(p.name), *types(p), spec).isNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        masks.append(mask.alias(f"nulls_{j}"))
    return df.select(*(col(k) for k in spec.keys), *hashes, *masks)


def batch_checksums(hashed: DataFrame, groups: int, spec: CompareSpec) -> DataFrame:
    """(batch, checksum, row_count): the sum of hashes doesn't depend on the order and sees repeated rows."""
    row = F.xxhash64(*(part for k in spec.keys for part in (col(k).isNull(), col(k))), *(F.col(f"gh_{i}") for i in range(groups)))
    return hashed.groupBy(col(spec.batch)).agg(wrapping_sum(row).alias("checksum"), F.count(F.lit(1)).alias("row_count"))


def batch_status(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """(batch, left_checksum, right_checksum, left_row_count, right_row_count, batch_status), a row per batch.

    Null batches never meet: each side's is of that side only.
    """
    sides = [
        df.select(col(spec.batch).alias(f"{s}_batch"), F.col("checksum").alias(f"{s}_checksum"), F.col("row_count").alias(f"{s}_row_count"))
        for s, df in (("left", left), ("right", right))
    ]
    both = sides[0].join(sides[1], F.col("left_batch") == F.col("right_batch"), "full_outer")
    same = (F.col("left_checksum") == F.col("right_checksum")) & (F.col("left_row_count") == F.col("right_row_count"))
    status = F.when(F.col("left_checksum").isNull(), "right_only").when(F.col("right_checksum").isNull(), "left_only").when(same, "identical").otherwise("changed")
    return both.select(
        F.coalesce("left_batch", "right_batch").alias(spec.batch), "left_checksum", "right_checksum", "left_row_count", "right_row_count", status.alias("batch_status")
    )
