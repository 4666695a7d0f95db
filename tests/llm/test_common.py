"""The helpers that the corpus operators share."""

import pytest
from pyspark.sql import functions as F

from diffloom.llm.common import sieved


@pytest.mark.parametrize(("some", "most"), [(1, 4096), (300, 4096), (5000, 4096), (5000, 1), (90_000, 1)])
def test_sieve_loses_no_key(spark, some, most):
    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("part_"), F.lit("x").alias("bits_")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) part_, 'y' bits_"))
    keys = spark.range(some).select((F.col("id") * 3 - 9000).alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) k"))
    left = sieved(rows, "part_", keys, "k", most)
    assert left.columns == rows.columns
    found = {r["part_"] for r in left.collect()}
    wanted = {3 * i - 9000 for i in range(some)} & set(range(-20_000, 20_000))
    assert wanted <= found
    if some < 10_000:  # 16 bits a key, or 6 where the bound holds
        assert None not in found and len(found - wanted) < (0.1 if most > 1 else 0.2) * 40_000


def test_sieve_without_keys(spark):
    none = spark.range(0).withColumnRenamed("id", "k")
    assert sieved(spark.range(5), "id", none, "k").collect() == []
    assert sieved(spark.range(0), "id", spark.range(5).withColumnRenamed("id", "k"), "k").collect() == []
