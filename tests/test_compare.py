"""Golden tables and edge cases."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from diffloom.plans.compare import Comparison
from diffloom.sources.synthetic import mutate, wide_table
from diffloom.sources.tables import SchemaError
from diffloom.spec import CompareSpec

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 4, 1)


def compare(spark, left, right, schema, critical, keys=("id", "day"), batch="day", right_schema=None, **options):
    sides = [spark.createDataFrame(rows, s) for rows, s in ((left, schema), (right, right_schema or schema))]
    return Comparison(spark, CompareSpec(*sides, keys, batch, critical, **options))


def counts(c):
    return {(r["batch_key"], r["column"]): (r["mismatch_count"], r["null_mismatch_count"]) for r in c.summary_by_batch.collect()}


def statuses(c):
    return {r["batch_key"]: r["batch_status"] for r in c.batch_status.collect()}


def row_counts(c):
    return {(r["batch_key"], r["row_status"]): r["row_count"] for r in c.row_status_counts.collect()}


def test_exact_tolerance_null_and_unchanged(spark):
    schema = "id long, day date, num_exact double, num_within_tol double, num_null double, num_unchanged double"
    left = [(i + 20 * b, d, 1.0 * i, 2.0 * i, 3.0 * i, 4.0 * i) for b, d in enumerate((D1, D2)) for i in range(20)]
    right = []
    for id_, d, a, w, n, u in left:
        i = id_ % 20
        if d == D2 and i < 5:
            a, w = a + 10, w + 0.1
        right.append((id_, d, a, w, None if d == D2 and 5 <= i < 10 else n, u))
    c = compare(spark, left, right, schema, ("num_exact", "num_within_tol", "num_null", "num_unchanged"), default_tolerance=0.5)
    got = counts(c)
    assert [got[("2024-04-01", x)] for x in ("num_exact", "num_within_tol", "num_null", "num_unchanged")] == [(5, 0), (0, 0), (5, 5), (0, 0)]
    assert all(v == (0, 0) for (b, _), v in got.items() if b == "2024-01-01")
    assert statuses(c) == {"2024-01-01": "identical", "2024-04-01": "changed"}
    by = {(r["batch_key"], r["column"]): r for r in c.summary_by_batch.collect()}
    assert by[("2024-04-01", "num_null")]["nonnull_compared_count"] == 15
    assert by[("2024-04-01", "num_within_tol")]["max_abs_diff"] == 0.1
    assert by[("2024-04-01", "num_exact")]["changed_row_count"] == 10
    assert by[("2024-01-01", "num_exact")]["max_abs_diff"] is None
    c.close()


@pytest.mark.parametrize("other_change", [False, True])
def test_normalisation_counts_for_hash_and_cells(spark, other_change):
    schema = "id long, day date, s_trim string, s_lower string, f_round double, co_change double"
    left = [(i, d, "ABC", "abc", 1.001, 5.0) for d in (D1, D2) for i in range(10)]
    right = [(i, d, " ABC " if d == D2 else "ABC", "ABC" if d == D2 else "abc", 1.002 if d == D2 else 1.001, 105.0 if other_change and d == D2 else 5.0) for i, d, *_ in left]
    c = compare(spark, left, right, schema, ("s_trim", "s_lower", "f_round", "co_change"), trim_strings=True, lower_strings=True, round_floats=2)
    got = counts(c)
    assert statuses(c)["2024-04-01"] == ("changed" if other_change else "identical")
    assert [got[("2024-04-01", x)] for x in ("s_trim", "s_lower", "f_round")] == [(0, 0)] * 3
    assert got[("2024-04-01", "co_change")] == ((10, 0) if other_change else (0, 0))


def test_without_normalisation_texts_differ(spark):
    c = compare(spark, [(1, D1, "a")], [(1, D1, " A")], "id long, day date, s string", ("s",))
    assert counts(c) == {("2024-01-01", "s"): (1, 0)}


def test_a_text_is_never_taken_for_null(spark):
    left = [(i, D1, "__NULL__" if i > 4 else "x") for i in range(10)]
    right = [(i, D1, None if i > 4 else "x") for i in range(10)]
    assert counts(compare(spark, left, right, "id long, day date, s string", ("s",))) == {("2024-01-01", "s"): (5, 5)}


def test_null_keys_are_unknown(spark):
    c = compare(spark, [(1, "b", 1.0), (None, "b", 1.0)], [(1, "b", 2.0), (None, "b", 1.0)], "id long, day string, v double", ("v",))
    assert row_counts(c) == {("b", "matched"): 1, ("b", "unknown"): 2}


def test_null_batches_never_meet(spark):
    c = compare(spark, [(1, None, 1.0), (2, "a", 1.0)], [(1, None, 1.0), (2, "a", 1.0)], "id long, day string, v double", ("v",))
    assert sorted((r["batch_key"] or "", r["batch_status"]) for r in c.batch_status.collect()) == [("", "left_only"), ("", "right_only"), ("a", "identical")]
    assert row_counts(c) == {(None, "left_only"): 1, (None, "right_only"): 1, ("a", "matched"): 1}


def test_one_sided_batches_are_counted_when_nothing_changed(spark):
    c = compare(spark, [(1, "a", 1.0), (2, "l", 1.0)], [(1, "a", 1.0), (3, "r", 1.0), (4, "r", 1.0)], "id long, day string, v double", ("v",))
    assert row_counts(c) == {("a", "matched"): 1, ("l", "left_only"): 1, ("r", "right_only"): 2}
    assert c.mismatch_sample.collect() == [] and "old_value" in c.mismatch_sample.columns
    assert counts(c) == {("a", "v"): (0, 0)}


def test_swapped_rows_and_repeated_rows_are_seen(spark):
    c = compare(spark, [(1, "a", 1.0), (2, "a", 2.0)], [(1, "a", 2.0), (2, "a", 1.0)], "id long, day string, v double", ("v",))
    assert statuses(c) == {"a": "changed"} and counts(c) == {("a", "v"): (2, 0)}
    c = compare(spark, [(1, "a", 1.0)] * 2, [(1, "a", 1.0)], "id long, day string, v double", ("v",))
    assert statuses(c) == {"a": "changed"}
    assert [r["n"] for r in c.duplicate_keys[0].collect()] == [2] and c.duplicate_keys[1].isEmpty()


def test_duplicate_keys_meet_all_counterparts(spark):
    left, right = [(1, "a", 1.0), (1, "a", 2.0)], [(1, "a", 5.0), (1, "a", 6.0), (1, "a", 7.0)]
    c = compare(spark, left, right, "id long, day string, v double", ("v",))
    assert row_counts(c) == {("a", "matched"): 6}
    assert counts(c) == {("a", "v"): (6, 0)}


def test_special_numbers(spark):
    nan, inf = float("nan"), float("inf")
    left = [(1, "a", nan, 0.0), (2, "a", 1.0, 1.0), (3, "a", inf, 1.0), (4, "a", nan, 1.0)]
    right = [(1, "a", nan, -0.0), (2, "a", nan, 1.0), (3, "a", inf, 2.0), (4, "a", nan, 3.0)]
    c = compare(spark, left, right, "id long, day string, v double, w double", ("v", "w"))
    assert counts(c) == {("a", "v"): (1, 0), ("a", "w"): (2, 0)}
    c = compare(spark, [(1, "a", nan, 0.0)], [(1, "a", nan, -0.0)], "id long, day string, v double, w double", ("v", "w"))
    assert statuses(c) == {"a": "identical"}


def test_large_whole_numbers_and_decimals_are_exact(spark):
    schema = "id long, day string, n long, d decimal(38,10)"
    c = compare(spark, [(1, "a", 2**53, Decimal("1.0000000001"))], [(1, "a", 2**53 + 1, Decimal("1.0000000002"))], schema, ("n", "d"))
    assert counts(c) == {("a", "n"): (1, 0), ("a", "d"): (1, 0)}
    assert {r["column"]: r["diff"] for r in c.mismatch_detail.collect()}["n"] == 1.0
    c = compare(spark, [(1, "a", -(2**63), Decimal(1))], [(1, "a", 2**63 - 1, Decimal(1))], schema, ("n", "d"))
    assert counts(c)[("a", "n")] == (1, 0)


def test_types_may_drift(spark):
    left, right = [(1, "a", 1, "2024-01-01", 3), (2, "a", 2, "x", 4)], [(1, "a", 1.0, D1, 3), (2, "a", 2.5, D2, 9)]
    c = compare(spark, left, right, "id long, day string, n int, s string, i int", ("n", "s", "i"), right_schema="id long, day string, n double, s date, i long")
    assert counts(c) == {("a", "n"): (1, 0), ("a", "s"): (1, 0), ("a", "i"): (1, 0)}
    c = compare(spark, left[:1], right[:1], "id long, day string, n int, s string, i int", ("n",), right_schema="id long, day string, n double, s date, i long")
    assert statuses(c) == {"a": "identical"}


def test_nested_values_and_maps(spark):
    schema = "id long, day string, v array<float>, m map<string,int>, p struct<a:int,b:string>"
    left = [(1, "a", [1.0, 2.0], {"x": 1, "y": 2}, (1, "q")), (2, "a", [1.0], {"x": 1}, (1, "q"))]
    right = [(1, "a", [1.0, 3.0], {"y": 2, "x": 1}, (1, "q")), (2, "a", [1.0], {"x": 2}, (2, "q"))]
    assert counts(compare(spark, left, right, schema, ("v", "m", "p"))) == {("a", "v"): (1, 0), ("a", "m"): (1, 0), ("a", "p"): (1, 0)}


@pytest.mark.parametrize(
    ("kind", "value", "key"),
    [
        ("date", D1, "2024-01-01"),
        ("int", 7, "7"),
        ("string", "Q1", "Q1"),
        ("timestamp", dt.datetime(2024, 1, 1, 2, 3, 4, 5), "2024-01-01T02:03:04.000005"),
        ("timestamp_ntz", dt.datetime(2024, 1, 1, 2, 3, 4, 5), "2024-01-01T02:03:04.000005"),
    ],
)
def test_batch_types(spark, kind, value, key):
    c = compare(spark, [(1, value, 1.0)], [(1, value, 1.0)], f"id long, day {kind}, v double", ("v",))
    assert [r["batch_key"] for r in c.batch_status.collect()] == [key]


@pytest.mark.parametrize("kind", ["double", "boolean", "decimal(10,2)", "binary"])
def test_other_batch_types_are_rejected_by_name(spark, kind):
    df = spark.createDataFrame([(1, 1.0)], "id long, v double").select("id", F.lit(None).cast(kind).alias("quarter_val"), "v")
    with pytest.raises(SchemaError, match="quarter_val"):
        Comparison(spark, CompareSpec(df, df, ("id", "quarter_val"), "quarter_val", ("v",)))


def test_missing_columns_are_rejected(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "id long, day string, v double")
    spec = CompareSpec(df, df, ("id", "day"), "day", ("v",), columns=("v", "w"))
    with pytest.raises(SchemaError, match="w"):
        Comparison(spark, spec)
    assert [p.name for p in Comparison(spark, spec.using(strict_columns=False)).pairs] == ["v"]
    with pytest.raises(SchemaError):
        Comparison(spark, CompareSpec(df, df.drop("v"), ("id", "day"), "day", ("v",)))


def test_unusual_names(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "id long, day string, v double").toDF("the id", "da`y.x", "v-1")
    other = df.withColumn("v-1", F.lit(2.0))
    c = Comparison(spark, CompareSpec(df, other, ("the id", "da`y.x"), "da`y.x", ("v-1",), left_label="before it", right_label="after.it"))
    assert counts(c) == {("a", "v-1"): (1, 0)}
    assert c.mismatch_sample.columns[-9:-6] == ["column", "before it", "after.it"][-3:] or "before it" in c.mismatch_sample.columns
    assert c.mismatch_sample.count() == 1


def test_views_and_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0)], "id long, day string, v double")
    df.createOrReplaceTempView("left_view")
    df.write.parquet(str(tmp_path / "right"))
    assert statuses(Comparison(spark, CompareSpec("left_view", str(tmp_path / "right"), ("id", "day"), "day", ("v",)))) == {"a": "identical"}


def test_many_columns_in_groups(spark):
    left = wide_table(spark, 3, 150, numbers=130, texts=0, dates=0, flags=0)
    names = tuple(f"number_{i:03d}" for i in range(130))
    right = mutate(left, ["number_003", "number_070"], 5).where("true")
    first = left.where("batch_date = '2020-01-01'")
    right = first.unionByName(right.where("batch_date > '2020-01-01'"))
    c = Comparison(spark, CompareSpec(left, right, ("row_id", "batch_date"), "batch_date", names, group_size=50, columns_per_pass=60))
    assert [len(g) for g in c.groups] == [50, 50, 30]
    assert statuses(c) == {"2020-01-01": "identical", "2020-04-01": "changed", "2020-07-01": "changed"}
    rows = c.summary_by_batch.collect()
    assert len(rows) == 3 * 130 == len({(r["batch_key"], r["column"]) for r in rows})
    assert {r["column"] for r in rows if r["mismatch_count"]} == {"number_003", "number_070"}
    assert all(r["changed_row_count"] == 0 for r in rows if r["column"] > "number_099")
    assert {r["group_index"] for r in c.group_changes.collect()} == {0, 1}
    nulls = {(r["batch_key"], r["column"]): r["nonnull_count"] for r in c.nonnull_counts.collect()}
    plain = left.join(right.select("row_id", F.col("number_129").alias("other")), "row_id").where("number_129 is not null and other is not null").groupBy("batch_date").count()
    assert {str(r["batch_date"]): r["count"] for r in plain.collect()} == {b: n for (b, col), n in nulls.items() if col == "number_129"}
    c.close()


def test_sample_is_the_first_by_key(spark):
    left = [(i, d, 1.0, 1.0) for d in ("a", "b") for i in range(30)]
    right = [(i, d, 2.0, 1.0 if i % 2 else 3.0) for i, d, *_ in left]
    c = compare(spark, left, right, "id long, day string, v double, w double", ("v", "w"), sample_per_column=4)
    got = sorted((r["day"], r["column"], r["id"]) for r in c.mismatch_sample.collect())
    assert got == sorted([(d, "v", i) for d in "ab" for i in range(4)] + [(d, "w", i) for d in "ab" for i in (0, 2, 4, 6)])
    assert c.mismatch_detail.count() == 60 + 30


def test_noise_threshold_is_inclusive(spark):
    left = [(i, "a", 1.0, 1.0, 1.0) for i in range(20)]
    right = [(i, "a", 2.0, 2.0 if i < 19 else 1.0, 2.0 if i < 18 else 1.0) for i in range(20)]
    c = compare(spark, left, right, "id long, day string, all_ double, most double, less double", ("all_", "most", "less"))
    assert sorted(r["column"] for r in c.noisy_columns.collect()) == ["all_", "most"]


def test_differences_in_percent(spark):
    c = compare(spark, [(1, "a", 8.0), (2, "a", 0.0), (3, "a", 1.0)], [(1, "a", 6.0), (2, "a", 1.0), (3, "a", None)], "id long, day string, v double", ("v",))
    got = {r["id"]: (r["diff"], r["abs_diff"], r["pct_diff"], r["pct_diff_pct"], r["null_mismatch"]) for r in c.mismatch_detail.collect()}
    assert got == {1: (-2.0, 2.0, -0.25, -25.0, False), 2: (1.0, 1.0, None, None, False), 3: (None, None, None, None, True)}


def test_empty_tables(spark):
    c = compare(spark, [], [], "id long, day string, v double", ("v",))
    assert c.batch_status.isEmpty() and c.summary_by_batch.isEmpty() and c.row_status_counts.isEmpty() and c.noisy_columns.isEmpty()
    c = compare(spark, [(1, "a", 1.0)], [], "id long, day string, v double", ("v",))
    assert statuses(c) == {"a": "left_only"} and c.summary_of_all.isEmpty()


def test_checksums_do_not_overflow(spark):
    df = spark.range(100_000).select(F.col("id"), F.lit("a").alias("day"), F.rand(1).alias("v"))
    c = Comparison(spark, CompareSpec(df, df, ("id", "day"), "day", ("v",)))
    assert statuses(c) == {"a": "identical"}
    assert math.isfinite(c.batch_status.first()["left_checksum"])
