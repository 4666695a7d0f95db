"""Second versions of real tables, and the benchmark's report."""

import csv

import bench
from conftest import DATA
from diffloom import Comparison, CompareSpec
from diffloom.sources.synthetic import mutate_table


def test_a_real_table_is_changed_in_the_named_columns_only(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("*", "o_orderkey % 3 AS lot")
    spec = CompareSpec(orders, mutate_table(orders, "o_orderkey", ["o_totalprice", "o_custkey"], 10), ("o_orderkey", "lot"), "lot", ("o_totalprice",))
    with Comparison(spark, spec) as c:
        rows = {r["column"]: r for r in c.summary_of_all.collect()}
    n = rows["o_totalprice"]["mismatch_count"]
    assert 0.05 * orders.count() < n == rows["o_custkey"]["mismatch_count"] < 0.2 * orders.count()
    assert rows["o_totalprice"]["max_abs_diff"] == rows["o_custkey"]["max_abs_diff"] == 1.0
    assert all(r["mismatch_count"] == 0 for c, r in rows.items() if c not in ("o_totalprice", "o_custkey"))


def test_only_changed_batches_are_read_again(spark, tmp_path):
    """The list of changed batches reaches the scan of a partitioned table."""
    orders = spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("o_orderkey", "o_totalprice", "o_orderkey % 4 AS lot")
    left, right = f"file://{tmp_path}/left", f"file://{tmp_path}/right"
    orders.write.partitionBy("lot").parquet(left)
    orders.selectExpr("o_orderkey", "if(lot = 2, o_totalprice + 1D, o_totalprice) AS o_totalprice", "lot").write.partitionBy("lot").parquet(right)
    with Comparison(spark, CompareSpec(left, right, ("o_orderkey", "lot"), "lot", ("o_totalprice",))) as c:
        plan = c._joined[0][0]._jdf.queryExecution().toString()
        assert c.mismatch_detail.select("lot").distinct().collect()[0][0] == 2
    assert plan.count("PartitionFilters: [isnotnull(lot") >= 2 and ("(lot#" in plan and "= 2)" in plan)


def test_report(tmp_path, capsys):
    rows = [{"scale": "tiny", "rate": "5 %", "seconds": 1.5}, {"scale": "tiny", "rate": "50 %", "seconds": 12.25}]
    bench.report(rows, str(tmp_path / "r.csv"))
    assert capsys.readouterr().out.splitlines()[1].split() == ["tiny", "5", "%", "1.5"]
    with open(tmp_path / "r.csv") as f:
        assert [r["seconds"] for r in csv.DictReader(f)] == ["1.5", "12.25"]
