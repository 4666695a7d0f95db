"""The registered queries of the comparison engine, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators import profile as profiles
from diffloom.operators import triage
from diffloom.oracle import Oracle, OracleColumn
from diffloom.plans import recipes
from diffloom.plans.artifacts import latest_status
from diffloom.plans.compare import Comparison
from diffloom.sources import pairs
from diffloom.sources.tables import newest_batches
from diffloom.spec import CompareSpec

Query = Callable[[SparkSession, str], DataFrame]

TOLERANCE = 0.5
NOISE = 0.06


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_open: list[Comparison] = []


def _compare(spark: SparkSession, spec: CompareSpec) -> Comparison:
    _open.append(Comparison(spark, spec))
    return _open[-1]


def _alone(query: Query) -> Query:
    """The query, closing the comparisons of the one before it: results are lazy, so none can close its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        while _open:
            _open.pop().close()
        return query(spark, sf_dir)

    return run


def orders(spark: SparkSession, sf_dir: str, later: bool = False, **options) -> Comparison:
    left, right = pairs.orders_pair(spark, _read(spark, sf_dir, "orders"), later)
    given = {"tolerances": {"o_totalprice": TOLERANCE}, "critical": ("o_totalprice", "o_orderstatus"), "noisy_threshold": NOISE} | options
    return _compare(spark, CompareSpec(left, right, ("o_orderkey", "batch"), "batch", **given))


def _orders_oracle(later: bool = False, grouped: bool = False, tolerance: float = TOLERANCE, normalised: bool = False, only: tuple[str, ...] | None = None) -> Oracle:
    text = "lower(trim({}, ' '))" if normalised else "{}"
    columns = [
        OracleColumn("o_totalprice", "double", 0, tolerance),
        OracleColumn("o_orderstatus", "string", 0, norm=text),
        OracleColumn("o_custkey", "bigint", int(grouped)),
        OracleColumn("o_orderpriority", "string", int(grouped), norm=text),
    ]
    return Oracle(pairs.orders_sql(later), ("o_orderkey", "batch"), "batch", [c for c in columns if only is None or c.name in only])


def _status(c: Comparison) -> DataFrame:
    return c.batch_status.select("batch_key", "batch_status", "left_row_count", "right_row_count")


def _events(spark: SparkSession, sf_dir: str, **options) -> Comparison:
    events = _read(spark, sf_dir, "events")
    sides = [spark.sql(sql, events=events) for sql in (pairs.EVENTS_LEFT, pairs.EVENTS_RIGHT)]
    return _compare(spark, CompareSpec(*sides, ("event_id", "day"), "day", **{"critical": ("value",)} | options))


EVENTS_ORACLE = Oracle(
    pairs.plain_sql(pairs.EVENTS_LEFT, pairs.EVENTS_RIGHT),
    ("event_id", "day"),
    "day",
    [OracleColumn("value", "double"), OracleColumn("event_type", "string"), OracleColumn("props", "string")],
    "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')",
)


def _customers(spark: SparkSession, sf_dir: str) -> Comparison:
    customer = _read(spark, sf_dir, "customer")
    return _compare(spark, CompareSpec(customer, spark.sql(pairs.CUSTOMER_RIGHT, customer=customer), ("c_custkey", "c_mktsegment"), "c_mktsegment", ("c_acctbal",)))


CUSTOMER_ORACLE = Oracle(
    pairs.plain_sql("SELECT * FROM customer", pairs.CUSTOMER_RIGHT),
    ("c_custkey", "c_mktsegment"),
    "c_mktsegment",
    [OracleColumn("c_acctbal", "double"), OracleColumn("c_name", "string"), OracleColumn("c_nationkey", "int")],
    "{}",
)


def _parts(spark: SparkSession, sf_dir: str) -> Comparison:
    part = _read(spark, sf_dir, "part")
    return _compare(spark, CompareSpec(part, spark.sql(pairs.PART_RIGHT, part=part), ("p_partkey", "p_size"), "p_size", ("p_type",)))


PART_ORACLE = Oracle(
    pairs.plain_sql("SELECT * FROM part", pairs.PART_RIGHT),
    ("p_partkey", "p_size"),
    "p_size",
    [OracleColumn("p_type", "string"), OracleColumn("p_name", "string"), OracleColumn("p_brand", "string"), OracleColumn("p_retailprice", "double")],
    "CAST({} AS VARCHAR)",
)


def orders_total_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: what became of the rows of every batch."""
    return orders(spark, sf_dir).row_status_counts


def null_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are null on either side meet nothing."""
    left, right = (df.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 70 != 5, F.col("o_orderkey"))) for df in pairs.orders_pair(spark, _read(spark, sf_dir, "orders")))
    spec = CompareSpec(left, right, ("o_orderkey", "batch"), "batch", ("o_totalprice",))
    return _compare(spark, spec).row_status_totals


def null_key_sql() -> str:
    o = _orders_oracle()
    sides = "".join(f", {s}2 AS (SELECT * REPLACE (CASE WHEN o_orderkey % 70 <> 5 THEN o_orderkey END AS o_orderkey) FROM {s})" for s in "lr")
    tables = f"{o.tables}{sides}".replace("l AS (", "l0 AS (", 1).replace(", r AS (", ", r0 AS (", 1).replace("FROM l)", "FROM l0)").replace("FROM r)", "FROM r0)").replace("l2 AS", "l AS").replace("r2 AS", "r AS")
    # identical batches are counted whole, null keys and all
    return f"""{Oracle(tables, o.keys, o.batch, o.columns).ctes}, w AS (SELECT coalesce(l_batch, r_batch) AS d, row_status, l_batch IS NOT NULL AS in_l, year(coalesce(l_batch, r_batch)) = 1996 AS same FROM j)
SELECT CASE WHEN same THEN 'matched' WHEN d = DATE '1995-01-01' THEN 'left_only' WHEN d = DATE '2001-07-01' THEN 'right_only' ELSE row_status END AS row_status, CAST(count(*) AS BIGINT) AS row_count
FROM w WHERE NOT (same AND row_status = 'unknown' AND NOT in_l) GROUP BY 1"""


def duplicate_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose key is not unique, as every comparison reports them."""
    items = _read(spark, sf_dir, "lineitem")
    spec = CompareSpec(items, items, ("l_orderkey", "l_linenumber"), "l_linenumber", ("l_quantity",))
    return triage.duplicate_keys(items, spec)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    shown = profiles.profile(o, o.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderstatus", " O_OrderStatus ").withColumnRenamed("o_custkey", "customer"), "orders", "reshaped")
    return shown.withColumns({c: F.concat_ws(",", c) for c in ("left_only_columns", "right_only_columns")})


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return profiles.schema_drift(o, o.withColumn("o_totalprice", F.col("o_totalprice").cast("string")).drop("o_custkey").withColumn("o_extra", F.lit(1)))


def latest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = pairs.orders_pair(spark, _read(spark, sf_dir, "orders"))
    return newest_batches(left, "batch", 3).groupBy("batch").agg(F.count(F.lit(1)).alias("row_count"))


def scaling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("narrow", 1000, 2.5), ("narrow", 2000, 4.5), ("narrow", 4000, 8.5), ("wide", 1000, 3.0), ("wide", 2000, 7.0), ("wide", 4000, 11.0)]
    return recipes.scaling_fit(spark.createDataFrame(rows, "label string, n_rows long, seconds double"))


RUN_LOG = "('a', 1, 'RUNNING'), ('a', 5, 'COMPLETED'), ('b', 2, 'RUNNING'), ('c', 3, 'RUNNING'), ('c', 3, 'FAILED')"
TIMINGS = "('a', 'cells', 2.0D), ('a', 'triage', 1.5D), ('a', 'cells', 0.25D), ('b', 'cells', 4.0D)"


def latest_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run the last event of its log; of events of one moment the start counts as the earlier."""
    log = spark.sql(f"SELECT run_id, timestamp_seconds(moment) AS event_at, status FROM VALUES {RUN_LOG} AS t(run_id, moment, status)")
    return latest_status(log).select("run_id", "status")


def phase_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.phase_table(spark.sql(f"SELECT * FROM VALUES {TIMINGS} AS t(run_id, phase, seconds)"))


def scaling_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", 1000, 10, 2.5), ("a", 1000, 20, 4.0), ("a", 4000, 20, 15.5)]
    return recipes.scaling_fit_by_cells(spark.createDataFrame(rows, "label string, n_rows long, n_columns long, seconds double"))


_grouped = {"group_size": 2}
_text = {"trim_strings": True, "lower_strings": True}


def _totals(c: Comparison) -> DataFrame:
    return c.summary_of_all


QUERIES: dict[str, Query] = {
    "batch_status": lambda s, d: _status(orders(s, d)),
    "batch_status_timestamp": lambda s, d: _status(_events(s, d)),
    "batch_status_string": lambda s, d: _status(_customers(s, d)),
    "batch_status_int": lambda s, d: _status(_parts(s, d)),
    "row_status_counts": orders_total_status,
    "row_status_totals": lambda s, d: orders(s, d).row_status_totals,
    "row_status_detail": lambda s, d: orders(s, d).row_status_detail,
    "changed_keys": lambda s, d: orders(s, d, **_grouped).changed_keys,
    "group_changes": lambda s, d: orders(s, d, **_grouped).group_changes,
    "nonnull_counts": lambda s, d: orders(s, d).nonnull_counts,
    "summary_by_batch": lambda s, d: orders(s, d).summary_by_batch,
    "summary_by_batch_exact": lambda s, d: orders(s, d, tolerances={}).summary_by_batch,
    "summary_by_batch_grouped": lambda s, d: orders(s, d, columns_per_pass=1, **_grouped).summary_by_batch,
    "summary_by_batch_events": lambda s, d: _events(s, d).summary_by_batch,
    "summary_by_batch_customers": lambda s, d: _customers(s, d).summary_by_batch,
    "summary_of_critical": lambda s, d: orders(s, d, compare_all=False).summary_by_batch,
    "summary_of_all": lambda s, d: _totals(orders(s, d)),
    "noisy_columns": lambda s, d: orders(s, d).noisy_columns,
    "zero_fill_coverage": lambda s, d: orders(s, d).summary_by_batch.groupBy("batch_key").agg(F.count(F.lit(1)).alias("column_count"), F.count_if(F.col("changed_row_count") == 0).alias("unchanged_count")),
    "mismatch_sample": lambda s, d: orders(s, d, sample_per_column=3).mismatch_sample,
    "mismatch_detail": lambda s, d: orders(s, d).mismatch_detail,
    "normalized_compare": lambda s, d: orders(s, d, **_text).summary_by_batch,
    "null_vs_sentinel": lambda s, d: _events(s, d, columns=("value", "props")).mismatch_detail.where("column = 'props'"),
    "null_key_rows": null_key_rows,
    "duplicate_key_rows": duplicate_key_rows,
    "column_profile": column_profile,
    "schema_drift": schema_drift,
    "top_columns": lambda s, d: recipes.top_columns(_totals(orders(s, d)), 3),
    "columns_by_rate": lambda s, d: recipes.by_rate(_totals(orders(s, d))),
    "cell_rollup": lambda s, d: recipes.cell_rollup(orders(s, d).summary_by_batch),
    "non_noisy_summary": lambda s, d: recipes.without_noise((c := orders(s, d)).summary_by_batch, c.noisy_columns),
    "column_samples": lambda s, d: recipes.samples_of(orders(s, d, sample_per_column=2).mismatch_sample, "o_custkey"),
    "run_drift": lambda s, d: recipes.drift(_totals(orders(s, d)), _totals(orders(s, d, later=True))),
    "latest_batches": latest_batches,
    "scaling_fit": scaling_fit,
    "scaling_by_cells": scaling_by_cells,
    "latest_run_status": latest_run_status,
    "phase_pivot": phase_pivot,
}
QUERIES = {name: _alone(query) for name, query in QUERIES.items()}

_o, _g = _orders_oracle(), _orders_oracle(grouped=True)
_critical = ("o_totalprice", "o_orderstatus")
_sentinel = Oracle(EVENTS_ORACLE.tables, EVENTS_ORACLE.keys, "day", [c for c in EVENTS_ORACLE.columns if c.name == "props"], EVENTS_ORACLE.key)


def _drift_sql() -> str:
    parts = {n: f"({_orders_oracle(later=later).summary_of_all()})" for n, later in (("a", False), ("z", True))}
    return f"""SELECT "column", a.mismatch_count AS before_count, a.mismatch_pct AS before_pct, z.mismatch_count AS after_count, z.mismatch_pct AS after_pct,
z.mismatch_count - a.mismatch_count AS count_delta FROM {parts["a"]} a JOIN {parts["z"]} z USING ("column")"""


ORACLE_SQL: dict[str, str] = {
    "batch_status": _o.batch_status(),
    "batch_status_timestamp": EVENTS_ORACLE.batch_status(),
    "batch_status_string": CUSTOMER_ORACLE.batch_status(),
    "batch_status_int": PART_ORACLE.batch_status(),
    "row_status_counts": _o.row_status_counts(),
    "row_status_totals": _o.row_status_totals(),
    "row_status_detail": _o.row_status_detail(),
    "changed_keys": _g.changed_keys(),
    "group_changes": _g.group_changes(),
    "nonnull_counts": _o.nonnull_counts(),
    "summary_by_batch": _o.summary_by_batch(),
    "summary_by_batch_exact": _orders_oracle(tolerance=0.0).summary_by_batch(),
    "summary_by_batch_grouped": _g.summary_by_batch(),
    "summary_by_batch_events": EVENTS_ORACLE.summary_by_batch(),
    "summary_by_batch_customers": CUSTOMER_ORACLE.summary_by_batch(),
    "summary_of_critical": _orders_oracle(only=_critical).summary_by_batch(),
    "summary_of_all": _o.summary_of_all(),
    "noisy_columns": _o.noisy_columns(NOISE),
    "zero_fill_coverage": f"SELECT batch_key, CAST(count(*) AS BIGINT) AS column_count, CAST(count(*) FILTER (changed_row_count = 0) AS BIGINT) AS unchanged_count FROM ({_o.summary_by_batch()}) GROUP BY batch_key",
    "mismatch_sample": _o.mismatch_sample(3),
    "mismatch_detail": _o.mismatch_detail(),
    "normalized_compare": _orders_oracle(normalised=True).summary_by_batch(),
    "null_vs_sentinel": _sentinel.mismatch_detail(),
    "null_key_rows": null_key_sql(),
    "duplicate_key_rows": "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "column_profile": """SELECT 'orders' AS left_name, 'reshaped' AS right_name, CAST(count(*) AS BIGINT) AS left_row_count, CAST(count(*) FILTER (o_orderkey % 2 = 0) AS BIGINT) AS right_row_count,
 CAST(6 AS BIGINT) AS left_column_count, CAST(6 AS BIGINT) AS right_column_count, CAST(5 AS BIGINT) AS shared_column_count, CAST(1 AS BIGINT) AS left_only_column_count, CAST(1 AS BIGINT) AS right_only_column_count,
 CAST(count(*) FILTER (o_orderkey % 2 <> 0) AS BIGINT) AS row_delta, CAST(0 AS BIGINT) AS column_delta, 'o_custkey' AS left_only_columns, 'customer' AS right_only_columns FROM orders""",
    "schema_drift": "SELECT * FROM (VALUES ('o_custkey', 'bigint', NULL, 'left_only'), ('o_extra', NULL, 'int', 'right_only'), ('o_totalprice', 'double', 'string', 'type')) AS t(\"column\", left_type, right_type, drift)",
    "top_columns": _o.top_columns(3),
    "columns_by_rate": _o.by_rate(),
    "cell_rollup": _o.cell_rollup(),
    "non_noisy_summary": _o.without_noise(NOISE),
    "column_samples": _o.mismatch_sample(2, "o_custkey"),
    "run_drift": _drift_sql(),
    "latest_batches": f"WITH {pairs.orders_sql()} SELECT batch, CAST(count(*) AS BIGINT) AS row_count FROM l WHERE batch IN (SELECT DISTINCT batch FROM l ORDER BY batch DESC LIMIT 3) GROUP BY batch",
    "scaling_by_cells": """SELECT label, regr_slope(s, n * c) AS slope, regr_intercept(s, n * c) AS intercept, regr_r2(s, n * c) AS r2
FROM (VALUES ('a', 1000.0::DOUBLE, 10.0::DOUBLE, 2.5::DOUBLE), ('a', 1000.0, 20.0, 4.0), ('a', 4000.0, 20.0, 15.5)) AS t(label, n, c, s) GROUP BY label""",
    "latest_run_status": f"SELECT run_id, arg_max(status, moment * 2 + CAST(status <> 'RUNNING' AS INT)) AS status FROM (VALUES {RUN_LOG}) AS t(run_id, moment, status) GROUP BY run_id",
    "phase_pivot": f"""SELECT run_id, sum(seconds) FILTER (phase = 'cells') AS cells, sum(seconds) FILTER (phase = 'triage') AS triage, sum(seconds) AS total_seconds
FROM (VALUES {TIMINGS.replace("D)", "::DOUBLE)")}) AS t(run_id, phase, seconds) GROUP BY run_id""",
    "scaling_fit": """SELECT label, regr_slope(seconds, n_rows) AS slope, regr_intercept(seconds, n_rows) AS intercept, regr_r2(seconds, n_rows) AS r2
FROM (VALUES ('narrow', 1000.0::DOUBLE, 2.5::DOUBLE), ('narrow', 2000.0, 4.5), ('narrow', 4000.0, 8.5), ('wide', 1000.0, 3.0), ('wide', 2000.0, 7.0), ('wide', 4000.0, 11.0)) AS t(label, n_rows, seconds) GROUP BY label""",
}
