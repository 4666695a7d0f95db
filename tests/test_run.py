import pytest

from diffloom.plans import recipes
from diffloom.plans.artifacts import SCHEMAS, drop_artifacts, latest_status
from diffloom.plans.compare import Comparison
from diffloom.plans.run import run, write_profile
from diffloom.sources.tables import SchemaError
from diffloom.spec import CompareSpec

SCHEMA = "id int, day string, v double, s string"


def spec(spark, **options):
    left = spark.createDataFrame([(i, "a", 1.0, "x") for i in range(10)], SCHEMA)
    right = spark.createDataFrame([(i, "a", 2.0 if i < 4 else 1.0, "x") for i in range(10)], SCHEMA)
    return CompareSpec(left, right, ("id", "day"), "day", ("v",), **({"database": "runs", "detail": "full", "row_detail": True} | options))


def test_run_appends_artifacts_and_logs(spark):
    results = [run(spark, spec(spark, prefix="ok", source_label=label)) for label in ("one", "two")]
    first = results[0]
    assert first.status == "COMPLETED" and first.run_id != results[1].run_id
    assert set(first.tables) >= {"run_log", "batch_checksums", "row_status_counts", "row_status_detail", "column_summary_by_batch", "mismatch_sample", "mismatch_detail", "column_summary_all_batches", "noisy_columns"}
    for name, schema in SCHEMAS.items():
        if name in first.tables:
            assert spark.table(first.tables[name]).columns == [c.split()[0] for c in schema.replace("array<string>", "a").split(", ")]
    assert first.read(spark, "mismatch_detail").count() == 4 and spark.table(first.tables["mismatch_detail"]).count() == 8
    assert dict(first.read(spark, "mismatch_detail").dtypes)["id"] == "bigint"
    log = latest_status(spark.table(first.tables["run_log"]))
    assert sorted((r["status"], r["source_label"], r["compared_column_count"]) for r in log.collect()) == [("COMPLETED", "one", 2), ("COMPLETED", "two", 2)]
    assert [p for p, _ in first.timings][:2] == ["screening", "triage"] and first.write_seconds > 0
    assert recipes.phase_table(first.timing_rows(spark)).count() == 1
    assert len(drop_artifacts(spark, "runs", "ok")) == len(first.tables)


def test_failed_validation_is_logged_and_raised(spark):
    bad = spec(spark, prefix="bad", columns=("v", "nope"), strict_columns=True)
    with pytest.raises(SchemaError, match="nope"):
        run(spark, bad)
    log = spark.table("`runs`.`bad_run_log`")
    assert [r["status"] for r in log.orderBy("event_at").collect()] == ["RUNNING", "FAILED"]
    assert latest_status(log).first()["status"] == "FAILED" and "nope" in latest_status(log).first()["message"]


@pytest.mark.parametrize("cleanup", [False, True])
def test_failure_in_a_later_phase(spark, monkeypatch, cleanup):
    made = []
    start = Comparison.__init__
    monkeypatch.setattr(Comparison, "__init__", lambda self, *a: (start(self, *a), made.append(self))[0])
    monkeypatch.setattr(Comparison, "mismatch_sample", property(lambda self: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        run(spark, spec(spark, prefix=f"late_{cleanup}", cleanup_on_failure=cleanup))
    assert bool(made[0]._kept) is not cleanup
    assert latest_status(spark.table(f"`runs`.`late_{cleanup}_run_log`")).first()["status"] == "FAILED"
    made[0].close()


def test_kept_tables_are_let_go(spark):
    with Comparison(spark, spec(spark)) as c:
        c.summary_by_batch.count()
        assert c._kept
    assert not c._kept


def test_profile_artifact(spark):
    shown = write_profile(spark, spec(spark, prefix="prof")).first()
    assert (shown["left_row_count"], shown["shared_column_count"], shown["left_only_columns"]) == (10, 4, [])
    assert spark.table("`runs`.`prof_profiles`").count() == 1


def test_artifacts_of_another_shape_are_refused(spark):
    run(spark, spec(spark, prefix="shape"))
    with pytest.raises(ValueError, match="prefix"):
        run(spark, spec(spark, prefix="shape", left_label="before"))
