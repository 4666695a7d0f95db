"""A persisted run: compare, append the artifacts, log how it went."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from diffloom.functions.names import col
from diffloom.operators.profile import profile
from diffloom.plans.artifacts import Sink
from diffloom.plans.compare import Comparison
from diffloom.sources.tables import resolve
from diffloom.spec import CompareSpec

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunResult:
    """tables: artifact -> table's name; the timings are in seconds, in the order in which things were done."""

    run_id: str
    status: str
    tables: dict[str, str]
    timings: list[tuple[str, float]]
    write_timings: list[tuple[str, float]]

    @property
    def write_seconds(self) -> float:
        return sum(s for _, s in self.write_timings)

    def read(self, spark: SparkSession, artifact: str) -> DataFrame:
        return spark.table(self.tables[artifact]).where(col("run_id") == self.run_id)

    def timing_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.run_id, p, s) for p, s in self.timings], "run_id string, phase string, seconds double")


def _name(source: str | DataFrame) -> str:
    return source if isinstance(source, str) else "<DataFrame>"


def run(spark: SparkSession, spec: CompareSpec) -> RunResult:
    """Compare as spec says and append all artifacts.

    The log has RUNNING before anything is looked at, then COMPLETED, or FAILED
    with the error, which is raised again. Kept intermediate tables are let go
    after a success or a failure as spec's two flags say.
    """
    sink, facts = Sink(spark, spec), {"left_name": _name(spec.left), "right_name": _name(spec.right), "key_columns": spec.keys, "batch_column": spec.batch, "group_size": spec.group_size, "detail": spec.detail}
    sink.ensure_database()
    sink.log("RUNNING", facts)
    comparison, done = None, False
    try:
        comparison = Comparison(spark, spec)
        compared = list(comparison.pairs_by_name)
        critical = sum(c in set(spec.critical) for c in compared)
        facts |= {"critical_column_count": critical, "other_column_count": len(compared) - critical, "compared_column_count": len(compared)}
        artifacts = [
            ("screening", "batch_checksums", lambda: comparison.batch_status),
            ("triage", "row_status_counts", lambda: comparison.row_status_counts),
            ("row detail", "row_status_detail", lambda: comparison.row_status_detail if spec.row_detail else None),
            ("cells", "column_summary_by_batch", lambda: comparison.summary_by_batch),
            ("sample", "mismatch_sample", lambda: comparison.mismatch_sample if spec.detail != "summary" else None),
            ("detail", "mismatch_detail", lambda: comparison.mismatch_detail if spec.detail == "full" else None),
            ("rollup", "column_summary_all_batches", lambda: comparison.summary_of_all),
            ("noise", "noisy_columns", lambda: comparison.noisy_columns),
        ]
        for phase, artifact, make in artifacts:
            with comparison.timed(phase):
                if (df := make()) is not None:
                    sink.append(artifact, df)
            logger.info("%s: %s done", spec.run_id, phase)
        sink.log("COMPLETED", facts)
        done = True
        return RunResult(spec.run_id, "COMPLETED", dict(sink.written), comparison.timings, sink.write_timings)
    except Exception as error:
        try:
            sink.log("FAILED", facts, str(error)[:1000])
        except Exception:  # the first error matters more
            logger.warning("run %s: its failure could not be logged", spec.run_id, exc_info=True)
        raise
    finally:
        if comparison and (spec.cleanup_on_success if done else spec.cleanup_on_failure):
            comparison.close()


def write_profile(spark: SparkSession, spec: CompareSpec) -> DataFrame:
    """profile() of spec's tables, appended to the artifact `profiles`."""
    sides = [resolve(spark, s, spec.table_format) for s in (spec.left, spec.right)]
    made = profile(*sides, _name(spec.left), _name(spec.right))
    sink = Sink(spark, spec)
    sink.ensure_database()
    sink.append("profiles", made)
    return made
