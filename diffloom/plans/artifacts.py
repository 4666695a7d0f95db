"""Artifact tables: declared schemas, aligned appends, and a run log of events."""

from __future__ import annotations

from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.functions.names import bare, col, quoted, table_name
from diffloom.spec import CompareSpec

_RUN = "run_id string, source_label string"
_SUMMARY = "column string, left_type string, right_type string, is_numeric boolean, tolerance double"

#: Columns of the artifacts whose schema is the same for all tables.
SCHEMAS = {
    "run_log": f"{_RUN}, event_at timestamp, status string, message string, left_name string, right_name string, key_columns array<string>, batch_column string, critical_column_count long, other_column_count long, compared_column_count long, group_size long, detail string",
    "batch_checksums": f"{_RUN}, batch_key string, left_checksum long, right_checksum long, left_row_count long, right_row_count long, batch_status string",
    "row_status_counts": f"{_RUN}, batch_key string, row_status string, row_count long",
    "column_summary_by_batch": f"{_RUN}, batch_key string, {_SUMMARY}, changed_row_count long, nonnull_compared_count long, mismatch_count long, null_mismatch_count long, max_abs_diff double, matched_row_count long, mismatch_pct double, null_mismatch_pct double",
    "column_summary_all_batches": f"{_RUN}, {_SUMMARY}, matched_row_count long, nonnull_compared_count long, mismatch_count long, mismatch_pct double, null_mismatch_count long, null_mismatch_pct double, max_abs_diff double",
    "noisy_columns": f"{_RUN}, column string, matched_row_count long, mismatch_count long, mismatch_pct double, suspected_reason string",
    "profiles": f"{_RUN}, left_name string, right_name string, left_row_count long, right_row_count long, left_column_count long, right_column_count long, shared_column_count long, left_only_column_count long, right_only_column_count long, row_delta long, column_delta long, left_only_columns array<string>, right_only_columns array<string>",
}


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, so that tables of different origin can share an artifact."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*(col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, narrow) else col(f.name) for f in df.schema.fields))


@dataclass
class Sink:
    """Appends a run's artifacts to tables of one database, and times the writes."""

    spark: SparkSession
    spec: CompareSpec
    write_timings: list[tuple[str, float]] = field(default_factory=list)
    written: dict[str, str] = field(default_factory=dict)

    def name(self, artifact: str) -> str:
        return table_name(self.spec.database, self.spec.prefix, artifact)

    def ensure_database(self) -> None:
        if not self.spark.catalog.databaseExists(bare(self.spec.database)):
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {'.'.join(map(quoted, bare(self.spec.database).split('.')))}")

    def append(self, artifact: str, df: DataFrame) -> None:
        """Add run_id and source_label, bring the columns into the artifact's order and types, and append."""
        marked = df.withColumns({"run_id": F.lit(self.spec.run_id), "source_label": F.lit(self.spec.source_label).cast("string")})
        if artifact in SCHEMAS:
            kinds = T._parse_datatype_string(SCHEMAS[artifact])
            marked = marked.select(*(col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields))
        else:
            marked = widened(marked.select("run_id", "source_label", *(col(c) for c in df.columns)))
        began = perf_counter()
        name = self.name(artifact)
        if self.spark.catalog.tableExists(name):
            # by name: the table may have been made by an earlier release, with the columns in another order
            present = {f.name: f.dataType for f in self.spark.table(name).schema.fields}
            if odd := [c for c in marked.columns if c not in present]:
                raise ValueError(f"{name} lacks {odd}: artifacts of differently shaped tables need another prefix")
            marked = marked.select(*(col(c).cast(t).alias(c) if c in marked.columns else F.lit(None).cast(t).alias(c) for c, t in present.items()))
        marked.write.mode("append").format(self.spec.table_format).saveAsTable(name)
        self.write_timings.append((artifact, perf_counter() - began))
        self.written[artifact] = name

    def log(self, status: str, facts: dict, message: str | None = None) -> None:
        """An event of the run: the log is only ever appended to."""
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(SCHEMAS["run_log"]).fields}
        values = facts | {"status": status, "message": message}
        row = self.spark.range(1).select(
            F.current_timestamp().alias("event_at"),
            *((F.array(*map(F.lit, v)) if isinstance(v := values.get(c), (list, tuple)) else F.lit(v)).cast(t).alias(c) for c, t in kinds.items() if c not in ("event_at", "run_id", "source_label")),
        )
        self.append("run_log", row)


def latest_status(log: DataFrame) -> DataFrame:
    """The last event of each run."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("event_at"), F.expr("status = 'RUNNING'")))
    return log.withColumn("place_", place).where("place_ = 1").drop("place_")


def drop_artifacts(spark: SparkSession, database: str, prefix: str) -> list[str]:
    """Drop all tables of that prefix; their names."""
    names = [t.name for t in spark.catalog.listTables(bare(database)) if t.name.startswith(f"{prefix}_") and not t.isTemporary]
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {'.'.join(map(quoted, bare(database).split('.')))}.{quoted(n)}")
    return names


