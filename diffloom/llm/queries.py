"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm import licences, mixing, neardup, neighbours, packing, quality, secrets, surrogates, topk, warc
from diffloom.llm.common import read


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_quantised(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


#: A key for the tables here; whoever publishes a corpus passes one of their own and keeps it secret.
SURROGATE_KEY = b"diffloom test tables"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(read(spark, sf_dir, "documents"), SURROGATE_KEY)


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"))


def op6_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_licence_scan,
        op2_threshold_topk,
        op3_secret_scan,
        op4_pii_surrogates,
        op5_weak_label_quality,
        op6_window_packing,
        op7_warc_dictionary,
        op8_projection_forest,
        op9_minmax_near_duplicates,
        op10_source_mix,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_licence_scan": licences.scan_sql(),
    "op2_threshold_topk": topk.search_sql(),
    "op7_warc_dictionary": warc.archive_sql(),
    "op9_minmax_near_duplicates": neardup.find_sql(),
}
