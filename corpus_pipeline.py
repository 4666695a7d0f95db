"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's docs. The first four return the columns of
documents; the last returns the packed pieces.

Edge cases of every stage: columns of any other name and type pass through as
they are (the last stage ignores them); null and empty texts don't crash any
stage, and the first one rejects them; texts of any length are taken whole;
rows that share or lack an id are documents of their own; no rows, no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diffloom.llm import mixing, neardup, packing, quality, secrets
from diffloom.llm.common import Scratch, materialise, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject; those without words go. Equal texts are judged alike."""
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    Five words are the rule for near-duplicate stages; the op9 query's two
    words are its own contract's. Documents without words are no duplicates of
    each other.
    """
    return neardup.keep_one(docs, width=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars set anew where that changed the text."""
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them. Null sources are one source."""
    return mixing.mixed_rows(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of token windows; a document taken twice is two documents here."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed_windows),
]

#: SQL expresses none of the classifier's training, hashing, sampling and packing: tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. Each stage's table is deleted once the next one is written; the last one's is the result."""
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, docs = docs, scratch(stage(spark, docs, sf_dir), f"stage-{name}")
            scratch.drop(before)
        name, stage = STAGES[-1]
        return materialise(stage(spark, docs, sf_dir), f"stage-{name}")
