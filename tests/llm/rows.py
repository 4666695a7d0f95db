"""Documents that every operator must bear: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

LONG = "lorem ipsum dolor " * 40_000
TEXTS = [
    (1, "plain words in a plain line", "en", "s1", 1),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \t\n ", "en", "s2", 4),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "plain words in a plain line", "en", "s1", 1),
    (6, "plain words in a plain line", "en", "s1", 1),
    (None, "plain words in another line é日本", None, "s1", None),
    (7, "one", "en", None, 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


#: Names that the operators use themselves.
CLASHING = ("row", "row_", "all_", "copies", "source_", "place", "key", "size", "w", "u", "tag", "turn", "digest", "node", "n", "kept", "rank", "part", "length", "special", "html", "leader", "root", "left", "h", "good")


def odd_documents(spark):
    """With columns whose names the operators use themselves, and one that can't be ordered."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASHING}).withColumn("a map", F.create_map(F.lit("k"), F.col("n_chars")))


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
