"""Licence scans by canonical digests of whole texts.

A text is brought to a canonical form that licences keep however they are
dressed (case, punctuation, copyright lines, equivalent spellings), hashed, and
looked up among the digests of known licences. It is one pass of built-in
expressions and a join with the short table of known digests, so the texts
never move. The same steps are written out as SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm.licence_texts import DIGESTS, TEXTS, TITLES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (pattern, replacement) in order; \1 is the first group. The patterns mean the
#: same to Java and RE2. From the third on, words stand between single spaces.
#: Spellings need not come out as words, only alike: "otherwise" becomes
#: "otherwize" on either side of the comparison.
STEPS = (
    # lines that name a holder: by sign, year, bracket, or a holder's last word; licence bodies have other lines that begin with "copyright"
    (
        r"(?m)^[^a-z0-9\n©]*(?:portions[ \t]+)?(?:copyright[ \t,:]*(?:\(c\)|©|[0-9<\[{])|copyright[ \t,:][^\n]{0,60}(?:19|20)[0-9][0-9]|"
        r"copyright[ \t,:][^\n]{0,60}(?:authors?|developers?|team|project|foundation|university|inc|ltd|llc|gmbh|corporation)[.,]?[ \t]*$|"
        r"\(c\)[ \t]*[0-9<\[{]|©|all rights reserved[^a-z0-9\n]*$)[^\n]*",
        "",
    ),
    (r"[\x00-/:-@\[-`{-\x7f\x{a0}\x{a9}\x{ab}\x{bb}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2022}\x{2026}\x{3000}]+", " "),
    (r"is(e|ed|es|er|ers|ing|ation|ations) ", r"iz\1 "),
    (r" (licen|offen|defen)c", r" \1s"),
    (r" (fav|hon|lab|behavi|endeav)our", r" \1or"),
    (r" (acknowledg|judg)ement", r" \1ment"),
    (r" (analog|catalog)ue", r" \1"),
    (r" (non|sub|third|per) (commercial|infringement|license|part|cent)", r" \1\2"),
    (r" copyright owner", " copyright holder"),
    (r" https? www| https?| www", " http"),
)


def canonical(text: Column) -> Column:
    """Null is as an empty text; an empty text stays empty."""
    text = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for k, (pattern, put) in enumerate(STEPS):
        text = F.regexp_replace(text, pattern, put.replace("\\1", "$1").replace("\\2", "$2"))
        if k == 1:
            text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))
    return F.trim(text)


def canonical_sql(text: str) -> str:
    sql = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for k, (pattern, put) in enumerate(STEPS):
        sql = f"regexp_replace({sql}, '{pattern}', '{put}', 'g')"
        if k == 1:
            sql = f"' ' || trim({sql}, ' ') || ' '"
    return f"trim({sql}, ' ')"


def known_texts() -> list[tuple[str, str]]:
    """(licence, text), each bare and under its usual titles."""
    titled = [(name, f"{title}\n\n{TEXTS[name]}") for name, titles in TITLES.items() for title in titles]
    return sorted([*TEXTS.items(), *titled])


def digests_of(known: DataFrame) -> DataFrame:
    """(digest, licence) of texts (licence, text); of licences with equal canonical texts the first name counts, and empty ones are none."""
    known = known.select("licence", canonical(F.col("text")).alias("c")).where("c <> ''")
    return known.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def known_digests(spark: SparkSession) -> DataFrame:
    """The built-in table: short licences by their texts, long ones by digests made with digests_of()."""
    texts = digests_of(spark.createDataFrame(known_texts(), "licence string, text string"))
    long = spark.createDataFrame([(d, name) for name, all_ in DIGESTS.items() for d in all_], "digest string, licence string")
    return texts.unionByName(long)


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, canonical_chars and licence (null if unknown), for each row.

    known: (digest, licence), as digests_of() makes it of texts. Null and empty
    texts, and those of punctuation alone, are no licence; very long texts are
    hashed whole. Repeated rows give repeated results, other columns are
    ignored; no rows, no result. The planner broadcasts the known digests while
    they are within its broadcast limit.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("c"))
    rows = rows.select("doc_id", F.sha2("c", 256).alias("digest"), F.length("c").cast("long").alias("canonical_chars"))
    return rows.join(known.select("digest", "licence"), "digest", "left").select("doc_id", "digest", "canonical_chars", "licence")


def scan_sql(table: str = "documents") -> str:
    """scan() of a table of documents against the built-in licences."""
    quoted = ",\n".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in known_texts())
    long = ", ".join(f"('{d}', '{name}')" for name, all_ in DIGESTS.items() for d in all_)
    return f"""WITH known(licence, text) AS (VALUES {quoted}),
long(digest, licence) AS (VALUES {long}),
canon AS (SELECT licence, {canonical_sql("text")} AS c FROM known),
digests AS (SELECT sha256(c) AS digest, min(licence) AS licence FROM canon WHERE c <> '' GROUP BY 1 UNION ALL SELECT digest, licence FROM long),
docs AS (SELECT doc_id, {canonical_sql("text")} AS c FROM {table})
SELECT doc_id, sha256(c) AS digest, CAST(length(c) AS BIGINT) AS canonical_chars, licence
FROM docs LEFT JOIN digests ON sha256(c) = digest"""
