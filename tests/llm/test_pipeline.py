"""Each stage on its own input against a plain version of it."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from rows import no_documents, odd_documents
from test_neardup import brute
from test_packing import check as check_packing
from test_secrets import brute as brute_secrets
from tokenizers import Tokenizer

import __spark_entry__ as entry
from conftest import DATA
from diffloom.llm import packing, secrets
from diffloom.llm.common import materialise


def test_stages_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = materialise(stage(spark, docs, DATA), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns and docs.schema.simpleString() == inputs[0].schema.simpleString()
    inputs.append(docs)
    raw, good, distinct, clean, mixed, packed = ([r.asDict() for r in d.collect()] for d in inputs)

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert all(r in raw for r in good[:20]) and sum(i in kept for i, q in labels.items() if q) >= 0.97 * sum(labels.values())

    roots, _ = brute({r["doc_id"]: r["text"] for r in good}, 5)
    assert sorted(r["doc_id"] for r in distinct) == sorted(i for i, root in roots.items() if i == root)

    before = {r["doc_id"]: r for r in distinct}
    for r in clean:
        spans = secrets.Scanner().spans(before[r["doc_id"]]["text"])
        assert r == before[r["doc_id"]] if not spans else brute_secrets(r["text"])[:3] == (0, 0, 0) and r["n_chars"] == len(r["text"])
    assert len(clean) == len(distinct)

    copies = Counter(r["doc_id"] for r in mixed)
    of = {r["doc_id"]: r for r in clean}
    assert max(copies.values()) <= 2 and all(r == of[r["doc_id"]] for r in mixed)

    # a document taken twice is two documents to pack: its pieces come in two equal sets
    half = [r for r in packed if copies[r["doc_id"]] == 1]
    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    tokenizer = Tokenizer.from_file(packing.default_paths()[0])
    assert {i: n * (len(tokenizer.encode(of[i]["text"], add_special_tokens=False).ids) + 1) for i, n in copies.items()} == tokens
    assert half
    alone = packing.pack(spark.createDataFrame([(i, r["text"]) for i, r in of.items()], "doc_id long, text string")).collect()
    check_packing(alone, {i: r["text"] for i, r in of.items()}, tokenizer)


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_odd_and_no_rows(spark):
    """With columns of the operators' own names and a map: all but the last stage return them as they came."""
    many = spark.range(2000, numPartitions=3).selectExpr("cast(null AS long) AS doc_id", "concat('this is one of the documents that have no id of their own and it is number ', id, ' of them all') AS text")
    odd = odd_documents(spark)
    odd = odd.unionByName(many.withColumns({c: odd_column(c) for c in odd.columns if c not in many.columns}))
    for docs in (odd, no_documents(spark)):
        columns = docs.schema.simpleString()
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, DATA), f"odd-{name}")
            if name != "packing":
                assert docs.schema.simpleString() == columns
                if "row_" in docs.columns:
                    assert docs.where("row_ <> 'mine' OR all_ <> 'mine' OR copies <> 'mine'").count() == 0 < docs.where("doc_id IS NULL").count()
    assert docs.count() == 0


def odd_column(name):
    if name == "a map":
        return F.create_map(F.lit("k"), F.lit(1).cast("long"))
    return F.lit(1).cast("long") if name == "n_chars" else F.lit("en") if name == "lang" else F.lit(None).cast("string") if name == "source" else F.lit("mine")
