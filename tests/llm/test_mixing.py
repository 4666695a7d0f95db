import math
import re
from collections import Counter, defaultdict

from rows import no_documents, odd_documents

from conftest import DATA
from diffloom.llm import mixing
from diffloom.llm.queries import QUERIES


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By the rule as it is written: hand out by weight, stop what is over, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, got = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += left * weight[s] / total
        left = 0.0
        for s in sorted(open_, key=str):
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                open_.discard(s)
    return got


def check(rows, docs):
    sizes, count = defaultdict(int), {}
    for d in docs:
        count[d["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        sizes[d["source"]] += count[d["doc_id"]]
    want, taken = targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] == count[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert r["taken"] in (r["size"] * k for k in range(3))
        taken[r["source"]] += r["taken"]
    for s in sizes:
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1e-6


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    first = QUERIES["op10_source_mix"](spark, DATA).collect()
    source = {d["doc_id"]: d["source"] for d in docs}
    check([r.asDict() | {"source": source[r["doc_id"]]} for r in first], docs)
    assert sorted(first) == sorted(QUERIES["op10_source_mix"](spark, DATA).collect())


def plain_mix(rows, target, weight):
    """copies by tag and turn of one source: complete epochs, then the smallest keys until the sum is nearest. rows: (tag, turn, size, u, w)."""
    total = sum(r[2] for r in rows)
    epochs = int(target // total) if total else 0
    left, sum_, out = target - epochs * total, 0, {}
    for tag, turn, size, *_ in sorted(rows, key=lambda r: -math.log(r[3]) / weight(r)):
        take = sum_ + size <= left or (sum_ < left and sum_ + size - left <= left - sum_)
        out[tag, turn] = epochs + take
        sum_ += size
    return out


def test_equals_a_plain_version(spark):
    """With repeated and null ids: all copies of a row count as documents with draws of their own."""
    df = spark.range(3000).selectExpr("if(id % 5 = 0, null, id % 2000) AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "repeat('w ', int(id % 7) + 1) AS text", "1D + id % 4 AS w")
    docs = df.collect()
    tags = df.selectExpr("xxhash64(xxhash64(17, doc_id), source, cast(id % 7 + 1 AS long), 1D + id % 4) AS t".replace("id % 7", "length(text) / 2 - 1").replace("1D + id % 4", "w"), "doc_id", "source", "cast(length(text) / 2 AS long) AS size", "w")
    turns, rows = Counter(), defaultdict(list)
    for r in tags.collect():
        rows[r["source"]].append((r["t"], turns[r["t"]], r["size"], None, r["w"], r["doc_id"]))
        turns[r["t"]] += 1
    draws = spark.createDataFrame([x[:2] for v in rows.values() for x in v], "tag long, turn long").selectExpr("tag", "turn", "(shiftrightunsigned(xxhash64(tag, turn), 11) + 0.5D) / 9007199254740992D AS u")
    u = {(r["tag"], r["turn"]): r["u"] for r in draws.collect()}
    sizes = {s: sum(x[2] for x in v) for s, v in rows.items()}
    want = targets(sizes, (1, 5))
    expected = Counter()
    for s, v in rows.items():
        drawn = [(t, n, size, u[t, n], w) for t, n, size, _, w, _ in v]
        copies = plain_mix(drawn, want[s], lambda r: r[4])
        expected.update((i, s, size, copies[t, n]) for t, n, size, _, _, i in v)
    for parts in (1, 7):
        out = mixing.mix(df.repartition(parts), mixing.n_words(df["text"]), df["w"], weights=(1, 5)).collect()
        assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in out) == expected
    assert len(docs) == 3000


def test_equal_rows_and_worthless_ones_draw_by_themselves(spark):
    """Ten thousand equal rows without an id, and as many without weight: each is a document of its own, half of them are taken."""
    for w in (1.0, 0.0, None):
        df = spark.range(10_000, numPartitions=4).selectExpr("cast(null AS long) AS doc_id", "'s' AS source", "'one two' AS text")
        rows = mixing.mix(df, mixing.n_words(df["text"]), mixing.F.lit(w).cast("double"), share=0.5, most=1.0).collect()
        assert Counter(r["copies"] for r in rows) == {0: 5000, 1: 5000}


def test_better_documents_are_taken_more_often(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id < 4000, 's', 't') AS source", "'one two three' AS text", "if(id % 2 = 0, 1.0D, 0.25D) AS w")
    rows = mixing.mix(df, mixing.n_words(df["text"]), df["w"], share=0.5, most=1.0).collect()
    taken = [sum(r["copies"] for r in rows if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert sum(taken) == 2000 and taken[0] > 2 * taken[1]


def test_odd_rows(spark):
    docs = odd_documents(spark).where("doc_id is not null and doc_id <> 6").collect()
    rows = mixing.mix_documents(odd_documents(spark).where("doc_id is not null and doc_id <> 6")).collect()
    check(rows, docs)
    assert mixing.mix_documents(odd_documents(spark)).count() == 9
    assert mixing.mix_documents(no_documents(spark)).collect() == []
    empty = spark.createDataFrame([(1, None, "s"), (2, "", "t")], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix_documents(empty).collect()} == {(0.0, 0)}


def test_rows_of_the_mix(spark):
    docs = odd_documents(spark)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.schema.simpleString() == docs.schema.simpleString()
    assert all(r["row_"] == r["all_"] == r["copies"] == "mine" for r in mixed.collect())
    assert mixed.where("doc_id = 5").count() in (1, 2)
