"""Exact and approximate search."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DATA
from diffloom.llm import neighbours, topk
from diffloom.llm.queries import ORACLE_SQL, QUERIES
from duck import connect, same

NAN, INF = float("nan"), float("inf")
ODD = [
    (0, [0.5, 0.5], 1), (1, None, 1), (2, [0.5, None], 1), (3, [NAN, 1.0], 1), (4, [INF, 1.0], 1), (5, [0.0, 0.0], 1),
    (7, [0.5, 0.5], 1), (6, [0.5, 0.5], 1), (8, [-0.5, 0.25], 1), (8, [-0.5, 0.25], 1), (9, [1.0], 1), (None, [1.0, 1.0], 1), (10, [], 1),
]
SCHEMA = "vec_id long, embedding array<float>, label int"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "asks", "lot", "score", "rank", "row", "query_id")})


def test_exact_query_equals_sql(spark):
    same(QUERIES["op2_threshold_topk"](spark, DATA), connect(DATA), ORACLE_SQL["op2_threshold_topk"])


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from([2, 64, 2**40, 2**61]))
def test_block_equals_sorting(n, width, k, seed, scale):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-3, 4, (n, width)) * (scale // 2), rng.integers(-2, 3, width)
    ids = rng.permutation(n)
    got_ids, got, _ = topk.Block(ids, x).top(0, q, k)
    cut = lambda s: min(topk.LARGEST, max(topk.SMALLEST, s))
    scores = [(-sum(int(a) * int(b) for a, b in zip(row, q, strict=True)), int(i)) for row, i in zip(x, ids, strict=True) if i != 0]
    want = sorted(scores)[:k]
    assert list(zip(got, map(int, got_ids), strict=True)) == [(cut(-s), i) for s, i in want]


def test_block_stops_early():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1000, (5000, 2))
    _, _, seen = topk.Block(np.arange(5000), x).top(-1, np.array([3, 1]), 5)
    assert seen < 1000


@pytest.mark.parametrize("rows", [2, 3, 2048])
def test_exact_odd_rows(spark, rows):
    got = topk.search_quantised(odd(spark), F.col("vec_id") % 2 == 0, k=3, block_rows=rows).orderBy("query_id", "rank").collect()
    scores = {}
    usable = {0: (32, 32), 5: (0, 0), 6: (32, 32), 7: (32, 32), 8: (-32, 16), 9: (64, 0), 10: (0, 0)}
    for q in (0, 6, 8, 10):
        every = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q)
        scores[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(every[:3])]
    assert {q: [(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q] for q in scores} == scores
    assert {r["query_id"] for r in got} == set(scores)
    assert topk.search_quantised(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []


def test_forest_recall_and_scores(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    df = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.stack(df.embedding).astype(float)
    ids = df.vec_id.to_numpy()
    rows = QUERIES["op8_projection_forest"](spark, folder).collect()
    place = {int(i): k for k, i in enumerate(ids)}
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[place[q]] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[place[q]]))
        s[place[q]] = -INF
        best = set(ids[np.lexsort((ids, -s))[:5]])
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s[place[r["vec_id"]]] - r["score"]) < 1e-12 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits, total = hits + len(best & {r["vec_id"] for r in mine}), total + 5
    assert hits >= 0.9 * total


def test_forest_odd_rows(spark):
    got = neighbours.search(odd(spark), F.col("vec_id") % 2 == 0, k=2).orderBy("query_id", "rank").collect()
    rows = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got]
    half = round(math.sqrt(0.5), 6)
    assert [r for r in rows if r[0] == 0] == [(0, 1, 6, 1.0), (0, 2, 7, 1.0)]
    assert [r for r in rows if r[0] == 6] == [(6, 1, 0, 1.0), (6, 2, 7, 1.0)]
    assert {r[0] for r in rows} == {0, 6, 8} and half == round(math.sqrt(2) / 2, 6)
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)
    assert neighbours.search(one, F.col("vec_id") % 2 == 0).collect() == []


def test_forest_with_a_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i % 7), float(i % 5), float(i % 11) + 1], 1) for i in range(900)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 300, k=5, block_rows=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 3, 6, 9, 12]
