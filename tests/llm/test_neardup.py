import random
import re
from collections import defaultdict

import numpy as np
import pytest
from rows import found, no_documents, odd_documents

from conftest import DATA
from diffloom.llm import components, minmax, neardup
from diffloom.llm.common import Scratch
from diffloom.llm.queries import ORACLE_SQL, QUERIES
from duck import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width=2):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(texts, width=2):
    """Smallest id reachable of each document, over all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    by_size = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(by_size):
        for b in by_size[k + 1 :]:
            if len(sets[b]) * 80 > 100 * len(sets[a]):
                break
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def expected(texts, width=2):
    roots, sizes = brute(texts, width)
    return sorted((i, sizes[i], r, i == r) for i, r in roots.items())


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = found(QUERIES["op9_minmax_near_duplicates"](spark, DATA), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(rows) == expected(texts)


def test_query_equals_sql(spark):
    same(QUERIES["op9_minmax_near_duplicates"](spark, DATA), connect(DATA), ORACLE_SQL["op9_minmax_near_duplicates"])


def families(seed, n, words=60):
    """Copies of a few texts with one to a dozen words changed: many pairs are near the threshold."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(500)}" for _ in range(words)] for _ in range(4)]
    out = {}
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(9)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out[i] = " ".join(text)
    return out


def test_families_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 16)
    for seed in (1, 2):
        texts = families(seed, 300)
        df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
        assert sorted(found(neardup.find(df), "doc_id", "n_shingles", "component_id", "kept")) == expected(texts)


def test_family_below_the_threshold_is_not_compared_as_a_whole(spark, monkeypatch):
    """Texts that share a frame of two thirds: many share bands, none is linked but a few copies, and the last stage has nothing to do."""
    rng = random.Random(6)
    frame = [f"f{i}" for i in range(200)]
    texts = {i: " ".join(frame + [f"x{rng.randrange(10**9)}" for _ in range(60)]) for i in range(400)}
    texts |= {1000 + i: texts[i] + " more" for i in range(0, 400, 40)}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK_NODES", 16)
    monkeypatch.setattr(neardup, "between", None)
    assert sorted(found(neardup.find(df), "doc_id", "n_shingles", "component_id", "kept")) == expected(texts)


def test_many_rows_without_an_id(spark):
    """Each finds its own text again, not those of all others; two of them are near copies of a row with an id."""
    base = [f"w{i}" for i in range(40)]
    rows = [(None, f"a{k} b{k} c{k} d{k}") for k in range(3000)] * 2 + [(None, " ".join(base)), (None, " ".join([*base, "end"])), (5, " ".join([*base, "other"]))]
    rows = found(neardup.find(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id", "kept", "first")
    assert len(rows) == 6003 and sum(r[3] for r in rows) == 3001
    assert sorted((r for r in rows if r[1] == 5), key=repr) == [(5, 5, True, True), (None, 5, False, False), (None, 5, False, False)]


def test_five_word_shingles(spark):
    texts = families(3, 120, words=300)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert sorted(found(neardup.find(df, width=5), "doc_id", "n_shingles", "component_id", "kept")) == expected(texts, 5)


def test_odd_rows(spark):
    rows = found(neardup.find(odd_documents(spark)), "doc_id", "n_shingles", "component_id", "kept", "first")
    assert rows.count((6, 5, 1, False, False)) == 2
    assert set(rows) == {(1, 5, 1, True, True), (2, 0, 2, True, True), (3, 0, 3, True, True), (4, 0, 4, True, True), (5, 3, 5, True, True), (6, 5, 1, False, False), (7, 1, 7, True, True), (None, 5, None, True, True)}
    assert neardup.find(no_documents(spark)).collect() == []
    kept = neardup.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.schema.simpleString() == odd_documents(spark).schema.simpleString()
    assert {(r["row"], r["row_"]) for r in kept.collect()} == {("mine", "mine")}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]


def test_repeated_ids_with_different_texts(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(r["text"] for r in neardup.keep_one(df).collect()) == ["a b c d", "e f g h"]


def test_signatures_estimate_similarity():
    hashing, rng = minmax.MinMax(), np.random.default_rng(5)
    errors = []
    for j in (0.2, 0.5, 0.8):
        for _ in range(20):
            both = rng.integers(0, 2**63, int(400 * j)).astype(np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, int(200 * (1 - j))).astype(np.uint64)]) for _ in range(2))
            errors.append((hashing.signature(a) == hashing.signature(b)).mean() - j)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert len(set(hashing.keys(hashing.signature(a)).tolist())) == hashing.bands
    half = len(hashing.factors)
    assert half * 2 >= hashing.bands * hashing.rows


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 540)] + [(7, k) for k in range(600, 700)] + [(3, 3)]
    neighbours = defaultdict(set)
    for a, b in edges:
        neighbours[a].add(b)
        neighbours[b].add(a)
    want = {}
    for n in sorted(neighbours):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += neighbours[x]
    with Scratch(spark) as scratch:
        rows = components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
        assert {r["node"]: r["root"] for r in rows} == {n: r for n, r in want.items() if n != r}
        assert len(scratch.tables) == 1
        assert components.components(spark.createDataFrame([], "a long, b long"), scratch).collect() == []


def test_pairs_at_a_low_threshold_are_linked(spark):
    """Each pair shares 10 of 30 words."""
    texts = []
    for k in range(60):
        words = [[f"p{k}{part}{i}" for i in range(10)] for part in "abc"]
        texts += [" ".join(words[0] + words[1]), " ".join(words[0] + words[2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = neardup.find(df, percent=33, width=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i - i % 2 for i in range(120)}


def test_bands_follow_the_threshold():
    assert minmax.MinMax.of(80) == minmax.MinMax.of(95) == minmax.MinMax()
    for percent in range(1, 80):
        bands = minmax.MinMax.of(percent)
        assert (1 - (percent / 100) ** bands.rows) ** bands.bands <= 3.1e-6, percent
        assert len(bands.keys(bands.signature(np.arange(1, 9, dtype=np.uint64)))) == bands.bands
    for percent in (0, 101):
        with pytest.raises(ValueError):
            minmax.MinMax.of(percent)
