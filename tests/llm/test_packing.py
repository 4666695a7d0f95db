import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import no_documents, odd_documents
from tokenizers import Tokenizer

from conftest import DATA
from diffloom.llm import packing
from diffloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_paths()[0])


def check(rows, texts, tokenizer):
    """Every id in one piece, no gaps in documents or sequences; the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / sum(n for s in sequences.values() for _, n in s)


def test_query_is_an_exact_round_trip(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert check(QUERIES["op6_window_packing"](spark, DATA).collect(), texts, tokenizer) < 0.05


def test_odd_rows(spark, tokenizer):
    rows = packing.pack(odd_documents(spark).where("doc_id is null or doc_id <> 6")).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_documents(spark).collect() if r["doc_id"] != 6}
    check(rows, texts, tokenizer)
    assert packing.pack(odd_documents(spark).where("doc_id = 6")).count() == 2
    assert packing.pack(no_documents(spark)).collect() == []


def test_both_encoders_agree(tokenizer):
    encode = packing.Encoder(*packing.default_paths())
    for text in ("", "a b  c\n\n d", "<|endoftext|>", "x<|endoftext|>y", "don't  stop 123 é日本 \t ", "a" * 5000, " " * 5000 + "x", "​﻿"):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_combinations():
    assert packing.combinations(4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)]
    assert all(sum(c) == 256 and len(c) <= 3 for c in packing.combinations(256))


def test_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, want = rng.random((8, 5)), np.maximum(0, rng.normal(size=5))
        np.testing.assert_allclose(packing.non_negative_least_squares(a, a @ want), want, atol=1e-6)
    x = packing.non_negative_least_squares(np.eye(2), np.array([1.0, -1.0]))
    np.testing.assert_allclose(x, [1, 0], atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 30)), max_size=30), st.sampled_from([1, 4]))
def test_plans_place_every_piece(histogram, unit):
    counts = np.zeros(65, np.int64)
    for n, c in histogram:
        counts[n] += c
    plan = packing.make_plan(counts, 64, unit)
    lengths = np.repeat(np.arange(65), counts)
    ranks = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, int)
    sequence, offset = plan.locate(lengths, ranks)
    ends = defaultdict(int)
    for s, o, n in sorted(zip(sequence, offset, lengths, strict=True)):
        assert o == ends[s]
        ends[s] += n
    assert all(e <= 64 for e in ends.values())


def test_large_histograms_pack_tightly():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(1024, rng.lognormal(5.8, 1.0, 50_000).astype(int) + 1), minlength=1025)
    plan = packing.make_plan(counts)
    assert (counts @ np.arange(1025)) / (1024 * sum(n for _, n in plan.runs)) > 0.99
