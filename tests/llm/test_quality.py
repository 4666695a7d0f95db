import math
from collections import defaultdict

import numpy as np
from rows import found, no_documents, odd_documents

from conftest import DATA
from diffloom.llm import quality
from diffloom.llm.queries import QUERIES


def test_accuracy_on_labels(spark):
    """Labels are held out by nature: training never sees any."""
    folder = DATA.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op5_weak_label_quality"](spark, folder).collect() if r["doc_id"] in labels}
    good = [kept[i] for i, q in labels.items() if q == 1]
    bad = [kept[i] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    n, truth = 40_000, np.array([0.95, 0.8, 0.7, 0.9])
    y = np.where(rng.random(n) < 0.7, 1, -1)
    vote = np.stack([np.where(rng.random(n) < 0.3, 0, np.where(rng.random(n) < a, y, -y)) for a in truth], axis=1)
    distinct, counts = np.unique(vote, axis=0, return_counts=True)
    model = quality.LabelModel.fit(distinct, counts.astype(float))
    np.testing.assert_allclose(model.accuracy, truth, atol=0.03)
    assert abs(model.prior - 0.7) < 0.03
    assert ((model.posterior(vote) > 0.5) == (y > 0)).mean() > 0.9


def test_patterns():
    votes = (1, 0, -1, 1, 0, 0, -1, 1, -1)
    assert quality.patterns_to_votes(np.array([quality.pattern(votes)]), 9).tolist() == [list(votes)]
    assert quality.LabelModel.fit(np.zeros((0, 9), int), np.zeros(0)).prior > 0


def test_odd_rows(spark):
    docs = odd_documents(spark)
    kept = dict((str(a), b) for a, b in found(quality.classify(docs), "doc_id", "kept"))
    assert not kept["2"] and not kept["3"] and not kept["4"] and kept["1"] is kept["6"]
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()}.isdisjoint({2, 3, 4})
    assert quality.classify(no_documents(spark)).collect() == []


def test_runs_agree(spark):
    model = [quality.QualityModel.fit(spark.read.parquet(f"{DATA}/documents.parquet").repartition(n)) for n in (1, 3)]
    np.testing.assert_allclose(model[0].scorer.weights, model[1].scorer.weights)


def plain_model(texts, rounds=300):
    """Posteriors text by text, and a scorer over dictionaries: the model without pattern counts, arrays or Spark."""
    votes = {t: quality.votes(t) for t in set(texts)}
    labellers = range(len(quality.LABELLERS))
    good = {t: 1 / (1 + math.exp(-2.0 * (sum(votes[t]) + 0.5))) for t in votes}
    rates, prior = [[[1 / 3] * 3 for _ in labellers] for _ in (0, 1)], 0.8
    for _ in range(rounds):
        new = [[[sum((good[t] if y else 1 - good[t]) for t in texts if votes[t][j] == v) + 0.5 for v in (-1, 0, 1)] for j in labellers] for y in (0, 1)]
        share = lambda rows: [[x / sum(r) for x in r] for r in rows]
        new = [share(rows) for rows in new]
        for j in labellers:
            new[0][j][0] = max(new[0][j][0], 1.5 * new[1][j][0])
            new[1][j][2] = max(new[1][j][2], new[0][j][2])
        new = [share(rows) for rows in new]
        share_good = min(0.98, max(0.02, (sum(good[t] for t in texts) + 0.8) / (len(texts) + 1)))
        moved = max(abs(a - b) for y in (0, 1) for j in labellers for a, b in zip(new[y][j], rates[y][j], strict=True)) + abs(share_good - prior)
        rates, prior = new, share_good
        for t in votes:
            evidence = math.log(prior / (1 - prior)) + sum(math.log(rates[1][j][v + 1] / rates[0][j][v + 1]) for j, v in enumerate(votes[t]))
            good[t] = 1 / (1 + math.exp(-evidence))
        if moved < 1e-7:
            break
    vectors = {t: list(zip(*(a.tolist() for a in quality.hashed(t)), strict=True)) for t in votes}
    w, speed, bias, speed_b = defaultdict(float), defaultdict(float), 0.0, 0.0
    score = lambda t: 1 / (1 + math.exp(-(sum(v * w[k] for k, v in vectors[t]) + bias)))
    for _ in range(60):
        slope = {t: (score(t) - good[t]) / len(votes) for t in votes}
        step = defaultdict(float)
        for t, d in slope.items():
            for k, v in vectors[t]:
                step[k] += v * d
        for k in {*step, *w}:
            speed[k] = 0.9 * speed[k] - 30.0 * (step[k] + 1e-5 * w[k])
        for k in speed:
            w[k] += speed[k]
        speed_b = 0.9 * speed_b - 3.0 * sum(slope.values())
        bias += speed_b
    return {t: score(t) for t in votes}


def test_query_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = plain_model([r["text"] or "" for r in docs])
    rows = {r["doc_id"]: r for r in QUERIES["op5_weak_label_quality"](spark, DATA).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        score = want[r["text"] or ""]
        assert abs(rows[r["doc_id"]]["score"] - score) < 1e-4
        assert abs(score - 0.35) < 1e-4 or rows[r["doc_id"]]["kept"] == (score >= 0.35 and bool((r["text"] or "").split()))


def test_the_sample_is_bounded_by_its_values(spark):
    df = spark.createDataFrame([(i, f"text number {i} of a few short ones") for i in range(200)], "doc_id long, text string")
    model = quality.QualityModel.fit(df, sample_entries=500)
    assert 0 < np.count_nonzero(model.scorer.weights) <= 500
    assert not quality.QualityModel.fit(df, sample_entries=3).scorer.weights.any()


def test_long_texts_are_judged_by_their_variety_too():
    words = [f"w{i}" for i in range(700)]
    assert quality.by_variety(quality.Facts(" ".join(words * 20))) == 1
    assert quality.by_variety(quality.Facts(" ".join(words[:20] * 700))) == -1
