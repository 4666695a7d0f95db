"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Only the counts of
vote patterns leave the executors: at most 3 to the number of labellers,
however many texts there are. Expectation-maximisation over these counts
estimates each labeller's accuracy and the share of good texts, hence for each
pattern the probability that such a text is good. These posteriors are the
labels of a linear scorer over hashed byte trigrams, trained on a bounded
sample; it scores every text by itself, also those on which no labeller votes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.llm.common import Scratch, sliced

BUCKETS = 1 << 14
#: Frequent function words of the languages expected.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec "
    "el que y los se del las por con no su para al lo como más pero sus le ya o".split()
)
WORD = re.compile(r"[^\x20\x09-\x0D]")
# kinds of bytes: bytes of other scripts count as letters
_BYTES = np.arange(256)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LETTER = UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
MARK = ~(SPACE | LETTER | DIGIT)
RARE_MARK = MARK & ~np.isin(_BYTES, np.frombuffer(b".,;:!?'\"()-|", np.uint8))


class Facts:
    """What the labellers look at: words, and counts of kinds of bytes."""

    def __init__(self, text: str):
        self.text, self.words = text, text.split()
        self.n, self.tally = len(self.words), Counter(self.words)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts = np.bincount(data, minlength=256)
        self.letters, self.upper, self.marks, self.rare = (int(counts[k].sum()) for k in (LETTER, UPPER, MARK, RARE_MARK))
        self.solid = len(data) - int(counts[SPACE].sum())
        mark, gap = np.append(MARK[data], False), np.append(SPACE[data], True)
        #: words that end in two marks or more, and words of a single mark
        ends = mark[1:-1] & gap[2:]
        self.double_ends = int((mark[:-2] & ends).sum())
        self.alone = int((gap[:-2] & ends).sum())


def _between(value: float, bad: float, good: float) -> int:
    """-1 at `bad` and beyond, 1 at `good` and beyond, 0 between; either may be the larger."""
    if bad > good:
        value, bad, good = -value, -bad, -good
    return -1 if value <= bad else 1 if value >= good else 0


# The first ones only know bad signs: without theirs they don't vote. The last ones vote either way.


def by_symbols(f: Facts) -> int:
    return -(f.rare >= 0.25 * max(1, f.n))


def by_case(f: Facts) -> int:
    return -(f.letters >= 20 and f.upper >= 0.5 * f.letters)


def by_endings(f: Facts) -> int:
    return -(f.double_ends >= 0.2 * max(1, f.n))


def by_cells(f: Facts) -> int:
    return -(f.n >= 10 and f.alone >= 0.2 * f.n)


def by_lines(f: Facts) -> int:
    lines = [x for x in f.text.split("\n") if x]
    return -(len(lines) >= 5 and len(set(lines)) <= 0.5 * len(lines))


def by_letters(f: Facts) -> int:
    return -(f.n >= 5 and f.letters <= 0.75 * f.solid)


def by_top_word(f: Facts) -> int:
    """A word other than the frequent ones that takes a large part of a text."""
    top = next((c for w, c in f.tally.most_common(8) if w not in FUNCTION_WORDS and w.lower() not in FUNCTION_WORDS), 0)
    return -(f.n >= 40 and top >= 0.08 * f.n)


def by_variety(f: Facts) -> int:
    """Distinct words, counted anew about every 1,000 words, since long texts repeat more of theirs. It votes on all lengths: silence would tell short texts."""
    if not f.n:
        return 0
    parts = max(1, f.n // 1000)
    cuts = [f.n * k // parts for k in range(parts + 1)]
    return _between(sum(len(set(f.words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)) / f.n, 0.12, 0.25)


def by_function_words(f: Facts) -> int:
    return _between(sum(f.tally[w] for w in f.tally.keys() & FUNCTION_WORDS) / f.n, 0.02, 0.1) if f.n >= 20 else 0


LABELLERS: tuple[Callable[[Facts], int], ...] = (
    by_symbols,
    by_case,
    by_endings,
    by_cells,
    by_lines,
    by_letters,
    by_top_word,
    by_variety,
    by_function_words,
)


def votes(text: str | None, labellers=LABELLERS) -> tuple[int, ...]:
    facts = Facts(text or "")
    return tuple(label(facts) for label in labellers)


def pattern(vote: tuple[int, ...]) -> int:
    """Votes as digits of base three."""
    return sum((v + 1) * 3**j for j, v in enumerate(vote))


def patterns_to_votes(codes: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([codes // 3**j % 3 - 1 for j in range(labellers)], axis=1) if len(codes) else np.zeros((0, labellers), np.int64)


@dataclass
class LabelModel:
    """rates[y, j, v + 1]: how often labeller j votes v on texts that are bad (y = 0) or good (1); prior: the share of good ones.

    Not voting counts as an outcome too: most labellers only know bad signs,
    and their silence on nearly all good texts is what their accuracy rests on.
    """

    rates: np.ndarray
    prior: float

    @property
    def accuracy(self) -> np.ndarray:
        """Of the votes that each labeller casts, the expected share that is right."""
        share = np.array([1 - self.prior, self.prior])[:, None]
        right = share[0] * self.rates[0, :, 0] + share[1] * self.rates[1, :, 2]
        return right / np.maximum((share * (self.rates[:, :, 0] + self.rates[:, :, 2])).sum(axis=0), 1e-12)

    @classmethod
    def fit(cls, vote: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
        """Expectation-maximisation, begun from the sum of votes. A bad vote never speaks for a text, nor a good one against it."""
        good = 1 / (1 + np.exp(-2.0 * (vote.sum(axis=1) + 0.5)))
        model = cls(np.full((2, vote.shape[1], 3), 1 / 3), 0.8)
        for _ in range(rounds if counts.sum() else 0):
            # a few imagined votes keep rates off zero
            rates = np.stack([[weight @ (vote == v) + 0.5 for v in (-1, 0, 1)] for weight in (counts * (1 - good), counts * good)]).transpose(0, 2, 1)
            rates /= rates.sum(axis=2, keepdims=True)
            rates[0, :, 0] = np.maximum(rates[0, :, 0], 1.5 * rates[1, :, 0])
            rates[1, :, 2] = np.maximum(rates[1, :, 2], rates[0, :, 2])
            rates /= rates.sum(axis=2, keepdims=True)
            prior = float(np.clip((counts @ good + 0.8) / (counts.sum() + 1), 0.02, 0.98))
            moved = np.abs(rates - model.rates).max() + abs(prior - model.prior)
            model = cls(rates, prior)
            good = model.posterior(vote)
            if moved < 1e-7:
                break
        return model

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        says = np.log(self.rates[1] / self.rates[0])
        evidence = says[np.arange(vote.shape[1]), vote + 1].sum(axis=1) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(evidence, -50, 50)))


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the text's byte trigrams: roots of counts, nearly of length one in all.

    Short texts are shorter vectors, so that a few odd trigrams don't decide.
    """
    data = np.frombuffer(f"  {text or ''} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (data[2:] * np.uint32(0xC2B2AE35))
    counts = np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    values /= np.sqrt((values * values).sum() + 200.0)
    # how far the text repeats itself, for its length: pairs of steps, hashed like the rest
    n = len(mixed)
    shape = [(1, n.bit_length(), 24 * len(at) // n), (2, n.bit_length(), int(np.log2(counts.max() / n) * 2)), (3, n.bit_length(), 24 * int((counts > 1).sum()) // len(at))]
    extra = [zlib.crc32(repr(x).encode()) % BUCKETS for x in shape]
    return np.append(at, extra), np.append(values, np.full(len(extra), 0.5))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: np.ndarray, at: np.ndarray, values: np.ndarray, good: np.ndarray, rounds: int = 60, rate: float = 30.0, decay: float = 1e-5) -> Scorer:
        """Logistic regression on soft labels by full gradients with momentum. Entry k says that text rows[k] has values[k] in bucket at[k]."""
        self = cls(np.zeros(BUCKETS), 0.0)
        n = len(good)
        speed, speed_b = np.zeros(BUCKETS), 0.0
        for _ in range(rounds if n else 0):
            p = 1 / (1 + np.exp(-(np.bincount(rows, values * self.weights[at], n) + self.bias)))
            slope = (p - good) / n
            speed = 0.9 * speed - rate * (np.bincount(at, values * slope[rows], BUCKETS) + decay * self.weights)
            speed_b = 0.9 * speed_b - 0.1 * rate * float(slope.sum())
            self.weights += speed
            self.bias += speed_b
        return self

    def __call__(self, text: str | None) -> float:
        at, values = hashed(text)
        return float(1 / (1 + np.exp(-(values @ self.weights[at] + self.bias))))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer
    threshold: float

    @classmethod
    def fit(cls, docs: DataFrame, sample_rows: int = 8_192, sample_entries: int = 12_000_000, threshold: float = 0.35, text_col: str = "text") -> QualityModel:
        """Labellers' accuracies from all rows, the scorer from a sample of them, chosen by a hash of the text.

        The sample has about sample_rows texts, twice as many at most, and
        sample_entries values in all (100 MB as set here; a text has 16,387 at
        most); equal texts count once. Texts stay on the executors, which turn
        them into values before the sample is ordered and cut.
        threshold: texts that score less are rejected. It is below one half so
        that doubtful texts stay.
        """
        code = T.StructType([T.StructField("code", T.LongType()), T.StructField("h", T.LongType())])

        def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t.as_py())) for t in batch.column(0)], pa.int64()), batch.column(1)], ["code", "h"])

        keyed = docs.select(text_col, F.pmod(F.xxhash64(text_col), F.lit(1 << 30)).alias("h"))
        tally = keyed.mapInArrow(cast, code).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
        codes, counts = np.array([r["code"] for r in tally], np.int64), np.array([r["n"] for r in tally], float)
        vote = patterns_to_votes(codes, len(LABELLERS))
        labels = LabelModel.fit(vote, counts)
        posterior = dict(zip(codes.tolist(), labels.posterior(vote).tolist(), strict=True))
        upto = int((1 << 30) * min(1.0, sample_rows / max(1.0, counts.sum())))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 128):
                texts = [t.as_py() for t in batch.column(2)]
                good = [posterior[pattern(votes(t))] for t in texts]
                vectors = [hashed(t) for t in texts]
                values = [pa.array([v[0].astype(np.int32) for v in vectors], pa.list_(pa.int32())), pa.array([v[1].astype(np.float32) for v in vectors], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v[0]) for v in vectors], pa.int64()), pa.array(good, pa.float64()), *values], ["h", "x", "n", "good", "at", "value"])

        # the hash decides the order: the sample does not depend on how rows are dealt
        chosen = keyed.where(F.col("h") < upto).groupBy(F.xxhash64(text_col).alias("x")).agg(F.first("h").alias("h"), F.first(text_col).alias(text_col))
        with Scratch(docs.sparkSession) as scratch:
            made = scratch(chosen.select("h", "x", text_col).mapInArrow(features, "h long, x long, n long, good double, at array<int>, value array<float>"), "features")
            sizes = made.select("h", "x", "n").orderBy("h", "x").limit(2 * sample_rows).toArrow()
            within = np.flatnonzero(np.cumsum(sizes.column("n").to_numpy()) <= sample_entries)
            last = (sizes.column("h")[int(within[-1])].as_py(), sizes.column("x")[int(within[-1])].as_py()) if len(within) else (-1, 0)
            upto_last = (F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("x") <= last[1]))
            table = made.where(upto_last).select("good", "at", "value").toArrow()
        # flat arrays straight from Arrow: thousands of small ones would stay in the driver's memory
        at, value = (table.column(c).combine_chunks() for c in ("at", "value"))
        rows = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(at.offsets.to_numpy()) if len(at) else 0)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (at, value)]
        return cls(labels, Scorer.fit(rows, *flat, np.array(table.column("good"), float)), threshold)

    def judge(self, text: str | None) -> tuple[float, bool]:
        """Score, and whether the text is kept. A text without words is not."""
        score = self.scorer(text)
        return score, bool(WORD.search(text or "")) and score >= self.threshold


def classify(docs: DataFrame, model: QualityModel | None = None, **options) -> DataFrame:
    """doc_id, score, kept: a row per row of docs.

    Null counts as an empty text, and a text without words is rejected. Very
    long texts are scored whole. Repeated rows are judged alike; other columns
    are ignored; no rows, no result.
    """
    model = model or QualityModel.fit(docs, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [model.judge(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel | None = None, **options) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns, of any name and type.

    Null, empty and white texts go; long texts are judged whole; rows that
    repeat are judged alike; no rows, no result.
    """
    model = model or QualityModel.fit(docs, **options)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([model.judge(t.as_py())[1] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
