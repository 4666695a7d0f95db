"""Packing token pieces into windows by non-negative least squares.

Documents are cut into whole windows and a tail. The tails' lengths, in units
of a few tokens, give a histogram of bounded size. All combinations of up to
three lengths that fill a window exactly are enumerated; non-negative least
squares finds how often each must repeat to use up the histogram; the counts
are rounded down and what is left is packed greedily, best fit first, still as
counts of lengths. So the plan is made from the histogram alone and has the
same bounded size for any corpus.

A piece finds its place from its length and its rank among the pieces of that
length. Ranks are counted inside each task while it tokenises, and the counts
per task and length give each task's first rank: no task sorts or holds all
pieces of a length, not even of the commonest, the whole window.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.llm.common import materialise, sliced

WINDOW = 1024
END = 0  # the id behind each document
END_OF_TEXT = "<|endoftext|>"
#: How the byte-level vocabulary splits text before merging: a fixed value of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a text as the `tokenizers` library gives them for json_path.

    The same vocabulary as ranks is several times faster in `tiktoken`. Texts
    that hold the special token, which the two treat differently, and texts on
    which the faster one gives up go to the other.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self._slow = json_path, None

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.json_path)
        return self._slow

    def __call__(self, text: str) -> np.ndarray:
        if END_OF_TEXT not in text:
            try:
                return np.frombuffer(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except (ValueError, RuntimeError):
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, part long, place long"


def pieces(docs: DataFrame, json_path: str, ranks_path: str, window: int = WINDOW) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, and its place among the task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(json_path, ranks_path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in sliced(batches):
            owners, rows = [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    owners.append(row)
                    rows.append((start, n, zlib.crc32(piece.tobytes()), len(ids), part, seen[n]))
                    seen[n] += 1
            figures = np.array(rows, np.int64).reshape(-1, 6)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c) for c in figures.T.copy())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, PIECE.format(id=kind))


def combinations(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All descending tuples of up to `depth` positive lengths with the sum `units`."""
    found = []

    def extend(taken: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(taken)
        elif len(taken) < depth:
            slots = depth - len(taken)
            for x in range(min(left, taken[-1] if taken else left), (left + slots - 1) // slots - 1, -1):
                extend((*taken, x), left - x)

    extend((), units)
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 of the least |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    ridge = 1e-10 * float((a * a).sum(axis=0).max(initial=1))
    for _ in range(rounds or 3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            held = a[:, at]
            s = np.linalg.solve(held.T @ held + ridge * np.eye(len(at)), held.T @ b)
            if len(s) == 0 or s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            x[at[x[at] <= 1e-12]] = 0
            passive &= x > 0
    return x


@dataclass
class Plan:
    """How often each combination of classes repeats, and lookups made of it."""

    runs: list[tuple[tuple[int, ...], int]]
    counts: np.ndarray  # pieces by length
    unit: int

    def __post_init__(self):
        classes = self.class_of(len(self.counts) - 1) + 1
        self.base = np.concatenate([[0], np.cumsum([n for _, n in self.runs])]).astype(np.int64)
        slots: list[list] = [[] for _ in range(classes)]
        used = [0] * classes
        for r, (parts, n) in enumerate(self.runs):
            ahead = []
            for c in parts:
                slots[c].append((used[c], r, tuple(ahead)))
                ahead.append((c, used[c]))
                used[c] += n
        self.starts = [np.array([s[0] for s in x], np.int64) for x in slots]
        self.slots = slots
        # ranks inside a class go by length: those of shorter lengths come first
        self.before = np.zeros(len(self.counts), np.int64)
        for n in range(1, len(self.counts)):
            self.before[n] = self.before[n - 1] + self.counts[n - 1] if self.class_of(n) == self.class_of(n - 1) else 0

    def class_of(self, length):
        return (length + self.unit - 1) // self.unit

    def length_at(self, c: int, ranks: np.ndarray) -> np.ndarray:
        low = self.unit * (c - 1) + 1
        upto = np.cumsum(self.counts[low : low + self.unit])
        return low + np.searchsorted(upto, ranks, side="right")

    def locate(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of those lengths and ranks among equal lengths."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        ranks, classes = rank + self.before[length], self.class_of(length)
        for c in np.unique(classes):
            mine = np.flatnonzero(classes == c)
            run = np.searchsorted(self.starts[c], ranks[mine], side="right") - 1
            for k in np.unique(run):
                at = mine[run == k]
                start, r, ahead = self.slots[c][k]
                instance = ranks[at] - start
                sequence[at] = self.base[r] + instance
                for other, first in ahead:
                    offset[at] += self.length_at(other, first + instance)
        return sequence, offset


def make_plan(counts: np.ndarray, window: int = WINDOW, unit: int = 4, depth: int = 3) -> Plan:
    """counts[n]: pieces of n tokens, n up to the window. Every piece gets a place."""
    units = window // unit
    left = np.zeros(units + 1, np.int64)
    np.add.at(left, (np.arange(len(counts)) + unit - 1) // unit, counts)
    runs: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...], n: int) -> None:
        for c in parts:
            left[c] -= n
        runs.append((parts, int(n)))

    if left[units]:
        take((units,), left[units])
    shapes = [s for s in combinations(units, depth) if len(s) > 1 and all(left[c] for c in s)]
    if shapes:
        a = np.zeros((units + 1, len(shapes)))
        for j, s in enumerate(shapes):
            for c in s:
                a[c, j] += 1
        # long pieces are the hardest to place later, so their misfit weighs more
        weigh = np.sqrt(np.arange(units + 1) / units + 0.1)[:, None]
        repeats = non_negative_least_squares(a * weigh, left * weigh[:, 0])
        for j in np.argsort(-repeats, kind="stable"):
            n = int(min(np.floor(repeats[j] + 1e-6), *(left[c] // shapes[j].count(c) for c in set(shapes[j]))))
            if n > 0:
                take(shapes[j], n)
    # best fit on counts: each step uses up a length or repeats one shape as often as it can
    while left.any():
        parts, room, spare = [], units, left.copy()
        while room and (fits := np.flatnonzero(spare[1 : room + 1])).size:
            c = int(fits[-1]) + 1
            parts.append(c)
            spare[c] -= 1
            room -= c
        take(tuple(parts), min(left[c] // parts.count(c) for c in set(parts)))
    return Plan(runs, counts, unit)


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, window: int = WINDOW, unit: int = 4) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    Null texts count as empty: their one piece is the end id. Repeated ids are
    documents of their own; other columns are ignored; no rows give no rows.
    Padding is under `unit` tokens a tail, plus what the last, greedy sequences
    leave open.
    """
    if json_path is None or ranks_path is None:
        json_path, ranks_path = default_paths()
    cut = materialise(pieces(docs, json_path, ranks_path, window), "pieces")
    tally = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length at most
        counts[row["length"]] = row["n"]
    plan = make_plan(counts, window, unit)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tally.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = cut.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("place"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            sequence, offset = plan.locate(np.asarray(batch.column(2)), np.asarray(batch.column(5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
