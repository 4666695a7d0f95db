"""Secret scans by one combined deterministic automaton.

All rules are compiled (automaton.py) into one minimal automaton in which a
match may begin anywhere. A text's UTF-8 bytes run through it once, without a
check on the way: accepting states keep the run, so its last state says whether
any rule hit. Only texts with a hit are walked again, to find the first hit of
each rule and from there that rule's spans: its own automaton finds the first
byte at which a match ends, the reversed one goes back to the leftmost start,
and the anchored one forward to the longest end; the search then goes on behind
the span. This gives the leftmost non-overlapping spans of each rule, for
patterns in which the match that ends first also starts first, as all below.

The combined automaton only has to find where a first match ends, so the open
repetitions at the patterns' ends are cut to their least count: else it would
keep every combination of rules that are in such a run. The same holds for the
search and for the way back from the end it finds. Lengths are tested on
the found spans, for counting would multiply states too. Only the hexadecimal
rule counts, or every digit would hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from diffloom.llm.automaton import Dfa, Parser, reverse, trimmed
from diffloom.llm.common import sliced


@dataclass(frozen=True)
class Rule:
    """kind; pattern of the automaton; fold: letters in either case; least: characters of the span,
    or, if value is given, of the part of it that this Python pattern's group finds."""

    kind: str
    pattern: str
    least: int = 1
    fold: bool = False
    value: str | None = None


# The three base rules, then prefixes and shapes that issuers publish for their tokens.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)\Z"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# A key goes on to its END line, with anything but five dashes on the way. Without one it goes on over header fields and
# runs of base64, however they are parted: quoted lines, written-out line ends, spaces. A last run may be short.
_closed = r"([^-]|-{1,4}[^-])*-{5,}END [A-Z ]*PRIVATE KEY-----"
_line = r"(\r?\n|(\\r)?\\n)"
_gap = r"([\x20\t\r\n\x22'>#*|,-]|\\[rn])"
_open = rf"({_gap}+[A-Z][A-Za-z-]+:\x20[^\n\\-]*(-[^\n\\-]+)*)*({_gap}+[A-Za-z0-9+/=]{{16,}})+({_line}{_gap}*[A-Za-z0-9+/=]+|[\x20\t]+[A-Za-z0-9+/]*=+)?"
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----({_closed}|{_open})?", 27),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """Compiled rules. spans() is the operator on one text."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = tuple(rules)

    @cached_property
    def _trees(self) -> list:
        return [Parser(r.pattern, r.fold).parse() for r in self.rules]

    @cached_property
    def combined(self) -> Dfa:
        return Dfa.of([trimmed(t) for t in self._trees], search=True)

    @cached_property
    def _rows(self) -> tuple:
        one = lambda tree, search: Dfa.of([tree], search).linked()[0]
        single = [(one(trimmed(t), True), one(reverse(trimmed(t)), False), one(t, False), re.compile(r.value.encode()) if r.value else None) for r, t in zip(self.rules, self._trees, strict=True)]
        return self.combined.linked(stop=True)[0], self.combined.linked()[0], single

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start and then in the order of the rules."""
        data = (text or "").encode("utf-8", "surrogatepass")
        fast, full, single = self._rows
        if not reduce(getitem, data, fast)[256]:
            return []
        met: dict[int, int] = {}
        row = full
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                for k in row[256]:
                    met.setdefault(k, i + 1)
                if len(met) == len(single):
                    break
        found = []
        for k, end in met.items():
            found += [(*span, k) for span in self._of_rule(data, k, end)]
        return [(s, e, k) for s, e, k in sorted(_code_points(data, found), key=lambda x: (x[0], x[2]))]

    def _of_rule(self, data: bytes, k: int, hit: int | None) -> Iterator[tuple[int, int]]:
        rule, (search, back, ahead, value) = self.rules[k], self._rows[2][k]
        done = 0
        while hit is not None:
            row, start = back, hit
            for i in range(hit - 1, done - 1, -1):
                row = row[data[i]]
                if row[256]:
                    start = i
                elif row[257]:
                    break
            row, end = ahead, hit
            for i in range(start, len(data)):
                row = row[data[i]]
                if row[256]:
                    end = i + 1
                elif row[257]:
                    break
            if rule.value is None:
                size = end - start
            else:
                m = value.search(data, start, end)
                size = m.end(1) - m.start(1) if m else 0
            if size >= rule.least:
                yield start, end
            done, row, hit = end, search, None
            for i in range(end, len(data)):
                row = row[data[i]]
                if row[256]:
                    hit = i + 1
                    break


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points, counted once from left to right."""
    at, n, place = 0, 0, {}
    for x in sorted({y for s in spans for y in s[:2]}):
        n += len(data[at:x].decode("utf-8", "surrogatepass"))
        at = x
        place[x] = n
    return [(place[s], place[e], k) for s, e, k in spans]


def _joined(rules: Sequence[Rule], spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, e, k in spans)


SCAN_FIELDS = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[Rule] = MORE_RULES) -> DataFrame:
    """Per row: id, counts of the base kinds, the digest of the base spans and all spans as text.

    One pass over the rows where they lie, no shuffle. Null and empty texts have
    no spans; repeated ids are rows of their own; other columns are ignored.
    """
    scanner = Scanner(BASE_RULES + tuple(more))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in SCAN_FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1):
                spans = scanner.spans(text.as_py())
                base = [x for x in spans if x[2] < len(BASE_RULES)]
                digest = hashlib.sha256(_joined(scanner.rules, base).encode()).hexdigest()
                rows.append([*(sum(x[2] == k for x in base) for k in range(len(BASE_RULES))), digest, _joined(scanner.rules, spans)])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)] if rows else [pa.array([], t) for t in [pa.int64()] * 3 + [pa.string()] * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(n for n, _ in SCAN_FIELDS)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with each secret replaced by [kind]; overlapping spans merge under the first one's kind.

    All other columns stay; length_col, if there, is set to the new length of
    rows that changed. Null texts stay null.
    """
    scanner, names = Scanner(rules), docs.columns
    at, n = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            lengths = columns[n].to_pylist() if n is not None else None
            for i, text in enumerate(texts):
                if spans := scanner.spans(text):
                    texts[i] = _redacted(text, spans, scanner.rules)
                    if lengths:
                        lengths[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if lengths is not None:
                columns[n] = pa.array(lengths, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, spans: Sequence[tuple[int, int, int]], rules: Sequence[Rule]) -> str:
    parts, at, last = [], 0, -1
    for s, e, k in spans:
        if s >= last:
            parts += [text[at:s], f"[{rules[k].kind}]"]
        last = at = max(e, last)
    return "".join(parts) + text[at:]
