"""Personal data replaced by keyed surrogates.

Every detected entity has a kind and a canonical form: an address in lower
case, a number's digits, one word of a name. A keyed hash of these, and of an
attempt number, drives a generator that keeps the kind's looks: separators,
lengths, letter case, check digits, a name's script and gender. So equal
entities get equal surrogates in all documents, without a table of them.

What a hash alone can't promise is checked: the distinct entities are compared
as a table, and an entity whose surrogate is another's, or is itself a real
entity of the corpus, tries its next attempt until there is no such case. Names
of all kinds are compared together, and a format whose values are used up grows
longer with further attempts, so that there always is an end. Only
entities that needed more than one attempt have to be known when the texts are
rewritten; they are joined to the documents that hold them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import Scratch, materialise, sliced

# Forms of address with the gender they tell.
TITLES = {
    "male": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "female": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
}
GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}
# Beginnings, middles and endings of invented names by script.
SYLLABLES = {
    "LATIN": (("b", "br", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w"), ("al", "an", "ar", "el", "en", "er", "il", "in", "or", "ul"), {"male": ("o", "us", "ek", "an"), "female": ("a", "ia", "elle", "ina"), "family": ("son", "er", "mann", "ez", "ois")}),
    "CYRILLIC": (("б", "в", "г", "д", "ж", "к", "л", "м", "н", "п", "р", "с", "т"), ("ал", "ан", "ар", "ел", "ен", "ил", "ор", "ул"), {"male": ("ий", "ей", "ан"), "female": ("а", "ия", "ина"), "family": ("енко", "ук", "ич")}),
    "GREEK": (("β", "γ", "δ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ"), ("αλ", "αν", "αρ", "ελ", "εν", "ιλ", "ορ"), {"male": ("ος", "ης", "ας"), "female": ("α", "η", "ία"), "family": ("ίδης", "άκης", "όπουλος")}),
}
DIGIT = re.compile(r"[0-9]")
#: Given names that tell a person's name without a title; none of them is a common word.
GIVEN = {
    "male": "Alexander Andrew Antoine Anthony Benjamin Carlos Charles Christian Christopher Daniel David Diego Dimitri Edward Fernando François George Giovanni Hans Heinrich Henry Jacques James Javier Jean Johann John Jorge Joseph José Juan Jürgen Kevin Klaus Louis Luis Manuel Matthew Michael Miguel Nicolas Olivier Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert Stefan Thomas Ulrich William Wolfgang".split(),
    "female": "Alice Amélie Angela Anna Anne Barbara Beatriz Camille Carmen Caroline Catherine Charlotte Christine Claudia Elena Elizabeth Emily Emma Gabriela Gisela Hannah Helen Inés Ingrid Isabel Jane Jennifer Jessica Julia Karin Katharina Laura Linda Lucía Margaret María Maria Mary Monika Nathalie Nicole Patricia Rachel Sabine Sarah Sofía Sophie Susan Susanne Teresa Ursula Valérie Victoria".split(),
}
GIVEN_GENDER = {name: gender for gender, names in GIVEN.items() for name in names}
GIVEN_WORDS = frozenset(GIVEN_GENDER)
WIDER = 16  # from this attempt on formats of fixed length grow
RESERVED = "example"  # a label that no registry gives out

# \w leaves out the marks that many scripts write their vowels with
_marks = "".join(c for c in map(chr, range(0x300, 0xFE30)) if unicodedata.category(c) in ("Mn", "Mc"))
_letter = rf"(?:[^\W\d_]|[{_marks}])"
_name = rf"[^\W\d_a-zа-яα-ω](?:{_letter}+(?:['’-]{_letter}+)?|['’-]{_letter}+)"
WORD = re.compile(rf"(?<![\w{_marks}]){_letter}++(?!\w)")
_sep, _zero = r"[ ./-]?", r"(?: ?\(0\))?"
_date = r"(?!\d{1,2}(?P<d>[./-])\d{1,2}(?P=d)(?:\d{4}|\d{2})(?!(?P=d)?\d))"
_card = r"(?!\d{4}(?P<c>[ -])\d{4}(?P=c)\d{4}(?P=c)\d)"
# Digits are counted, so that a number behind a phone number isn't taken along; of countries with one length it is fixed.
PHONES = (
    rf"\+1(?:{_sep}\(\d{{3}}\)|{_sep}\d(?:{_sep}\d){{2}})(?:{_sep}\d){{7}}(?!\d)",
    rf"\+3[34]{_zero}(?:{_sep}\d){{9}}(?!\d)",
    rf"\+44{_zero}(?:{_sep}\d){{10}}(?!\d)",
    rf"\+49{_zero}(?:{_sep}\(?\d(?:\)(?={_sep}\d))?){{6,11}}(?!\d)",
    rf"\+\d(?:{_zero}{_sep}\(?\d(?:\)(?={_sep}\d))?){{7,14}}(?!\d)",
    rf"(?<![\w.+-])(?<!\d,)(?!\d{{15}})00[1-9]\d{{0,2}}{_zero}(?:{_sep}\d){{7,12}}(?!\w)",
    r"(?<![\d.-])1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
    r"(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    rf"(?<![\w.+-])(?<!\d[,/])(?<!\d ){_date}{_card}\(?0[1-9](?:\)?{_sep}\d){{7,10}}(?![\w@])",
    r"(?<![\d.+,-])(?<!\d )[6-9](?:\d\d \d\d|\d \d{3}) \d\d \d\d(?!\d| \d\d\b)",
)
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile("|".join(PHONES))),
    ("card", re.compile(r"(?<![\d.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?![\d-])")),
    ("name", re.compile(rf"\b({'|'.join(sorted(GENDER, key=len, reverse=True))})\.? ({_name}(?: {_name}){{0,2}})")),
)
#: A given name, another or initials, and a family name. It isn't a pattern of its own, as few texts need it.
UNTITLED = re.compile(rf"(?<![\w'’-])(({'|'.join(sorted(GIVEN_GENDER, key=len, reverse=True))})(?:-{_name})?(?: [A-Z]\.)*(?: {_name}){{1,2}})")


@dataclass(frozen=True)
class Entity:
    kind: str
    canon: str
    start: int
    end: int
    text: str


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _iban_ok(x: str) -> bool:
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def detect(text: str | None) -> list[Entity]:
    """Entities from left to right; of overlapping ones that of the earlier pattern counts."""
    found: list[Entity] = []
    if not text:
        return found
    # what a kind can't do without is looked for first: most texts have none of it
    there = {"email": "@" in text, "name": any(t in text for t in GENDER), "number": DIGIT.search(text) is not None}
    if not GIVEN_WORDS.isdisjoint(text.replace("-", " ").split()):
        for m in UNTITLED.finditer(text):
            found += _names(m.group(1), m.start(1), GIVEN_GENDER[m.group(2)])
    for kind, pattern in PATTERNS:
        if not there[kind if kind in there else "number"]:
            continue
        for m in pattern.finditer(text):
            if kind == "name":
                found += _names(m.group(2), m.start(2), GENDER[m.group(1)])
            elif (canon := _canonical(kind, m.group())) is not None:
                found.append(Entity(kind, canon, m.start(), m.end(), m.group()))
    found += _again(text, found)
    order = {kind: k for k, (kind, _) in enumerate(PATTERNS)}
    starts: list[int] = []
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (order.get(e.kind, len(order)), e.start)):
        k = bisect(starts, e.start)
        if (k == 0 or out[k - 1].end <= e.start) and (k == len(out) or e.end <= out[k].start):
            starts.insert(k, e.start)
            out.insert(k, e)
    return out


def _canonical(kind: str, text: str) -> str | None:
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "iban":
        x = text.replace(" ", "")
        return x if _iban_ok(x) else None
    digits = re.sub(r"\D", "", text.replace("(0)", "") if kind == "phone" else text)
    if kind == "phone":
        digits = digits.removeprefix("00")
        if not 8 <= len(digits) <= 15:
            return None
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return digits if kind == "ssn" or 13 <= len(digits) <= 19 else None


def _names(name: str, at: int, gender: str) -> list[Entity]:
    """The words of a name by themselves, so that a family name means the same alone and behind a first name."""
    words = [(re.sub(r"['’][sS]$", "", w.group()), at + w.start()) for w in re.finditer(r"\S+", name)]
    roles = [gender] * (len(words) - 1) + ["family"]
    out = []
    for (word, start), role in zip(words, roles, strict=True):
        if word.endswith("."):  # an initial tells little and stays
            continue
        script = unicodedata.name(word[0], "LATIN").split()[0]
        out.append(Entity(f"name:{role}:{script if script in SYLLABLES or letters(script) else 'LATIN'}", word.lower(), start, start + len(word), word))
    return out


def _again(text: str, found: list[Entity]) -> list[Entity]:
    """Mentions without a title of the words of titled names, as what the word was first."""
    known: dict[str, str] = {}
    for e in found:
        if e.kind.startswith("name:") and e.text not in GENDER:
            known.setdefault(e.canon, e.kind)
    if not known:
        return []
    there, out, done = {e.start for e in found}, [], 0
    words = list(WORD.finditer(text))
    for m, after in zip(words, [*words[1:], None], strict=True):
        if m.start() < done:
            continue
        joined = after is not None and after.start() == m.end() + 1 and text[m.end()] in "'’-"
        for end in ([after.end()] if joined else []) + [m.end()]:
            word = text[m.start() : end]
            if (kind := known.get(word.lower())) and word[0] == word[0].title():
                done = end
                if m.start() not in there:
                    out.append(Entity(kind, word.lower(), m.start(), end, word))
                break
    return out


@cache
def letters(script: str) -> tuple[str, ...]:
    """Letters, small ones if there is case, of which names are made in a script without syllables: those of its first block."""
    start, end = {"CJK": (0x4E00, 0x9FA6), "HANGUL": (0xAC00, 0xD7A4)}.get(script, (0x100, 0x20000))
    found = [c for c in map(chr, range(start, end)) if unicodedata.name(c, "").startswith(f"{script} ") and unicodedata.category(c) in ("Ll", "Lo") and unicodedata.normalize("NFKC", c) == c]
    found = [c for c in found if c != c.upper() or "SMALL" not in unicodedata.name(c)]  # small kana don't stand by themselves
    return tuple(c for c in found if script in ("CJK", "HANGUL") or ord(c) - ord(found[0]) < 0x80)


class Stream:
    """Numbers below given bounds from a keyed hash, as many as are asked for."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.block, self.value, self.left = key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, 0, 1

    def below(self, n: int) -> int:
        if self.left < n << 64:  # enough that no number is favoured measurably
            h = hashlib.blake2b(self.seed, key=self.key, salt=self.block.to_bytes(8, "big")).digest()
            self.value, self.left, self.block = self.value + self.left * int.from_bytes(h, "big"), self.left << 512, self.block + 1
        self.value, out = divmod(self.value, n)
        self.left //= n
        return out

    def pick(self, options):
        return options[self.below(len(options))]

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def _shaped(text: str, s: Stream) -> str:
    """Letters for letters, digits for digits, the rest as it is."""
    return "".join(s.pick("0123456789") if c.isdigit() else s.pick("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in text)


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate at that attempt."""
    s = Stream(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        host = _shaped(labels[0], Stream(key, "domain", domain))
        # later attempts lengthen the local part: short shapes can be used up
        return f"{_shaped(local + 'x' * max(0, attempt - 2), s)}@{host}.{RESERVED}.{labels[-1]}"
    wider = s.digits(attempt - WIDER + 1) if attempt >= WIDER and kind in ("iban", "card", "phone", "ssn") else ""
    if kind == "ip":
        if attempt >= WIDER:  # four numbers don't suffice: of the range for documentation there is more
            return "2001:db8:" + ":".join(f"{s.below(1 << 16):x}" for _ in range(6))
        return ".".join(str(s.below(254) + 1) for _ in range(4))
    if kind == "iban":
        body = "".join(s.pick("0123456789") if c.isdigit() else s.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in canon[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}{wider}"
    if kind == "card":
        valid = luhn(canon[:-1]) == int(canon[-1])
        body = canon[0] + s.digits(len(canon) - 2)
        return body + str((luhn(body) + (0 if valid else 1 + s.below(9))) % 10) + wider
    if kind == "phone":
        lead = canon[:2] if len(canon) > 10 else "0" if canon[0] == "0" else ""
        return lead + str(2 + s.below(8)) + s.digits(len(canon) - len(lead) - 1) + wider
    if kind == "ssn":
        return s.digits(len(canon)) + wider
    _, role, script = kind.split(":")
    if script not in SYLLABLES:
        size = min(max(2, sum(c.isalpha() for c in canon)), 8) + max(0, attempt - 2)
        return "".join(s.pick(letters(script)) for _ in range(size))
    heads, tails, ends = SYLLABLES[script]
    middle = "".join(s.pick(heads) + s.pick(tails) for _ in range(2 + max(0, attempt - 2)))
    return middle + s.pick(ends[role])


def dressed(entity: Entity, canon: str) -> str:
    """A canonical surrogate in the entity's own format."""
    if entity.kind == "email":
        return canon.upper() if entity.text.isupper() else canon
    if entity.kind == "ip":
        return canon
    if entity.kind.startswith("name:"):
        return canon.upper() if len(entity.text) > 1 and entity.text.isupper() else canon[0].title() + canon[1:]
    left = iter(canon)
    zero = entity.text.find("(0)") + 1 if entity.kind == "phone" else 0  # neither is the zero of +33 (0)6
    out, skip = [], sum(c.isalnum() for c in entity.text) - len(canon) - (zero > 0)  # a country code that is not part of the canonical form
    for i, c in enumerate(entity.text):
        if zero and i == zero:
            out.append(c)
        elif c.isalnum() and skip > 0:
            skip -= 1
            out.append(c)
        else:
            out.append(next(left) if c.isalnum() else c)
    return "".join([*out, *left])  # what a wider form has more


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """The text with surrogates, and the number of entities."""
    entities = detect(text)
    if not entities:
        return text, 0
    parts, at = [], 0
    for e in entities:
        parts += [text[at : e.start], dressed(e, surrogate(key, e.kind, e.canon, attempts.get((e.kind, e.canon), 0)))]
        at = e.end
    return "".join([*parts, text[at:]]), len(entities)


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, kind, canon), once per row: h is the hash of the text that holds the entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(i, *x) for i, t in enumerate(batch.column(1)) for x in sorted({(e.kind, e.canon) for e in detect(t.as_py())})]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], ["h", "kind", "canon"]
            )

    return docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "h long, kind string, canon string")


def attempts_of(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is taken: by a real entity, or by one that comes first.

    Of entities with one surrogate that of the fewest attempts keeps it, then
    the smallest canonical form. So who has a surrogate keeps it in later
    rounds, and each round only moves those without. Names of all kinds are
    compared with each other.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            made = [surrogate(key, k.as_py(), c.as_py(), n.as_py()) for k, c, n in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "canon", "attempt", "made"])

    space = F.substring_index("kind", ":", 1).alias("space")
    with Scratch(entities.sparkSession) as scratch:
        now = scratch(entities.select("kind", "canon", F.lit(0).alias("attempt")), "entities")
        real = now.select(space, F.col("canon").alias("made"), F.lit(True).alias("real")).distinct()
        while True:
            made = scratch(now.mapInArrow(make, "kind string, canon string, attempt int, made string").select("*", space), "surrogates")
            first = made.groupBy("space", "made").agg(F.min(F.struct("attempt", "canon", "kind")).alias("owner"), F.count(F.lit(1)).alias("n"))
            judged = made.join(first.where("n > 1"), ["space", "made"], "left").join(real, ["space", "made"], "left")
            lost = F.col("real").isNotNull() | (F.col("owner.canon") != F.col("canon")) | (F.col("owner.kind") != F.col("kind"))
            judged = scratch(judged.select("kind", "canon", "attempt", F.coalesce(lost, F.lit(False)).alias("lost")), "judged")
            scratch.drop(made)
            if judged.where("lost").isEmpty():
                return materialise(judged.where("attempt > 0").select("kind", "canon", "attempt"), "attempts")
            now = judged.select("kind", "canon", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_entities: every row with its entities replaced.

    Null texts stay null, texts without entities stay as they are, very long
    texts are searched whole. Equal entities have equal surrogates in all rows,
    different ones of a kind have different ones (names of all kinds), and none is
    an entity of the input. A name is found by a title or a frequent given name,
    and its words then wherever they stand in the same text; names with neither
    in their text are not detected. Repeated rows are rewritten alike, and rows
    that share or lack an id by their own texts; other columns are ignored; no
    rows, no result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        met = scratch(occurrences(docs), "occurrences")
        again = attempts_of(met.select("kind", "canon").distinct(), key)
        special = met.join(again, ["kind", "canon"]).distinct().groupBy(F.col("h").alias("special_h"))
        special = materialise(special.agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("special")), "special")  # at most a text's entities each
    rows = docs.select("doc_id", "text").join(special, F.xxhash64("text") == F.col("special_h"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            done = [replaced(t.as_py(), key, {(x["kind"], x["canon"]): x["attempt"] for x in s.as_py() or ()}) for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["doc_id", "text", "n_entities"])

    return rows.select("doc_id", "text", "special").mapInArrow(run, f"doc_id {id_type}, text string, n_entities long")
