import hashlib
import re
from pathlib import Path

import pytest
from rows import found, no_documents, odd_documents

from conftest import DATA
from diffloom.llm import licences
from diffloom.llm.licence_texts import DIGESTS, TEXTS
from diffloom.llm.queries import ORACLE_SQL, QUERIES
from duck import connect, same


def test_query_equals_sql(spark):
    same(QUERIES["op1_licence_scan"](spark, DATA), connect(DATA), ORACLE_SQL["op1_licence_scan"])


def test_every_known_text_is_found_and_they_differ(spark):
    rows = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(sorted(TEXTS.items()))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licence"] for r in rows] == sorted(TEXTS)


def test_dress_does_not_matter_but_words_do(spark):
    mit = TEXTS["MIT"]
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Someone, Ltd\nAll rights reserved.\n\n" + mit),
        (2, mit.upper().replace('"', "“")),
        (3, "/*\n * " + mit.replace("\n", "\n * ").replace(" of ", " of\n * ") + "\n */"),
        (4, TEXTS["Unlicense"].replace("recognize", "recognise").replace("https://", "http://www.")),
        (5, TEXTS["BSL-1.0"].replace("license", "licence").replace("organization", "organisation")),
        (6, mit.replace("free of charge", "for a fee")),
        (7, "Before.\n" + mit),
        (8, mit[:-60]),
    ]
    got = found(licences.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "licence")
    assert got == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "Unlicense"), (5, "BSL-1.0"), (6, None), (7, None), (8, None)]


def test_odd_rows_and_own_licences(spark):
    known = spark.createDataFrame([("b", "Plain WORDS, in a plain line!"), ("a", "plain words in a plain line"), ("nothing", "—")], "licence string, text string")
    got = found(licences.scan(odd_documents(spark), licences.digests_of(known)), "doc_id", "licence")
    assert got == sorted([(1, "a"), (2, None), (3, None), (4, None), (5, None), (6, "a"), (6, "a"), (7, None), (None, None)], key=repr)
    assert licences.scan(no_documents(spark)).collect() == []


HOLDERS = ("Copyright The Foo Authors", "Copyright, 2020 Foo", "Copyright: 2020 Foo", "Portions Copyright (c) 2020 Foo", "Copyright 1999-2020 by A and B", "# Copyright (C) Foo Inc.", "(c) 2021 Foo", "© Foo", "Copyright Acme Inc.")


def test_lines_that_name_a_holder_go(spark):
    rows = [(i, f"MIT License\n\n{line}\nAll rights reserved.\n\n{TEXTS['MIT']}") for i, line in enumerate(HOLDERS)]
    rows += [(100 + i, TEXTS["BSD-3-Clause"].replace("the above copyright", "the above\ncopyright").replace("the copyright holder nor", "the\ncopyright holder nor")) for i in range(1)]
    got = sorted(found(licences.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "licence"))
    assert got == [(i, "MIT") for i in range(len(HOLDERS))] + [(100, "BSD-3-Clause")]


def plain_canonical(text):
    """The form as words: an independent version for ASCII texts without lines that name a holder."""
    words = re.findall("[a-z0-9]+", text.lower())
    out = []
    for w in words:
        w = re.sub("is(e|ed|es|er|ers|ing|ation|ations)$", r"iz\1", w)
        w = re.sub("^(licen|offen|defen)c", r"\1s", w)
        w = re.sub("^(fav|hon|lab|behavi|endeav)our", r"\1or", w)
        w = re.sub("^(acknowledg|judg)ement", r"\1ment", w)
        w = re.sub("^(analog|catalog)ue", r"\1", w)
        out.append(w)
    line = " ".join(out)
    line = re.sub(r"\b(non|sub|third|per) (?=(?:commercial|infringement|license|part|cent))", r"\1", line)
    return re.sub(r"\bhttps?(?: www)?\b|\bwww\b", "http", line.replace("copyright owner", "copyright holder"))


def test_digests_equal_those_of_a_plain_version(spark):
    texts = [t for _, t in sorted(TEXTS.items()) if t.isascii()]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["digest"] for r in rows] == [hashlib.sha256(plain_canonical(t).encode()).hexdigest() for t in texts]


LONG = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not LONG.is_dir(), reason="no folder of licence texts")
def test_long_licences_are_found_in_any_dress(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for file, name in names.items():
        if (LONG / file).exists():
            text = (LONG / file).read_text()
            rows += [(name, text), (name, text.upper()), (name, text.replace("    ", " ")), (name, text.split("END OF TERMS AND CONDITIONS")[0])]
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert got and all(r["licence"] == r["doc_id"] for r in got)


def test_digests_are_of_one_licence_each():
    every = [d for all_ in DIGESTS.values() for d in all_]
    assert len(every) == len(set(every)) and all(re.fullmatch("[0-9a-f]{64}", d) for d in every)
