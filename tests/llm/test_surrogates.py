import re
import unicodedata

from rows import found, no_documents, odd_documents

from conftest import DATA
from diffloom.llm import surrogates
from diffloom.llm.queries import QUERIES

KEY = b"test key"
EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
FORMS = (EMAIL, re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}"), re.compile(r"(?<!\d)\d{16}(?!\d)"), re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"))


def plain(texts, key=KEY):
    """All texts rewritten by one loop over all entities: the rule of attempts as it is written."""
    entities = {(e.kind, e.canon) for t in texts.values() for e in surrogates.detect(t)}
    space = lambda kind: kind.split(":")[0]
    real = {(space(k), c) for k, c in entities}
    attempts = dict.fromkeys(entities, 0)
    while True:
        made = {(k, c): (space(k), surrogates.surrogate(key, k, c, n)) for (k, c), n in attempts.items()}
        owner = {}
        for (k, c), m in made.items():
            owner[m] = min(owner.get(m, (1 << 30, "", "")), (attempts[k, c], c, k))
        lost = [e for e, m in made.items() if m in real or owner[m][1:] != e[::-1]]
        if not lost:
            return {i: surrogates.replaced(t, key, attempts)[0] for i, t in texts.items()}
        for e in lost:
            attempts[e] += 1


def test_query_equals_a_plain_version(spark):
    from diffloom.llm.queries import SURROGATE_KEY

    for folder in (DATA, DATA.replace("sf0.001", "sf0.01")):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        assert {r["doc_id"]: r["text"] for r in QUERIES["op4_pii_surrogates"](spark, folder).collect()} == plain(texts, SURROGATE_KEY)


def test_formats_that_are_used_up_grow(spark, monkeypatch):
    """More addresses than a narrowed format has values: none crashes, all stay distinct."""
    narrow = surrogates.surrogate
    few = lambda key, kind, canon, n: f"10.0.0.{surrogates.Stream(key, canon, n).below(20)}" if kind == "ip" and n < surrogates.WIDER else narrow(key, kind, canon, n)
    monkeypatch.setattr(surrogates, "surrogate", few)
    out = plain({i: f"from 192.168.{i}.7 on" for i in range(60)})
    assert len(set(out.values())) == 60 and sum("2001:db8:" in t for t in out.values()) >= 40
    ssn = surrogates.detect("no 123-45-6789 here")[0]
    wide = surrogates.dressed(ssn, narrow(KEY, "ssn", ssn.canon, surrogates.WIDER + 2))
    assert re.fullmatch(r"\d{3}-\d{2}-\d{7}", wide)


def test_rows_without_an_id_are_rewritten_by_their_own_text(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(500)]
    rows = [(None, f"write to {n}@x.org") for n in names] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(dict(enumerate(t for _, t in rows)))
    assert sorted(r["text"] for r in surrogates.pseudonymise(df, KEY).collect()) == sorted(want.values())


def test_a_given_name_tells_a_name():
    text = "Mr. John Smith arrived. Smith left. John Smith paid. Write to Mary Jones, Mary J. Brown or Jean-Luc Picard."
    out, n = surrogates.replaced(text, KEY, {})
    assert not re.search("John|Smith|Mary|Jones|Brown|Luc|Picard", out) and " J. " in out
    assert surrogates.replaced("Paul went. The John is Paul and mary jones", KEY, {})[1] == 0


def test_query_replaces_all_and_nothing_else(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()}
    rows = QUERIES["op4_pii_surrogates"](spark, DATA.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) == len(texts)
    shape = lambda t: re.sub("[a-z]", "a", re.sub(r"\d", "0", t))
    forward, back, n = {}, {}, 0
    real = {m for t in texts.values() for f in FORMS for m in f.findall(t)}
    for r in rows:
        before = texts[r["doc_id"]]
        if not any(f.search(before) for f in FORMS):
            assert r["text"] == before and r["n_entities"] == 0
            continue
        for f in FORMS:
            was, now = f.findall(before), f.findall(r["text"])
            assert len(was) == len(now)
            for a, b in zip(was, now, strict=True):
                n += 1
                assert b not in real and (f is FORMS[3] or shape(b.split("@")[0]).startswith(shape(a.split("@")[0])))
                assert forward.setdefault(a, b) == b and back.setdefault(b, a) == a
    assert n > 30


def test_formats_stay():
    text = "A.B@C.ORG a_1@x.de (743) 555-3824 +1 743 555 3824 ; 4111 1111 1111 1111 5500005555555559 1.2.3.4 123-45-6789 DE89 3704 0044 0532 0130 00"
    out, n = surrogates.replaced(text, KEY, {})
    assert n == 9
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", t)))
    a, b = text.split(), out.split()
    assert b[0].isupper() and b[0].endswith(".EXAMPLE.ORG") and b[1].endswith(".example.de")
    assert [shape(x) for x in a[2:14]] == [shape(x) for x in b[2:14]]
    assert re.sub(r"\D", "", "".join(b[2:4])) == "".join(b[5:8])  # the same number in two formats
    card = "".join(b[9:13])
    assert card[0] == "4" and surrogates.luhn(card[:-1]) == int(card[-1])
    assert surrogates._iban_ok("".join(b[16:]))


def test_names_keep_gender_script_and_identity():
    out, n = surrogates.replaced("Mr. John Smith met Mrs Smith and Frau MARIA Weber; Госпожа Анна Иванова", KEY, {})
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Frau (\w+) (\w+); Госпожа (\w+) (\w+)", out)
    assert m and n == 7 and m[2] == m[3] != m[1]
    assert m[1].endswith(surrogates.SYLLABLES["LATIN"][2]["male"]) and m[4].lower().endswith(surrogates.SYLLABLES["LATIN"][2]["female"])
    assert m[4].isupper() and re.fullmatch("[А-Яа-я]+", m[6] + m[7])


def test_collisions_are_resolved(spark):
    """Two-letter addresses: 676 shapes for 500 entities, so many meet at first."""
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(500)]
    df = spark.createDataFrame([(i, f"write to {n}@x.org or {n}@x.org today") for i, n in enumerate(names)], "doc_id long, text string")
    rows = surrogates.pseudonymise(df, KEY).collect()
    out = {r["doc_id"]: EMAIL.findall(r["text"]) for r in rows}
    assert all(a == b for a, b in out.values())
    assert len({a for a, _ in out.values()}) == 500
    assert out == {r: EMAIL.findall(t) for r, t in plain({r["doc_id"]: r["text"] for r in df.collect()}).items()}
    assert surrogates.attempts_of(surrogates.occurrences(df).select("kind", "canon").distinct(), KEY).count() > 50


def test_odd_rows(spark):
    docs = odd_documents(spark)
    before, after = found(docs, "doc_id", "text"), found(surrogates.pseudonymise(docs, KEY), "doc_id", "text")
    assert before == after
    assert surrogates.pseudonymise(no_documents(spark), KEY).collect() == []


def test_keys_matter():
    assert surrogates.replaced("a.b@c.org", b"one", {}) != surrogates.replaced("a.b@c.org", b"two", {})


def test_names_are_replaced_without_their_title_too(spark):
    text = "Smith came first. Mr John Smith arrived. Later Smith and John Smith left, SMITH's hat stayed; blacksmith, smith, Smithson and Smith2 stay. Mrs Anne O'Brien: O'Brien's, Anne-Smith. Mr Smith's"
    out, n = surrogates.replaced(text, KEY, {})
    john, smith, anne, brien = (surrogates.dressed(e, surrogates.surrogate(KEY, e.kind, e.canon, 0)) for e in surrogates.detect("Mr John Smith, Mrs Anne O'Brien"))
    assert out == (
        f"{smith} came first. Mr {john} {smith} arrived. Later {smith} and {john} {smith} left, {smith.upper()}'s hat stayed; blacksmith, smith, Smithson and Smith2 stay. "
        f"Mrs {anne} {brien}: {brien}'s, {anne}-{smith}. Mr {smith}'s"
    )
    assert n == 13
    df = spark.createDataFrame([(1, text), (2, "Smith without a title")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["text"], r["n_entities"]) for r in surrogates.pseudonymise(df, KEY).collect()}
    assert rows[2] == ("Smith without a title", 0) and rows[1][1] == 13 and not re.search(r"John|Smith\b|Anne|Brien", rows[1][0])
    assert surrogates.replaced("mail smith@x.org, Mr Smith", KEY, {})[1] == 2


def test_names_of_other_scripts_keep_them():
    for name in ("王伟", "김민수", "さくら", "サクラ", "שרה", "محمد", "शर्मा", "Արամ", "გიორგი", "สมชาย"):
        out, n = surrogates.replaced(f"Mr {name} came, {name} left", KEY, {})
        a, b = re.fullmatch(r"Mr (\S+) came, (\S+) left", out).groups()
        assert n == 2 and a == b != name
        assert {unicodedata.name(c).split()[0] for c in a} == {unicodedata.name(name[0]).split()[0]}, (name, a)


def test_many_mentions_take_linear_time():
    assert surrogates.replaced("Mr Smith: " + "Smith-Smith " * 20_000, KEY, {})[1] == 40_001


PHONES = ["+33 6 12 34 56 78", "+33 (0)6 12 34 56 78", "+33(0)612345678", "0033 6 12 34 56 78", "+49 30 12345678", "+49 171 1234567", "+49 (0)171/1234567", "+34 612345678", "+34 612 34 56 78", "+44 20 7946 0958", "+4930123456"]
PHONES += ["06 12 34 56 78", "06.12.34.56.78", "0612345678", "0171 1234567", "0171/1234567", "(030) 12345678", "030 123 456 78", "1-800-555-1234", "1 (800) 555-1234", "555 123 4567", "555-123-4567", "(555) 123 4567", "612 34 56 78", "91 123 45 67"]
PHONES += ["+1 (743) 555-3824", "+1 743 555 3824", "+17435553824"]


def test_phone_forms_of_all_languages():
    sentences = ("Call {} today or 20 people", "Appelez le {} avant 2020", "Rufen Sie {} an, bis 2020", "Llame al {}, hoy. 2020", "{}", "{} 2020 rows")
    for phone in PHONES:
        for sentence in sentences:
            found = surrogates.detect(sentence.format(phone))
            if (phone, sentence) not in {(p, "{} 2020 rows") for p in PHONES if p.startswith(("+4", "030", "0171", "(030"))}:  # of no fixed length
                assert [(e.kind, e.text) for e in found] == [("phone", phone)], (phone, sentence)
            else:
                assert found[0].text.startswith(phone), (phone, sentence)
        out, n = surrogates.replaced(f"x {phone} y", KEY, {})
        assert n == 1 and out != f"x {phone} y" and re.sub(r"\d", "0", out) == re.sub(r"\d", "0", f"x {phone} y")
        assert phone[0] != "0" or out[2] == "0"
        assert "(0)" not in phone or "(0)" in out
        assert surrogates._canonical("phone", out[2:-2]) == surrogates.surrogate(KEY, "phone", surrogates._canonical("phone", phone), 0), phone
    assert len({surrogates._canonical("phone", p) for p in PHONES[:4]}) == 1


def test_other_numbers_are_no_phones():
    for text in ("01.02.2020 12:30", "01-02-2020 12", "05/06/2021 1234", "3.0612345678", "3,0612345678", "0.0171234567", "12 345 678 900", "000123456789", "2020-01-02 10:20:30", "0123 4567 8901 2345", "0054994038693466", "9c0150411590525cf8", "612 345 678", "1 000 000 000"):
        assert [e for e in surrogates.detect(text) if e.kind == "phone"] == [], text
