import re

from hypothesis import given, settings
from hypothesis import strategies as st

from diffloom.llm.automaton import Dfa, Parser, reverse, trimmed

PATTERNS = ["ab*c", "(a|bc)+d?", "[a-c]{2,3}x", "a{2}(b|)c", "[^ab]c|a.c", r"\x61\.b+", "(ab|a)(c|bcd)*", "a{2,}b?"]


def accepts(dfa, data):
    state = 0
    for b in data:
        state = dfa.table[256 * state + b]
    return bool(dfa.rules[state])


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(PATTERNS), st.text("abcdx. ", max_size=8))
def test_same_language_as_re(pattern, text):
    tree, data = Parser(pattern).parse(), text.encode()
    assert accepts(Dfa.of([tree], search=False), data) == bool(re.fullmatch(pattern, text))
    assert accepts(Dfa.of([reverse(tree)], search=False), data[::-1]) == bool(re.fullmatch(pattern, text))
    ends_here = any(re.fullmatch(pattern, text[i:]) for i in range(len(text) + 1))
    assert accepts(Dfa.of([tree], search=True), data) == ends_here


def test_minimal_and_shared():
    assert len(Dfa.of([Parser("(a|b)*abb").parse()], search=False)) == 5  # four, and that of other bytes
    both = Dfa.of([Parser("ab").parse(), Parser("b+").parse()], search=True)
    state = 0
    for b in b"ab":
        state = both.table[256 * state + b]
    assert both.rules[state] == frozenset({0, 1})


def test_trimmed_matches_end_first_alike():
    for p in ("ab+", "x[ab]{2,}", "a(b|c)"):
        full, cut = (Dfa.of([t], search=True) for t in (Parser(p).parse(), trimmed(Parser(p).parse())))
        for text in (b"xxabbbaab", b"zab", b"xabab", b"acab"):
            first = []
            for d in (full, cut):
                state = 0
                ends = []
                for i, b in enumerate(text):
                    state = d.table[256 * state + b]
                    ends += [i] if d.rules[state] else []
                first.append(ends[:1])
            assert first[0] == first[1]


def test_folded_letters_are_ascii_only():
    d = Dfa.of([Parser("sk", fold=True).parse()], search=False)
    assert accepts(d, b"Sk") and accepts(d, b"sK") and not accepts(d, "ſk".encode())
