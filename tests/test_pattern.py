import pytest

from tokenlake.functions import Charset, any_of, at_least, choice, concat, decimal_float, exact, identifier, kleene, optional, plus, repeat, text
from tokenlake.functions import unicode as u
from tokenlake.operators.automaton import Nfa, StateLimitError, determinize, minimize


def matches(p, data):
    return Nfa().add(p, 0, 0).match(data)[1] == len(data) and Nfa().add(p, 0, 0).match(data)[0] is not None


@pytest.mark.parametrize(
    "p, yes, no",
    [
        (any_of("ab"), [b"a", b"b"], [b"", b"c"]), (text("ab"), [b"ab"], [b"a"]), (text(""), [b""], []), (concat(text("a"), text("b")), [b"ab"], [b"a"]),
        (choice(text("a"), text("bc")), [b"a", b"bc"], [b"b"]), (kleene(text("a")), [b"", b"aaa"], [b"b"]), (plus(text("a")), [b"a", b"aa"], [b""]),
        (optional(text("a")), [b"", b"a"], [b"aa"]), (exact(text("a"), 2), [b"aa"], [b"a", b"aaa"]), (exact(text("a"), 0), [b""], [b"a"]),
        (at_least(text("a"), 2), [b"aa", b"aaa"], [b"a"]), (repeat(text("a"), 1, 2), [b"a", b"aa"], [b"", b"aaa"]), (any_of(Charset()), [], [b"", b"a"]),
        (identifier(), [b"_a1"], [b"1a"]), (decimal_float(), [b"1.5"], [b"1.", b".5"]),
    ],
)
def test_combinators(p, yes, no):
    assert all(matches(p, x) for x in yes) and not any(matches(p, x) for x in no)


def test_what_is_refused():
    for bad in (lambda: concat(), lambda: choice(), lambda: repeat(text("a"), 3, 2), lambda: Charset.range("b", "a"), lambda: u.byte_ranges(0xD800, 0xDFFF), lambda: u.byte_ranges(5, 4), lambda: u.merged([]), lambda: u.merged([(5, 6), (1, 2)])):
        with pytest.raises(ValueError):
            bad()


def test_charset_algebra():
    s = Charset.of("abc")
    assert (s + "d" - "a").symbols() == [98, 99, 100] and ("z" + s).symbols() == [97, 98, 99, 122] and not (s - s).symbols()
    assert len(Charset.all()) == 256 and Charset.whitespace().symbols() == [9, 32] and Charset.newline().symbols() == [10, 13]
    assert len(Charset.printable()) == 95 and Charset.escape().symbols() == sorted(b"\n\t\r'\"\\")


def test_utf8_ranges_spell_exactly_the_code_points():
    dfa = minimize(determinize(Nfa().add(u.code_points(0x7F0, 0x10010), 0, 0))[0])
    for cp in [0x7EF, 0x7F0, 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10010, 0x10011]:
        assert (dfa.match(chr(cp).encode())[1] > 0) == (0x7F0 <= cp <= 0x10010)
    whole = minimize(determinize(Nfa().add(u.code_points(0, u.LAST), 0, 0))[0])
    for bad in (b"\x80", b"\xc0\x80", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xff", b"\xc3"):
        assert whole.match(bad) == (None, 0)
    assert u.merged([(1, 2), (3, 4), (6, 6)]) == [(1, 4), (6, 6)]


def test_identifier_classes():
    start, more = set(u.property_ranges("XID_Start")), u.property_ranges("XID_Continue")
    inside = lambda c, ranges: any(a <= ord(c) <= b for a, b in ranges)
    assert inside("a", start) and inside("é", start) and inside("字", start) and not inside("_", start) and not inside("1", start)
    assert inside("_", more) and inside("1", more) and all(any(a <= x and y <= b for a, b in more) for x, y in start)


def test_state_limit():
    p = concat(kleene(any_of("ab")), text("a"), exact(any_of("ab"), 6))
    n = determinize(Nfa().add(p, 0, 0))[0].states
    determinize(Nfa().add(p, 0, 0), n)
    with pytest.raises(StateLimitError):
        determinize(Nfa().add(p, 0, 0), n - 1)


def test_automata_are_composed():
    a, b = Nfa().add(text("ab"), 0, 1), Nfa().add(plus(text("c")), 0, 2)
    assert a.then(b).match(b"abcc") == (2, 4) and a.then(b).match(b"ab") == (None, 0)
    both = Nfa.merged([a, b.shifted(3)])
    assert both.match(b"ab") == (1, 2) and both.match(b"cc") == (2, 2)
    now = both.closure({both.start})
    for byte in b"ab":
        now = both.advance(now, byte)
    assert both.token(now) == (0, 1)
    dfa = minimize(determinize(both)[0])
    assert dfa.token(dfa.advance(dfa.advance(0, 97), 98)) == 1 and dfa.advance(0, 120) is None and dfa.token(0) is None
