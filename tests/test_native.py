"""Expressions of the JVM against the automaton: the same tokens, or no expression."""

import random

import pytest

from tests.test_lexer import random_set
from tokenlake.functions import Charset, any_of, choice, concat, kleene, plus, text
from tokenlake.functions.unicode import LAST, code_points
from tokenlake.operators import native, scan
from tokenlake.operators.tokenset import TokenSet
from tokenlake.plans import grammars


def made(*patterns):
    out = TokenSet()
    for i, p in enumerate(patterns):
        out.add_token(p, i)
    return out.compile()


def test_which_sets_have_an_expression():
    assert all(native.spells(grammars.lexer(g)) for g in ("words", "html", "log lines", "base", "scaling"))
    assert native.spells(grammars.lexer("JSON")) is None and native.spells(grammars.lexer("base + block comments")) is None  # cycles of several states
    assert native.spells(made(kleene(text("a")))) is None  # an empty token
    assert native.spells(made(any_of(Charset.all()))) is None  # tokens that end inside a character
    assert native.spells(made(plus(any_of(Charset.all())))) and native.spells(made(concat(text(b"\xc3"), kleene(any_of(Charset.range(0, 0x7F)))))) is None
    with pytest.raises(ValueError, match="cycles"):
        native.lexemes(None, grammars.lexer("JSON"))


def test_tokens_equal_those_of_the_automaton(spark):
    rng, sets = random.Random(21), []
    for _ in range(60):
        lexer = random_set(rng)[0].compile()
        if native.spells(lexer):
            sets.append((lexer, "abcd"))
    assert len(sets) > 15
    star = concat(text("/*"), kleene(any_of(Charset.range(0, 0x7F) - "*")), text("*/"))
    sets += [(made(text("a"), concat(text("a"), kleene(text("b")), text("c")), text("b"), star, any_of("/*")), "abc/*"), (made(text("ab"), concat(text("ab"), plus(choice(text("é"), code_points(0x10000, LAST))), text("."))), "ab.é🙂")]
    sets += [(grammars.lexer(g), "ab <>/!=é字🙂\n\t1_\"-(") for g in ("words", "html", "log lines", "base", "scaling")]
    for lexer, letters in sets:
        texts = ["", None] + ["".join(rng.choice(letters) for _ in range(rng.choice((1, 3, 10, 60)))) for _ in range(12)]
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {}
        for r in native.lexemes(rows, lexer).collect():
            found.setdefault(r["doc_id"], []).append((r["seq"], r["kind"], r["length"], r["lexeme"]))
        for i, t in enumerate(texts):
            data, at, expected = (t or "").encode(), 0, []
            for n, (kind, length) in enumerate(lexer.scan(data)[0]):
                expected.append((n, kind, length, data[at : at + length].decode()))
                at += length
            assert sorted(found.get(i, [])) == expected


def test_totals_take_either_way(spark):
    rows = spark.createDataFrame([(1, "a", 'ab 12 "x"'), (1, "b", "[1, 2]"), (2, "a", None)], "doc_id long, lang string, text string")
    for name in ("words", "JSON"):
        lexer = grammars.lexer(name)
        got = {(r["lang"], r["kind"]): (r["tokens"], r["bytes"]) for r in scan.totals(rows, lexer, ("lang",)).collect()}
        expected = {}
        for _, lang, t in rows.collect():
            for kind, n in lexer.scan((t or "").encode())[0]:
                a, b = expected.get((lang, kind), (0, 0))
                expected[lang, kind] = a + 1, b + n
        assert got == expected
    plan = scan.totals(rows, grammars.lexer("words"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_stop_is_the_last_token(spark):
    rows = spark.createDataFrame([(1, "ab 1 c 2"), (2, "xy"), (3, "7"), (3, "a 7 b")], "doc_id long, text string")
    tokens = scan.tokenize(rows, grammars.lexer("words"), stop=frozenset({grammars.DIGITS}))
    assert sorted((r["doc_id"], r["seq"], r["kind"]) for r in tokens.collect()) == [(1, 0, 0), (1, 1, 2), (1, 2, 1), (2, 0, 0), (3, 0, 0), (3, 0, 1), (3, 1, 2), (3, 2, 1)]


def test_evidence_in_stretches_equals_a_search_byte_by_byte():
    rng, seen = random.Random(5), 0
    for k in range(50):
        lexer = random_set(rng)[0].compile() if k % 5 else grammars.lexer(rng.choice(["conventional", "JSON", "log lines", "base + block comments"]))
        for _ in range(5):
            data = "".join(rng.choice('abcd"*/ \n') for _ in range(rng.choice((0, 3, 70, 400)))).encode()
            at = rng.randint(0, 3)
            expected = None
            for i in range(at, len(data)):
                if lexer.split_points[data[i]]:
                    expected = (i, i, i + 1, False)
                elif not lexer.nullable and (found := lexer._window_at(data, i)) is not None:
                    expected = (found[0], i, found[1], True)
                if expected:
                    break
            got = lexer.next_certified_evidence(data, at)
            seen += got is not None and got.window
            assert (got and (got.start, got.evidence_begin, got.evidence_end, got.window)) == expected
    assert seen > 20
