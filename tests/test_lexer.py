"""Compiled token sets against the direct simulation, certificates against exhaustive scans, and published cases."""

import itertools
import random

import numpy as np
import pytest

from tokenlake.functions import Charset, any_of, at_least, choice, concat, exact, kleene, optional, plus, text
from tokenlake.functions.unicode import LAST, code_points
from tokenlake.operators.automaton import Nfa
from tokenlake.operators.scan import BatchScanner
from tokenlake.operators.tokenset import TokenSet
from tokenlake.plans import grammars


def random_pattern(rng, depth):
    c = rng.random()
    if depth == 0 or c < 0.35:
        return any_of("".join(rng.sample("abc", rng.randint(1, 2)))) if rng.random() < 0.5 else text("".join(rng.choice("abc") for _ in range(rng.randint(1, 2))))
    if c < 0.6:
        return concat(random_pattern(rng, depth - 1), random_pattern(rng, depth - 1))
    if c < 0.8:
        return choice(random_pattern(rng, depth - 1), random_pattern(rng, depth - 1))
    return rng.choice([kleene, plus, optional, lambda p: exact(p, 2), lambda p: at_least(p, 2)])(random_pattern(rng, depth - 1))


def random_set(rng):
    out, nfa = TokenSet(), Nfa()
    for i in range(rng.randint(1, 4)):
        p, priority = random_pattern(rng, 2), rng.randint(0, 2)
        out.add_token(p, i, priority)
        nfa.add(p, priority, i)
    return out, nfa


def test_matches_and_batches_equal_the_direct_simulation():
    rng = random.Random(7)
    for _ in range(60):
        tokens, nfa = random_set(rng)
        lexer = tokens.compile()
        texts = ["".join(rng.choice("abcd") for _ in range(rng.choice((0, 3, 20, 90)))).encode() for _ in range(12)]
        assert all(lexer.match(t) == nfa.match(t) for t in texts)
        raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        of, kind, start, length, consumed = BatchScanner(lexer).scan(raw, offsets)
        for i, t in enumerate(texts):
            expected, used = lexer.scan(t)
            own = of == i
            assert list(zip(kind[own].tolist(), length[own].tolist())) == expected and consumed[i] == used
            assert (np.cumsum(length[own]) - length[own]).tolist() == start[own].tolist()


def test_batches_cut_at_windows_where_every_input_scans():
    rng, cut = random.Random(21), 0
    for _ in range(60):
        tokens, _ = random_set(rng)
        lexer = tokens.add_token(any_of(Charset.all()), 9, 9).compile()
        if lexer.nullable:
            continue
        assert lexer.total
        cut += bool((lexer.pair_windows >= 0).any())
        texts = ["".join(rng.choice("abcd") for _ in range(rng.choice((0, 1, 5, 40, 200)))).encode() for _ in range(10)]
        raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        of, kind, start, length, consumed = BatchScanner(lexer).scan(raw, offsets)
        for i, t in enumerate(texts):
            own = of == i
            assert list(zip(kind[own].tolist(), length[own].tolist())) == lexer.scan(t)[0] and consumed[i] == len(t)
    assert cut > 20


def test_what_scans_every_text():
    assert grammars.lexer("words").covers_utf8 and not grammars.lexer("words").total
    assert grammars.lexer("html").total and not grammars.lexer("base").covers_utf8
    halves = TokenSet().add_token(code_points(0, LAST), 0, 1).add_token(text(b"\xc3"), 1, 1).add_token(text(b"ab\xc3"), 2, 1).compile()
    assert not halves.covers_utf8  # `ab\xc3` ends inside a code point


def test_certified_chunks_reproduce_the_serial_scan():
    rng, certified, split = random.Random(0x5B1C), 0, 0
    for _ in range(60):
        tokens, _ = random_set(rng)
        lexer = tokens.add_token(text("s"), 9, 0).compile()
        if not lexer.is_split_point(ord("s")):
            continue
        certified += 1
        for _ in range(4):
            data = "s".join("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(8)).encode()
            serial, used = lexer.scan(data)
            for n in (2, 3, 5):
                parts = lexer.scan_parallel(data, n)
                split += len(parts) > 1
                spliced = [t for p, _ in parts for t in p]
                assert spliced[: len(serial)] == serial
                if used == len(data):
                    assert spliced == serial
    assert certified > 20 and split > 50


def test_windows_hold_on_every_complete_input():
    rng, seen = random.Random(11), 0
    for _ in range(25):
        tokens, _ = random_set(rng)
        lexer = tokens.compile()
        found = {w: o for n in (1, 2, 3) for w, o in lexer.certified_windows(n).items() if set(w) <= set(b"abc")}
        for n in range(1, 7):
            for letters in itertools.product(b"abc", repeat=n):
                data = bytes(letters)
                scan, used = lexer.scan(data)
                if used < n or not scan:
                    continue
                begins = set(np.cumsum([0] + [k for _, k in scan])[:-1].tolist())
                for w, o in found.items():
                    for at in range(n - len(w) + 1):
                        if data[at : at + len(w)] == w:
                            seen += 1
                            assert at + o in begins
        core = lexer.mandatory_core
        assert all(core in w[:-1] for w in found) if core else True
    assert seen > 100


def made(*patterns):
    out = TokenSet()
    for i, p in enumerate(patterns):
        out.add_token(text(p) if isinstance(p, str) else p, i)
    return out.compile()


def test_published_windows_and_plans():
    assert made("a", "abc", "bx", "x").is_split_window(b"abx") == 1
    assert made("a", "ab", "b").is_split_window(b"ab") is None
    assert made("0", "00", "01").is_split_window(b"1001") == 2
    assert made(plus(text("a"))).is_split_window(b"aaa") is None and made(kleene(text("a"))).is_split_window(b"a") is None
    lexer = made(plus(text("a")), ";")
    assert lexer.chunk_boundaries(b"aaaaaaa;;a", 4) == [0, 7, 8, 10] and lexer.chunk_boundaries(b"aaaaaaa;;a", 2) == [0, 7, 10] and lexer.chunk_boundaries(b"", 3) == [0, 0]
    everything = made(any_of("x"))
    assert everything.chunk_boundaries(b"x" * 997, 7) == [997 * i // 7 for i in range(8)]
    odd = made("a", "aa", "ab", "bc")
    assert odd.scan(b"abc") == ([(2, 2)], 2) and odd.chunk_boundaries_with_windows(b"abc", 2) == [0, 1, 3]


def test_plans_up_to_ignored_tokens_and_what_plans_look_at():
    own = grammars.words().set_ignored_tokens({grammars.BLANK}).compile()
    data = b"abcdefgh    ijklmnop    qrst"
    assert own.chunk_boundaries(data, 2) == [0, 28] and own.chunk_boundaries(data, 2, ignoring=True) == [0, 20, 28]
    for chunks in (2, 3, 5, 28):
        plan = own.chunk_boundaries(data, chunks, ignoring=True)
        parts = [t for a, b in zip(plan[:-1], plan[1:]) for t in own.scan(data[a:b])[0] if t[0] != grammars.BLANK]
        assert parts == [t for t in own.scan(data)[0] if t[0] != grammars.BLANK]
    lines = grammars.separated("\n").compile()
    assert lines.plan_cost(b"aaaa\naaaa\naaaa\n", 2) == ([0, 9, 15], 2) and lines.plan_cost(b"a" * 16, 4) == ([0, 16], 12)
    assert lines.plan_cost(b"", 4) == ([0, 0], 0) and grammars.separated("").compile().plan_cost(b"a\n" * 8, 4) == ([0, 16], 0)


def test_core_and_exhaustive_plans_agree():
    lexer, rng = grammars.lexer("base + block comments"), random.Random(3)
    assert lexer.mandatory_core == b"*/"
    for _ in range(30):
        data = "".join(rng.choice(["a ", "/* x */\t", "1+", "*/ ", "\n"]) for _ in range(60)).encode()
        assert lexer.chunk_boundaries_with_windows(data, 5) == lexer.chunk_boundaries_with_windows(data, 5, use_core=False)


@pytest.mark.parametrize("name, exact_bytes, ignoring", [("base", 24, 27), ("base + strings", 0, 1), ("JSON", 0, 3), ("log lines", 1, 1), ("keyword-scale", 16, 19), ("scaling", 13, 16)])
def test_certificate_table(name, exact_bytes, ignoring):
    lexer = grammars.lexer(name)
    assert (int(lexer.split_points.sum()), int(lexer.split_points_ignoring.sum())) == (exact_bytes, ignoring)


def test_published_automaton_size():
    assert grammars.lexer("keyword-scale").dfa.states == 251 and len(grammars.keyword_scale().rules) == 143


def test_early_stop_payload_and_zero_length():
    own = TokenSet().add_token(text("a"), 0).add_token(text("b"), 1).set_token_payload(0, 5).set_token_payload(0, 6)
    seen = []
    lexer = own.compile()
    assert lexer.scan(b"aab", lambda k, n, p: seen.append((k, n, p))) == ([(0, 1), (0, 1), (1, 1)], 3) and seen == [(0, 1, 6), (0, 1, 6), (1, 1, 0)]
    assert lexer.scan(b"aab", lambda k, n: False) == ([(0, 1)], 1)
    empty = made(kleene(text("a")))
    assert empty.match(b"b") == (0, 0) and empty.scan(b"b") == ([], 0) and empty.match(b"") == (0, 0)


def test_diagnosis():
    d = TokenSet().add_token(grammars.identifier(), 0, 0).add_token(text("if"), 1, 1).add_token(text("if"), 2, 0).diagnose()
    assert d.dead_tokens == [1, 2] and d.ties == [(0, 2)]
