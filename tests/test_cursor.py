"""The cursor, recovery, modes."""

import random

import pytest

from tokenlake.functions import Charset, any_of, plus, text
from tokenlake.operators import modes
from tokenlake.operators.modes import Action, ModalTokenSet, Stack, go_to, pop, push, stay
from tokenlake.operators.tokenizer import END, ERROR, Tokenizer
from tokenlake.operators.tokenset import TokenSet
from tokenlake.plans import grammars


def words():
    return TokenSet().add_token(plus(any_of(Charset.range("a", "z"))), 0).add_token(plus(text(" ")), 1).compile()


def test_tokens_errors_and_recovery():
    t = Tokenizer(words(), "abc@@@def ghi")
    assert (t.next().lexeme, t.offset) == (b"abc", 3)
    r = t.next()
    assert (r.status, r.message, t.offset) == (ERROR, "Unrecognized character at position 3", 3)
    assert t.recover() == 6 and t.offset == 9
    assert [x.lexeme for x in t] == [b" ", b"ghi"] and t.next().status == END
    t.reset()
    t.seek(3)
    found = t.recover_from_failure()
    assert (found.start, found.evidence_begin, found.evidence_end, found.window) == (9, 6, 10, True) or (found.start, found.window) == (9, True)
    t.seek(3)
    assert t.recover_from_clean(7).start >= 9 and Tokenizer(words(), "@@").recover() is None
    t.seek(99)
    assert t.next().status == END
    assert Tokenizer(TokenSet().add_token(text(""), 0).compile(), "b").next().message == "Zero-width match at position 0"


def test_modal_scans():
    lexer = grammars.modal_code().compile()
    stack = Stack()
    found, used = lexer.scan(b'a /* x /* y */ z */ "b\\"c" d', stack)
    assert used == 28 and (stack.current, stack.saved) == (0, [])
    assert [m for m, _, _ in found[:4]] == [0, 0, 0, 2]
    stack = Stack()
    assert lexer.scan(b'"abc', stack)[1] == 4 and (stack.current, stack.saved) == (1, [0])
    with pytest.raises(ValueError):
        lexer.match(b"a", Stack(7))


def test_pop_without_a_frame_is_no_match():
    lexer = ModalTokenSet().add_token(0, text(")"), 0, 0, pop()).add_token(0, text("("), 1, 0, push(0)).compile()
    stack = Stack()
    assert lexer.match(b")", stack) == (None, 0) and stack == Stack()
    assert lexer.scan(b"())")[1] == 2


def test_registration_is_checked():
    m = ModalTokenSet().add_token(0, text("a"), 0, 0, push(1))
    with pytest.raises(ValueError):
        m.add_token(0, text("b"), 0, 0, stay())
    with pytest.raises(ValueError):
        m.compile()
    with pytest.raises(ValueError):
        ModalTokenSet().compile()
    with pytest.raises(ValueError):
        ModalTokenSet().add_token(0, any_of("a"), 0).add_token(0, text(""), 1, 0, push(0)).compile()
    assert ModalTokenSet().add_token(0, text("a"), 0, 0, go_to(0)).actions[0, 0] == stay()
    assert all(Action.unpack(a.pack()) == a for a in (stay(), go_to(3), push(2), pop()))
    assert modes.NAMES[push(1).kind] == "push"


def test_modal_diagnosis():
    m = ModalTokenSet().add_token(0, text("a"), 0, 0, push(1)).add_token(1, text("b"), 1, 0, go_to(2)).add_token(2, text("c"), 2, 0, pop()).add_token(3, text("d"), 3, 0, go_to(0)).add_token(4, text("e"), 4, 0, push(4))
    d = m.diagnose()
    assert d.unreachable_modes == [3, 4] and d.inescapable_modes == [4]


def test_cursor_equals_batch_on_random_modal_texts():
    lexer, rng = grammars.modal_code().compile(), random.Random(5)
    for _ in range(60):
        data = "".join(rng.choice(['"', "/*", "*/", "a", " ", "\\", "x1", "\n"]) for _ in range(30)).encode()
        tokens = [(r.kind, len(r.lexeme)) for r in Tokenizer(lexer, data) if r.status == "TOKEN"]
        assert tokens == [(k, n) for _, k, n in lexer.scan(data)[0]]
