"""Named token sets."""

from __future__ import annotations

from functools import cache

from ..functions import Charset, any_of, choice, concat, decimal_float, decimal_integer, exact, identifier, kleene, optional, plus, text
from ..functions.unicode import LAST, code_points
from ..operators.modes import ModalTokenSet, pop, push
from ..operators.tokenset import TokenSet

IDENTIFIER, NUMBER, OPERATOR, PUNCTUATION, SPACE, NEWLINE, STRING, LINE_COMMENT, BLOCK_COMMENT, CHARACTER, KEYWORD = range(11)
WORD, DIGITS, BLANK, OTHER = range(4)
# The members of each class of symbols, and the words that are keywords.
OPERATORS, PUNCTUATIONS = "+-*/<>=!&|^%~", "()[]{};,.:?"
KEYWORDS = (
    "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class compl concept const consteval constexpr constinit const_cast continue "
    "co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new "
    "noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch "
    "template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq final override import module int8_t int16_t int32_t int64_t"
).split()


def words(catch_all: bool = True) -> TokenSet:
    """Identifiers, numbers, white space, and any other code point: scans every text wholly."""
    out = TokenSet().add_token(identifier(), WORD, 1).add_token(decimal_integer(), DIGITS, 1).add_token(plus(any_of(" \t\n\r")), BLANK, 1)
    return out.add_token(code_points(0, LAST), OTHER, 9) if catch_all else out


def _base(newline: bool = False) -> TokenSet:
    out = TokenSet().add_token(identifier(), IDENTIFIER, 2).add_token(decimal_integer(), NUMBER, 2)
    out.add_token(any_of(OPERATORS), OPERATOR, 2).add_token(any_of(PUNCTUATIONS), PUNCTUATION, 2)
    out.add_token(plus(any_of(" \t" if newline else " \t\n")), SPACE, 2)
    return out.add_token(text("\n"), NEWLINE, 2) if newline else out


def _string() -> object:
    return concat(text('"'), kleene(any_of(Charset.all() - '"' - "\n")), text('"'))


def _line_comment() -> object:
    return concat(text("//"), kleene(any_of(Charset.all() - "\n")))


def _block_comment() -> object:
    star = text("*")
    return concat(text("/*"), kleene(choice(any_of(Charset.all() - "*"), concat(plus(star), any_of(Charset.all() - "*" - "/")))), plus(star), text("/"))


def c_like(strings: bool = False, lines: bool = False, blocks: bool = False, newline: bool = False) -> TokenSet:
    """Identifiers, numbers, operators, punctuation and white space, with what else is asked for; comments are ignored like white space."""
    out, ignored = _base(newline), {SPACE} | ({NEWLINE} if newline else set())
    if strings:
        out.add_token(_string(), STRING, 2)
    if lines:
        out.add_token(_line_comment(), LINE_COMMENT, 1)
        ignored |= {LINE_COMMENT}
    if blocks:
        out.add_token(_block_comment(), BLOCK_COMMENT, 1)
        ignored |= {BLOCK_COMMENT}
    return out.set_ignored_tokens(ignored)


def complete_c() -> TokenSet:
    """The C-like set that scans any C source wholly: comments, strings and characters with escapes, and the stray symbols."""
    out = TokenSet().add_token(identifier(), IDENTIFIER, 2).add_token(decimal_integer(), NUMBER, 2).add_token(any_of(OPERATORS), OPERATOR, 2)
    out.add_token(any_of(PUNCTUATIONS + "#\\@`$'"), PUNCTUATION, 2).add_token(plus(any_of(" \t\n\r")), SPACE, 2)
    for quote, kind in (('"', STRING), ("'", CHARACTER)):
        out.add_token(concat(text(quote), kleene(choice(any_of(Charset.all() - quote - "\\" - "\n"), concat(text("\\"), any_of(Charset.all() - "\n")))), text(quote)), kind, 2)
    return out.add_token(_line_comment(), LINE_COMMENT, 1).add_token(_block_comment(), BLOCK_COMMENT, 1).set_ignored_tokens({SPACE, LINE_COMMENT, BLOCK_COMMENT})


def json() -> TokenSet:
    """RFC 8259: strings 0, numbers 1, literals 2, structure 3, white space 4."""
    escape = concat(text("\\"), choice(any_of('"\\/bfnrt'), concat(text("u"), exact(any_of(Charset.digits() + Charset.range("a", "f") + Charset.range("A", "F")), 4))))
    string = concat(text('"'), kleene(choice(any_of(Charset.range(0x20, 0xFF) - '"' - "\\"), escape)), text('"'))
    number = concat(optional(text("-")), choice(text("0"), concat(any_of("123456789"), kleene(any_of(Charset.digits())))), optional(concat(text("."), decimal_integer())), optional(concat(any_of("eE"), optional(any_of("+-")), decimal_integer())))
    out = TokenSet().add_token(string, 0, 2).add_token(number, 1, 2).add_token(choice(text("true"), text("false"), text("null")), 2, 1)
    return out.add_token(any_of("{}[]:,"), 3, 2).add_token(plus(any_of(" \t\n\r")), 4, 2).set_ignored_tokens({4})


def lines() -> TokenSet:
    """Lines 0 and line ends 1."""
    return TokenSet().add_token(plus(any_of(Charset.all() - "\n")), 0).add_token(text("\n"), 1)


def separated(by: str) -> TokenSet:
    """Runs without a separator 0 and the separator 1; without a separator runs of any bytes, which certify nothing."""
    out = TokenSet().add_token(plus(any_of(Charset.all() - by) if by else any_of(Charset.all())), 0, 2)
    return out.add_token(text(by), 1, 1) if by else out


def html() -> TokenSet:
    """Closing tags 0, comments and declarations 1, opening tags 2, text 3, a stray `<` 4."""
    inner = kleene(any_of(Charset.all() - ">"))
    out = TokenSet().add_token(concat(text("</"), inner, text(">")), 0, 1).add_token(concat(text("<!"), inner, text(">")), 1, 1)
    return out.add_token(concat(text("<"), inner, text(">")), 2, 2).add_token(plus(any_of(Charset.all() - "<")), 3, 2).add_token(text("<"), 4, 9)


def keyword_scale() -> TokenSet:
    """100 keywords, identifiers, numbers, white space, 28 operators, 11 punctuation marks: 143 patterns of six kinds."""
    out = TokenSet()
    # The operators.
    operators = "== != <= >= << >> && || ++ -- -> += -= *= /= + - * / % = < > ! ~ & | ^".split()
    for word in KEYWORDS:
        out.add_token(text(word), KEYWORD, 1)
    out.add_token(identifier(), IDENTIFIER, 2).add_token(decimal_float(), NUMBER, 1).add_token(decimal_integer(), NUMBER, 1).add_token(plus(any_of(" \t\n")), SPACE, 1)
    for op in operators:
        out.add_token(text(op), OPERATOR, 2)
    for mark in PUNCTUATIONS:
        out.add_token(text(mark), PUNCTUATION, 2)
    return out.set_ignored_tokens({SPACE})


def scaling() -> TokenSet:
    out = TokenSet().add_token(plus(any_of(" \t\n")), SPACE, 2).add_token(identifier(), IDENTIFIER, 2).add_token(decimal_integer(), NUMBER, 2)
    out.add_token(choice(*map(text, ("if", "else", "while", "return", "int"))), 10, 1)
    out.add_token(choice(*map(text, ("==", "!=", "<=", ">=", "+", "-", "*", "/", "=", "<", ">"))), OPERATOR, 2)
    return out.add_token(any_of("(){};,"), PUNCTUATION, 2).set_ignored_tokens({SPACE})


TABLE = {
    "base": lambda: c_like(),
    "base + strings": lambda: c_like(strings=True),
    "base + line comments": lambda: c_like(lines=True),
    "base + block comments": lambda: c_like(blocks=True),
    "JSON": json,
    "log lines": lines,
    "conventional": lambda: c_like(strings=True, lines=True),
    "split-friendly": lambda: c_like(strings=True, lines=True, newline=True),
    "split-friendly + block comments": lambda: c_like(strings=True, lines=True, blocks=True, newline=True),
    "keyword-scale": keyword_scale,
    "scaling": scaling,
}


@cache
def lexer(name: str):
    return (TABLE.get(name) or {"words": words, "html": html, "complete C": complete_c}[name])().compile()


def modal_code() -> ModalTokenSet:
    """Mode 0 code, 1 string, 2 comment (nested): identifiers 0, blanks 1, quote 2, string body 3, escape 4, comment marks 5 and 6, comment body 7, other 8."""
    out = ModalTokenSet().add_token(0, identifier(), 0, 2).add_token(0, plus(any_of(" \t\n")), 1, 2)
    out.add_token(0, text('"'), 2, 1, push(1)).add_token(0, text("/*"), 5, 1, push(2)).add_token(0, any_of(Charset.all()), 8, 9)
    out.add_token(1, plus(any_of(Charset.all() - '"' - "\\")), 3, 2).add_token(1, concat(text("\\"), any_of(Charset.all())), 4, 2).add_token(1, text('"'), 2, 1, pop())
    out.add_token(2, text("/*"), 5, 1, push(2)).add_token(2, text("*/"), 6, 1, pop())
    return out.add_token(2, plus(any_of(Charset.all() - "/" - "*")), 7, 2).add_token(2, any_of("/*"), 7, 3)
