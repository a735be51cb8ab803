"""A pull cursor over one text, flat or modal: what a DataFrame of tokens is for a table of texts."""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import CertifiedStart, Lexer
from .modes import ModalLexer, Stack

TOKEN, END, ERROR = "TOKEN", "END", "ERROR"
# What errors say.
UNKNOWN, EMPTY = "Unrecognized character", "Zero-width match"


@dataclass(frozen=True)
class Result:
    """status TOKEN with kind and lexeme, END, or ERROR with message and position."""

    status: str
    kind: int | None = None
    lexeme: bytes | None = None
    message: str | None = None
    position: int | None = None


class Tokenizer:
    """An error leaves the cursor where it is; `recover` and its kin move it, or say that they can't."""

    def __init__(self, lexer: Lexer | list[Lexer] | ModalLexer, data: bytes | str = b""):
        self.modal = lexer if isinstance(lexer, ModalLexer) else None
        self.lexers = lexer.lexers if self.modal else [lexer] if isinstance(lexer, Lexer) else list(lexer)
        self.mode_set = 0
        self.load(data)

    def load(self, data: bytes | str) -> None:
        """A new text.  Modes that tokens move begin anew; a mode that the caller has set stays."""
        self.input = data.encode() if isinstance(data, str) else bytes(data)
        self.reset()

    def reset(self) -> None:
        self.offset, self.stack = 0, Stack()

    def seek(self, offset: int) -> None:
        self.offset = min(offset, len(self.input))

    @property
    def mode(self) -> int:
        return self.stack.current if self.modal else self.mode_set

    @property
    def depth(self) -> int:
        return len(self.stack.saved)

    def set_mode(self, mode: int) -> None:
        if self.modal:
            raise ValueError("tokens move the modes of this tokenizer")
        if not 0 <= mode < len(self.lexers):
            raise ValueError(f"there is no mode {mode}")
        self.mode_set = mode

    def next(self) -> Result:
        if self.offset >= len(self.input):
            return Result(END)
        if self.modal:
            kind, n = self.modal.match(self.input, self.stack, self.offset)
        else:
            kind, n = self.lexers[self.mode].match(self.input, self.offset)
        if kind is None or not n:
            what = UNKNOWN if kind is None else EMPTY
            return Result(ERROR, message=f"{what} at position {self.offset}", position=self.offset)
        self.offset += n
        return Result(TOKEN, kind, self.input[self.offset - n : self.offset])

    def __iter__(self):
        while (r := self.next()).status == TOKEN:
            yield r
        if r.status == ERROR:
            yield r

    def _move(self, since: int) -> CertifiedStart | None:
        found = self.lexers[self.mode].next_certified_evidence(self.input, since)
        if found is not None:
            self.offset = found.start
        return found

    def recover(self) -> int | None:
        """Moves to the next certified start after the failure; the bytes skipped, or None without having moved."""
        before = self.offset
        return None if self._move(self.offset + 1) is None else self.offset - before

    def recover_from_failure(self) -> CertifiedStart | None:
        """The same, with its evidence."""
        return self._move(self.offset + 1)

    def recover_from_clean(self, clean: int) -> CertifiedStart | None:
        """The same, with evidence at or after an offset from which the input is known to be sound."""
        return self._move(max(clean, self.offset + 1))
