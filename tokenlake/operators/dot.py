"""Automata in the DOT language."""

from __future__ import annotations

from pathlib import Path

from .automaton import Dfa, Nfa


def label(symbols: list[int | None]) -> str:
    """Symbols of one edge; None is the empty word."""
    # How quotes, backslashes, line ends and tabs are escaped.
    escapes = {34: '\\"', 92: "\\\\", 10: "\\\\n", 9: "\\\\t"}
    return " ".join("ε" if s is None else escapes.get(s) or (chr(s) if 0x20 <= s < 0x7F else f"\\\\x{s:02X}") for s in symbols)


def _render(states: int, start: int, accepts: dict[int, str], rows) -> str:
    edges: dict[tuple[int, int], list] = {}
    for s, b, t in rows:
        edges.setdefault((s, t), []).append(b)
    out = ["digraph {", "  rankdir=LR;", "  entry [shape=point];", f"  entry -> {start};"]
    out += [f'  {s} [shape={"doublecircle" if s in accepts else "circle"}, label="{s}{f" / {accepts[s]}" if s in accepts else ""}"];' for s in range(states)]
    out += [f'  {s} -> {t} [label="{label(sorted(b, key=lambda x: -1 if x is None else x))}"];' for (s, t), b in sorted(edges.items())]
    return "\n".join([*out, "}"]) + "\n"


def to_dot(automaton: Nfa | Dfa, names: dict[int, str] | None = None) -> str:
    names = names or {}
    if isinstance(automaton, Nfa):
        accepts = {s: names.get(t, str(t)) + f" ({p})" for s, (p, t) in automaton.accepts.items()}
        return _render(automaton.states, automaton.start, accepts, automaton.rows())
    accepts = {s: names.get(int(t), str(t)) for s, t in enumerate(automaton.accept) if t >= 0}
    return _render(automaton.states, 0, accepts, automaton.rows())


def to_file(automaton: Nfa | Dfa, path: str, names: dict[int, str] | None = None) -> None:
    """Writes the graph, and makes the folders above it."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(to_dot(automaton, names), encoding="utf-8")
