"""Source text to tokens and back to one canonical layout, to see how far the original layout is from it.

The lexer knows what most languages share: comments, strings, numbers, words, brackets, signs. The canonical layout
has one statement a line: it breaks behind ``{`` and ``;``, before ``}``, where the original breaks outside of round
and square brackets, and at a comma once a line is ``WIDTH`` long; four blanks a level; one blank between words and
around signs, none inside brackets and before commas.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

WIDTH, INDENT = 100, 4
_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_HASH = r"\#[^\n]*"
_REST = r"""
    |(?P<string>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)
    |(?P<number>\d[\w.]*)
    |(?P<word>[^\W\d]\w*)
    |(?P<open>[\[({])|(?P<close>[\])}])
    |(?P<end>;)|(?P<comma>,)
    |(?P<line>\r\n|\r|\n)|(?P<blank>[^\S\r\n]+)
    |(?P<sign>[^\w\s\[\](){};,"'`]+?(?=[\w\s\[\](){};,"'`]|//|/\*|\Z)|.)
"""
_LEXERS = {kind: re.compile(f"(?P<comment>{c}){_REST}", re.X | re.S) for kind, c in (("c", _C), ("hash", _HASH), ("both", f"{_C}|{_HASH}"))}
_OF = {"python": "hash", "ruby": "hash", "shell": "hash", "elixir": "hash", "yaml": "hash", "php": "both"}
_CLOSES = {")": "(", "]": "[", "}": "{"}


def tokens(text: str, lang: str | None = None) -> list[tuple[str, str]]:
    """(kind, text) of each token; nothing is lost: the texts make up the source."""
    return [(m.lastgroup or "", m.group()) for m in _LEXERS[_OF.get(lang or "", "c")].finditer(text)]


def spaced(line: list[tuple[str, str]]) -> str:
    """One line of tokens with canonical blanks."""
    out: list[str] = []
    before = ""
    for kind, text in line:
        if out and _apart(before, kind, out[-1], text):
            out.append(" ")
        out.append(text)
        before = kind
    return "".join(out)


def _apart(a: str, b: str, left: str, right: str) -> bool:
    if b in ("comma", "end") or (b == "close" and right != "}") or (a == "open" and left != "{"):
        return False
    if b == "open" and right in "([":
        return a in ("comma", "sign") and left not in (".", "::", "->", "?.", "!", "@")
    if left in (".", "::", "->", "?.", "!", "@", "~") or right in (".", "::", "->", "?.", ":", "?", "!"):
        return False
    return True


_AROUND_SIGNS = re.compile(r"""\s*([^\w\s()\[\]{},;"'`]+)\s*|\s+(\()""")


def alike(own: str, line: list[tuple[str, str]]) -> bool:
    """Whether a line stands as it is re-emitted, blanks around signs and before round brackets aside, on which languages differ."""
    return _AROUND_SIGNS.sub(r"\1\2", own.strip()) == _AROUND_SIGNS.sub(r"\1\2", spaced(line))


def canonical(source: list[tuple[str, str]], newlines: bool = True) -> list[tuple[int, list[tuple[str, str]]]]:
    """(level, tokens) of each line of the canonical layout. ``newlines``: whether the original's breaks end statements."""
    lines: list[tuple[int, list[tuple[str, str]]]] = []
    line: list[tuple[str, str]] = []
    stack: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal line, size
        if line:
            lines.append((stack.count("{") - (line[0][1] == "{" and stack[-1:] == ["{"]), line))
        line, size = [], 0

    for kind, text in source:
        if kind == "blank":
            continue
        if kind == "line":
            if newlines and not any(b != "{" for b in stack):
                flush()
            continue
        if line and line[-1][1] == "}" and kind not in ("close", "comma", "end", "sign"):
            flush()
        if kind == "close":
            if text == "}":
                flush()
            if stack and stack[-1] == _CLOSES[text]:
                stack.pop()
        line.append((kind, text))
        size += len(text) + 1
        if kind == "open":
            if text == "{":
                flush()
            stack.append(text)
        elif kind == "end" and not any(b == "(" for b in stack) or kind == "comment" or kind == "comma" and size > WIDTH:
            flush()
    flush()
    return lines


@dataclass
class Layout:
    """How the original layout of a text compares with its canonical one."""

    chars: int = 0
    lines: int = 0
    canonical_lines: int = 0
    same_lines: int = 0
    shapes: int = 0
    literal_chars: int = 0
    code_chars: int = 0

    @property
    def expansion(self) -> float:
        """Canonical lines for each original one."""
        return self.canonical_lines / self.lines if self.lines else 0.0

    @property
    def uniformity(self) -> float:
        """The share of lines laid out as the canonical layout does, times the share of lines that repeat a pattern."""
        return self.same_lines / self.lines * (1 - self.shapes / self.lines) if self.lines else 0.0

    @property
    def literal_share(self) -> float:
        """The share of strings and numbers in what is not comment."""
        return self.literal_chars / self.code_chars if self.code_chars else 0.0


def layout(text: str, lang: str | None = None) -> Layout:
    """Lexes a text, re-emits it and compares, line by line."""
    source = tokens(text, lang)
    out = Layout(chars=len(text), canonical_lines=len(canonical(source, newlines=True)))
    shapes: set[tuple[str, ...]] = set()
    line: list[tuple[str, str]] = []

    def end() -> None:
        body = [t for t in line if t[0] != "blank"]
        if not body:
            return
        out.lines += 1
        shapes.add(tuple(k if k in ("string", "number", "word", "comment") else t for k, t in body))
        own = "".join(t for _, t in line)
        indent = len(own) - len(own.lstrip())
        out.same_lines += alike(own, body) and own == own.rstrip() and (own[:indent].strip("\t") == "" or indent % 2 == 0)

    for kind, t in source:
        if kind == "line":
            end()
            line = []
            continue
        if kind in ("string", "comment") and "\n" in t:
            out.lines += t.count("\n")
            out.same_lines += t.count("\n")
        line.append((kind, t))
        if kind not in ("blank", "comment"):
            out.code_chars += len(t)
            if kind in ("string", "number"):
                out.literal_chars += len(t)
    end()
    out.shapes = len(shapes)
    return out
