"""Spans of comments, docstrings and function heads in source text."""

from __future__ import annotations

import inspect
import re
from bisect import bisect_right
from collections.abc import Iterator

_PY = re.compile(
    r"#[^\n]*|[rRuUbBfF]{0,2}(?:\"\"\"[^\"\\]*(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*')"
)
_CPP = re.compile(r"\b\d[\w.]*(?:'[\w.]+)+|//[^\n]*|/\*[\s\S]*?\*/|R\"(\w*)\([\s\S]*?\)\1\"|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'")
_HEAD = re.compile(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*")
_SIMPLE = re.compile(r"\([^()\[\]{}\"'#\n]*\)[ \t]*(?:->[ \t]*[\w.]+[ \t]*)?:")
_PAIRED = re.compile(r"[()\[\]{}:]")

#: kind, anchor line of a head (0 for a span), position, position the span has to follow at once, text
Row = tuple[str, int, int, int, str]


def python_spans(text: str) -> Iterator[Row]:
    """Heads of functions (where each ends) and the strings that are statements by themselves."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    tokens = [(m.start(), m.end()) for m in _PY.finditer(text)]
    starts = [a for a, _ in tokens]

    def inside(at: int) -> tuple[int, int] | None:
        k = bisect_right(starts, at) - 1
        return tokens[k] if k >= 0 and at < tokens[k][1] else None

    for m in _HEAD.finditer(text):
        if inside(m.start() + len(m.group()) - len(m.group().lstrip())):
            continue
        simple = _SIMPLE.match(text, m.end())
        end = simple.end() - 1 if simple else None
        if end is None:
            depth = 0
            for x in _PAIRED.finditer(text, m.end()):
                if inside(x.start()):
                    continue
                c = x.group()
                if c == ":" and not depth:
                    end = x.start()
                    break
                depth += (c in "([{") - (c in ")]}")
        if end is not None:
            first = m.start() + len(m.group()) - len(m.group().lstrip())
            yield "head", bisect_right(breaks, first - 1) + 1, end, 0, ""
    for k, (a, b) in enumerate(tokens):
        if text[a] == "#" or text[a] in "bBfF" or text[a + 1 : a + 2] in ("b", "B", "f", "F"):
            continue
        rest = re.compile(r"[ \t]*(?:[;#\n]|\r|\Z)").match(text, b)
        if not rest:
            continue
        j, at = k, a
        while True:  # back over blanks and comments to the last character of code
            low = tokens[j - 1][1] if j else 0
            before = text[low:at].rstrip(" \t\r\n\f\\")
            if before:
                prev = low + len(before) - 1
                break
            if not j or text[tokens[j - 1][0]] != "#":
                prev = -1
                break
            j -= 1
            at = tokens[j][0]
        if prev >= 0 and text[prev] == ":":
            body = re.sub(r"^[rRuU]*(\"\"\"|'''|\"|')([\s\S]*)\1$", r"\2", text[a:b])
            yield "span", 0, a, prev, inspect.cleandoc(body)


def cpp_spans(text: str) -> Iterator[Row]:
    """Comments alone on their lines; runs of line comments are one. Positions are line numbers."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    run: list[str] = []
    last = -1
    for m in _CPP.finditer(text):
        a, b = m.span()
        if text[a] != "/":
            continue
        line = bisect_right(breaks, a - 1)
        begin = breaks[line - 1] + 1 if line else 0
        stop = text.find("\n", b)
        if text[begin:a].strip() or text[b : stop if stop >= 0 else len(text)].strip():
            continue
        if text[a + 1] == "/":
            if run and line == last + 1:
                run.append(m.group())
            else:
                if run:
                    yield "span", 0, last + 1, last + 2, "\n".join(run)
                run = [m.group()]
            last = line
        else:
            end = line + m.group().count("\n")
            yield "span", 0, end + 1, end + 2, m.group()
    if run:
        yield "span", 0, last + 1, last + 2, "\n".join(run)


def is_python(path: str, language: str | None) -> bool:
    return (language or "").strip().lower() == "python" or path.endswith((".py", ".pyi"))
