"""Symbols of Python and C++ sources: name, kind, lines, parent and what they call."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

Symbol = tuple[str, str, str, int, int, str, list[str]]  # qualname, name, type, start, end, parent qualname, calls


def python_symbols(text: str) -> tuple[list[Symbol], list[str], bool]:
    """Classes and functions by the syntax tree, modules imported, and whether the text didn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], [], True
    out: list[Symbol] = []
    imports: list[str] = []
    todo = [(tree, "", False)]
    while todo:
        node, owner, in_class = todo.pop()
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.Import):
                imports += [a.name for a in x.names]
            elif isinstance(x, ast.ImportFrom):
                imports.append("." * x.level + (x.module or ""))
            if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "async_function" if isinstance(x, ast.AsyncFunctionDef) else "function"
                q = f"{owner}.{x.name}" if owner else x.name
                calls = {c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id for c in ast.walk(x) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Attribute, ast.Name))}
                out.append((q, x.name, kind, x.lineno, x.end_lineno or x.lineno, owner, sorted(calls)))
                todo.append((x, q, kind == "class"))
            else:
                todo.append((x, owner, in_class))
    return sorted(out, key=lambda s: (s[3], -s[4], s[0])), sorted(set(imports)), False


_MASK = re.compile(r"\b\d[\w.]*(?:'[\w.]+)+|//[^\n]*|/\*[\s\S]*?\*/|R\"(\w*)\([\s\S]*?\)\1\"|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'")
_HEAD = re.compile(r"(?:^|[;{}])\s*((?:template\s*<[^;{}]*>\s*)?(?:(namespace|class|struct|enum(?:\s+class)?|union)\s+([A-Za-z_]\w*)[^;{}()]*|[^;{}()=]*?([~A-Za-z_][\w:~]*)\s*\([^;{}]*\)[^;{}()]*))\{")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else", "new", "delete", "throw"}


def blank(text: str) -> str:
    """The text with literals, comments and numbers with digit separators as blanks of the same length; line ends stay."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def cpp_symbols(text: str) -> list[Symbol]:
    """Namespaces, types and functions by the braces of the blanked text."""
    code = blank(text)
    heads = {m.end() - 1: m for m in _heads(code)}
    lines = [m.start() for m in re.finditer("\n", code)]
    stack: list[tuple[str, str, str, int, int] | None] = []
    out: list[Symbol] = []

    def line(at: int) -> int:
        lo, hi = 0, len(lines)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if lines[mid] < at else (lo, mid)
        return lo + 1

    for m in re.finditer(r"[{}]", code):
        at = m.start()
        if m.group() == "{":
            h = heads.get(at)
            name = h and (h[3] or h[4])
            if not h or not name or name.split("::")[-1] in _WORDS:
                stack.append(None)
                continue
            owner = next((s[0] for s in reversed(stack) if s), "")
            inside = next((s[2] for s in reversed(stack) if s), "")
            kind = "namespace" if h[2] == "namespace" else "type" if h[2] else "method" if inside == "type" or "::" in name else "function"
            stack.append((f"{owner}::{name}" if owner else name, name, kind, line(h.start(1)), at))
        elif stack:
            s = stack.pop()
            if s:
                body = code[s[4] : at]
                calls = sorted({c for c in re.findall(r"([A-Za-z_]\w*)\s*\(", body) if c not in _WORDS}) if s[2] in ("function", "method") else []
                out.append((s[0], s[1].split("::")[-1], s[2], s[3], line(at), s[0].rpartition("::")[0], calls))
    return sorted(out, key=lambda s: (s[3], -s[4], s[0]))


def _heads(code: str) -> Iterator[re.Match]:
    at = 0
    while m := _HEAD.search(code, at):
        yield m
        at = m.end() - 1
