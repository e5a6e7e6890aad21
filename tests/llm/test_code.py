"""Documented functions and pieces of oversized symbols, against plain reading of the source."""

import ast
import random

import pytest

from cairn.llm.code import documented, documented_pairs, rebuilt, split_symbols
from cairn.llm.codespans import cpp_spans
from cairn.llm.docwords import described
from cairn.llm.segment import BLOCK, estimate, valleys

SYM = "id string, path string, name string, qualname string, type string, start_line int, end_line int, doc string, tokens int, parent string"
FILE = "path string, language string, content string, doc string"

PY = '''"""Module."""
import os


@wraps(
    x
)
def plain(a, b={"(": [":"]}, *, c="):"):  # note: x
    # a comment before
    """Say what it does."""
    return a


def statement(a):
    x = 1
    """Not documentation."""
    return x


async def waits():
    \'\'\'
    :param x:
    :return:

    Wait for the next slot.
    \'\'\'


def oneline(): r"""Raw text on one line."""


class K:
    """A class."""

    def nested(self):
        def inner():
            """Inner one."""
            return "def fake(): "
        return inner

    def method(self) -> dict[str, int]:
        "Plain quotes."

    def f(self):
        f"""{self} isn't one."""

    def g(self):
        """text""".format(1)

    def h(
        self,
        x=(1, 2),
    ):

        # first

        """After blank lines and comments."""
'''

CPP = """// file header

/// Adds two.
int add(int a, int b) {
    return a + b; // trailing
}

// too far above

int far(int a) {
    return a;
}
int after(int x) { return x; } // not alone
int code_above() {
    return 1;
}
/* Block
 * over lines. */
int block() {
}
// one
// two
int lines() {
}
const char* s = "// no";
int str() {
}
"""


def py_symbols():
    out = []
    for n in ast.walk(ast.parse(PY)):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((f"m.py:{n.name}", "m.py", n.name, n.name, " Function ", n.lineno, n.end_lineno, None, None, None))
    return out


def cpp_symbols():
    return [(f"c.cpp:{x}", "c.cpp", x, x, "METHOD", k, k + 2, "", 0, "") for k, line in enumerate(CPP.split("\n"), 1) if (x := line.split("(")[0].removeprefix("int ")) and line.startswith("int ")]


def test_documented(spark):
    want = {f"m.py:{n.name}": d for n in ast.walk(ast.parse(PY)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and (d := ast.get_docstring(n))}
    rows = py_symbols() + cpp_symbols()
    rows += rows[:3] + [(None, "m.py", "x", "x", "function", 1, 2, None, None, None), ("q", None, "x", "x", "function", 1, 2, None, None, None), ("c", "m.py", "K", "K", "class", 30, 40, None, None, None), ("z", "gone.py", "x", "x", "function", 1, 2, None, None, None), ("n", "null.py", "x", "x", "function", 1, 2, None, None, None), ("o", "m.py", "x", "x", "function", None, 2, None, None, None), ("t", "m.py", "x", "x", None, 8, 9, None, None, None), ("end", "m.py", "x", "x", "function", 9999, 10000, None, None, None)]
    files = spark.createDataFrame([("m.py", "python", PY, "q"), ("m.py", "python", PY, "q"), ("c.cpp", "cpp", CPP, None), ("null.py", "python", None, None), ("empty.py", "python", "", None)], FILE)
    symbols = spark.createDataFrame(rows, SYM)
    got = {r.id: r.doc for r in documented(symbols, files).collect()}
    assert {k: v for k, v in got.items() if k.startswith("m.py")} == want
    assert {k.split(":")[1]: v for k, v in got.items() if k.startswith("c.cpp")} == {"add": "/// Adds two.", "block": "/* Block\n * over lines. */", "lines": "// one\n// two"}
    pairs = {r.id: r.code for r in documented_pairs(symbols, files).collect()}
    assert set(pairs) == set(got) and pairs["c.cpp:add"].startswith("int add")
    assert documented(symbols.limit(0), files).count() == 0 and documented(symbols, files.limit(0)).count() == 0


@pytest.mark.parametrize(
    "doc",
    ["", "  \n ", "...", "-----", "///", "/** * */", "TODO", "TODO: document", "FIXME: docs", "XXX", "tbd", "n/a", "Add description.", "Docstring goes here.", "(no description)", "Undocumented.", "See above.", "See base class.", "See other_function.", "Same as parent.", "Inherited.", "{@inheritDoc}", "noqa", "type: ignore", "pylint: disable=all", "fmt: off", "NOLINT", ":param x:\n:return:", "@param x\n:return:", "walk_grid", "walk_grid()", "Walk grid.", "Walk Grid", "The walk_grid function.", "walk grid method", "See above.\n:param x:", "// TODO\n// NOLINT", None],
)
def test_trivial(doc):
    assert not described(doc, "walk_grid", "Grid.walk_grid")


@pytest.mark.parametrize(
    "doc",
    ["Half-open range.", "Newest first.", "TODO: rename. Walk the rows.", ":return:\n\nWalk the rows.", "Walk grid. Newest first.", "See above. Blocks until drained.", ":param x: the rows to walk", "type: ignore\nWalk the rows.", "Walk grid cells.", "Widths are in cells.", "Devuelve el nombre más corto.", "n/a\nReplace the rows.", "/** * Runs after every flush. */", "x" * 100_000],
)
def test_not_trivial(doc):
    assert described(doc, "walk_grid", "Grid.walk_grid")


def test_raw_strings_hide_comments():
    assert list(cpp_spans('auto s = R"x(\n// no\n)x";\n')) == []


def check_pieces(rows, content, a, b, limit, overlap):
    lines = content.split("\n")
    upto = a - 1
    chars = {}
    for k, r in enumerate(rows):
        assert r.tokens <= limit and estimate(len(r.text)) == r.tokens
        full = "\n".join(lines[r.start_line - 1 : r.end_line])
        assert r.text in full
        whole = r.start_char == 0 and r.end_char == len(lines[r.end_line - 1])
        if whole:
            assert r.text == full
        if k and whole and upto < r.end_line and rows[k - 1].end_char == len(lines[upto - 1]) and all(len(x) < limit for x in lines[max(0, upto - overlap) : upto]):
            assert r.start_line == max(a, upto + 1 - overlap)
        assert r.start_line <= upto + 1
        chars.setdefault(r.end_line, 0)
        chars[r.end_line] = max(chars[r.end_line], r.end_char)
        upto = max(upto, r.end_line)
    assert upto == b and all(chars[n] == len(lines[n - 1]) for n in chars)


def test_pieces(spark):
    rnd = random.Random(2)
    lines = []
    for _ in range(900):
        lines.append(rnd.choice(["", "    " * rnd.randrange(4) + " ".join(rnd.choice(["alpha", "beta", "gamma", "delta_x"]) for _ in range(rnd.randrange(1, 9))), "}"]))
    lines[300] = "y" * 9000
    lines[301] = "z" * 3201
    content = "\n".join(lines)
    symbols = [("big", "f.py", "big", "big", "class", 1, 900, None, None, None), ("big", "f.py", "big", "big", "class", 1, 900, None, None, None), ("part", "f.py", "p", "p", "class", 290, 420, None, 900, None), ("small", "f.py", "s", "s", "class", 1, 3, None, -1, None), ("edge", "f.py", "s", "s", "class", 5, 6, None, 801, None), ("in", "f.py", "s", "s", "class", 5, 6, None, 800, None), ("lost", "gone", "s", "s", "class", 5, 6, None, 5000, None), ("unknown", "gone", "s", "s", "class", 5, 6, None, None, None), ("past", "f.py", "s", "s", "class", 5000, 6000, None, 900, None), ("open", "f.py", "s", "s", "class", None, None, None, 900, None)]
    df = spark.createDataFrame(symbols, SYM)
    files = spark.createDataFrame([("f.py", "python", content, None), ("f.py", "python", None, None)], FILE)
    rows = split_symbols(df, files).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    for v in by.values():
        v.sort(key=lambda r: r.piece)
    assert set(by) == {"big", "part", "edge", "lost", "past", "open"}
    check_pieces(by["big"], content, 1, 900, 800, 3)
    check_pieces(by["part"], content, 290, 420, 800, 3)
    assert {r.id: r.text for r in rebuilt(split_symbols(df, files)).collect() if r.id in ("big", "part")} == {"big": content, "part": "\n".join(lines[289:420])}
    assert len(by["edge"]) == 1 and by["lost"][0].start_line is None and by["past"][0].text is None
    free = [r for r in by["big"] if r.end_line < 900 and r.end_line not in (300, 301, 302)]  # elsewhere the long lines leave no choice
    natural = sum(not lines[r.end_line - 1].strip() or not lines[r.end_line].strip() or lines[r.end_line - 1] == "}" for r in free)
    assert len(free) >= 4 and natural == len(free)
    assert split_symbols(df.limit(0), files).count() == 0


def test_cohesion_counts_every_word():
    from collections import Counter

    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    lines = [" " * 20 + " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))) for _ in range(60)] + [" " * 20 + "Ab aB"]
    count = lambda x: Counter(" ".join(x).lower().split())

    def cosine(k):
        a, b = count(lines[max(0, k - BLOCK) : k]), count(lines[k : k + BLOCK])
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        return sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0

    sim = [cosine(k) for k in range(1, len(lines) + 1)]
    want = [max(sim[max(0, i - BLOCK) : i + 1]) + max(sim[i : i + BLOCK + 1]) - 2 * x for i, x in enumerate(sim)]
    assert valleys(lines)[0].tolist() == pytest.approx(want)
    for short in ([""], ["a"], ["a b", "a"], ["x"] * 20):
        assert len(valleys(short)[0]) == len(valleys(short)[1]) == len(short)


def test_cuts_lie_at_the_deepest_valley(spark):
    """Blocks of their own words between blank lines: the cut is where the words change, not at any blank line."""
    topic = lambda k: [f"    {a}{k} = load({b}{k}, {c}{k})" if j % 5 else "" for j, (a, b, c) in enumerate([("alpha", "beta", "gamma"), ("beta", "delta", "alpha"), ("gamma", "alpha", "delta")] * 9)]
    lines = [x for k in ("one", "two", "three", "four", "five", "six") for x in topic(k)]
    symbols = spark.createDataFrame([("big", "f.py", "big", "big", "class", 1, len(lines), None, None, None)], SYM)
    files = spark.createDataFrame([("f.py", "python", "\n".join(lines), None)], FILE)
    rows = split_symbols(symbols, files, limit=300).orderBy("piece").collect()
    chosen = [r for r in rows if r.deepest is not None]
    assert len(chosen) >= 4 and all(r.depth == r.deepest for r in chosen)
    assert all(abs(r.end_line % 27) <= 1 or r.end_line % 27 == 26 for r in chosen)
    flat = spark.createDataFrame([("f.py", "python", "\n".join(x or "    x = 1" for x in lines), None)], FILE)
    assert all(r.depth == r.deepest for r in split_symbols(symbols, flat, limit=300).collect() if r.deepest is not None)
    whole = rebuilt(split_symbols(symbols, files, limit=300)).first().text
    assert whole == "\n".join(lines)


def test_digit_separators_hide_no_comment():
    assert [(r[0], r[4]) for r in cpp_spans("int a = 1'000;\n// Width in cells.\nint f();\nint b = 2'000;\n")] == [("span", "// Width in cells.")]


def test_one_content_of_a_path_counts(spark):
    """Two contents of one path: code and documentation come from the same one."""
    a, b = 'def walk():\n    """Walk the rows once."""\n', '\n\ndef walk():\n    """Fold the cells twice."""\n    return 1\n'
    files = spark.createDataFrame([("f.py", "python", a, None), ("f.py", "python", b, None)], FILE)
    sym = spark.createDataFrame([("i", "f.py", "walk", "walk", "function", 1, 2, None, None, None), ("j", "f.py", "walk", "walk", "function", 3, 5, None, None, None)], SYM)
    rows = documented_pairs(sym, files).collect()
    assert [(r.id, r.doc, r.code) for r in rows] in ([("i", "Walk the rows once.", a.rstrip("\n"))], [("j", "Fold the cells twice.", b.strip("\n"))])
