"""Small functions against fixed examples and properties."""

import ast

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairn.functions.checklists import checklist, draft
from cairn.functions.code_symbols import blank, cpp_symbols, python_symbols
from cairn.functions.formats import flat_yaml, json_items, line_range, list_id, manifest
from cairn.functions.rewrite import consolidate, front_value, remove, without_repeats
from cairn.functions.shell import decision, is_long, observations, routed, simple_commands, tool_observations


@pytest.mark.parametrize(
    "command, want",
    [
        ("cat a.py b.py", [("read", "/a.py"), ("read", "/b.py")]),
        ("cd src && grep -rn 'x y' lib | head -5", [("search", "x y path=/src/lib")]),
        ("X=1 rg -g '*.py' foo", [("search", "foo glob=*.py")]),
        ("git grep -e bar -- one two", [("search", "bar path=/one"), ("search", "bar path=/two")]),
        ("find a b -name '*.c' -type f", [("search", "*.c path=/a"), ("search", "*.c path=/b")]),
        ("ps | grep x", []),
        ("sed -i s/a/b/ f; sed -n 1p g 2>/dev/null > out", [("read", "/1p"), ("read", "/g")]),
        ("cat $(ls)", []),
        ("cat <<EOF\ncat z\nEOF", []),
        ("echo 'unclosed", []),
        (None, []),
        ("", []),
    ],
)
def test_shell(command, want):
    assert observations(command) == want


def test_shell_pipes_and_routing():
    assert simple_commands("a | b || c & d |& e") == [(["a"], False), (["b"], True), (["c"], False), (["d"], False), (["e"], True)]
    assert routed("cd x && pytest -q", "wrap", True) == "cd x && wrap run -- bash -c 'pytest -q'" and routed("make", "wrap") == "wrap run -- bash -c make"


@pytest.mark.parametrize(
    "command, want",
    [
        ("pytest -q tests", True), ("FOO=1 pytest", True), ("python3 -m pytest -x", True), ("cd a && make -j4 2>&1", True), ("/usr/bin/ctest", True), ("cmake --build out", True),
        ("cmake -S .", False), ("pytest | tail", False), ("pytest > log", False), ("pytest &", False), ("make -n", False), ("pytest --collect-only", False), ("pytest # raw", False),
        ("wrap pytest", False), ("echo $(pytest)", False), ("ls || npm test", True), ("./gradlew test", True), ("gradlew test", False), ("ls", False), ("", False), ("echo 'torn", False),
    ],
)
def test_long_commands(command, want):
    assert is_long(command, "wrap") is want


def test_routing_decisions():
    run = "wrap run -- bash -c 'pytest -q'"
    got = [decision("Bash", "pytest -q", False, m, "wrap") for m in ("redirect", "ask", "rewrite", "off")]
    assert got == [("deny", run), ("ask", run), ("allow", run), None]
    assert decision("Read", "pytest -q", False, "ask", "wrap") is None and decision("Bash", "pytest -q", True, "ask", "wrap") is None and decision("Bash", None, False, "ask", "wrap") is None


def test_tool_observations():
    assert tool_observations("Read", {"file_path": "a/b.py"}, "/srv") == [("read", "/srv/a/b.py")]
    assert tool_observations("Grep", {"pattern": "x", "path": "lib", "glob": "*.py"}) == [("search", "x path=/lib glob=*.py")]
    assert tool_observations("Glob", {"pattern": "**/*.c", "glob": "no"}) == [("search", "**/*.c")]
    assert tool_observations("Edit", {"file_path": "a"}) == [] and tool_observations("Grep", {"pattern": 5}) == [] and tool_observations(None, {}) == []
    assert tool_observations("Bash", {"command": "awk 1 x"}) == [("read", "/1"), ("read", "/x")] and observations("wc -l x") == []


def test_checklists():
    plain = "Please do these steps:\n1. Open it\n   and wait\n2. Close **it**\n\n3. Tell me"
    assert checklist(plain) == ("Please do these steps", "num", [("Open it and wait", False), ("Close it", False), ("Tell me", False)])
    assert checklist("- [ ] a\n- [x] b\n- [X] c")[2] == [("a", False), ("b", True), ("c", True)]
    assert checklist("Next steps:\n☐ a\n✔ b\n☐ c")[1:] == ("glyph", [("a", False), ("b", True), ("c", False)])
    assert checklist("You should:\nStep 1: a\nStep 2 - b\nStep 3) c")[1] == "step"
    assert checklist(plain + "\n\nYour turn:\n1) x\n2) y\n3) z")[0] == "Your turn"
    for none in ("1. a\n2. b\n3. c", "Please:\n1. a\n2. b", "Please:\n2. a\n3. b\n4. c", "Which do you want?\n1. a\n2. b\n3. c", "Update todos for you\n- [ ] a\n- [ ] b\n- [ ] c", "Do you:\n❯ 1. a\n2. b\n3. c", "Please:\n1. a\n\n\n2. b\n3. c", "", "Please:\n- a\n- b\n- c"):
        assert checklist(none) is None, none
    many = checklist("Please:\n" + "\n".join(f"- [ ] i{k}" for k in range(43)))
    assert [t for t, _ in many[2]] == ["i40", "i41", "i42"]


def test_drafts():
    assert draft("ab\x7fc\r") == ["ac"] and draft(["a", "\x1b[A", "b", "\r", "c", "\r"]) == [None, "c"] and draft("a\tb\x15z\r") == ["z"] and draft("x") == []


def test_formats():
    assert json_items('[1, 2] [3]{"a": 1} [torn') == [1, 2, 3, {"a": 1}]
    assert flat_yaml("a: 1\nb:\n  c: 'x'\n  d: -2 # no\ne: f") == {"a": 1, "b": {"c": "x", "d": -2}, "e": "f"}
    assert line_range("5") == (5, 5) and line_range("3:900") == (3, 402) and line_range("9:3") is None and line_range("x") is None
    assert manifest("package.json", "[]") == ([], []) and manifest("other", "") == ([], [])
    assert list_id([]) == "811c9dc5" and list_id(["a"]) == "e40c292c"


@given(st.text(max_size=40), st.text(max_size=40))
def test_list_ids_differ_by_content(a, b):
    assert (list_id([a]) == list_id([b])) or a != b


def test_rewrites():
    doc = "---\ndescription: old\n  more\n---\nKeep the\nfirst line. Never edit by hand. Tail."
    assert "Never edit" not in remove(doc, "Never  edit by\nhand.")[0] and remove(doc, "Absent.")[1] is False
    out, missing = consolidate("One rule. Two rule. Three.", ["One rule.", "Two rule.", "Gone."], 0, "Best rule.")
    assert "Best rule." in out and "Two" not in out and missing == ["Gone."]
    assert 'description: "new \\"x\\""\n---' in front_value(doc, "description", 'new "x"')
    assert without_repeats("The cache drops all open leases. x\nThe cache drops all open leases.") == ("The cache drops all open leases. x\n", 1)


def test_python_symbols():
    text = "import os\nfrom . import x\nclass A:\n    def f(self):\n        return g(1)\nasync def h():\n    def k(): pass\n"
    symbols, imports, bad = python_symbols(text)
    assert [(s[0], s[2], s[3], s[4]) for s in symbols] == [("A", "class", 3, 5), ("A.f", "method", 4, 5), ("h", "async_function", 6, 7), ("h.k", "function", 7, 7)]
    assert imports == [".", "os"] and not bad and python_symbols("def (") == ([], [], True)
    assert {s[1] for s in symbols} == {n.name for n in ast.walk(ast.parse(text)) if hasattr(n, "name") and hasattr(n, "lineno") and not isinstance(n, ast.alias)}


def test_cpp_symbols():
    text = 'namespace a {\n// struct no {\nstruct S {\n    int f(int x) { if (x) { return g("}"); } return 0; }\n};\nint h() {\n    return 1;\n}\n}\n'
    assert [(s[0], s[2], s[3], s[4]) for s in cpp_symbols(text)] == [("a", "namespace", 1, 9), ("a::S", "type", 3, 5), ("a::S::f", "method", 4, 4), ("a::h", "function", 6, 8)]
    assert len(blank(text)) == len(text) and blank(text).count("\n") == text.count("\n") and cpp_symbols("") == [] and cpp_symbols("}}{") == []


def test_digit_separators_open_no_literal():
    from cairn.functions.code_symbols import cpp_symbols

    text = "constexpr int A = 1'000; // don't\nint f() { return 0xFF'FF + 'a'; }\nint g() { return 2'5; }\n"
    assert [s[1] for s in cpp_symbols(text)] == ["f", "g"]
