"""Small formats: manifests, concatenated JSON, flat YAML, list ids, line ranges."""

from __future__ import annotations

import json
import re
import tomllib


def _names(items: object) -> list[str]:
    return [m[0] for x in items or () if isinstance(x, str) and (m := re.match(r"[A-Za-z0-9][\w.\-]*", x.strip()))]


def _tables(o: dict, *paths: str) -> list[str]:
    """Keys of the tables at dotted paths."""
    out: list[str] = []
    for p in paths:
        at: object = o
        for k in p.split("."):
            at = at.get(k, {}) if isinstance(at, dict) else {}
        out += list(at) if isinstance(at, dict) else []
    return out


def _python(text: str) -> tuple[list[object], list[str]]:
    o = tomllib.loads(text)
    project = o.get("project", {})
    extras = [d for x in (project.get("optional-dependencies") or {}).values() for d in _names(x)]
    old = [d for d in _tables(o, "tool.poetry.dependencies") if d.lower() != "python"]
    return [project.get("name") or o.get("tool", {}).get("poetry", {}).get("name")], _names(project.get("dependencies")) + old + extras


def _script(text: str) -> tuple[list[object], list[str]]:
    o = json.loads(text)
    return [o.get("name")], _tables(o, "dependencies", "peerDependencies", "devDependencies")


def _crate(text: str) -> tuple[list[object], list[str]]:
    o = tomllib.loads(text)
    return [o.get("package", {}).get("name")], _tables(o, "dependencies")


def _module(text: str) -> tuple[list[object], list[str]]:
    return re.findall(r"(?m)^module\s+(\S+)", text)[:1], re.findall(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-/]+)\s+v[\w.\-+]+", text)


#: How each manifest is read.
MANIFESTS = {
    "pyproject.toml": _python,
    "package.json": _script,
    "Cargo.toml": _crate,
    "go.mod": _module,
    "requirements.txt": lambda text: ([], _names(x for x in text.splitlines() if x[:1] not in ("-", "#"))),
}


def manifest(name: str, text: str) -> tuple[list[str], list[str]]:
    """(packages provided, packages needed) that a manifest states; none of one that doesn't read."""
    try:
        provides, needs = MANIFESTS[name](text)
    except (KeyError, ValueError, AttributeError, TypeError):
        return [], []
    return [p for p in provides if isinstance(p, str) and p], sorted(set(needs))


def json_items(text: str) -> list:
    """The items of JSON arrays written one after another, up to the first that doesn't read."""
    out, at, read = [], 0, json.JSONDecoder()
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if at >= len(text):
            return out
        try:
            v, at = read.raw_decode(text, at)
        except ValueError:
            return out
        out += v if isinstance(v, list) else [v]


def flat_yaml(text: str) -> dict:
    """Keys and values with one level of nesting by indent."""
    out: dict = {}
    inner: dict | None = None
    for line in text.splitlines():
        m = re.match(r"(\s*)([\w.-]+):\s*(.*?)\s*(?:#.*)?$", line)
        if not m:
            continue
        value = m[3].strip("\"'")
        v: object = int(value) if re.fullmatch(r"-?\d+", value) else value
        if m[1] and inner is not None:
            inner[m[2]] = v
        elif value == "":
            inner = out[m[2]] = {}
        else:
            out[m[2]], inner = v, None
    return out


def list_id(items: list[str]) -> str:
    """FNV-1a over the items, 32 bits in hex: the same list has the same id."""
    x = 0x811C9DC5
    for c in "\n".join(items):
        x = ((x ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    return f"{x:08x}"


def line_range(spec: str, most: int = 400) -> tuple[int, int] | None:
    """First and last line of N, A:B or all, at most ``most`` lines."""
    if spec == "all":
        return 1, most
    m = re.fullmatch(r"(\d+)(?::(\d+))?", spec)
    if not m:
        return None
    a, b = int(m[1]), int(m[2] or m[1])
    return (a, min(b, a + most - 1)) if 1 <= a <= b else None
