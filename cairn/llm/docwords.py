"""Whether a documentation text says anything: marks, tags, placeholders, pointers and bare names don't."""

from __future__ import annotations

import re

# Rules of our own: comment marks around and at the start of lines.
_OPEN = re.compile(r"\A\s*/\*+!?|\*+/\s*\Z")
_LEAD = re.compile(r"(?m)^[ \t]*(?://+[/!<]*|\*(?![\w*])|\*(?=\w)|;+|#+)[ \t]?")
# Rules of our own: directives to tools, as the tools spell them.
_TOOL = re.compile(
    r"(?im)(?:^|(?<=\s))(?:type:\s*ignore(?:\[[\w,\s-]*\])?|noqa(?::\s*[\w,\s]+?)?(?=\s*$)|noqa\b|nolint(?:nextline|begin|end)?(?:\([\w\-.,* ]*\))?|pylint:\s*(?:disable|enable)(?:-next)?=[\w,\- ]+|"
    r"fmt:\s*(?:off|on|skip)|isort:\s*\w+|pragma:?\s*no\s*cover|clang-format\s+(?:off|on)|mypy:\s*[\w-]+|flake8:\s*noqa|ruff:\s*noqa|pyright:\s*\w+|yapf:\s*\w+|cppcheck-suppress\s+\w+|-\*-.*?-\*-|eslint-disable\S*|coding[:=]\s*[\w-]+)"
)
# Rules of our own: tags that take a name, and tags that don't.
_NAMED = re.compile(r"^(?::(?:param|parameter|arg|argument|key|keyword|raises?|raise|except|exception|var|ivar|cvar|type|vartype)\b[^:\n]*:|[@\\](?:param|tparam|arg|throws?|exception|raises?|retval)(?:\[[\w,]*\])?[ \t]*[\w.*&]*[ \t]*:?)", re.I)
_BARE = re.compile(r"^(?::(?:returns?|rtype|yields?|meta|see|todo)\b[^:\n]*:|[@\\](?:returns?|brief|details?|note|todo|deprecated|see|sa|since|author|version|internal|override|public|private|protected|static|file|class|fn|name|ingroup|addtogroup|defgroup|inheritdoc)\b:?)", re.I)
_INHERIT = re.compile(r"\{?[@\\]inherit_?doc\}?", re.I)
_GOOGLE = re.compile(r"(?i)^(?:args?|arguments|params?|parameters|returns?|yields?|raises|attributes|notes?|examples?|see also)\s*:?\s*$")
# Rules of our own: placeholders.
_HOLD = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip|hack|n/?a|none|null|undocumented|placeholder|pass|dummy|description|docstring|documentation|summary|no docs?|docs?)\W*"
    r"|(?:(?:todo|fixme|xxx|tbd)\b[\s:()\-\w]{0,3}?\s*)?(?:please\s+)?(?:add|write|insert|fill(?: in)?|missing|needs?|no|put|provide|document|update|complete)\b(?:\s+(?:a|an|the|some|this|your|me|proper|missing|in|here|it))*(?:\s+(?:description|descriptions|docstring|docstrings|doc|docs|documentation|summary|text|comment|comments|details|function|method|here|later|this))*(?:\s+(?:here|later|yet|available|provided|needed|required|given))?\W*"
    r"|(?:(?:todo|fixme|xxx|tbd)\b[\s:()\-]*)(?:docs?|document(?:ation)?|docstring|comment|describe|description|write|later)?\W*"
    r"|(?:description|docstring|documentation|summary|text|doc|docs)\s+(?:goes|to\s+(?:be|do)|comes|here|missing|pending|needed|tbd|todo)\b[\w\s]{0,20}\W*"
    r"|_+\w+_+\W*|lorem ipsum.*)$"
)
# Rules of our own: pointers to another place.
_POINT = re.compile(
    r"(?i)^\W*(?:(?:please\s+)?(?:see|cf\.?|refer(?:s)?\s+to|check|consult|look\s+at|read)\s+(?:also\s+)?(?:the\s+|its\s+|our\s+)?[\w.:/()#<>`~\-]+(?:\s+(?:class|method|function|above|below|docs?|documentation|base|parent|module|header|file|wiki|page|readme|for\s+(?:details|more|docs|documentation|information|info|usage)|instead|there|more|in\s+[\w.:/]+))*"
    r"|(?:same|as|like|identical)\s+(?:as|to|in|with)?\s*(?:the\s+)?[\w.:/()#`\-]+(?:\s+(?:class|method|function|above|below|parent))?|(?:as\s+)?(?:above|below)|ditto|idem"
    r"|inherit(?:ed|s)?(?:\s+(?:from|by|docs?|documentation)\b[\w\s.:]*)?|overrid(?:es?|den)(?:\s+(?:from\s+)?(?:the\s+)?[\w.:]+(?:\s+(?:class|method))?)?|https?://\S+)\W*$"
)
_FIRST = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def plain(doc: str) -> str:
    """The text without comment marks; lines are kept."""
    t = doc.replace("\r", "")
    if t.lstrip().startswith("/*"):
        t = _OPEN.sub("", t)
    if re.match(r"\s*(?:/[/*]|\*)", doc) or "\n" in t and re.search(r"(?m)^\s*(?://|\*)", t):
        t = _LEAD.sub("", t)
    return t.strip()


def _name_words(x: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", _CAMEL.sub(" ", x).lower()) if w]


_DROP = frozenset(("a", "an", "the", "function", "method", "async", "coroutine", "func", "this", "fn"))


def _only_name(text: str, names: list[list[str]]) -> bool:
    """Whether a text is one of the names, given as words, in some form."""
    first = _FIRST.search(text.lower())
    if first and first.group() not in _DROP and not any("".join(w).startswith(first.group()[:3]) for w in names):
        return False
    got = _name_words(text)
    kept = [w for w in got if w not in _DROP]
    for want in names:
        if got == want or "".join(got) == "".join(want):
            return True
        if kept == [w for w in want if w not in _DROP] and set(got) - set(want) <= _DROP:
            return True
    return False


def described(doc: str | None, name: str, qualname: str = "") -> bool:
    """Whether the documentation of a symbol describes it, all its lines counted."""
    if not doc:
        return False
    t = _INHERIT.sub(" ", _TOOL.sub(" ", plain(doc)))
    says = []
    for line in t.split("\n"):
        line = line.strip()
        while True:
            m = _NAMED.match(line) or _BARE.match(line)
            if not m:
                break
            line = line[m.end() :].strip(" \t-–:")
        if not re.search(r"\w", line) or _GOOGLE.match(line):
            continue
        says.append(line)
    if not says:
        return False
    whole = " ".join(says)
    spelt = {name, qualname, re.split(r"[.:]+", qualname)[-1]} if qualname else {name}
    names = [_name_words(n) for n in spelt if n]
    empty = lambda x: bool(_HOLD.match(x) or _POINT.match(x) or _only_name(x, names))
    if empty(whole):
        return False
    # Several sentences say something if one of them does.
    return not all(empty(s) for s in [*says] if s) or not all(empty(s) for s in re.split(r"(?<=[.!?])\s+", whole))
