"""Rewriting of documents: removals, consolidation, front values, moved sections."""

from __future__ import annotations

import re


def loose(text: str) -> re.Pattern:
    """A pattern that finds a text whatever its white space."""
    return re.compile(r"\s+".join(map(re.escape, text.split())) or r"(?!)")


def remove(doc: str, sentence: str) -> tuple[str, bool]:
    """The document without the first place of a sentence, and whether it was there."""
    out, n = loose(sentence).subn("", doc, count=1)
    return (re.sub(r"[ \t]{2,}", " ", out), True) if n else (doc, False)


def consolidate(doc: str, members: list[str], keep: int, text: str) -> tuple[str, list[str]]:
    """One member rewritten, the others taken out; members that aren't found come back.

    Every member has its own place: the first that no member before it has, so equal members
    and a text that holds another member are told apart.
    """
    places: list[tuple[int, int, str]] = []
    missing = []
    for k, x in enumerate(members):
        free = (m for m in loose(x).finditer(doc) if all(m.end() <= a or b <= m.start() for a, b, _ in places))
        m = next(free, None)
        if m is None:
            missing.append(x)
        else:
            places.append((m.start(), m.end(), text if k == keep else ""))
    if members[keep] in missing:
        return doc, [members[keep]]
    for a, b, new in sorted(places, reverse=True):
        doc = doc[:a] + new + doc[b:]
    return re.sub(r"(?<=\S)[ \t]{2,}", " ", doc), missing


def front_value(doc: str, key: str, value: str) -> str:
    """The value of a key of the front block replaced, with the lines that continue it."""
    quoted = '"' + " ".join(value.split()).replace("\\", "\\\\").replace('"', '\\"') + '"'
    return re.sub(rf"(?m)^({re.escape(key)}):[^\n]*(?:\n[ \t]+[^\n]*)*", lambda m: f"{m[1]}: {quoted}", doc, count=1)


def without_repeats(doc: str, words: int = 6) -> tuple[str, int]:
    """The document with each sentence of ``words`` words or more once, the first place kept; and how many went."""
    seen, gone, out = set(), 0, []
    for line in doc.split("\n"):
        kept = []
        for s in re.split(r"(?<=[.!?])\s+", line):
            k = " ".join(re.findall(r"\w+", s.lower()))
            if len(k.split()) >= words and k in seen:
                gone += 1
                continue
            seen.add(k)
            kept.append(s)
        out.append(" ".join(kept))
    return "\n".join(out), gone


# What headings say a section is, the first that fits; those that move out, and the tokens that make it worth it.
CATEGORIES = {
    "examples": r"\bexamples?\b",
    "background": r"\b(?:background|motivation|why|rationale|history)\b",
    "external_reference": r"\b(?:references?|see also|further reading|links?)\b",
    "constraints": r"\b(?:constraints?|rules?|invariants?|guarantees?|safety|limitations?)\b",
    "workflow": r"\b(?:workflow|steps?|process|usage|how to|getting started)\b",
}
OTHERWISE = "mandatory_instructions"
MOVING, LEAST_MOVED = ("background", "examples"), 20


def category(heading: str | None) -> str:
    return next((c for c, p in CATEGORIES.items() if heading and re.search(p, heading, re.I)), OTHERWISE)


def sections(doc: str) -> tuple[str, list[tuple[str | None, str, str]]]:
    """The front block, and (heading, its marks, body) of the sections under headings of level 1 and 2 outside fences."""
    m = re.match(r"---\n[\s\S]*?\n---(?:\n|\Z)", doc)
    front = m.group().rstrip("\n") if m else ""
    out: list[tuple[str | None, str, list[str]]] = [(None, "", [])]
    fenced = False
    for line in doc[m.end() if m else 0 :].split("\n"):
        if re.match(r"\s*(?:```|~~~)", line):
            fenced = not fenced
        h = None if fenced else re.match(r"(#{1,2})[ \t]+(\S.*?)\s*$", line)
        if h:
            out.append((h[2], h[1], []))
        else:
            out[-1][2].append(line)
    return front, [(h, k, "\n".join(x).strip("\n")) for h, k, x in out if h or "".join(x).strip()]


def _rendered(heading: str | None, marks: str, body: str) -> str:
    return body if heading is None else f"{marks} {heading}\n\n{body}" if body else f"{marks} {heading}"


def move_sections(doc: str) -> tuple[str, dict[str, str], int, int]:
    """(the document with pointers, the texts moved by file name, tokens before, tokens after)."""
    front, parts = sections(doc)
    size = lambda x: max(1, round(len(x) / 4))
    moved: dict[str, str] = {}
    kept = [front] if front else []
    for heading, marks, body in parts:
        if heading and category(heading) in MOVING and size(body) >= LEAST_MOVED:
            slug = re.sub(r"[^a-z0-9]+", "-", heading.lower()).strip("-") or "section"
            name = next(n for k in range(1, len(moved) + 2) if (n := f"{slug}.md" if k == 1 else f"{slug}-{k}.md") not in moved)
            moved[name] = _rendered(heading, marks, body) + "\n"
            body = f"See `references/{name}`."
        if (text := _rendered(heading, marks, body)).strip():
            kept.append(text)
    out = "\n\n".join(kept) + "\n" if moved else doc
    return out, moved, size(doc), size(out)


def requests(level: str, repeats: int, filler: int) -> list[tuple[str, int]]:
    """What a rewriting at a level asks for, with how many things each request names."""
    every = [("description_shorten", 1), ("duplicate_consolidation", repeats), ("unnecessary_removal", filler)]
    return every[: {"slight": 1, "lot": 3}.get(level, 0)]
