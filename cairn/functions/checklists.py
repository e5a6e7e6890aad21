"""Checklists that a text hands to its reader, and keystrokes folded to a line."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Item markers, what makes a list one for the reader, and its bounds.
MARKERS = {
    "num": re.compile(r"(\d{1,2})[.)]\s+(\S.*)\Z"),
    "step": re.compile(r"step\s+(\d{1,2})\s*[:.)\-–—]\s*(\S.*)\Z", re.I),
    "box": re.compile(r"(?:[-*+•]\s+)?\[([ xX])\]\s+(\S.*)\Z"),
    "glyph": re.compile(r"([☐□☑☒✓✔])\s*(\S.*)\Z"),
}
DONE = "xX☑☒✓✔"
FOR_READER = re.compile(r"\b(?:you|your|yourself|please|manual(?:ly)?|next steps?|action items?|checklist|steps? (?:to|for)|following steps|on your (?:end|side))\b", re.I)
NOT_FOR_READER = re.compile(r"^(?:update )?todos?\b|\?\s*$|^(?:>\s*)?(?:checklist results|re checklist)\b", re.I)
DECORATION = " \t⏺●⎿│┃"
CURSORS = "❯›"
LEAST, MOST = 3, 40


class _Line:
    """What one line is: how far in, its text, and the item it starts if it starts one."""

    def __init__(self, raw: str):
        raw = raw.rstrip()
        self.text = raw.lstrip(DECORATION)
        self.indent = len(raw) - len(self.text)
        self.menu = self.text[:1] in CURSORS and self.text[1:2].isspace() if self.text else False
        self.kind, self.mark, self.body = "", "", self.text
        for kind, p in MARKERS.items():
            if m := p.match(self.text):
                self.kind, self.mark, self.body = kind, m[1], m[2]
                break
        self.number = int(self.mark) if self.kind in ("num", "step") else None


def _tidy(s: str) -> str:
    return " ".join(re.sub(r"\*\*|__", "", s).split())


def _lists(lines: Iterable[_Line]) -> list[dict]:
    """Runs of like items: numbered ones count up from 1, deeper lines go on with the item above, two blank lines end a run."""
    out: list[dict] = []
    open_: dict | None = None
    blanks, above = 0, ""
    for x in lines:
        if not x.text:
            blanks += 1
            if blanks > 1:
                open_ = None
            continue
        blanks, intro, above = 0, above, x.text
        if open_ and x.indent > open_["indent"] + 1:
            open_["items"][-1][0] += " " + x.text
            open_["menu"] |= x.menu
            continue
        if not x.kind:
            open_ = None
            continue
        item = [x.body, x.mark in DONE and x.number is None]
        if open_ and open_["kind"] == x.kind and abs(x.indent - open_["indent"]) <= 1 and x.number in (None, len(open_["items"]) + 1) and len(open_["items"]) < MOST:
            open_["items"].append(item)
            open_["menu"] |= x.menu
        elif x.number in (None, 1):
            open_ = {"kind": x.kind, "indent": x.indent, "intro": intro, "items": [item], "menu": x.menu}
            out.append(open_)
        else:
            open_ = None
    return out


def checklist(text: str) -> tuple[str, str, list[tuple[str, bool]]] | None:
    """(title, kind, [(item, done)]) of the last list of a text that is meant for its reader, else None.

    Boxes count by themselves; other lists need the line above to speak to the reader. Menus
    and lists under a question or a heading of the writer's own list never count.
    """
    for run in reversed(_lists(map(_Line, text.split("\n")))):
        intro = _tidy(run["intro"])
        meant = bool(FOR_READER.search(intro))
        if run["menu"] or len(run["items"]) < LEAST or (intro and NOT_FOR_READER.search(intro)) or not (meant or run["kind"] == "box"):
            continue
        items = [(t, d) for t, d in ((_tidy(t), d) for t, d in run["items"]) if t]
        if len(items) >= LEAST:
            return (re.sub(r"[:：]\s*$", "", intro) if meant else "") or "Checklist", run["kind"], items
    return None


def draft(keys: Iterable[str]) -> list[str | None]:
    """The line at each Enter of a run of keystrokes, None where cursor keys, tabs or pastes came in between."""
    out: list[str | None] = []
    line: str | None = ""
    for k in keys:
        if k == "\r":
            out.append(line)
            line = ""
        elif k in ("\x15", "\x03"):
            line = ""
        elif line is not None:
            line = line[:-1] if k == "\x7f" else line + k if len(k) == 1 and (" " <= k <= "~" or k >= "\xa0") else None
    return out
