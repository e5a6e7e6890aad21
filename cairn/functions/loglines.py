"""Recognise the first line of a log record of many layouts.

A literal automaton (Aho-Corasick) finds the anchors of all layouts in one walk over a
line and so names the few parsers that may fit; an anchored expression then verifies the
line and extracts time, level, component and message.  A record has to start at the first
column (colour codes aside): indented or quoted records are text of another record.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

import ahocorasick

COLOUR = re.compile(r"\x1b(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])")

# Level names as programs write them, and the five names given out.
LEVELS = {
    "TRACE": "DEBUG", "DEBUG": "DEBUG", "DBG": "DEBUG", "D": "DEBUG",
    "INFO": "INFO", "NOTICE": "INFO", "I": "INFO",
    "WARN": "WARNING", "WARNING": "WARNING", "W": "WARNING",
    "ERROR": "ERROR", "ERR": "ERROR", "E": "ERROR",
    "FATAL": "FATAL", "CRITICAL": "FATAL", "CRIT": "FATAL", "F": "FATAL",
}
WORDS = [x for x in LEVELS if len(x) > 1]
MONTHS = {m: f"{i:02d}" for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}

_LV = "(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + ")"
_NAME = r"[A-Za-z_][\w./\-]*"
_CLOCK = r"\d\d:\d\d:\d\d"
_OFFSET = r"(?:Z|[+-]\d\d:?\d\d)"

# layout -> (anchors, anchored expression); the JSON layout is verified by the JSON parser.
LAYOUTS: dict[str, tuple[list[str], re.Pattern | None]] = {
    "json": (['{"'], None),
    "logfmt": (["level=", "lvl=", "severity="], re.compile(r'(?:[\w.]+=(?:"(?:[^"\\]|\\.)*"|[^\s"]*)(?:\s+|$))+\Z')),
    "dashed": (
        [f" - {w} - " for w in WORDS],
        re.compile(rf"(?P<t>\d{{4}}-\d\d-\d\d[ T]{_CLOCK}(?:[.,]\d+)?{_OFFSET}?) - (?P<c>{_NAME}) - (?P<l>{_LV}) - (?P<m>.*)\Z", re.S),
    ),
    "syslog": (
        [f"{m} " for m in MONTHS],
        re.compile(
            rf"(?P<mon>[A-Z][a-z]{{2}}) (?P<d>[ \d]\d) (?P<k>{_CLOCK}) [\w.\-]+ (?P<c>{_NAME})(?:\[\d+\])?: (?:(?P<l>(?i:{_LV})): )?(?P<m>.*)\Z",
            re.S,
        ),
    ),
    "lettered": (
        [f"{x}{y}" for x in "DIWEF" for y in "01"],
        re.compile(rf"(?P<l>[DIWEF])(?P<mon>\d\d)(?P<d>\d\d) (?P<k>{_CLOCK})(?:\.\d+)? +\d+ (?P<c>[\w./\-]+):\d+\] (?P<m>.*)\Z", re.S),
    ),
    "bracketed": (
        [f"{z}{w}" for z in ("Z ", "0 ", "5 ") for w in WORDS],
        re.compile(rf"(?P<t>\d{{4}}-\d\d-\d\d[T ]{_CLOCK}(?:[.,]\d+)?{_OFFSET}?) +(?P<l>{_LV}) +\[(?P<c>{_NAME})\] (?P<m>.*)\Z", re.S),
    ),
    "channel": (
        [f".{w}: " for w in WORDS],
        re.compile(rf"\[(?P<t>\d{{4}}-\d\d-\d\d[ T]{_CLOCK}(?:[.,]\d+)?{_OFFSET}?)\] (?P<c>{_NAME})\.(?P<l>{_LV}): (?P<m>.*)\Z", re.S),
    ),
    "threaded": (
        [f"] {w} " for w in WORDS],
        re.compile(rf"(?P<k>{_CLOCK})(?:[.,]\d+)? \[[^\]]*\] (?P<l>{_LV}) +(?P<c>{_NAME}) - (?P<m>.*)\Z", re.S),
    ),
    "levelfirst": (
        [f"{w} {y}" for w in WORDS for y in "12"],
        re.compile(
            rf"(?P<l>{_LV}) (?P<t>\d{{4}}[-/]\d\d[-/]\d\d {_CLOCK}(?:[.,]\d+)?{_OFFSET}?) (?P<c>{_NAME})(?:: | > )(?P<m>.*)\Z", re.S
        ),
    ),
    "piped": (
        [f"| {w}" for w in WORDS],
        re.compile(rf"(?P<dd>\d\d)\.(?P<mm>\d\d)\.(?P<yy>\d{{4}}) (?P<k>{_CLOCK})(?:[.,]\d+)? \| *(?P<l>{_LV}) *\| *(?P<c>{_NAME}) *\| (?P<m>.*)\Z", re.S),
    ),
    "quoted": (
        [f'] "{w}"' for w in WORDS],
        re.compile(rf'(?P<c>{_NAME}) \[(?P<dd>\d\d)/(?P<mon>[A-Z][a-z]{{2}})/(?P<yy>\d{{4}}):(?P<k>{_CLOCK}) (?P<z>[+-]\d{{4}})\] "(?P<l>{_LV})" (?P<m>.*)\Z', re.S),
    ),
    "epoch": (
        ["] ("],
        re.compile(rf"\[(?P<e>\d{{9,11}})(?:\.\d+)?\] \((?P<c>{_NAME})\) (?:(?P<l>(?i:{_LV})): )?(?P<m>.*)\Z", re.S),
    ),
    "coloned": ([f"{w}:" for w in WORDS], re.compile(rf"(?P<l>{_LV}):(?P<c>{_NAME}):(?P<m>.*)\Z", re.S)),
}
_ORDER = list(LAYOUTS)
_PAIR = re.compile(r'([\w.]+)=(?:"((?:[^"\\]|\\.)*)"|(\S*))')

# Names under which structured records state their parts, in order of preference.
TIME_KEYS = ("time", "ts", "timestamp", "@timestamp", "t", "datetime")
LEVEL_KEYS = ("level", "severity", "lvl", "levelname", "loglevel")
NAME_KEYS = ("logger", "component", "module", "name", "program", "file", "source")
TEXT_KEYS = ("message", "msg", "text", "event")


def register_layout(name: str, anchors: list[str], expression: str) -> None:
    """Adds a layout of one's own: plain words one of which its lines hold, and an anchored expression with the groups t (ISO time), l (level), c (component) and m (message).

    It is tried after the layouts there are, and reaches the workers with the next query only if
    it is registered where they import from: call it in a module that is shipped.
    """
    if name in LAYOUTS:
        raise ValueError(f"there is a layout {name}")
    LAYOUTS[name] = (anchors, re.compile(expression, re.S))
    _ORDER.append(name)


def automaton() -> ahocorasick.Automaton:
    """Anchor -> bit set of the layouts it belongs to."""
    masks: dict[str, int] = {}
    for i, name in enumerate(_ORDER):
        for a in LAYOUTS[name][0]:
            masks[a] = masks.get(a, 0) | 1 << i
    out = ahocorasick.Automaton()
    for a, m in masks.items():
        out.add_word(a, m)
    out.make_automaton()
    return out


def _utc(epoch: float) -> str:
    try:
        return (datetime(1970, 1, 1) + timedelta(seconds=int(epoch // 1))).strftime("%Y-%m-%d %H:%M:%S")
    except (OverflowError, ValueError):
        return ""


def _stamp(text: str) -> str:
    """``YYYY-MM-DD HH:MM:SS`` in UTC of an ISO-like time, '' if there is no such time."""
    head = text[:10].replace("/", "-") + " " + text[11:19]
    tail = text[19:].lstrip(".,0123456789")
    try:
        at = datetime.strptime(head, "%Y-%m-%d %H:%M:%S") if tail and tail != "Z" else None
    except ValueError:
        return ""
    if at is None:
        return head if _PLAIN.match(head) else ""
    z = _ZONE.match(tail)
    if not z:
        return ""
    shift = timedelta(hours=int(z[2]), minutes=int(z[3]))
    return (at - shift if z[1] == "+" else at + shift).strftime("%Y-%m-%d %H:%M:%S")


_PLAIN = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\Z")
_ZONE = re.compile(r"([+-])(\d\d):?(\d\d)\Z")


def _any_time(v: object) -> str:
    """A time given as text, as seconds or as milliseconds since 1970."""
    if isinstance(v, bool) or v is None:
        return ""
    if isinstance(v, str):
        v = v.strip()
        if not re.fullmatch(r"\d{9,13}(?:\.\d+)?", v):
            return _stamp(v)
        v = float(v)
    if isinstance(v, (int, float)):
        return _utc(v / 1000 if v >= 1e11 else v)
    return ""


def _fields(pairs: dict) -> tuple[str, str, str, str] | None:
    """A structured record's parts; None if it isn't one."""
    first = lambda keys: next((pairs[k] for k in keys if k in pairs), None)
    comp, level = first(NAME_KEYS), first(LEVEL_KEYS)
    if not isinstance(comp, str) or not comp:
        return None
    lv = LEVELS.get(str(level).strip().upper(), "") if isinstance(level, str) and len(str(level).strip()) > 1 else ""
    at = _any_time(first(TIME_KEYS))
    if not at and not lv:
        return None
    text = first(TEXT_KEYS)
    return at, lv, comp, text if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False)


def parse(line: str, machine: ahocorasick.Automaton) -> tuple[str, str, str, str] | None:
    """(time, level, component, message) of a line that starts a record, else None.

    A time lacking its year comes as ``????-MM-DD HH:MM:SS``, one lacking its date as
    ``????-??-?? HH:MM:SS``.
    """
    if not line or line[0] in " \t>|#":
        return None
    if "\x1b" in line:
        line = COLOUR.sub("", line)
        if not line or line[0] in " \t>|#":
            return None
    if line[-1] == "\r":
        line = line.rstrip("\r")
    mask = 0
    for _, m in machine.iter(line):
        mask |= m
    k = 0
    while mask:
        if mask & 1:
            name = _ORDER[k]
            got = _verify(name, line)
            if got:
                return got
        mask >>= 1
        k += 1
    return None


def _verify(name: str, line: str) -> tuple[str, str, str, str] | None:
    if name == "json":
        if line[0] != "{":
            return None
        try:
            o = json.loads(line)
        except ValueError:
            return None
        return _fields(o) if isinstance(o, dict) else None
    m = LAYOUTS[name][1].match(line)
    if not m:
        return None
    if name == "logfmt":
        return _fields({k: re.sub(r"\\(.)", r"\1", q) if q or not b else b for k, q, b in _PAIR.findall(line)})
    g = m.groupdict()
    level, comp, text = g.get("l") or "", g["c"], g["m"]
    level = LEVELS.get(level.upper(), "") if level else ""
    if "t" in g:
        at = _stamp(g["t"])
    elif "e" in g:
        at = _utc(int(g["e"]))
    elif "z" in g:
        at = _stamp(f"{g['yy']}-{MONTHS.get(g['mon'], '00')}-{g['dd']}T{g['k']}{g['z']}")
    elif "yy" in g:
        at = f"{g['yy']}-{g['mm']}-{g['dd']} {g['k']}"
    elif "mon" in g:
        mon = MONTHS.get(g["mon"], "") if name == "syslog" else g["mon"]
        if not mon:
            return None
        at = f"????-{mon}-{g['d'].replace(' ', '0')} {g['k']}"
    elif "k" in g:
        at = f"????-??-?? {g['k']}"
    else:
        at = ""
    return (at, level, comp, text) if at or level else None
