"""Fixed words and patterns of the text operators, and the expressions made of them.

Patterns are kept to what both Java's and RE2's engines read alike; word characters are ASCII.
"""

from __future__ import annotations

import re

# Words left out of keywords, by operator.
TASK_STOPWORDS = (
    "the a an in on of to for and or is are fix bug issue incorrect behavior when that this with error failing please need update change make "
    "should not it be at by from was were does do its into than then but so if as can assert none true false def return self import class lambda "
    "raise const int double void auto std where declared scope line file most recent call last traceback"
).split()
ROUTING_STOPWORDS = "the a an in on of to for and or is are this that with when please need want use using help me my it be at by from you your i can would like some any".split()
FACT_STOPWORDS = (
    "a an the and or but of to for in on at by with from into onto as is are was were be been it its this that these those there here than then so if when "
    "always must should use using used do does please only just all any each you we they i your our via per e g eg ie"
).split()
FACT_NEGATIONS = "never not no avoid don't dont doesn't doesnt do-not mustn't mustnt shouldn't shouldnt can't cant cannot won't wont without forbid forbidden disallow".split()
NOTE_STOPWORDS = "the and for with that this from are was were has have not but all any can its into than then when you your".split()
CONSTRAINT_STOPWORDS = "the this that with when and for are is was you your it its from into than then".split()
CONSTRAINT_MARKERS = "never always not must only required forbidden prohibited".split()
CONTRACTIONS = {
    "don't": "do not",
    "doesn't": "does not",
    "can't": "can not",
    "cannot": "can not",
    "mustn't": "must not",
    "shouldn't": "should not",
    "shan't": "shall not",
    "won't": "will not",
    "isn't": "is not",
    "aren't": "are not",
}
NON_VERBS = (
    "this that these those it it's its there there's here here's we we're you you're you'll i i'm they he she our your their the a an some many most all each every any "
    "such one what which who why how where in as of for at by with since because while although though if when once so and but or also to on from after before unlike like "
    "despite basically generally essentially typically usually overall ultimately honestly hopefully obviously clearly great happy good nice perhaps maybe indeed again just "
    "now sometimes often however otherwise additionally furthermore moreover anyway welcome congratulations sure ideally"
).split()

# Patterns.
ANSI = "\\x1b\\[[0-?]*[ -/]*[@-~]|\\x1b\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)|\\x1b[@-Z\\\\-_]"
VOLATILE = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?|\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TS>"),
    (r"(?:/private)?/(?:tmp|var/folders|var/tmp)/\S*|[A-Za-z]:\\\S*?\\Temp\\\S*|\bpytest-of-[^/\s]+/pytest-\d+\S*", "<TMP>"),
    (r"0x[0-9a-fA-F]+", "0xN"),
    (r"(?i)\b(pid|tid)(\s*[=:#]?\s*)\d+", r"\1\2<PID>"),
    (r"\b([A-Za-z][\w.-]*)\[\d+\]:", r"\1[<PID>]:"),
    (r"\d{6,}", "<N>"),
    (r"\s+", " "),
]
FENCE = r"(?s)```.*?```"
INLINE_CODE = r"`[^`\n]*`"
HEADING_LINE = r"(?m)^\s*#{1,6}\s+.*$"
LIST_MARKER = r"(?m)^\s*(?:[-*]|\d+\.)\s+"
CONSTRAINT = r"(?i)\b(never|always|must not|must|do not|don't|required|critical(?:ly)?|cannot|shall not|prohibited|forbidden)\b([^-]|$)"
INSTRUCTION = r"(?i)\b(?:must|never|always|do\s+not|don['’]t|only|should|required|ensure|run|use|call|pass|set|avoid|prefer)\b"
PLEASANTRY = r"(?i)^(?:please\s+)?(?:feel\s+free\b|note\s+that\b|note,|keep\s+in\s+mind\b|remember\s+that\b|bear\s+in\s+mind\b|thanks?\b|hope\b|enjoy\b|good\s+luck\b)"
FILLER = "(?i)" + "|".join(
    [
        r"\bfeel free to\b",
        r"\bhope (?:this|that|it) helps\b",
        r"\bhappy \w+ing\b",
        r"^(?:thanks|thank you)\b",
        r"\bgood luck\b",
        r"\bgreat question\b",
        r"\bwe hope\b",
        r"\bas an ai\b",
        r"\b(?:please )?note that\b",
        r"\bit(?:'s| is) (?:important|worth|good) (?:to )?(?:note|noting|remember|mention)",
        r"\bkeep in mind\b",
        r"\bbear in mind\b",
        r"\byou (?:might|may|could) (?:want|wish|find|like)\b",
        r"\bit (?:can|may|might|could) be (?:useful|helpful|handy|a good idea)\b",
        r"^(?:basically|generally|essentially|honestly|obviously|of course)\b",
        r"\bat the end of the day\b",
        r"\bin order to\b",
        r"\bthis skill (?:is designed to|helps you|will|aims to|exists to)\b",
        r"^(?:this|that|it)(?:'s| is| was) (?:very |really |quite |especially )?(?:useful|helpful|important|handy|nice|convenient|valuable|beneficial)\b",
        r"^(?:this|that) (?:way|helps|makes|approach|means)\b",
        r"^the (?:reason|idea|goal|point) (?:for|behind|of|is)\b",
    ]
)


def trim(d, x: str) -> str:
    return d.sub(x, r"^\s+|\s+$", "")


def normalise(d, x: str) -> str:
    """A message without what changes from run to run; the steps' order matters."""
    out = trim(d, x)
    for p, r in VOLATILE:
        out = d.sub(out, p, r)
    return out


def strip_code(d, x: str) -> str:
    return d.sub(d.sub(x, FENCE, " "), INLINE_CODE, " ")


def strip_structure(d, x: str) -> str:
    return d.sub(d.sub(strip_code(d, x), HEADING_LINE, ""), LIST_MARKER, "")


def pieces(d, x: str) -> str:
    """Sentences of a text: a mark is put behind each end, then the text is split there."""
    marked = d.sub(x, r"([.!?])\s+", "\\1\x01")
    return d.filter(d.map(d.split(marked, "\x01"), "y", trim(d, "y")), "y", "y <> ''")


def sentences(d, x: str) -> str:
    return pieces(d, f"replace({strip_structure(d, x)}, {d.lit(chr(10)) if d.name == 'spark' else 'chr(10)'}, ' ')")


def tokens_half_even(d, x: str) -> str:
    """A quarter of the characters, half to even, at least 1."""
    n = f"length({x}) / 4.0D" if d.name == "spark" else f"length({x}) / 4.0"
    return d.big(f"greatest(1, {d.half_even(n)})")


def stem_a(d, x: str) -> str:
    case = " ".join(f"WHEN {x} LIKE '%{s}' AND length({x}) >= {len(s) + 3} THEN left({x}, length({x}) - {len(s)})" for s in ("ing", "ed", "es", "s", "e"))
    return f"(CASE {case} ELSE {x} END)"


def stem_b(d, x: str) -> str:
    case = " ".join(f"WHEN {x} LIKE '%{s}' AND length({x}) >= {n} AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - {len(s)})" for s, n in (("ing", 6), ("ed", 5), ("es", 5), ("s", 4)))
    cut = f"(CASE {case} ELSE {x} END)"
    return f"(CASE WHEN length({cut}) > 4 THEN {d.sub(cut, 'e+$', '')} ELSE {cut} END)"


def identifier_parts(d, x: str) -> str:
    """Lower-case parts of snake_case and CamelCase: capitals end where the next part begins."""
    cut = d.sub(d.sub(x, r"([A-Z]+)([A-Z][a-z0-9])", r"\1_\2"), r"([a-z0-9])([A-Z])", r"\1_\2")
    return d.map(d.filter(d.all(cut, r"[A-Za-z0-9]+"), "p", "p <> ''"), "p", "lower(p)")


def word_list(d, x: str) -> str:
    return d.all(x, r"[A-Za-z_][A-Za-z0-9_]*")


def keywords_a(d, x: str) -> str:
    w = word_list(d, x)
    every = d.concat(d.map(w, "w", "lower(w)"), d.flat(d.map(w, "w", identifier_parts(d, "w"))))
    kept = d.filter(every, "w", f"length(w) > 1 AND NOT {d.has(d.strings(TASK_STOPWORDS), 'w')}")
    return d.sorted(d.distinct(d.map(kept, "w", stem_a(d, "w"))))


def keywords_b(d, x: str) -> str:
    w = word_list(d, x)
    every = d.concat(d.map(w, "w", "lower(w)"), d.flat(d.map(w, "w", identifier_parts(d, "w"))))
    kept = d.filter(every, "w", f"length(w) > 1 AND NOT {d.has(d.strings(ROUTING_STOPWORDS), 'w')}")
    return d.sorted(d.distinct(d.map(kept, "w", stem_b(d, "w"))))


def name_words(d, x: str) -> str:
    kept = d.filter(identifier_parts(d, x), "w", f"length(w) > 1 AND NOT {d.has(d.strings(TASK_STOPWORDS), 'w')}")
    return d.sorted(d.distinct(d.map(kept, "w", stem_a(d, "w"))))


def fact_tokens(d, x: str) -> str:
    return d.all(f"replace(lower({x}), '’', {d.lit(chr(39))})", r"[a-z0-9]+(?:'[a-z]+)?")


def negated(d, x: str) -> str:
    return d.any(fact_tokens(d, x), "t", d.has(d.strings(FACT_NEGATIONS), "t"))


def content_words(d, x: str) -> str:
    kept = d.filter(fact_tokens(d, x), "t", f"length(t) > 1 AND NOT {d.has(d.strings(FACT_STOPWORDS + FACT_NEGATIONS), 't')}")
    fold = "CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"
    return d.sorted(d.distinct(d.map(kept, "t", fold)))


#: What a text has that :func:`negated` holds for, and some that it doesn't hold for: one quick look.
MAYBE_NEGATED = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(w.replace("'", "['’]") for w in FACT_NEGATIONS) + r")(?![A-Za-z])"
_FACT_TOKEN, _NO_CONTENT = re.compile(r"[a-z0-9]+(?:'[a-z]+)?"), frozenset(FACT_STOPWORDS + FACT_NEGATIONS)


class ContentWords(dict):
    """The words of :func:`content_words` in Python, as numbers from 0; by token, -1 for one that is no content word."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def __missing__(self, t: str) -> int:
        w = "" if len(t) < 2 or t in _NO_CONTENT else t[:-1] if len(t) > 3 and t[-1] == "s" and t[-2] != "s" else t
        self[t] = n = self.numbers.setdefault(w, len(self.numbers)) if w else -1
        return n

    def of(self, x: str) -> set[int]:
        """The numbers of a text's words."""
        out = set(map(self.__getitem__, _FACT_TOKEN.findall(x.lower().replace("’", "'"))))
        out.discard(-1)
        return out


def note_words(d, x: str, plural: bool = False) -> str:
    kept = d.filter(d.all(f"lower({x})", r"[a-z0-9_]{3,}"), "t", f"NOT {d.has(d.strings(NOTE_STOPWORDS), 't')}")
    if plural:
        kept = d.map(kept, "t", "CASE WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END")
    return d.sorted(d.distinct(kept))


def plain_words(d, x: str) -> str:
    return d.sorted(d.distinct(d.all(f"lower({x})", r"[a-z0-9]+")))


def jaccard(d, a: str, b: str) -> str:
    both = d.size(d.meet(a, b))
    return f"(CASE WHEN {d.size(a)} = 0 OR {d.size(b)} = 0 THEN 0.0 ELSE {both} * 1.0 / ({d.size(a)} + {d.size(b)} - {both}) END)"


def expand_contractions(d, x: str) -> str:
    out = f"lower({x})"
    for a, b in CONTRACTIONS.items():
        out = d.sub(out, rf"\b{a}\b", b)
    return out


def base_verb(d, x: str) -> str:
    """Whether a sentence opens with what reads as a base verb."""
    s = d.sub(trim(d, x), r"(?i)^(?:please|then|first|next|finally|now)[,\s]+", "")
    w = f"lower(replace({d.ext(s, '^[ ' + chr(34) + chr(39) + '(*_>]*([A-Za-z][A-Za-z' + chr(39) + '’]*)', 1)}, '’', {d.lit(chr(39))}))"
    return f"(NOT {d.match(s, PLEASANTRY)} AND {w} <> '' AND NOT {d.has(d.strings(NON_VERBS), w)} AND NOT {d.match(w, chr(39) + '|(ed|ing|ly)$')} AND NOT ({w} LIKE '%s' AND NOT {d.match(w, '(ss|us|is)$')}))"


def is_instruction(d, x: str) -> str:
    return f"({d.match(x, INSTRUCTION)} OR {base_verb(d, x)})"


def is_filler(d, x: str) -> str:
    return f"({trim(d, x)} <> '' AND NOT {is_instruction(d, trim(d, x))} AND {d.match(trim(d, x), FILLER)})"


# Places of systems and toolchains, and folders of what others wrote or a build makes.
SYSTEM_PATH = r"^/(?:usr|opt|Library|Applications|System|nix|sw|Developer|private/var)/|\.sdk/|\.xctoolchain/|/Xcode\.app/|/CommandLineTools/|/Toolchains/"
VENDOR_PARTS = ["vendor", "third_party", "third-party", "thirdparty", "build", "_deps", "site-packages", "dist-packages", ".venv", "venv", "node_modules"]


def user_path(d, p: str) -> str:
    """Whether a path is a user's own file: not of a system, a toolchain, a vendor or a build."""
    parts = d.split(p, "/")
    above = d.slice(parts, "1", d.size(parts) + " - 1") if d.name == "duck" else f"slice({parts}, 1, size({parts}) - 1)"
    return f"({p} <> '' AND {p} NOT LIKE '<%' AND NOT {d.match(p, SYSTEM_PATH)} AND NOT {d.any(above, 'y', d.has(d.strings(VENDOR_PARTS), 'y'))})"
