"""Lexical cohesion of source lines, and pieces that end where it is lowest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Lines of the blocks compared on either side of a gap.
BLOCK = 8
#: A piece is filled to at least this share of the limit before it may end.
FILL = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def estimate(chars: int) -> int:
    """A quarter of the characters, rounded half to even, at least 1."""
    return max(1, round(chars / 4))


def _cosines(words: list[list[int]], n_words: int) -> np.ndarray:
    """Cosine of the word counts of the blocks before and after each line's end.

    Each distinct word has a count of its own. From a gap to the next only the words of three
    lines change sides, and the sums of products are kept up by these: time goes with the words
    of the file, whatever its vocabulary.
    """
    n = len(words)
    left, right = [0] * n_words, [0] * n_words
    dot = ll = rr = 0
    for x in words[:BLOCK]:
        for w in x:
            rr += 2 * right[w] + 1
            right[w] += 1
    out = np.zeros(n)
    for i in range(n):
        for w in words[i]:  # this line goes from the right to the left
            a, b = left[w], right[w]
            dot += b - a - 1
            ll += 2 * a + 1
            rr -= 2 * b - 1
            left[w], right[w] = a + 1, b - 1
        if i >= BLOCK:
            for w in words[i - BLOCK]:
                dot -= right[w]
                ll -= 2 * left[w] - 1
                left[w] -= 1
        if i + BLOCK < n:
            for w in words[i + BLOCK]:
                dot += left[w]
                rr += 2 * right[w] + 1
                right[w] += 1
        if ll and rr:
            out[i] = dot / (ll * rr) ** 0.5
    return out


def valleys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How deep the valley of cohesion is after each line, and whether the code has a natural boundary there.

    The words of the two blocks around a gap are compared by cosine; the depth is how far
    the similarity lies below the nearest peaks on both sides.  Blank lines and lone closing
    brackets are natural boundaries, as paragraphs are for prose.
    """
    n = len(lines)
    seen: dict[str, int] = {}
    words = [[seen.setdefault(w.lower(), len(seen)) for w in _WORD.findall(x)] for x in lines]
    sim = _cosines(words, len(seen))
    peak = np.copy(sim)
    for k in range(1, BLOCK + 1):  # the highest similarity within a block on each side
        peak[k:] = np.maximum(peak[k:], sim[:-k])
    after = np.copy(sim)
    for k in range(1, BLOCK + 1):
        after[:-k] = np.maximum(after[:-k], sim[k:])
    depth = (peak - sim) + (after - sim)
    blank = np.array([not x.strip() for x in lines], bool)
    closing = np.array([x.strip() in ("}", "};", "})", ")", "]") for x in lines], bool)
    return depth, blank | np.append(blank[1:], True) | closing


def pieces(content: str | None, items: list[tuple[str, int | None, int | None, int | None]], limit: int, overlap: int, text: bool) -> Iterator[tuple]:
    """(id, piece, start_line, end_line, start_char, end_char, tokens, text, depth, deepest) of the items of one file over the limit."""
    if content is None:
        for i, _, _, size in items:
            if size is not None and size > limit:
                yield i, 0, None, None, None, None, size, None, None, None
        return
    lines = content.split("\n")
    total = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    found = None
    for i, a, b, size in items:
        a, b = max(1, a or 1), min(len(lines), b or a or 1)
        if size is None:
            if a > b:
                continue
            size = estimate(int(total[b] - total[a - 1]) - 1)
        if size <= limit:
            continue
        if a > b:
            yield i, 0, None, None, None, None, size, None, None, None
            continue
        if found is None:
            found = valleys(lines)
        yield from ((i, *p) for p in _split(lines, total, *found, a, b, limit, overlap, text))


def _split(lines: list[str], total: np.ndarray, depth: np.ndarray, natural: np.ndarray, a: int, b: int, limit: int, overlap: int, text: bool) -> Iterator[tuple]:
    most = 4 * limit + 2  # characters that still round to the limit
    while estimate(most) > limit:
        most -= 1
    size = lambda x, y: int(total[y] - total[x - 1]) - 1
    k, begin, new = 0, a, a  # the piece starts at begin; new is its first line not in the one before
    while new <= b:
        while begin < new and size(begin, new) > most:
            begin += 1
        if size(new, new) > most:  # a line too long by itself is cut inside; its first part keeps the overlap if there is room
            line, at = lines[new - 1], 0
            while begin < new and size(begin, new - 1) + 2 > most // 2:
                begin += 1
            while at < len(line):
                room = most - (size(begin, new - 1) + 1 if begin < new else 0)
                upto = min(len(line), at + room)
                part = "\n".join([*lines[begin - 1 : new - 1], line[at:upto]])
                yield k, begin, new, at if begin == new else 0, upto, estimate(len(part)), part if text else None, None, None
                k, at, begin = k + 1, upto, new
            new += 1
            begin = new
            continue
        # the last line that still fits
        end = int(np.searchsorted(total, total[begin - 1] + most + 1, "right")) - 1
        end = min(end, b)
        here = deepest = None
        if end < b:
            low = int(np.searchsorted(total, total[begin - 1] + int(most * FILL), "left"))
            low = min(max(low, new), end)
            gaps = np.arange(low - 1, end)  # boundaries lie at natural gaps; where the window has none, any line will do
            own = gaps[natural[low - 1 : end]]
            gaps = own if len(own) else gaps
            deepest = float(depth[gaps].max())
            end = int(gaps[depth[gaps] == deepest][-1]) + 1
            here = float(depth[end - 1])
        n = size(begin, end)
        yield k, begin, end, 0, len(lines[end - 1]), estimate(n), "\n".join(lines[begin - 1 : end]) if text else None, here, deepest
        k += 1
        new = end + 1
        begin = max(a, new - overlap)
