"""Greedy string tiling of token sequences, and the passages its tiles make up."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Tokens of the shortest tile.
MIN_TILE = 3
#: Words that a leaked passage has at least.
PASSAGE_WORDS = 15
#: Unmatched document tokens that end a passage.
GAP = 12
#: Share of words of a passage that may be changed, added or left out.
EDITS = 1 / 6
#: Share of the weight of the stretch of the item that a passage covers which its matched tokens have at least.
WEIGHT_SHARE = 0.65
#: Seeds of one passage lie so far apart at least: it has 13 words that match, each a word of the text or an edit.
SPAN = math.ceil((1 - EDITS / (1 - EDITS)) * math.ceil(PASSAGE_WORDS * (1 - EDITS)) - 0.5 / (1 - EDITS)) - MIN_TILE
#: Pairs of a seed in a text and an item that are listed at a time.
PAIRS = 4_000_000
#: Share of an item's words from which on a beginning or end that another item has too makes them variants.
VARIANT = 0.5

_MARK = re.compile(r"(?m)^[ \t]*(?:[-*+>#|•]+[ \t]*|\(?\d{1,4}[.):|]+(?=\s)[ \t]*)+")
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")


def words(text: str) -> list[str]:
    """Lower-case words without punctuation, markup and the marks at line starts."""
    text = _TAG.sub(" ", _MARK.sub(" ", text)) if "\n" in text or "<" in text or text[:1] in "-*+>#|• " else text
    out = _WORD.findall(text.lower())
    return [w.strip("_") or w for w in out] if "_" in text else out


def sentences(text: str) -> list[tuple[str, ...]]:
    """The words of each sentence that has any."""
    return [w for s in _SENTENCE.split(text) if (w := tuple(words(s)))]


def edges(text: str) -> list[tuple[str, str]]:
    """(beginning or end of whole sentences, the sentence next to it) of an item, shorter than a passage or than half of the item.

    Two items that have the beginning in common and go on differently make it a standing
    instruction; where they have most of their words in common, one is a variant of the other.
    """
    ss = sentences(text)
    most, out = max(VARIANT * sum(map(len, ss)), PASSAGE_WORDS - 1), []
    for side, seq in (("<", ss), (">", ss[::-1])):
        n, key = 0, side
        for s, after in zip(seq, seq[1:]):
            n += len(s)
            if n > most:
                break
            key += " ".join(s) + "|"
            out.append((key, " ".join(after)))
    return out


@dataclass
class Item:
    item_ids: list[int]  # all items of the same words
    ids: list[int]  # token numbers, 0 for a masked token
    group: list[int]  # the white-space word that each token belongs to
    weight: list[float]  # how much each token tells about the item, 0 for a masked one
    seeds: dict[int, list[int]]  # where each run of MIN_TILE tokens begins, by its hash


class Items:
    """The evaluation items of one block: vocabulary, seeds and tokens.

    Items of the same words are one.  A token weighs the cube of log(1 + items / items that
    hold it), whatever the size of the set.
    """

    def __init__(self, rows: list[tuple[int, str]], standing: set[str] | None = None, held: dict[str, int] | None = None, total: int | None = None):
        """``standing`` beginnings and ends, by how many items words are ``held`` and their ``total``: of the whole set, where ``rows`` are a block of it."""
        same: dict[tuple[str, ...], list[int]] = defaultdict(list)
        texts: dict[tuple[str, ...], str] = {}
        for i, t in sorted(rows):
            key = tuple(words(t or ""))
            same[key].append(i)
            texts.setdefault(key, t or "")
        if standing is None:
            after: dict[str, set[str]] = defaultdict(set)
            for t in texts.values():
                for key, s in edges(t):
                    after[key].add(s)
            standing = {k for k, s in after.items() if len(s) > 1}
        if held is None:
            held = Counter(w for key in same for w in set(key))
        total = total or len(same)
        self.vocab = {w: k for k, w in enumerate(sorted(set().union(*same)), 1)}
        value = {w: math.log(1 + total / held.get(w, 1)) ** 3 for w in self.vocab}
        self.items: list[Item] = []
        for key, ids in same.items():
            toks, group, mask, g = [], [], [], 0
            cut = [s for s in _SENTENCE.split(texts[key]) if words(s)]
            masked = _standing(texts[key], standing)
            for k, s in enumerate(cut):
                off = k < masked[0] or k >= len(cut) - masked[1]
                for piece in s.split():
                    ws = words(piece)
                    toks += ws
                    group += [g] * len(ws)
                    mask += [off] * len(ws)
                    g += bool(ws)
            numbers = [0 if m else self.vocab.get(w, 0) for w, m in zip(toks, mask)]
            weight = [0.0 if m else value.get(w, 0.0) for w, m in zip(toks, mask)]
            seeds: dict[int, list[int]] = defaultdict(list)
            for p, h in enumerate(rolling(np.array(numbers, np.int64)).tolist()):
                if h:
                    seeds[h].append(p)
            self.items.append(Item(ids, numbers, group, weight, seeds))
        self.hashes = np.array(sorted(set().union(*(x.seeds for x in self.items))), np.int64)
        #: The items that hold each seed, in order: number of the seed times the number of items, plus the item.
        self.holders = np.sort(np.concatenate([np.searchsorted(self.hashes, np.array(sorted(x.seeds), np.int64)) * len(self.items) + k for k, x in enumerate(self.items)] or [self.hashes]))


def _standing(text: str, standing: set[str]) -> tuple[int, int]:
    """How many sentences at the beginning and at the end of an item are standing instructions."""
    out = {"<": 0, ">": 0}
    for key, _ in edges(text):
        if key in standing:
            out[key[0]] = key.count("|")
    return out["<"], out[">"]


def rolling(ids: np.ndarray, n: int = MIN_TILE) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` known tokens, 0 where a run holds an unknown one."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(ids) - n + 1, np.int64)
    known = np.ones(len(h), bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        h = (h * 1_000_003 + part) % 2_305_843_009_213
        known &= part > 0
    return np.where(known, h + 1, 0)


def tiles(doc: list[int], item: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Longest matches first, none overlapping another on either side: (doc start, item start, length)."""
    heap, seen = [], set()
    for d, p in seeds:
        if (d - 1, p - 1) in seen:
            seen.add((d, p))
            continue
        seen.add((d, p))
        n = 0
        while d + n < len(doc) and p + n < len(item) and doc[d + n] and doc[d + n] == item[p + n]:
            n += 1
        if n >= MIN_TILE:
            heap.append((-n, d, p))
    heapq.heapify(heap)
    dmark, pmark, out = set(), set(), []
    while heap:
        n, d, p = heapq.heappop(heap)
        run = 0
        pieces = []
        for k in range(-n + 1):
            free = k < -n and d + k not in dmark and p + k not in pmark
            if free:
                run += 1
            else:
                if run >= MIN_TILE:
                    pieces.append((-run, d + k - run, p + k - run))
                run = 0
        if pieces and pieces[0][0] == n:
            out.append((d, p, -n))
            dmark.update(range(d, d - n))
            pmark.update(range(p, p - n))
        else:
            for x in pieces:
                heapq.heappush(heap, x)
    return sorted(out)


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence of two short gaps."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y and x else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def passage(doc: list[int], item: Item, found: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """(words, edits) of the best passage, None without one.

    A passage is a run of tiles with short gaps.  Gaps are aligned exactly; a tile out of the
    item's order starts a new stretch of a reordered passage.  The tokens matched have most of
    the weight of the stretch, or it is a phrase that items of a kind share.
    """
    best = None
    for a in range(len(found)):
        edits, matched = 0, set()
        hit = there = 0.0
        for b in range(a, len(found)):
            d, p, n = found[b]
            if b > a:
                pd, pp, pn = found[b - 1]
                gap = doc[pd + pn : d]
                if len(gap) > GAP:
                    break
                if pp + pn <= p <= pp + pn + GAP:
                    lost = item.ids[pp + pn : p]
                    both = _common(gap, lost)
                    edits += max(len(gap), len(lost)) - both
                    left = set(gap)
                    for k in range(pp + pn, p):
                        there += item.weight[k]
                        if item.ids[k] and item.ids[k] in left:
                            matched.add(item.group[k])
                            hit += item.weight[k]
                else:  # what the item has after the one tile and before the other isn't in the text
                    edits += len(gap)
                    there += sum(item.weight[pp + pn : pp + pn + len(gap)]) or sum(item.weight[max(0, p - len(gap)) : p])
            matched.update(item.group[p : p + n])
            w = sum(item.weight[p : p + n])
            hit += w
            there += w
            total = len(matched) + edits
            if total >= PASSAGE_WORDS and edits <= EDITS * total + 0.5 and len(matched) >= PASSAGE_WORDS * (1 - EDITS) and hit >= WEIGHT_SHARE * there:
                if best is None or len(matched) > best[0]:
                    best = len(matched), edits
    return best


def _near(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where the hashes are among the known ones."""
    if not len(known):
        return np.zeros(0, np.int64)
    return np.flatnonzero((known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) & (h > 0))


def _chains(text: np.ndarray, at: np.ndarray, seed: np.ndarray, items: Items, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first, last seed) of the runs of seeds with short gaps that are as long as a passage, for the items from ``low`` up to ``high``.

    What is more than PAIRS is done in parts, of texts first and then of items.
    """
    n = len(items.items)
    first = np.searchsorted(items.holders, seed * n + low)
    count = np.searchsorted(items.holders, seed * n + high) - first
    total = int(count.sum())
    if total == 0:
        return
    if total > PAIRS and text[0] != text[-1]:
        cut = int(np.searchsorted(text, text[len(text) // 2])) or int(np.searchsorted(text, text[0], "right"))
        yield from _chains(text[:cut], at[:cut], seed[:cut], items, low, high)
        yield from _chains(text[cut:], at[cut:], seed[cut:], items, low, high)
        return
    if total > PAIRS and high - low > 1:
        cut = (low + high) // 2
        yield from _chains(text, at, seed, items, low, cut)
        yield from _chains(text, at, seed, items, cut, high)
        return
    nth = np.arange(total) - np.repeat(np.cumsum(count) - count - first, count)
    pair = np.repeat(text, count) * n + items.holders[nth] % n
    order = np.argsort(pair, kind="stable")
    pair, where = pair[order], np.repeat(at, count)[order]
    begin = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (np.diff(where) > MIN_TILE + GAP)]))
    end = np.append(begin[1:], total) - 1
    long = where[end] - where[begin] >= SPAN
    pair, begin, end = pair[begin[long]], where[begin[long]], where[end[long]]
    yield from zip((pair // n).tolist(), (pair % n).tolist(), begin.tolist(), end.tolist())


def leaked(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int]]:
    """(text number, number of the item in ``items``, words, edits) for the items that texts hold.

    The seeds of all texts are found by one rolling hash over their tokens laid end to end.
    Any seeds of an item that lie as a passage's do open a comparison with it, however many
    items hold them; the stretch of text around them, as long as a passage of the item can be,
    is then tiled.
    """
    get = items.vocab.get
    flat: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(flat))
        if t:
            flat += [get(w, 0) for w in words(t)]
            flat.append(0)
    starts.append(len(flat))
    h = rolling(np.array(flat, np.int64))
    at = _near(h, items.hashes)
    which = np.searchsorted(items.hashes, h[at])
    by: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for w, k, first, last in _chains(np.searchsorted(np.array(starts), at, "right") - 1, at, which, items, 0, len(items.items)):
        by[w, k].append((first, last))
    out = []
    for (w, k), chains in by.items():
        item = items.items[k]
        reach = int(1.25 * len(item.ids)) + MIN_TILE + GAP
        best, upto = None, 0
        for x, (first, last) in enumerate(chains):
            if not x or first - reach >= upto:
                low = first - reach
            upto = last + reach
            if x + 1 < len(chains) and chains[x + 1][0] - reach < upto:
                continue
            a, b = max(starts[w], low), min(starts[w + 1], upto + 1)
            near = at[np.searchsorted(at, a) : np.searchsorted(at, b)].tolist()
            seeds = [(y - a, p) for y in near for p in item.seeds.get(int(h[y]), ())]
            doc = flat[a : min(starts[w + 1], b + MIN_TILE)]
            got = passage(doc, item, tiles(doc, item.ids, seeds))
            if got and (best is None or got > best):
                best = got
        if best:
            out.append((w, k, *best))
    return out
