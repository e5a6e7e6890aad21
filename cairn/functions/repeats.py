"""Units of one text that repeat each other: by overlap of words or by a run of words in common."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

_CODE = re.compile(r"```[\s\S]*?```|`[^`\n]*`")
_WORD = re.compile(r"[a-z0-9]+")


def word_sequence(unit: str) -> list[str]:
    """The words of a unit's prose in order."""
    return _WORD.findall(_CODE.sub(" ", unit).lower())


def longest_run(a: list[str], b: list[str]) -> int:
    """Words of the longest run that two sequences share: by halving, as a run of n has runs of all shorter lengths."""
    low, high = 0, min(len(a), len(b))
    has = lambda n: not {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}.isdisjoint(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if has(mid) else (low, mid - 1)
    return low


def overlaps(sets: list[frozenset[str]], threshold: float) -> list[tuple[int, int, float]]:
    """(a, b, overlap) of all pairs with Jaccard overlap of at least ``threshold``.

    Prefix filter: two sets that are so alike share one of their rarest words, so a set only meets
    those that have one of its first words in an index, rare words first, and sizes have to fit.
    Equal sets are compared as one.
    """
    same: dict[frozenset[str], list[int]] = defaultdict(list)
    for k, s in enumerate(sets):
        if s:
            same[s].append(k)
    df = Counter(w for s in same for w in s)
    index: dict[str, list[frozenset[str]]] = defaultdict(list)
    out = [(x[0], b, 1.0) for x in same.values() for b in x[1:]]
    for s in sorted(same, key=lambda s: (len(s), sorted(s))):
        n, near = len(s), set()
        first = sorted(s, key=lambda w: (df[w], w))[: n - -int(-threshold * n // 1) + 1]
        for w in first:
            near.update(t for t in index[w] if len(t) >= threshold * n)
            index[w].append(s)
        near.discard(s)
        for t in near:
            both = len(s & t)
            j = both / (n + len(t) - both)
            if j >= threshold:
                out.append((*sorted((same[s][0], same[t][0])), j))
    return out


def groups(units: list[str], threshold: float, run: int | None = None) -> list[tuple[list[int], float | None]]:
    """(places of the members, greatest overlap) of the groups of units that repeat each other.

    Two units are alike if their words overlap by ``threshold``, or with ``run`` if they share
    that many words in a row; what is alike directly or by others is one group. The overlap is
    that of the pairs over the threshold, None if only runs connect a group.
    """
    seqs = [word_sequence(u) for u in units]
    found = overlaps([frozenset(s) for s in seqs], threshold)
    up = list(range(len(units)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(a: int, b: int) -> None:
        a, b = sorted((root(a), root(b)))
        up[b] = a

    for a, b, _ in found:
        join(a, b)
    if run:
        seen: dict[tuple[str, ...], int] = {}
        for k, s in enumerate(seqs):
            for i in range(len(s) - run + 1):
                join(seen.setdefault(tuple(s[i : i + run]), k), k)
    members: dict[int, list[int]] = defaultdict(list)
    for k in range(len(units)):
        members[root(k)].append(k)
    best: dict[int, float] = {}
    for a, _, j in found:
        best[root(a)] = max(best.get(root(a), 0.0), j)
    return [(m, best.get(r)) for r, m in sorted(members.items()) if len(m) > 1]
