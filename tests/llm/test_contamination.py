"""Leaked evaluation texts: planted passages are found, look-alikes aren't."""

import random

from cairn.llm.contamination import contamination
from cairn.llm.tiling import Items, leaked, passage, tiles, words

NAMES = [f"{a}_{b}" for a in ("walk", "fold", "rank", "trim", "load", "store", "drain", "merge") for b in ("grid", "leaf", "ring", "seed", "slot", "card", "note", "bed")]


def item(rnd):
    n = lambda: rnd.choice(NAMES) + str(rnd.randrange(1000))
    return f"Read the task twice and stop when the checks pass. The command {n()} prints {rnd.randrange(999)} rows but {n()} expects only {rnd.randrange(999)}, so find the function that writes {n()} and tell on which line {n()} is opened. Hand the result to {n()} through {n()} and stop there. Note that {n()} may be missing when {n()} runs first."


def data():
    rnd = random.Random(5)
    items = [(i, item(rnd)) for i in range(1, 31)]
    filler = lambda: " ".join(rnd.choice(["the", "cache", "drops", "a", "note", "after", "every", "run", "slowly"]) for _ in range(40))
    docs, want = [], set()
    for k in range(120):
        i, t = items[rnd.randrange(30)]
        ws = t.split()
        kind = k % 10
        if kind == 0:
            body = t
        elif kind == 1:
            body = t.upper().replace(",", "").replace(".", "")
        elif kind == 2:
            body = "\n".join("> " + " ".join(ws[a : a + 7]) for a in range(0, len(ws), 7))
        elif kind == 3:
            a = rnd.randrange(12, len(ws) - 20)
            body = " ".join(ws[a : a + 20])
        elif kind == 4:
            body = " ".join(rnd.choice([w, w, w, w, w, w, w, f"**{w}**", f"`{w}`"]) for w in ws)
        elif kind == 5:  # one word in eight changed
            body = " ".join("really" if j % 8 == 4 else w for j, w in enumerate(ws))
        elif kind == 6:  # halves in another order
            body = " ".join(ws[len(ws) // 2 :]) + "\n\n" + " ".join(ws[: len(ws) // 2])
        elif kind == 7:  # too short
            a = rnd.randrange(12, len(ws) - 12)
            body = " ".join(ws[a : a + 8])
        elif kind == 8:  # only the standing instruction
            body = "Read the task twice and stop when the checks pass."
        else:  # a task of the same kind that isn't an item
            body = item(rnd)
        if kind <= 6:
            want.add((k, i))
        docs.append((k, f"{filler()}\n\n{body}\n\n{filler()}"))
    return items, docs, want


def test_planted(spark):
    items, docs, want = data()
    i = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    d = spark.createDataFrame([*docs, (500, None), (501, ""), (None, items[0][1])], "doc_id bigint, text string")
    for block in (8_000_000, 3_000):
        got = {(r.doc_id, r.item_id) for r in contamination(d, i, block_chars=block).collect()}
        assert got == want


def test_odd_rows(spark):
    items, docs, _ = data()
    i = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "")], "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert contamination(d.limit(0), i).count() == 0 and contamination(d, i.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + items[3][1] + " tail" * 100_000, 5, 6)], "doc_id bigint, text string, item_id int, words int")
    assert [(r.doc_id, r.item_id) for r in contamination(long, i).collect()] == [(1, 4)]


def test_tiles_against_brute_force():
    rnd = random.Random(8)
    for _ in range(200):
        a = [rnd.randrange(1, 6) for _ in range(rnd.randrange(3, 40))]
        b = [rnd.randrange(1, 6) for _ in range(rnd.randrange(3, 20))]
        seeds = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        got = tiles(a, b, seeds)
        used_a, used_b = set(), set()
        for d, p, n in got:
            assert n >= 3 and a[d : d + n] == b[p : p + n]
            assert not used_a & set(range(d, d + n)) and not used_b & set(range(p, p + n))
            used_a |= set(range(d, d + n))
            used_b |= set(range(p, p + n))
        best = max((next(k for k in range(len(a) + 1) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]) for i, j in seeds), default=0)
        assert max((n for _, _, n in got), default=0) == (best if best >= 3 else 0)


def test_words_and_standing():
    assert words("- A **b**, `c_d`\n2. e-f <b>g</b>\n> h") == ["a", "b", "c_d", "e", "f", "g", "h"]
    it = Items([(1, "Do it twice now. Alpha one."), (2, "Do it twice now. Beta two.")])
    assert it.items[0].ids[:4] == [0, 0, 0, 0] and any(it.items[0].ids[4:])


def test_same_words_and_larger_sets(spark):
    """Copies of items, items of the same words and a set ten times as large lose no leak."""
    items, docs, want = data()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    rnd = random.Random(6)
    twice = items + [(i + 1000, t.upper() + " ") for i, t in items]
    shuffled = items + [(k * 1000 + i, " ".join(rnd.sample(t.split(), len(t.split())))) for k in (1, 2, 3) for i, t in items]
    more = items + [(1000 + k, item(rnd)) for k in range(270)]
    variants = items + [(1000 + i, t + " Say so in the last line.") for i, t in items]
    for block in (8_000_000, 9_000):
        run = lambda x: {(r.doc_id, r.item_id) for r in contamination(d, spark.createDataFrame(x, "item_id bigint, text string"), block_chars=block).collect()}  # noqa: B023, E731
        assert run(twice) == want | {(k, i + 1000) for k, i in want}
        assert {x for x in run(shuffled) if x[1] < 1000} == want
        got = run(more)
        assert {x for x in got if x[1] < 1000} == want and not any(k % 10 == 8 for k, _ in got)
        assert run(variants) == want | {(k, i + 1000) for k, i in want}


def test_standing_edges():
    long = "Alpha one is here and walks along the wide road until nobody sees it any longer."
    same = [(1, f"Do it twice now. {long} Beta two."), (2, f"Do it twice now. {long} Beta two. Gamma."), (3, f"Do it twice now. {long.replace('Alpha', 'Delta')} Epsilon four.")]
    variants, all_ = Items(same[:2]), Items(same)
    assert all(variants.items[0].ids)
    assert all_.items[0].ids[:4] == [0] * 4 and all(all_.items[0].ids[4:])
    ends = Items([(1, "Alpha one is here. Answer with one letter."), (2, "Delta three is not there. Answer with one letter.")])
    assert ends.items[0].ids[-4:] == [0] * 4 and all(ends.items[0].ids[:4])


def test_items_of_words_that_all_items_hold(spark):
    """No word tells items apart that hold the same words: they are found by the order of words, in whole and in passages."""
    rnd = random.Random(9)
    base = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "se", "ra") for b in ("den", "fol", "gim", "hul", "jar", "kos")]
    items = [(k, " ".join(rnd.sample(base, len(base)))) for k in range(40)]
    docs, want = [], set()
    for k in range(80):
        i, t = items[rnd.randrange(40)]
        ws = t.split()
        a = rnd.randrange(len(ws) - 18)
        body = (t, " ".join(ws[a : a + 18]), " ".join("really" if j % 9 == 4 else w for j, w in enumerate(ws)), " ".join(ws[a : a + 9]))[k % 4]
        docs.append((k, f"So it goes on and on. {body} And nothing else is said."))
        if k % 4 < 3:
            want.add((k, i))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (8_000_000, 3_000):
        assert {(r.doc_id, r.item_id) for r in contamination(d, i, block_chars=block).collect()} == want


def test_leaked_against_all_pairs(monkeypatch):
    """What a text shares with every item, compared without a filter, also where the pairs are listed in parts."""
    rnd = random.Random(10)
    few = [f"w{k}" for k in range(30)]
    block = Items([(k, " ".join(rnd.choice(few) for _ in range(rnd.randrange(5, 40)))) for k in range(25)])
    texts = [None, ""]
    for _ in range(120):
        ids = [w for w, _ in sorted(block.vocab.items(), key=lambda x: x[1])]
        a, b = (block.items[rnd.randrange(25)].ids for _ in range(2))
        cut = rnd.randrange(len(a))
        ws = [ids[x - 1] for x in a[cut:] + b[: rnd.randrange(len(b))] + a[:cut]]
        texts.append(" ".join(rnd.choice([w, w, w, w, w, w, w, w, "x", f"{w} x"]) for w in ws))
    want = set()
    for w, t in enumerate(texts):
        doc = [block.vocab.get(x, 0) for x in words(t or "")] + [0]
        runs = {}
        for p in range(len(doc) - 2):
            runs.setdefault(tuple(doc[p : p + 3]), []).append(p)
        for k, it in enumerate(block.items):
            seeds = sorted((d, p) for p in range(len(it.ids) - 2) for d in runs.get(tuple(it.ids[p : p + 3]), ()))
            if got := passage(doc, it, tiles(doc, it.ids, seeds)):
                want.add((w, k, *got))
    assert len(want) > 60
    for most in (4_000_000, 200, 1):
        monkeypatch.setattr("cairn.llm.tiling.PAIRS", most)
        assert set(leaked(texts, block)) == want
