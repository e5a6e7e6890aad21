"""Source mixing against plain arithmetic, and the bound of the schedule."""

import random
from collections import Counter

import pytest

from cairn.llm.mixing import edf, mix_report, mix_schedule, token_counts

SOURCES = {"a": 200, "b": 30, "c": 3, "d": 1}


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(4)
    rows, n = [], 0
    for s, k in SOURCES.items():
        for _ in range(k):
            n += 1
            rows.append((n, " ".join(rnd.choice(["grid", "leaf", "ring", "über", "память"]) for _ in range(rnd.randrange(1, 60))), s))
    rows += [(9001, "no source at all", None), (9002, "", "a"), (9003, None, "a"), (None, "x", "a"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = [("m", "a", 0.5, 1), ("m", "b", 0.3, 4), ("m", "c", 0.1, 2), ("m", "gone", 0.1, 9), ("n", "d", 1.0, 3), ("n", "d", 1.0, 3), (None, "a", 1.0, 1), ("o", "a", None, None)]
    return docs, spark.createDataFrame(mix, "mix_id string, source string, target_share double, max_repeats int")


def test_report(data):
    docs, mix = data
    n = {r.doc_id: (r.source, r.tokens) for r in token_counts(docs).collect()}
    total = sum(t for _, t in n.values())
    rows = {(r.mix_id, r.source): r for r in mix_report(docs, mix).collect()}
    assert set(rows) == {("m", "a"), ("m", "b"), ("m", "c"), ("m", "gone"), ("n", "d"), ("o", "a")}
    for (m, s), r in rows.items():
        have = sum(t for x, t in n.values() if x == s)
        longest = max([t for x, t in n.values() if x == s], default=0)
        assert abs(r.tokens_needed - r.target_share * total) <= 0.5
        assert r.most_repeats <= r.max_repeats
        assert abs(r.tokens - min(r.tokens_needed, have * r.max_repeats)) <= longest
    assert abs(sum(r.share for (m, _), r in rows.items() if m == "m") - 1) < 1e-9


def test_schedule(data):
    docs, mix = data
    report = {(r.mix_id, r.source): r.tokens for r in mix_report(docs, mix).collect()}
    rows = mix_schedule(docs, mix, blocks=50).collect()
    got = Counter()
    for r in rows:
        got[r.mix_id, r.source] += r.tokens
    assert {k: v for k, v in report.items() if v} == dict(got)
    times = Counter((r.mix_id, r.doc_id) for r in rows)
    assert max(v for (m, _), v in times.items() if m == "n") <= 3
    assert len({(r.mix_id, r.doc_id, r.copy) for r in rows}) == len(rows)


def test_less_than_one_block_off():
    rnd = random.Random(6)
    for _ in range(60):
        blocks = {f"s{i}": rnd.randrange(0, 40) for i in range(rnd.randrange(1, 7))}
        order = edf(blocks)
        assert Counter(order) == {s: n for s, n in blocks.items() if n}
        seen, m = Counter(), len(order)
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[x] - n * t / m) < 1 for x, n in blocks.items())


def test_empty(data, spark):
    docs, mix = data
    assert all(r.tokens == 0 for r in mix_report(docs.limit(0), mix).collect())
    assert mix_report(docs, mix.limit(0)).count() == 0 and mix_schedule(docs, mix.limit(0)).count() == 0
