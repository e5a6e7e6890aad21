"""Contradicting statements: whole results without a shuffle of pairs."""

import glob
import random

import duckdb

from cairn.functions import words as W
from cairn.operators.similarity import contradictions
from cairn.plans import registry
from cairn.plans.dialect import SPARK


def test_grid_against_brute_force(spark):
    """Scopes in buckets and in grids give what all pairs give; pairs are never shuffled."""
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(14)]
    facts = [(scope, f"{scope} {k}", rnd.random() < 0.4, rnd.sample(vocab, rnd.randrange(0, 9))) for scope, n in (("a", 150), ("b", 40), ("c", 40), ("d", 3)) for k in range(n)]
    facts += [("a", "long one", True, [f"x{k}" for k in range(400)]), ("a", "long other", False, [f"x{k}" for k in range(20, 420)])]
    odd = [*facts, facts[0], (None, "z", True, ["w1"]), (None, "y", False, ["w1"]), ("b", "no polarity", None, ["w1"]), ("b", "no words", True, None)]
    want = set()
    for s, x, n, v in facts:
        for t, y, m, w in facts:
            if s == t and n and not m and v and w and len(set(v) & set(w)) / len(set(v) | set(w)) >= 0.4:
                want.add((s, x, y, round(len(set(v) & set(w)) / len(set(v) | set(w)), 6)))
    df = spark.createDataFrame(odd, "scope string, s string, neg boolean, w array<string>")
    for block in (8_000_000, 700, 100):
        got = contradictions(df, 0.4, block=block)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) > 200 and set(rows) == want
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    assert contradictions(df.limit(0), 0.4).count() == 0


def test_python_words(spark):
    said = ["Don’t use the caches' keys, it's boss's CLASS notes", "never5 NOT5 x'not can'ts  cannot, W\u212aS", "", "as gas gass gases", "don't5 5not n't", "do-not WITHOUT"]
    for r in spark.createDataFrame([(x,) for x in said], "s string").selectExpr("s", f"{W.content_words(SPARK, 's')} AS w", f"{W.negated(SPARK, 's')} AS neg", f"{SPARK.match('s', W.MAYBE_NEGATED)} AS maybe").collect():
        words = W.ContentWords()
        got = words.of(r.s)
        assert {w for w, k in words.numbers.items() if k in got} == set(r.w) and len(got) == len(r.w) and (r.maybe or not r.neg)


def test_ids_that_repeat(spark, tmp_path):
    """A text stands under the sources of all documents of its id, as in SQL."""
    docs = [(1, "a", "The cache keeps the old note. The cache never keeps the old note."), (1, "b", None), (1, None, "The cache forgets a note.\r\nIt does not."), (2, "b", "The cache does not keep the old note."), (None, "a", "The cache never keeps a note."), (3, "a", "Never does the cache keep that old note!"), (3, "a", "So it is.")]
    for t in glob.glob("/root/testdata/sf0.001/*.parquet"):
        if "/documents" not in t:
            (tmp_path / t.rsplit("/", 1)[1]).symlink_to(t)
    have = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    have.limit(0).unionByName(df, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(registry.oracles()["jon16_contradictions"]).fetchall()
    got = [tuple(r) for r in registry.queries()["jon16_contradictions"](spark, str(tmp_path)).collect()]
    assert {r[0] for r in want} == {"", "a", "b"} and sorted(got) == sorted(want)
