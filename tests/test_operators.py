"""Graphs, similarity, selection, statistics, sources and sinks against plain versions."""

import random

import pytest

from cairn.operators.graph import components, cycle_links, distances
from cairn.operators.selection import bootstrap_deltas, greedy_selection
from cairn.operators.similarity import contradictions, near_duplicates
from cairn.plans import registry
from cairn.plans.stats_queries import wilson
from cairn.sources.files import changed_since, columnar, documents_of, raw_lines, records, repository_files
from cairn.sources.sinks import KeyedTable, merge_block, write_records
from cairn.streaming.stateful import call_budgets, drain, follow, repeated_briefs, running_stats

EDGE = "a string, b string"


def test_components_and_cycles(spark):
    rnd = random.Random(9)
    e = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(26)] + [(None, "n1"), ("n2", "n2"), *((f"p{k}", f"p{k + 1}") for k in range(15))]
    root = {x: x for p in e for x in p if x}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    linked = {x for a, b in e if a and b and a != b for x in (a, b)}
    df = spark.createDataFrame(e, EDGE)
    assert {r.id: r.component for r in components(df).collect()} == {x: find(x) for x in linked}
    assert components(df.limit(0)).count() == 0
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("s", "s"), (None, "a")], EDGE)
    assert {tuple(r) for r in cycle_links(c).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")}
    seeds = spark.createDataFrame([("p0",), (None,), ("p0",)], "id string")
    assert {r.id: r.distance for r in distances(df, seeds, 4).collect()} == {f"p{k}": k for k in range(5)}


def test_near_duplicates(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(60)] for _ in range(6)]
    docs = []
    for k in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        docs.append((k, " ".join(t)))
    docs += [(100, None), (101, ""), (102, "!!!"), (103, "one two"), (104, "One, two"), (None, "x"), docs[0]]

    def sh(t):
        import re

        w = re.findall(r"\w+", (t or "").lower())
        return tuple(w), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: sh(t) for i, t in docs if i is not None}
    links, group = {i: set() for i in sets}, {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            (wa, sa), (wb, sb) = sets[a], sets[b]
            if a != b and sa and sb and len(sa & sb) / len(sa | sb) >= 0.8:
                if wa != wb:
                    links[a].add(wb)
                if group[a] is not group[b]:
                    both = group[a] | group[b]
                    for x in both:
                        group[x] = both
    got = {r.id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: (min(group[i]), len(links[i])) for i in sets}


def test_contradictions(spark):
    df = spark.createDataFrame([("s", "a", True, ["x", "y"]), ("s", "b", False, ["x", "y", "z"]), ("t", "c", False, ["x", "y"]), ("s", "d", False, ["q"]), ("s", "e", True, [])], "scope string, s string, neg boolean, w array<string>")
    assert [tuple(r) for r in contradictions(df, 0.4).collect()] == [("s", "a", "b", 0.666667)]


def test_greedy_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 9.0, 6), ("g", 2, 8.0, 6), ("g", 3, 7.0, 4), ("g", 4, None, 1), ("h", 5, 1.0, 99), (None, 6, 1.0, 1), ("h", 7, 1.0, -1), ("h", 8, 1.0, None)], "g string, k bigint, s double, c bigint")
    assert {(r.grp, r.key, r.used) for r in greedy_selection(df, "g", "k", "s", "c", 10).collect()} == {("g", 1, 6), ("g", 3, 10), ("h", 7, 0)}


def test_bootstrap(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, "t", "base" if i % 2 else "new", rnd.gauss(10, 2) * (1 if i % 2 else 1.2)) for i in range(2000)], "k bigint, t string, a string, v double")
    r = bootstrap_deltas(df, "k", "t", "a", "v", "base", samples=300).collect()
    again = bootstrap_deltas(df.repartition(7), "k", "t", "a", "v", "base", samples=300).collect()
    assert r[0].lo < r[0].delta < r[0].hi and 15 < r[0].delta < 25 and r[0].hi - r[0].lo < 6
    assert all(abs(x - y) < 1e-9 for x, y in zip(r[0][2:], again[0][2:]))


def test_published_intervals(spark):
    lo, hi = wilson("5", "10")
    r = spark.sql(f"SELECT {lo} AS lo, {hi} AS hi").first()
    assert (round(r.lo, 4), round(r.hi, 4)) == (0.2366, 0.7634)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.log").write_bytes(b"a\r\nb\n\nc")
    got = {(r.line_no, r.text) for r in raw_lines(spark, str(tmp_path / "t.log")).collect()}
    assert got == {(1, "a"), (2, "b"), (3, ""), (4, "c")}
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    schema = spark.createDataFrame([], "a int").schema
    assert {r.a for r in records(spark, str(tmp_path / "r.jsonl"), schema).collect()} == {1, 3}
    with pytest.raises(Exception):
        records(spark, str(tmp_path / "r.jsonl"), schema, strict=True).collect()
    tree = tmp_path / "tree" / "src"
    tree.mkdir(parents=True)
    (tree / "a.py").write_bytes(b"x = '\xff'")
    (tree / "b.bin").write_bytes(b"\0\1")
    files = repository_files(spark, str(tmp_path / "tree")).where("state = 'text'").collect()
    assert [f.path.rsplit("/", 1)[1] for f in files] == ["a.py"] and "x = " in files[0].content
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('{\n"a": 1\n}')
    assert documents_of(spark, str(tmp_path / "d")).count() == 1
    df = spark.range(5).toDF("id")
    for form in ("parquet", "orc", "csv"):
        df.write.format(form).option("header", True).save(str(tmp_path / form))
        assert columnar(spark, str(tmp_path / form), form, header="true").count() == 5
    assert changed_since(spark, str(tmp_path / "parquet"), "2001-01-01T00:00:00").count() == 5
    write_records(df, str(tmp_path / "out"))
    write_records(df, str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 10
    t = KeyedTable(spark, f"file://{tmp_path}/keyed", "k")
    rows = lambda *x: spark.createDataFrame(x, "k string, v int, at int")
    assert t.read() is None
    t.upsert(rows(("a", 1, 1), ("b", 1, 5), (None, 0, 0)), "at")
    t.upsert(rows(("a", 2, 2), ("b", 2, 4), ("b", 3, 5)), "at")
    t.delete(rows(("zz", 0, 0)))
    assert {(r.k, r.v) for r in t.read().collect()} == {("a", 2), ("b", 1)}
    assert merge_block(merge_block("x", "1"), "2").count("facts:begin") == 1


def test_streams(spark, tmp_path):
    where = str(tmp_path / "in")
    ev = lambda rows: spark.createDataFrame(rows, "session_id string, seq bigint, kind string, text string, session string, cost double, key string").coalesce(1).write.mode("append").parquet(where)
    ev([("s", 2, "call", "walk the old grid twice", "d1", 1.0, "k"), ("s", 1, "call", "walk the grid twice", "d1", 2.0, "k")])
    schema = spark.read.parquet(where).schema
    s = lambda: follow(spark, where, schema)
    root = f"file://{tmp_path}/budget"
    drain(spark, call_budgets(s(), limit=2, warn=1, live_ms=None), root)
    ev([("s", 3, "call", "walk the grid twice", "d2", None, "k"), ("s", 4, "stop", "other words entirely here", "d2", 1.0, "k"), ("s", 5, "call", None, "d1", 1.0, "k")])
    got = {(r.seq, r.n, r.verdict) for r in drain(spark, call_budgets(s(), limit=2, warn=1, live_ms=None), root).collect()}
    assert got == {(1, 1, "allow"), (2, 2, "warn"), (3, 3, "deny"), (5, 1, "allow")}
    briefs = {r.seq: (r.verdict, r.like) for r in drain(spark, repeated_briefs(s(), live_ms=None)).collect()}
    assert briefs == {1: ("allow", None), 2: ("hint", 1), 3: ("deny", 1), 4: ("allow", None), 5: ("allow", None)}
    last = {r.seq: (r.accesses, r.sessions, r.cost) for r in drain(spark, running_stats(s(), live_ms=None)).collect()}
    assert last[5] == (5, 2, 5.0)


def test_every_query_has_a_name_of_its_own():
    assert len(registry.queries()) == sum(len(b.queries) for b in registry.BOOKS) + len(registry.problems.QUERIES)
    assert set(registry.oracles()) <= set(registry.queries())


def test_briefs_of_a_long_session(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rnd.sample(words, rnd.randrange(0, 9))) for _ in range(500)]
    texts = [texts[0] + " once only brief", *texts, texts[0] + " only once brief"]
    where, want, kept = str(tmp_path / "in"), {}, []
    for i, t in enumerate(texts):
        mine, got = set(t.split()), ("allow", None)
        for k, other in kept:
            x = len(mine & other) / len(mine | other) if mine and other else 0.0
            if x >= 0.6:
                got = ("deny" if x >= 0.9 else "hint", k)
                break
        if got[0] != "deny":
            kept.append((i, mine))
        want[i] = got
    assert len(kept) > 300 and want[501] == ("deny", 0)
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, seq bigint, text string")
    root = f"file://{tmp_path}/briefs"
    for part in (rows.where("seq < 300"), rows.where("seq >= 300")):  # the state is taken up again
        part.coalesce(1).write.mode("append").parquet(where)
        got = drain(spark, repeated_briefs(follow(spark, where, rows.schema), live_ms=None), root)
    assert {r.seq: (r.verdict, r.like) for r in got.collect()} == want


def test_briefs_with_a_task_line(spark, tmp_path):
    texts = ["Task: walk the rows twice\nKnown: nothing", "- **Task**: walk the rows twice\nKnown: other words here", "Task: walk the rows twice\nNot a duplicate: other rows", "Task: fold cells\nKnown: nothing"]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, seq bigint, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = drain(spark, repeated_briefs(follow(spark, f"{tmp_path}/in", rows.schema), live_ms=None), f"file://{tmp_path}/b")
    assert [r.verdict for r in got.orderBy("seq").collect()] == ["allow", "deny", "allow", "allow"]


def test_slices_against_a_plain_fold(spark):
    import random

    from cairn.operators.selection import slices

    rnd = random.Random(9)
    rows = []
    for g in "xyz":
        for k in range(60):
            a = rnd.randrange(1, 80)
            rows.append((g, f"{g}{k:02}", float(rnd.randrange(-1, 12)), rnd.randrange(0, 60), rnd.choice("pq"), a, a + rnd.randrange(0, 12), rnd.random() < 0.3, rnd.random() < 0.1))
    rows += [(None, "n", 5.0, 1, "p", 1, 2, False, False), ("w", "only", 3.0, None, "p", 1, 2, False, False)]
    df = spark.createDataFrame(rows, "grp string, key string, score double, tokens bigint, path string, a int, b int, test boolean, named boolean")
    got = {(r.grp, r.key): (r.how, r.cost, r.used) for r in slices(df, 200, 40, floor=0.3).collect()}
    want = {}
    for g in "xyz":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        top, named = max(r[2] for r in mine), any(r[7] and r[8] for r in mine)
        used = tests = 0
        lines, later = set(), []
        for _, key, score, tokens, path, a, b, test, name in mine:
            if score <= 0 or score < 0.3 * top:
                continue
            span = {(path, n) for n in range(a, b + 1)}
            cost = round(tokens * len(span - lines) / len(span))
            if not span - lines:
                want[g, key] = ("nested", 0, used)
            elif used + cost > 200 or (test and not name and tests + cost > (20 if named else 40)):
                later += [(key, cost)] * name
            else:
                used += cost
                tests += cost if test and not name else 0
                lines |= span
                want[g, key] = ("chosen", cost, used)
        for key, cost in later:
            if used + cost <= 240:
                used += cost
                want[g, key] = ("expanded", cost, used)
    assert got == want and {h for h, _, _ in got.values()} >= {"chosen", "nested"}
    assert slices(df.limit(0), 200).count() == 0


def test_running_sum(spark):
    from pyspark.sql import functions as F

    from cairn.operators.selection import running_sum

    rows = [(k * 37 % 1000, (k * 7) % 11 if k % 9 else None) for k in range(1000)]
    got = running_sum(spark.createDataFrame(rows, "k int, n int").repartition(7), [F.desc("k")], "n").collect()
    total, want = 0, {}
    for k, n in sorted(rows, reverse=True):
        total += n or 0
        want[k] = total
    assert {r.k: r.upto for r in got} == want and {r.total for r in got} == {total}
    assert running_sum(spark.createDataFrame([], "k int, n int"), [F.asc("k")], "n").count() == 0
    odd = spark.createDataFrame([(1, 2, 9, 9, 9), (2, None, 9, 9, 9)], "k int, n int, upto int, total int, _part int")
    assert sorted((r.k, r.upto, r.total) for r in running_sum(odd, [F.asc("k")], "n").collect()) == [(1, 2, 2), (2, 2, 2)]


def test_groups_and_runs(spark):
    import itertools
    import random

    from cairn.functions.repeats import groups, longest_run, overlaps
    from cairn.operators.similarity import repeated

    rnd = random.Random(3)
    words = [f"w{k}" for k in range(14)]
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    for t, run in ((0.6, None), (0.7, 3), (0.45, 6), (1.0, None)) * 6:
        seqs = [[rnd.choice(words) for _ in range(rnd.randrange(0, 14))] for _ in range(40)]
        near = {(a, b): jac(seqs[a], seqs[b]) for a, b in itertools.combinations(range(40), 2)}
        alike = {p for p, j in near.items() if j >= t}
        got = {(a, b): j for a, b, j in overlaps([frozenset(x) for x in seqs], t)}
        assert all(abs(near[p] - j) < 1e-9 for p, j in got.items()) and set(got) <= alike
        assert all(any(set(seqs[a]) == set(seqs[x]) and set(seqs[b]) == set(seqs[y]) for x, y in [*got, *((y, x) for x, y in got)]) or set(seqs[a]) == set(seqs[b]) for a, b in alike)
        parent = list(range(40))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in near:
            if (a, b) in alike or (run and longest_run(seqs[a], seqs[b]) >= run):
                parent[find(b)] = find(a)
        want = {}
        for root in {find(p) for p in range(40)}:
            m = tuple(p for p in range(40) if find(p) == root)
            if len(m) > 1:
                want[m] = max((near[p] for p in alike if p[0] in m), default=None)
        assert {tuple(m): j for m, j in groups([" ".join(x) for x in seqs], t, run)} == want
    units = [[rnd.choice(words) for _ in range(rnd.randrange(0, 14))] for _ in range(20)]
    brute = lambda a, b: max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 1 + min(len(a) - i, len(b) - j)) if a[i : i + k] == b[j : j + k]), default=0)
    assert all(longest_run(x, y) == brute(x, y) for x, y in itertools.combinations(units, 2))
    briefs = [(rnd.choice("ab"), k, 100 + k, sorted(set(rnd.choices(words[:6], k=4)))) for k in range(80)] + [("hot", 1000 + k, 2000 + k, ["x", "y"]) for k in range(300)]
    got = {r.line_id: (r.first_line, round(r.overlap, 6)) for r in repeated(spark.createDataFrame(briefs, "session_id string, o bigint, line_id bigint, w array<string>"), 0.6).collect()}
    want = {}
    for s, o, i, w in briefs:
        early = [(p, q, len(set(w) & set(v)) / len(set(w) | set(v))) for t, p, q, v in briefs if t == s and p < o]
        first = min((x for x in early if x[2] >= 0.6), default=None)
        if first:
            want[i] = (first[1], round(first[2], 6))
    assert got == want
    odd = spark.createDataFrame([("s", 1, 1, ["a"], 5, 6), ("s", 2, 2, ["a"], 5, 6), ("s", 3, 3, None, 5, 6), ("s", 4, 4, [], 5, 6), (None, 5, 5, ["a"], 5, 6)], "session_id string, o bigint, line_id bigint, w array<string>, id int, m int")
    assert [tuple(r) for r in repeated(odd, 0.6).collect()] == [(2, 1, 1.0)] and repeated(odd.limit(0), 0.6).count() == 0


def test_scores_against_a_plain_sum():
    import random

    from cairn.functions import scoring

    rnd = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    queries = [(w, q, rnd.choice([0.5, 3.0, 12.0]), rnd.random() < 0.2) for q in (3, 7, 9) for w in rnd.sample(words, 8)]
    rows = [rnd.choices(words, k=rnd.randrange(0, 6)) for _ in range(200)]
    ids = [f"r{rnd.randrange(10**6)}-{k}" for k in range(200)]
    for cells in (30, 4_000_000):
        scoring.CELLS = cells
        for most in (None, 5):
            got = [(ids[r], q, s, n) for x in scoring.Queries(queries).score(rows, ids, most) for r, q, s, n in zip(*(y.tolist() for y in x))]
            want = []
            for i, r in zip(ids, rows):
                for q in (3, 7, 9):
                    hits = [(w, n) for t in r for a, b, w, n in queries if (a, b) == (t, q)]
                    if sum(w for w, _ in hits) > 0:
                        want.append((i, q, sum(w for w, _ in hits), any(n for _, n in hits)))
            if most is None:
                assert sorted(got) == sorted(want)
            else:
                best = lambda x: {q: sorted(((-s, i, n) for i, p, s, n in x if p == q))[:most] for q in (3, 7, 9)}
                assert best(got) == best(want)
    assert list(scoring.Queries([]).score(rows, ids, 5)) == []
