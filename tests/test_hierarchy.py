"""Parent-child rows into trees: depths, cycles, odd rows."""

import random

from cairn.operators.hierarchy import descendants, hierarchy


def brute(rows):
    up = {}
    for i, p in rows:
        if i is not None:
            up.setdefault(i, []).append(p)
    up = {i: min([p for p in ps if p], default=None) for i, ps in up.items()}
    out = {}
    for i in up:
        seen, x = [i], i
        while up[x] in up and up[x] not in seen:
            x = up[x]
            seen.append(x)
        out[i] = ("", -1) if up[x] in up else (x, len(seen) - 1)
    return out


def test_trees_and_cycles(spark):
    rnd = random.Random(1)
    rows = [(f"n{k}", f"n{rnd.randrange(max(1, k - 3), k + 1)}" if k > 4 else None) for k in range(60)]
    rows += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1"), ("self", "self"), ("x", "gone"), ("y", ""), (None, "n1"), ("n7", "n7b"), ("n7", None)]
    rows += [(f"deep{k}", f"deep{k - 1}" if k else None) for k in range(37)] + rows[:9]
    df = spark.createDataFrame(rows, "id string, parent string")
    want = brute(rows)
    for stride in (1, 3, 8):
        got = {r.id: (r.root, r.depth) for r in hierarchy(df, stride=stride).collect()}
        assert got == want
    tree = hierarchy(df).collect()
    assert all((r.path[0], r.path[-1], len(r.path)) == (r.root, r.id, r.depth + 1) if r.depth >= 0 else r.path == [] for r in tree)


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    got = sorted(tuple(r) for r in descendants(hierarchy(df)).collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]


def test_wide_parent_and_empty(spark):
    df = spark.createDataFrame([("hub", None), *((f"k{i}", "hub") for i in range(500))], "id string, parent string")
    assert hierarchy(df, paths=False).where("root = 'hub' and depth = 1").count() == 500
    assert hierarchy(df.limit(0)).count() == 0
    only = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    assert {r.depth for r in hierarchy(only).collect()} == {-1}


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", None, 7, "x", True), ("b", "a", 8, "y", False)], "id string, parent string, depth int, root string, hit boolean")
    assert {(r.id, r.depth) for r in hierarchy(df).collect()} == {("a", 0), ("b", 1)}
