"""Queries give all that their operator has, against plain versions."""

import glob

import pandas as pd

from cairn.plans import registry

DATA = "/root/testdata/sf0.1"


def rows(spark, name, d=DATA):
    return [tuple(r) for r in registry.queries()[name](spark, d).collect()]


def test_all_candidates(spark):
    got = rows(spark, "top04_candidates")
    want = {r.k for r in registry.queries()["mth06_10_19_20_values"](spark, DATA).collect() if r.value >= 1}
    assert len(got) > 100 and {k for k, _ in got} == want
    assert got == sorted(got, key=lambda r: (-r[1], r[0]))


def test_all_dependencies(spark):
    from cairn.plans.code_queries import imports
    from cairn.plans.dialect import ask

    links = ask(spark, DATA, lambda d: f"SELECT path, target FROM {imports(d)} i").collect()
    want = {(r.path.split("/")[0], r.target.split("/")[0]) for r in links if "/" in r.path and "/" in r.target}
    got = rows(spark, "agg08_src39_harvest")
    assert {(repo, name) for repo, what, name, _ in got if what == "depends"} == {(a, b) for a, b in want if a != b}
    most = pd.DataFrame(got, columns=["repo", "what", "name", "n"]).groupby(["what", "repo"]).size().groupby("what").max()
    assert most["language"] <= 4 and most["folder"] <= 10 < most["depends"]


def test_whole_merged_texts(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).dropna(subset=["text"])
    want = sorted((i, t + " <kept elsewhere>") for i, t in zip(docs.doc_id, docs.text.str.replace("\r", "")) if "```" not in t)
    got = sorted(r for r in rows(spark, "rwr05_06_marked_blocks") if r[0] in {i for i, _ in want})
    assert max(len(t) for _, t in want) > 4000 and got == want


def test_whole_line_ranges(spark, tmp_path):
    lines = [("r", k) for k in [*range(1, 30), *range(31, 900)]] + [("q", 1), ("r", 7)]
    events = [("r", "s", [3, 9]), ("r", "s", [20]), ("r", "t", [9]), ("r", "u", [30, 30]), ("q", "s", None), ("x", "s", [1]), ("r", "v", [None])]
    want = set()
    starts = sorted({x for r, _, a in events if r == "r" for x in a or [] if x})
    for r, s, a in events:
        for x in a or []:
            if x:
                upto = min([y for y in starts if y > x] + [x + 400])
                want |= {(r, s, k) for run, k in lines if run == r and x <= k < min(upto, x + 400)}
    for t in glob.glob("/root/testdata/sf0.001/*.parquet"):
        (tmp_path / t.rsplit("/", 1)[1]).symlink_to(t)
    for name, df in (("log_lines", spark.createDataFrame([(*x, "") for x in lines], "run_id string, line_no int, text string")), ("log_events", spark.createDataFrame(events, "run_id string, signature string, lines array<int>"))):
        (tmp_path / f"{name}.parquet").unlink()
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = rows(spark, "flt04_line_ranges", str(tmp_path))
    assert len(got) == len(want) and set(got) == want


def test_notes_of_all_stores(spark, tmp_path):
    for t in glob.glob("/root/testdata/sf0.001/*.parquet"):
        (tmp_path / t.rsplit("/", 1)[1]).symlink_to(t)
    docs = [(1, "b", "walrus tundra glacier"), (2, "b", "walrus tundra"), (3, "a", "see src/main/grid.py"), (4, None, "walrus tundra"), *((10 + k, "c", "walrus tundra filler") for k in range(6)), (5, "a", "walrus"), (6, "a", None)]
    for name, df in (("documents", spark.createDataFrame(docs, "doc_id bigint, source string, text string")), ("eval_items", spark.createDataFrame([("i", "suite", "walrus tundra glacier in src/main/grid.py")], "item_id string, suite string, text string"))):
        (tmp_path / f"{name}.parquet").unlink()
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(rows(spark, "jon29_30_note_retrieval", str(tmp_path)), key=lambda r: r[4])
    # words of over a third of the notes count only in stores of under four
    assert [r[:4] for r in got] == [("i", "", 4, 2), ("i", "a", 3, 6), ("i", "b", 1, 3), ("i", "b", 2, 2)]
