"""Sources and sinks of the driver, and rewriting, notes and ranges, against fixed examples."""

import json
import os
import subprocess

from cairn.functions.rewrite import category, move_sections, requests, sections
from cairn.plans import registry
from cairn.sources.files import captured, changed_files, real_files, repository_files, tail_text
from cairn.sources.sinks import write_schedule, write_summary


def test_files_of_a_tree(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "c.txt").write_text("x" * 50)
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "d.txt").write_text("no")
    got = {os.path.basename(r.path): (r.state, r.size, r.content) for r in repository_files(spark, str(tmp_path), 40).collect()}
    assert got == {"a.txt": ("text", 5, "ok �\n"), "b.bin": ("binary", 2, None), "c.txt": ("large", 50, None)}


def test_links_count_once(spark, tmp_path):
    root = tmp_path / "r"
    (root / "z").mkdir(parents=True)
    (root / "z" / "real.txt").write_text("x")
    os.symlink(root / "z" / "real.txt", root / "a.txt")
    os.symlink(root / "circle", root / "circle")
    (tmp_path / "out.txt").write_text("x")
    os.symlink(tmp_path / "out.txt", root / "b.txt")
    assert [os.path.relpath(r.path, root) for r in real_files(spark, str(root)).collect()] == ["z/real.txt"]


def test_changed_files(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a b.txt").write_text("1")
    (tmp_path / "same.txt").write_text("1")
    git("add", ".")
    git("commit", "-qm", "x")
    (tmp_path / "a b.txt").write_text("2")
    (tmp_path / "new.txt").write_text("3")
    assert [r.path for r in changed_files(spark, str(tmp_path)).collect()] == ["a b.txt", "new.txt"]
    (tmp_path / "none").mkdir()
    assert changed_files(spark, "/").count() == 0


def test_tail_and_capture(spark, tmp_path):
    p = str(tmp_path / "log")
    got = captured(spark, ["sh", "-c", "echo one; echo two >&2; printf three; exit 3"], p)
    assert got["exit_code"] == 3 and got["n_lines"] == 2 and open(p).read() == "one\ntwo\nthree"
    assert tail_text(spark, p, 8) == "three" and tail_text(spark, p, 999) == "one\ntwo\nthree"
    late = captured(spark, ["sh", "-c", "echo begun; sleep 30 & wait"], p, 0.5)
    assert late["timed_out"] and late["exit_code"] == 124 and late["duration_s"] < 10 and open(p).read() == "begun\n"


def test_summary_and_schedule(spark, tmp_path):
    write_summary(spark.createDataFrame([("t", "b", 1.5, 1.0, 2.0), ("t", "a", -1.0, -2.0, 0.0)], "task string, arm string, delta double, lo double, hi double"), str(tmp_path))
    assert [r["arm"] for r in json.load(open(tmp_path / "summary.json"))["results"]] == ["a", "b"]
    assert open(tmp_path / "summary.md").read().splitlines()[2:] == ["| t | a | -1.00 % | [-2.00, 0.00] |", "| t | b | 1.50 % | [1.00, 2.00] |"]
    write_schedule(spark.createDataFrame([("y", 1, 2), ("x", 1, 1)], "task string, rep int, place int"), str(tmp_path / "s.json"), 42, ["a", "b"])
    assert json.load(open(tmp_path / "s.json")) == {"seed": 42, "arms": ["a", "b"], "tasks": ["x", "y"], "order": [["x", 1], ["y", 1]]}


def test_sections_move():
    body = "An example that is long enough to be worth a file of its own, as it has many words in it."
    doc = f"---\nname: x\n---\n\nIntro.\n\n# Rules\n\nKeep it.\n\n## Examples\n\n{body}\n\n```sh\n# Background\n```\n\n## Example\n\n{body}\n\n## Why\n\nShort.\n"
    text, moved, before, after = move_sections(doc)
    assert list(moved) == ["examples.md", "example.md"] and moved["example.md"] == f"## Example\n\n{body}\n"
    assert "See `references/examples.md`." in text and text.startswith("---\nname: x\n---\n\nIntro.\n\n# Rules\n\nKeep it.\n\n## Examples\n\nSee") and "## Why\n\nShort." in text and "```" not in text
    assert after < before == round(len(doc) / 4)
    twice = move_sections(f"## Example\n\n{body}\n\n## example\n\n{body}\n")[1]
    assert list(twice) == ["example.md", "example-2.md"]
    assert move_sections("plain") == ("plain", {}, 1, 1) and sections("")[1] == []
    assert [category(h) for h in ("See also", "Why rules", "Getting started", "Rules", "Other", None)] == ["external_reference", "background", "workflow", "constraints", "mandatory_instructions", "mandatory_instructions"]
    assert [len(requests(x, 2, 3)) for x in ("none", "slight", "lot", "?")] == [0, 1, 3, 0]


def ask(spark, tmp_path, docs, name):
    rows = [(k, t, "en", "s", len(t), "note", None) for k, t in enumerate(docs)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, repo string").write.mode("overwrite").parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("src/a.py", "source", "python", 1, 1, None, None, "x")], "path string, kind string, language string, size_tokens int, line_count int, resolved_imports array<string>, mtime timestamp, content string").write.mode("overwrite").parquet(f"{d}/source_files.parquet")
    return registry.queries()[name](spark, d).collect()


def test_notes(spark, tmp_path):
    docs = [
        "Done.\n**Notes:**\n\n- `cache` | is cold at first | src/a.py:12, `src/none.py`\n* walk | twice | src/a.py:3-9\nthat is all\n- late | no | src/a.py", "- x | y | src/a.py", "Notes:\ntext\n- x | y | src/a.py", "Notes:\n- x | y | src/a.py\n\n- z | y | src/a.py", "Notes:\n- x | y",
    ]
    got = sorted((r.doc_id, r.topic, r.finding, r.path) for r in ask(spark, tmp_path, docs, "txt29_str11_notes"))
    assert got == [(0, "cache", "is cold at first", "src/a.py"), (0, "walk", "twice", "src/a.py"), (3, "x", "y", "src/a.py")]


def test_bullets(spark, tmp_path):
    docs = ["- a\n# H one\n- b\n  * b\n- b\n## Two\n* c\nno", "x\n<!-- facts:begin -->\n- in\n<!-- facts:end -->\n- out", "\n".join(f"- f{k}" for k in range(15))]
    got = sorted((r.doc_id, r.pos, r.scope, r.text) for r in ask(spark, tmp_path, docs[:1], "src28_bullets"))
    assert got == [(0, 0, "", "a"), (0, 2, "H one", "b"), (0, 6, "Two", "c")]
    hot = [(r.doc_id, r.bullet) for r in sorted(ask(spark, tmp_path, docs, "txt33_hot_bullets"), key=lambda r: (r.doc_id, r.pos))]
    assert hot[4:6] == [(0, "c"), (1, "in")] and [b for i, b in hot if i == 2] == [f"f{k}" for k in range(12)]


def test_consolidation(spark, tmp_path):
    docs = ["The cache keeps every line after the marker today. Other words stand here for a while now.\n\nThe cache keeps every line after the marker today, and the rest too. End of it all, no more words."]
    r = ask(spark, tmp_path, docs, "rwr02_07_consolidated")[0]
    assert r.n_groups == 1 and r.n_missing == 0 and r.text.count("The cache keeps") == 1 and "and the rest too. Other words" in r.text
    kinds = [(x.level, x.kind, x.n) for x in ask(spark, tmp_path, docs, "rwr03_requests")]
    assert sorted(kinds) == [("lot", "description_shorten", 1), ("lot", "duplicate_consolidation", 1), ("lot", "unnecessary_removal", 0), ("slight", "description_shorten", 1)]
    text = ask(spark, tmp_path, ["---\nname: a\ndescription: >\n  Old first. And more\n  lines\nkind: b\n---\nbody"], "rwr08_descriptions")
    assert text == [] or text[0].text.startswith("---\nname: a\ndescription: \"")


def test_functions_in_sql(spark):
    from cairn.functions.catalog import register

    assert "cairn_longest_run" in register(spark)
    got = spark.sql("""SELECT cairn_longest_run('walk the rows once', 'so walk the rows twice') AS a, cairn_section_category('See also') AS b, cairn_prints_much('make -j4') AS c, cairn_checklist_size(cast(NULL AS string)) AS d,
        cairn_checklist_size('- [ ] a\n- [x] b\n- [ ] c') AS e, cairn_without_repeats('One two three four five six. One two three four five six.') AS f""").first()
    assert tuple(got) == (3, "external_reference", True, None, 3, "One two three four five six.")


def test_own_layout():
    from cairn.functions import loglines

    loglines.register_layout("own", ["<<"], r"<<(?P<l>[A-Z]+)>> (?P<t>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (?P<c>\w+) (?P<m>.*)\Z")
    try:
        assert loglines.parse("<<ERROR>> 2026-01-02 03:04:05 pool no room", loglines.automaton()) == ("2026-01-02 03:04:05", "ERROR", "pool", "no room")
    finally:
        loglines.LAYOUTS.pop("own")
        loglines._ORDER.remove("own")


def test_late_rows_of_windows(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairn.streaming.stateful import follow
    from cairn.streaming.windows import settle, windowed

    where, root = str(tmp_path / "in"), f"file://{tmp_path}/w"
    for part in (["2026-01-01 10:00:00", "2026-01-01 10:30:00", None], ["2026-01-03 09:00:00"], ["2026-01-01 10:40:00", "2026-01-03 09:30:00"]):
        df = spark.createDataFrame([("k", x) for x in part], "k string, at string").select("k", F.col("at").cast("timestamp").alias("at"))
        df.coalesce(1).write.mode("append").parquet(where)
        got = settle(spark, windowed(follow(spark, where, df.schema), "at", ["k"], {"n": F.count("*")}, "1 hour", late="1 hour"), ["k"], root=root)
    assert sorted(r.n for r in got.collect()) == [2, 2]  # the row of the first hour came after its window was over
