"""Log rules on runs of our own, with the answers the rules give; the tables hold none of these layouts."""

import os

import pytest
from pyspark.sql import functions as F

from cairn.plans import log_queries, registry, text_queries

RUNS = {
    ("own-pytest", "pytest -q", 1): """collected 4 items
___ test_alpha ___
E   ValueError: width 3 is below 4
___ test_beta[1] ___
E   assert 3 == 4
E   KeyError: 'late'
=== short test summary info ===
FAILED tests/test_a.py::test_alpha - ValueError: width 3 is be...
FAILED tests/test_a.py::test_beta[1]
ERROR tests/test_b.py::test_gamma - RuntimeError: no disk
=== 3 failed, 7 passed in 1.25s ===""",
    ("own-ctest", "ctest -j4", 8): """The following tests FAILED:
\t  3 - grid_walk (Failed)
\t  9 - slot_io (Timeout)

Errors while running""",
    ("own-gcc", "make all", 2): """In file included from src/main.cpp:3:
src/main.cpp:14:9:   required from here
/usr/include/c++/11/bits/stl_algo.h:1866:25: error: no match for call
src/app.cpp:20:5: warning: unused variable 'x'
src/app.cpp:20:5: note: in instantiation of template requested here
/usr/bin/ld: app.o: undefined reference to `walk'""",
    ("own-cmake", "cmake -S .", 1): """CMake Error at CMakeLists.txt:12 (find_package):
  Could not find Boost

  Set Boost_DIR
-- Configuring incomplete
CMake Warning (dev) at cmake/x.cmake:3 (message):
  old policy""",
    ("own-slurm", "srun job", 137): """slurmstepd: error: Detected 1 oom-kill event(s) in step 4.0
MaxRSS=64200K
slurmstepd: error: *** JOB 4 CANCELLED
MaxRSS: 64300K""",
    ("own-solver", "solve --tol 1e-6", 0): """iter 1 resid = 0.5
iter 2 resid = 0.25
iter 3 resid = 0.125
iter 4 resid = 0.0625
iter 5 resid = nan
norm is nan here""",
    ("own-clean", "run all", 0): """0 errors, no failures
WARNING: slow disk
wrote out/report.csv
done""",
}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("runs"))
    # The lines of a run are cut over a block border, so that what blocks carry over is seen.
    at = log_queries.BLOCK - 3
    rows = [(r, 1, c, e, at + k, x) for (r, c, e), t in RUNS.items() for k, x in enumerate(t.split("\n"), 1)]
    rows += [(r, s, c, e, k, f"\x1b[31m{x}\x1b[0m\r") for r, s, c, e, k, x in rows if "KeyError" in x]
    spark.createDataFrame(rows, "run_id string, seq bigint, command string, exit_code int, line_no int, text string").coalesce(1).write.parquet(f"{d}/log_lines.parquet")
    runs = [(r, c, e, len(t.split("\n"))) for (r, c, e), t in RUNS.items()]
    spark.createDataFrame(runs, "run_id string, command string, exit_code int, n_lines int").withColumn("started_at", F.lit("2026-01-01").cast("timestamp")).coalesce(1).write.parquet(f"{d}/runs.parquet")
    return d, at


def ask(spark, data, name, *cols):
    d, at = data
    rows = registry.queries()[name](spark, d).collect()
    return sorted(tuple(r[c] - at if c in ("line_no", "ev") else r[c] for c in cols) for r in rows)


def test_pytest(spark, data):
    assert ask(spark, data, "log05_pytest_failures", "test", "message") == [
        ("tests/test_a.py::test_alpha", "ValueError: width 3 is below 4"), ("tests/test_a.py::test_beta[1]", "KeyError: 'late'"), ("tests/test_b.py::test_gamma", "RuntimeError: no disk"),
    ]
    assert ask(spark, data, "log05_pytest_counts", "run_id", "passed", "failed") == [("own-pytest", 7, 3)]


def test_ctest(spark, data):
    assert ask(spark, data, "log06_ctest_failures", "line_no", "test", "status") == [(2, "grid_walk", "Failed"), (3, "slot_io", "Timeout")]


def test_compiler(spark, data):
    assert ask(spark, data, "log07_compiler_events", "line_no", "file", "at_line", "severity", "context") == [
        (3, "/usr/include/c++/11/bits/stl_algo.h", 1866, "error", "src/main.cpp:3 src/main.cpp:14:9"), (4, "src/app.cpp", 20, "warning", "src/app.cpp:20:5"),
    ]
    assert [x for x in ask(spark, data, "log08_build_events", "run_id", "line_no", "severity") if x[0] == "own-gcc"] == [("own-gcc", 3, "error"), ("own-gcc", 4, "warning"), ("own-gcc", 6, "error")]
    assert ask(spark, data, "scl14_user_locations", "line_no", "loc") == [(3, "src/main.cpp:14:9"), (4, "src/app.cpp:20:5")]


def test_root_errors(spark, data):
    """The template error lies in a system header, but a user's file led to it: it goes before later errors without such a place."""
    got = {r: (n, t) for r, n, t in ask(spark, data, "win01_root_errors", "run_id", "line_no", "tier")}
    assert got["own-gcc"] == (3, 1) and got["own-pytest"][1] == 2 and "own-clean" not in got


def test_cmake(spark, data):
    assert [(n, s, m) for n, s, m in ask(spark, data, "log09_cmake_events", "line_no", "severity", "message")] == [
        (1, "error", "CMakeLists.txt:12: Could not find Boost Set Boost_DIR"), (6, "warning", "cmake/x.cmake:3: old policy"),
    ]


def test_scheduler_and_solver(spark, data):
    assert ask(spark, data, "log11_scheduler_summary", "run_id", "n_events", "reason", "peak") == [("own-slurm", 2, "out_of_memory", "64300K")]
    assert ask(spark, data, "log12_solver_summary", "run_id", "iterations", "first_residual", "last_residual", "met_nan") == [("own-solver", 5, 0.5, 0.0625, True)]
    assert ask(spark, data, "log13_residual_trend", "run_id", "trend") == [("own-solver", "converging")]


def test_tracebacks(spark, data, tmp_path):
    lines = ["Traceback (most recent call last):", '  File "a.py", line 3, in f', "", "    x()", "ValueError: no", "Traceback (most recent call last):", "  File", "KeyError: 'k'", "done"]
    rows = [("r", 1, "c", 1, log_queries.BLOCK - 4 + k, x) for k, x in enumerate(lines)]
    spark.createDataFrame(rows, "run_id string, seq bigint, command string, exit_code int, line_no int, text string").write.parquet(f"{tmp_path}/log_lines.parquet")
    assert sorted(r.message for r in registry.queries()["log10_tracebacks"](spark, str(tmp_path)).collect()) == ["KeyError: 'k'", "ValueError: no"]


def test_profiles_and_artifacts(spark, data):
    got = dict(ask(spark, data, "log01_02_profiles", "run_id", "profile"))
    assert got == {"own-pytest": "pytest", "own-ctest": "ctest", "own-gcc": "gcc", "own-cmake": "cmake", "own-slurm": "slurm", "own-solver": "numerical_solver", "own-clean": "generic"}
    assert ("own-clean", "out/report.csv") in ask(spark, data, "log14_artifacts", "run_id", "artifact")
    assert ask(spark, data, "log03_explicit_markers", "run_id", "severity")[0] == ("own-clean", "warning")


def test_error_places_and_names(spark, tmp_path):
    lines = [
        "src/a.cpp:3:9: error: 'foo' was not declared", "src/b.h:7:2:   required from here", r"C:\\src\\x.cpp(12,5): warning C4100: x", '  File "pkg/m.py", line 33, in walk_rows', "interp/core.py:11: ZeroDivisionError",
        "FAILED tests/t.py::TestGrid::test_walk - KeyError: 'k'", "> return fold(grid)", "  12 | int y = z;", "make: Entering directory '/srv/out'", "cd build && make", "In file included from src/c.cpp:3:",
    ]
    rows = [("r", 1, "c", 1, k, x) for k, x in enumerate(lines)]
    spark.createDataFrame(rows, "run_id string, seq bigint, command string, exit_code int, line_no int, text string").write.parquet(f"{tmp_path}/log_lines.parquet")
    run = lambda q, *c: {tuple(r[x] for x in c) for r in registry.queries()[q](spark, str(tmp_path)).collect()}
    assert run("txt20_error_places", "line_no", "form", "file", "at_line") == {
        (0, "compiler", "src/a.cpp", 3), (1, "instantiation", "src/b.h", 7), (2, "msvc", r"C:\\src\\x.cpp", 12), (3, "traceback", "pkg/m.py", 33), (4, "pytest", "interp/core.py", 11),
    }
    names = run("txt21_22_error_names", "kind", "name")
    assert {("exception", "ZeroDivisionError"), ("exception", "KeyError"), ("frame", "walk_rows"), ("quoted", "foo"), ("quoted", "k"), ("test", "TestGrid"), ("test", "test_walk"), ("echo", "fold"), ("echo", "grid")} <= names
    assert not {n for _, n in names} & {"int", "return", "module", "y", "z"}
    assert run("txt23_build_folders", "how", "folder") == {("entered", "/srv/out"), ("cd", "build"), ("included", "src")}


def test_texts(spark, tmp_path):
    texts = [
        "Fix the wrong sum", "Re-run all the tests", "Look at the cache", "Task: run the pytest suite\nand fix nothing", "- **Task**: renamed walk", "Rerunning nothing", "make it so",
        "Traceback (most recent call last):\n  File x\nValueError: no\nPlease look", "src/a.cpp:3:9: fatal error: x\nE  y\nFAILED t.py::a", "a\nb\nEnter to select", "Proceed? (Y/n)\n" + "x\n" * 14, "❯ 1. Yes", "What now?",
        "@bo wrote:\nhi\n@bora wrote:\nyes\n@bor do it\n@bo stop\n@\"Bora\" go on\n@all wait here\n@zed no\n@b ambiguous\n@bo",
    ]
    docs = [(k, t, "en", "s", len(t), "note", None) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, repo string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, suite string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    run = lambda q, *c: [tuple(r[x] for x in c) for r in registry.queries()[q](spark, str(tmp_path)).orderBy(*c[:2]).collect()]
    assert [w for _, w in run("txt31_router", "id", "worker")][:7] == ["edit", "run", "scout", "run", "edit", "scout", "run"]
    prompts = run("txt24_47_prompts", "doc_id", "has_error", "task")
    assert prompts[7][1:] == (True, "ValueError: no") and prompts[8][1:] == (True, "Fix the error") and prompts[0][1:] == (False, "Fix the wrong sum")
    assert [i for i, a in run("txt41_asking", "doc_id", "asking") if a] == [9, 11]
    assert run("txt40_mentions", "doc_id", "pos", "body", "n_targets", "target") == [
        (13, 0, "wrote:", 1, "bo"), (13, 2, "wrote:", 1, "bora"), (13, 4, "do it", 1, "bora"), (13, 5, "stop", 1, "bo"), (13, 6, "go on", 1, "bora"), (13, 7, "wait here", 2, ""),
    ]
    quoted = dict(run("scl41_44_46_clips", "doc_id", "quoted"))
    assert len(quoted[10]) == len("Proceed? (Y/n)" + " x" * 14) + 2
    assert text_queries.CLIP == 80 and os.path.exists(f"{tmp_path}/documents.parquet")
