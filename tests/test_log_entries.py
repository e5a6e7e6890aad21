"""Log lines into entries: layouts, runs in blocks, and rows that are odd."""

import random
from datetime import datetime

import pytest

from cairn.functions.loglines import automaton, parse
from cairn.operators.log_entries import log_entries

M = automaton()
LINES = "run_id string, line_no int, text string"


@pytest.mark.parametrize(
    "line, want",
    [
        ('{"time": "2026-02-06T13:09:07.628Z", "level": "info", "logger": "keeper", "message": "x level=error"}', ("2026-02-06 13:09:07", "INFO", "keeper")),
        ('{"severity": "WARN", "msg": "m", "ctx": {"level": "n/a"}, "component": "a.b", "ts": 1776607244179}', ("2026-04-19 14:00:44", "WARNING", "a.b")),
        ("\x1b[32mINFO\x1b[0m 2026-08-23 14:12:43 \x1b[2ma.ingest\x1b[0m > done", ("2026-08-23 14:12:43", "INFO", "a.ingest")),
        ("2026-07-07 15:07:55,078 - a.sync - CRITICAL - gone - ERROR - x", ("2026-07-07 15:07:55", "FATAL", "a.sync")),
        ("Mar  4 16:01:25 node17 relay.pool[18829]: warning: cache", ("????-03-04 16:01:25", "WARNING", "relay.pool")),
        ("Jul 12 11:24:21 node06 a.sync: checkpoint error: none", ("????-07-12 11:24:21", "", "a.sync")),
        ("level=err component=plotd ts=2026-05-22T07:57:11-05:00 msg=\"level=info \\\"x\\\"\"", ("2026-05-22 12:57:11", "ERROR", "plotd")),
        ("F0507 12:26:57.869409 17761 grid_solver.cc:129] stop", ("????-05-07 12:26:57", "FATAL", "grid_solver.cc")),
        ("2026-07-12T11:26:43.085Z WARN  [relay.pool] cache\r", ("2026-07-12 11:26:43", "WARNING", "relay.pool")),
        ("[2026-06-28 13:33:31] harbour.relay.DEBUG: queue", ("2026-06-28 13:33:31", "DEBUG", "harbour.relay")),
        ("11:23:56.440 [main-7] WARN a.sync - started", ("????-??-?? 11:23:56", "WARNING", "a.sync")),
        ("INFO 2026/08/23 14:12:28 a.gate: written", ("2026-08-23 14:12:28", "INFO", "a.gate")),
        ("27.04.2026 17:31:12 | ERROR | spool/writer | drained", ("2026-04-27 17:31:12", "ERROR", "spool/writer")),
        ('spade-x [01/Jan/2026:01:04:30 +0200] "DEBUG" error budget', ("2025-12-31 23:04:30", "DEBUG", "spade-x")),
        ("[1778833630.724] (a.cluster) info: cache", ("2026-05-15 08:27:10", "INFO", "a.cluster")),
        ("WARNING:a.pool:dropped INFO:x:y", ("", "WARNING", "a.pool")),
    ],
)
def test_layouts(line, want):
    assert parse(line, M)[:3] == want


@pytest.mark.parametrize(
    "line",
    ["", " ", "  INFO:a:b", "> INFO:a:b", "\tINFO:a:b", "| 27.04.2026 17:31:12 | ERROR | x | y", "Traceback (most recent call last):", "KeyError: 3", "[34/80] Building x.o", "{", "}", '{"a": 1}', '{"level": "info"}', '{"level": "info", "logger": "x"', "step 3/5 complete", "== make ==", "a=b", "level=info", "Error: INFO"],
)
def test_lines_that_start_nothing(line):
    assert parse(line, M) is None


def brute(rows, runs):
    """Entries by walking over each run."""
    years = {}
    for r, at in runs:
        if r is not None and at is not None:
            years[r] = min(years.get(r, at), at)
    text = {}
    for r, n, t in rows:
        if r is not None and n is not None:
            text.setdefault(r, {}).setdefault(n, []).append(t or "")
    out = []
    for r, lines in text.items():
        entry = None
        for n in sorted(lines):
            heads = [p for t in lines[n] if (p := parse(t, M))]
            if heads:
                if entry:
                    out.append((*entry[:2], n - 1, *entry[2:]))
                at, level, comp, _ = max(heads)
                s = years.get(r)
                if at.startswith("????"):
                    at = "" if s is None else (f"{s:%Y-%m-%d}" + at[10:] if at[5] == "?" else f"{s:%Y}" + at[4:])
                entry = (r, n, at, level, comp)
        if entry:
            out.append((*entry[:2], max(lines), *entry[2:]))
    return sorted(out)


def test_blocks_and_dirt(spark):
    rnd = random.Random(3)
    heads = ["INFO:a:b", "11:23:56.440 [m] WARN c - d", "Mar  4 16:01:25 n e[1]: error: f", "2026-07-07 15:07:55,078 - g - INFO - h"]
    rows = [(f"r{rnd.randrange(3)}", rnd.randrange(1, 120), rnd.choice([*heads, "", None, "  x", "plain", "plain"])) for _ in range(260)]
    rows = list({(a, b): (a, b, c) for a, b, c in rows}.values())
    rows += rnd.sample(rows, 40) + [(None, 1, "INFO:a:b"), ("r0", None, "INFO:a:b"), ("r9", 5, "plain"), ("long", 1, "INFO:a:" + "x" * 200_000), ("long", 70_000, "tail")]
    runs = [("r0", datetime(2026, 3, 4, 10)), ("r0", datetime(2026, 3, 4, 10)), ("r1", None), (None, datetime(2020, 1, 1))]
    lines = spark.createDataFrame(rows, LINES)
    runs_df = spark.createDataFrame(runs, "run_id string, started_at timestamp")
    for block in (7, 16384):
        got = sorted(tuple(r) for r in log_entries(lines, runs_df, block, message=False).collect())
        assert got == brute(rows, runs)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], LINES)
    assert log_entries(empty).count() == 0
    extra = spark.createDataFrame([("a", 1, "INFO:x:y", "t", 2)], "run_id string, line_no bigint, text string, level string, blk int")
    assert [tuple(r) for r in log_entries(extra).collect()] == [("a", 1, 1, "", "INFO", "x", "y")]
