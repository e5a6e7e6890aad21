"""Queries that are one text for two engines, against plain Python over the small tables: a text that is wrong in both is seen here."""

import hashlib
import json
import math
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from cairn.plans import registry

DATA = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet").astype(object).where(lambda x: x.notna(), None).to_dict("records")


def ask(spark, name, *cols):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in registry.queries()[name](spark, DATA).collect()), key=str)


@pytest.fixture(scope="module")
def lines():
    """{(run, line): (text, exit code)}, clean and once each."""
    out = {}
    for r in table("log_lines"):
        if r["run_id"] is not None and r["line_no"] is not None:
            x = re.sub(r"\r+$", "", re.sub(r"\x1b\[[0-?]*[ -/]*[@-~]", "", r["text"] or ""))
            k = r["run_id"], r["line_no"]
            out[k] = max(out.get(k, ("", None))[0], x), r["exit_code"] if r["exit_code"] is not None else out.get(k, ("", None))[1]
    return out


def normal(x):
    x = re.sub(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?|\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TS>", x)
    x = re.sub(r"(?:/private)?/(?:tmp|var/folders|var/tmp)/\S*|[A-Za-z]:\\\S*?\\Temp\\\S*|\bpytest-of-[^/\s]+/pytest-\d+\S*", "<TMP>", x)
    x = re.sub(r"0x[0-9a-fA-F]+", "0xN", x)
    x = re.sub(r"(?i)\b(pid|tid)(\s*[=:#]?\s*)\d+", r"\1\2<PID>", x)
    x = re.sub(r"\b([A-Za-z][\w.-]*)\[\d+\]:", r"\1[<PID>]:", x)
    return " ".join(re.sub(r"\d{6,}", "<N>", x).split())


def event(x, code):
    """(severity, signature) of a line of generic output, None if it is no event."""
    bad = re.search(r"(?i)\b(?:error|exception|fatal|failed|failure)\b", re.sub(r"(?i)\b(?:0|no|zero)\s+(?:errors?|exceptions?|failed|failures?|fatal)\b", "", x))
    if not bad and not re.search(r"(?i)\bwarning\b", x) and not re.match(r"(?i)\s*(?:WARNING|ERROR|FATAL)\b[:\s]", x):
        return None
    if not bad and not re.search(r"(?i)\bwarning\b", x):
        return "warning" if re.match(r"(?i)\s*WARNING", x) else "error", normal(x)
    return "error" if bad and (code or 0) != 0 else "warning", normal(x)


@pytest.fixture(scope="module")
def events(lines):
    codes = defaultdict(lambda: None)
    for r in table("log_lines"):
        if r["exit_code"] is not None:
            codes[r["run_id"]] = r["exit_code"]
    out = {}
    for (run, n), (x, code) in lines.items():
        e = event(x, code)
        if e:
            out[run, n] = (*e, x.strip())
    return out


def test_events(spark, events):
    assert ask(spark, "log14_all_events", "run_id", "line_no", "severity", "message") == sorted(((r, n, s, m) for (r, n), (s, _, m) in events.items()), key=str)


def groups_of(events):
    out = defaultdict(list)
    for (run, n), (s, sig, m) in events.items():
        out[run, sig].append((n, s, m))
    return {k: sorted(v) for k, v in out.items()}


def test_clusters(spark, events):
    want = [(r, sig, v[0][2], v[0][1], len(v), v[0][0], [n for n, _, _ in v[:20]]) for (r, sig), v in groups_of(events).items()]
    assert ask(spark, "agg01_24_event_clusters", "run_id", "signature", "representative", "severity", "n", "first_line", "first_lines") == sorted(want, key=str)


def chains():
    """Runs of each command, the oldest first."""
    runs = {}
    for r in table("runs"):
        if r["run_id"] is not None and r["command"] is not None:
            runs[r["run_id"]] = (" ".join(r["command"].split()), r["started_at"])
    by = defaultdict(list)
    for i, (k, at) in runs.items():
        by[k].append((at, i))
    return {k: [i for _, i in sorted(v)] for k, v in by.items()}


def test_previous_runs(spark):
    want = [(i, k, v[j - 1] if j else None) for k, v in chains().items() for j, i in enumerate(v)]
    assert ask(spark, "win04_previous_runs", "run_id", "command_key", "previous") == sorted(want, key=str)


def test_run_diffs(spark, events):
    count = defaultdict(dict)
    for (run, sig), v in groups_of(events).items():
        count[run][sig] = len(v)
    want = []
    for v in chains().values():
        for before, now in zip(v, v[1:]):
            a, b = count[now], count[before]
            for sig in {*a, *b}:
                if a.get(sig, 0) != b.get(sig, 0):
                    want.append((now, sig, "new" if sig not in b else "resolved" if sig not in a else "changed", a.get(sig, 0), b.get(sig, 0)))
    assert ask(spark, "jon13_33_run_diffs", "run_id", "signature", "change", "n", "n_before") == sorted(want, key=str)


def test_residuals(spark, lines):
    by = defaultdict(list)
    for (run, n), (x, _) in sorted(lines.items()):
        by[run] += [float(m[1]) for m in [re.search(r"residual=([-+0-9.eE]+)", x)] if m]
        by[run] += [float(m[1]) for m in [re.search(r"(?i)iter(?:ation)?\D{0,5}\d+.{0,30}?resid\w*\D{0,5}?([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", x)] if m]
    by = {k: v for k, v in by.items() if v}
    got = {r: (n, a, b) for r, n, a, b in ask(spark, "log12_solver_summary", "run_id", "iterations", "first_residual", "last_residual")}
    assert got == {k: (len(v), round(v[0], 6), round(v[-1], 6)) for k, v in by.items()}

    def trend(v):
        d = [b - a for a, b in zip(v, v[1:])]
        turns = sum(x * y < 0 for x, y in zip(d, d[1:]))
        down, up = sum(x < 0 for x in d), sum(x > 0 for x in d)
        if not d:
            return "insufficient_data"
        return "oscillatory" if len(d) >= 3 and turns >= 0.4 * len(d) else "converging" if down >= 2 * up else "diverging" if up >= 2 * down else "mixed"

    assert dict(ask(spark, "log13_residual_trend", "run_id", "trend")) == {k: trend(v[-4096:]) for k, v in by.items()}


def test_word_weights(spark):
    docs = [set(re.findall(r"[a-z0-9]+", r["text"].lower())) for r in table("documents") if r["text"] is not None]
    df, n = Counter(w for d in docs for w in d), len(docs)
    raw = {w: math.log((n + 1) / (k + 0.5)) for w, k in df.items()}
    got = {w: (k, a, b) for w, k, a, b in ask(spark, "agg03_04_idf", "word", "df", "idf", "raw")}
    assert set(got) == set(df)
    for w, (k, a, b) in got.items():
        assert k == df[w] and abs(b - raw[w]) < 2e-6 and abs(a - min(1, max(0.05, raw[w] / math.log(n + 1)))) < 2e-6


def test_values_of_keys(spark):
    by = defaultdict(list)
    events = sorted((r for r in table("events") if r["value"] is not None and r["user_id"] is not None), key=lambda r: (r["ts"], r["event_id"]))
    for r in events:
        by[f"{r['user_id']}:{r['event_type']}"].append(r)
    now = max(r["ts"] for r in table("events"))
    got = {k: (f, v) for k, f, v in ask(spark, "mth06_10_19_20_values", "k", "failure", "value")}
    assert set(got) == set(by)
    for k, rows in by.items():
        hashes = [math.floor(r["value"] / 100) for r in rows]
        changes = sum(a != b for a, b in zip(hashes, hashes[1:]))
        sessions = len({r["ts"].date() for r in rows})
        failure = 150 * sum(r["value"] > 200 for r in rows)
        days = max(0.0, (now - rows[-1]["ts"]).total_seconds() / 86400)
        decay = 1.0 if k.endswith(":view") else 0.5 ** (days / 30)
        value = ((sessions - 1) * (sum(r["value"] for r in rows) / len(rows)) + failure) / (1 + changes) * decay / max(1, math.ceil(len(k) / 4))
        assert got[k][0] == failure and got[k][1] == pytest.approx(value, abs=2e-6, rel=1e-6)


def test_symbols_and_calls(spark):
    files, syms = {}, {}
    for r in table("source_files"):
        if r["path"] is not None:
            files[r["path"]] = max(files.get(r["path"]) or "", r["content"] or "") or files.get(r["path"]) or r["content"]
    imports = {(r["path"], t) for r in table("source_files") if r["path"] and r["resolved_imports"] is not None for t in r["resolved_imports"] if t}
    for r in table("symbols"):
        if r["id"] and r["path"] and r["name"]:
            syms[r["id"]] = r
    edges = set()
    for path, text in files.items():
        own = [s for s in syms.values() if s["path"] == path]
        for n, x in enumerate((text or "").split("\n"), 1) if text is not None else ():
            if re.match(r"^\s*(?:async )?def ", x):
                continue
            for name in re.findall(r"([a-z_][a-z_]+)\(", x):
                around = sorted(((s["end_line"] - s["start_line"], -s["start_line"], s["id"]) for s in own if s["start_line"] <= n <= s["end_line"]))
                if around:
                    edges.add((around[0][2], path, name))
    by_name, want = defaultdict(list), []
    for s in syms.values():
        by_name[s["name"]].append(s)
    for src, path, name in edges:
        same = [s["id"] for s in by_name[name] if s["path"] == path]
        imported = [s["id"] for s in by_name[name] if (path, s["path"]) in imports]
        every = [s["id"] for s in by_name[name]]
        one = next(((x[0], how) for x, how in ((same, "same_file"), (imported, "resolved_import"), (every, "unique_name")) if len(x) == 1), (None, "ambiguous" if len(every) > 1 else "unresolved"))
        want.append((src, name, *one))
    assert ask(spark, "jon01_name_resolution", "src", "name", "target", "how") == sorted(want, key=str)
    repo = lambda p: p.split("/")[0]
    links = Counter((repo(a), repo(b)) for a, b in imports if repo(a) != repo(b))
    assert ask(spark, "jon19_20_repo_links", "source", "target", "n") == sorted(((a, b, n) for (a, b), n in links.items()), key=str)


def test_message_totals(spark):
    want = []
    for r in table("transcripts"):
        try:
            m = json.loads(r["message"])
        except (TypeError, ValueError):
            continue
        if r["type"] == "assistant":
            u = m.get("usage") if isinstance(m, dict) else None
            n = lambda k, u=u: int(u[k]) if isinstance(u, dict) and re.fullmatch(r"-?\d+", str(u.get(k))) else 0
            a, b, c, o = n("input_tokens"), n("cache_read_input_tokens"), n("cache_creation_input_tokens"), n("output_tokens")
            want.append((r["line_id"], a + b + c + o, a + b + c))
    assert ask(spark, "mth17_23_totals", "line_id", "total", "prompt") == sorted(want, key=str)


def test_names_and_hashes(spark):
    files = {}
    for r in table("source_files"):
        if r["path"]:
            files[r["path"]] = None if r["content"] is None else hashlib.sha256(r["content"].encode()).hexdigest()
    got = dict(ask(spark, "scl45_content_hashes", "path", "hash"))
    assert all(got[p] == h for p, h in files.items() if h)
    cases = {"parseHTTPResponse": ["parse", "http", "response"], "walk_rows2": ["walk", "rows2"], "_x": ["x"]}
    from cairn.functions import words as W
    from cairn.plans.dialect import SPARK

    for name, parts in cases.items():
        assert spark.sql(f"SELECT {W.identifier_parts(SPARK, SPARK.lit(name))} AS p").first().p == parts
