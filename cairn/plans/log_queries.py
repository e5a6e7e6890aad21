"""Log parsing as windows over lines (SRC01, LOG), clustering and diffs of runs (AGG01, AGG24, JON13, JON33, WIN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import words as W
from cairn.operators.selection import running_sum
from cairn.plans.dialect import Book, Spark, ask
from cairn.session import written
from cairn.tables import load

book = Book()

#: Lines per block of a run in windows over its lines, so that one huge run is many tasks.
BLOCK = 16384
#: First lines that a cluster of events keeps; runs of a command and lines of all that the retention keeps.
FIRST_LINES, KEPT_RUNS, KEPT_LINES = 20, 10, 10_000
#: Groups and lines that a summary shows: root errors, other errors, warnings, lines of a small output, lines of a tail.
ROOT_SHOWN, ERRORS_SHOWN, WARNINGS_SHOWN, SMALL, TAIL = 1, 10, 5, 30, 40


def lines(d: Spark) -> str:
    """Lines once each, without colour codes and trailing CR: run_id, command, exit_code, line_no, x."""
    if d.held.get("lines"):
        return d.held["lines"]
    clean = d.sub(d.sub("text", W.ANSI, ""), r"\r+$", "")
    return f"""(SELECT run_id, max(command) AS command, max(exit_code) AS exit_code, line_no, max({clean}) AS x FROM (
        SELECT run_id, command, exit_code, line_no, coalesce(text, '') AS text FROM log_lines WHERE run_id IS NOT NULL AND line_no IS NOT NULL) a GROUP BY run_id, line_no)"""


def since(d: Spark, rel: str, ahead: bool = False, **marks: str) -> str:
    """``rel`` with the line of the last row up to each row where a mark holds (``ahead``: of the first row from it on).

    Blocks of a run are windowed by themselves; one row per block carries marks over.
    """
    pick, order, rest = ("min", " DESC", "FOLLOWING") if ahead else ("max", "", "PRECEDING")
    blk = d.div("line_no", str(BLOCK))
    inner = ", ".join(f"{pick}(CASE WHEN {c} THEN line_no END) OVER (PARTITION BY run_id, {blk} ORDER BY line_no{order}) AS i_{n}" for n, c in marks.items())
    per = ", ".join(f"{pick}(CASE WHEN {c} THEN line_no END) AS m_{n}" for n, c in marks.items())
    over = ", ".join(f"{pick}(m_{n}) OVER (PARTITION BY run_id ORDER BY blk ROWS BETWEEN {'1 FOLLOWING AND UNBOUNDED FOLLOWING' if ahead else 'UNBOUNDED PRECEDING AND 1 PRECEDING'}) AS b_{n}" for n in marks)
    out = ", ".join(f"coalesce(w.i_{n}, c.b_{n}) AS {n}" for n in marks)
    return f"""(SELECT w.*, {out} FROM (SELECT *, {blk} AS blk, {inner} FROM {rel} r) w
        JOIN (SELECT run_id, blk, {over} FROM (SELECT run_id, {blk} AS blk, {per} FROM {rel} r GROUP BY run_id, {blk}) g) c ON c.run_id = w.run_id AND c.blk = w.blk)"""


# Words and layouts that tools write.
FLAGS = {
    "pytest": r"(?i)short test summary info|={3,} failures ={3,}",
    "ctest": r"(?i)tests failed out of|the following tests failed",
    "cmake": r"(?i)cmake error|cmake warning",
    "slurm": r"(?i)slurmstepd|\bslurm\b",
    "gcc": r"\S+:\d+:(?:\d+:)?\s*(?:error|warning):",
    "python_traceback": r"(?i)traceback \(most recent call last\):",
    "numerical_solver": r"(?i)iter(?:ation)?\D{0,5}\d+.{0,30}?resid",
}
ERRORS = r"(?i)\b(error|exception|fatal|failed|failure)\b"
ZERO = r"(?i)\b(?:0|no|zero)\s+(?:errors?|exceptions?|failed|failures?|fatal)\b"
GCC = r"^([^:\s][^:]*):(\d+):(?:(\d+):)?\s*(error|warning|note):\s*(.*)$"
MARK = r"(?i)^\s*(WARNING|ERROR|FATAL)\b[:\s]"
LINKER = r"undefined reference to|ld: symbol\(s\) not found|ld returned \d+ exit status|Undefined symbols for architecture|linker command failed with exit code"


@book.sql
def src01_raw_lines(d: Spark) -> str:
    """Lines of each file from 1, split at LF with trailing CR dropped."""
    ls = d.split("content", "\n") if d.name == "spark" else "string_split(content, chr(10))"
    return f"SELECT path, {d.big('pos + 1')} AS line_no, {d.sub('x', chr(92) + 'r$', '')} AS line FROM (SELECT path, max(content) AS content FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY path) t {d.unnest(ls, 'x')}"


def any_of(x: str, *words: str) -> str:
    """Whether a lower-case text holds one of some plain words: told without an expression, before one is tried."""
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


#: Plain words without one of which a flag isn't raised.
HINTS = {"pytest": ("short test summary", "= failures ="), "ctest": ("tests failed",), "cmake": ("cmake ",), "slurm": ("slurm",), "gcc": ("error:", "warning:"), "python_traceback": ("traceback",), "numerical_solver": ("resid",)}


def profiles(d: Spark) -> str:
    flags = ", ".join(f"bool_or({any_of('low', *HINTS[n])} AND {d.match('x', p)}) AS f_{n}" for n, p in FLAGS.items())
    return f"""(SELECT run_id, CASE WHEN c LIKE '%pytest%' OR f_pytest THEN 'pytest' WHEN c LIKE '%ctest%' OR f_ctest THEN 'ctest'
        WHEN f_cmake OR (c LIKE '%cmake%' AND c NOT LIKE '%--build%') THEN 'cmake' WHEN c LIKE '%srun%' OR c LIKE '%sbatch%' OR f_slurm THEN 'slurm'
        WHEN f_gcc OR {d.match('c', r'^(?:gcc|g\+\+|clang|cc|c\+\+)|(?:^| )(?:gcc|g\+\+|clang|clang\+\+|cc|c\+\+)(?: |$)')} THEN 'gcc'
        WHEN f_python_traceback THEN 'python_traceback' WHEN f_numerical_solver THEN 'numerical_solver' ELSE 'generic' END AS profile
        FROM (SELECT run_id, lower(coalesce(max(command), '')) AS c, {flags} FROM (SELECT *, lower(x) AS low FROM {lines(d)} l) t GROUP BY run_id) g)"""


@book.sql
def log01_02_profiles(d: Spark) -> str:
    """What kind of output each run has, by its command and the flags its lines raise."""
    return f"SELECT run_id, profile FROM {profiles(d)} p"


@book.sql
def log03_explicit_markers(d: Spark) -> str:
    """Lines that open with a level word."""
    return f"SELECT run_id, line_no, {W.trim(d, 'x')} AS message, CASE WHEN upper({d.ext('x', MARK, 1)}) = 'WARNING' THEN 'warning' ELSE 'error' END AS severity FROM {lines(d)} l WHERE {d.match('x', MARK)}"


def failing(d: Spark, x: str, low: str) -> str:
    return f"({any_of(low, 'error', 'exception', 'fatal', 'failed', 'failure')} AND {d.match(x, ERRORS)} AND {d.match(d.sub(x, ZERO, ''), ERRORS)})"


def generic(d: Spark) -> str:
    return f"""SELECT run_id, line_no, {W.trim(d, 'x')} AS message, CASE WHEN err AND coalesce(exit_code, 0) <> 0 THEN 'error' ELSE 'warning' END AS severity
        FROM (SELECT *, {failing(d, 'x', 'low')} AS err, contains(low, 'warning') AND {d.match('x', '(?i)' + chr(92) + 'bwarning' + chr(92) + 'b')} AS warns FROM (SELECT *, lower(x) AS low FROM {lines(d)} l) a) b WHERE err OR warns"""


@book.sql
def log04_generic_events(d: Spark) -> str:
    """Lines with words of failure or warning; counts of zero don't count, and only failing runs have errors."""
    return generic(d)


@book.sql
def log05_pytest_failures(d: Spark) -> str:
    """Failing tests with their reason: the summary's, else the first typed, else the first E line of the test."""
    head = r"^_{3,}\s+(.+?)\s+_{3,}$"
    eline = r"^E\s+(\w[\w.]*(?:Error|Exception|Warning))?:?\s*(.*)$"
    summ = r"^(FAILED|ERROR)\s+(\S+)\s*(?:-\s*(.*))?$"
    return f"""WITH l AS (SELECT run_id, line_no, {W.trim(d, 'x')} AS s FROM {lines(d)} l),
        m AS (SELECT *, CASE WHEN {d.match('s', head)} THEN {d.ext('s', head, 1)} END AS h, CASE WHEN {d.match('s', '(?i)short test summary info')} THEN 1 ELSE 0 END AS opens,
            CASE WHEN s LIKE '=%' AND NOT {d.match('s', '(?i)short test summary info')} THEN 1 ELSE 0 END AS closes FROM l),
        w AS (SELECT * FROM {since(d, 'm', h_line='h IS NOT NULL', o_line='opens = 1', c_line='closes = 1')} k),
        n AS (SELECT run_id, line_no AS h_line, {d.sub('h', '^ERROR collecting ', '')} AS test FROM m WHERE h IS NOT NULL),
        e AS (SELECT w.run_id, n.test, w.line_no, {d.ext('s', eline, 1)} AS kind, {d.ext('s', eline, 2)} AS msg FROM w JOIN n ON w.run_id = n.run_id AND w.h_line = n.h_line WHERE {d.match('s', eline)}),
        t AS (SELECT run_id, test, min_by(concat(kind, ': ', msg), line_no) AS m FROM e WHERE kind <> '' GROUP BY run_id, test),
        f AS (SELECT run_id, test, min_by(msg, line_no) AS m FROM e WHERE kind = '' AND msg <> '' GROUP BY run_id, test),
        p AS (SELECT run_id, line_no, {d.ext('s', summ, 1)} AS kind, {d.ext('s', summ, 2)} AS test, {d.ext('s', summ, 3)} AS reason FROM w WHERE {d.match('s', summ)} AND o_line IS NOT NULL AND o_line > coalesce(c_line, 0)),
        q AS (SELECT *, {d.ext('test', '([^:]+)$', 1)} AS short FROM p)
        SELECT q.run_id, q.line_no, q.test, CASE WHEN reason <> '' AND reason NOT LIKE '%...' THEN trim(reason) ELSE coalesce(t.m, f.m, concat(q.kind, ' ', q.test)) END AS message
        FROM q LEFT JOIN t ON q.run_id = t.run_id AND q.short = t.test LEFT JOIN f ON q.run_id = f.run_id AND q.short = f.test"""


@book.sql
def log05_pytest_counts(d: Spark) -> str:
    """Passed and failed tests of each run by its final line."""
    fin = r"^=*\s*\d+ (?:passed|failed|errors?|skipped|xfailed|xpassed|deselected|warnings?)\b.*\bin [\d.]+s\b.*?=*$"
    return f"""SELECT run_id, coalesce({d.try_int(f"nullif({d.ext('s', '([0-9]+) passed', 1)}, '')")}, 0) AS passed, coalesce({d.try_int(f"nullif({d.ext('s', '([0-9]+) failed', 1)}, '')")}, 0) AS failed
        FROM (SELECT run_id, max_by({W.trim(d, 'x')}, line_no) AS s FROM {lines(d)} l WHERE {d.match(W.trim(d, 'x'), fin)} GROUP BY run_id) t"""


@book.sql
def log06_ctest_failures(d: Spark) -> str:
    """Failing tests of the list that ends at a blank line."""
    row = r"^\s*\d+\s*-\s*(\S+)\s*\((\w+)\)"
    return f"""WITH m AS (SELECT run_id, line_no, x, CASE WHEN {d.match('x', '(?i)the following tests failed')} THEN line_no END AS o, CASE WHEN {W.trim(d, 'x')} = '' THEN line_no END AS c FROM {lines(d)} l),
        w AS (SELECT * FROM {since(d, 'm', o_line='o IS NOT NULL', c_line='c IS NOT NULL')} k)
        SELECT run_id, line_no, {d.ext('x', row, 1)} AS test, {d.ext('x', row, 2)} AS status FROM w WHERE {d.match('x', row)} AND o_line > coalesce(c_line, 0)"""


def contexts(d: Spark) -> str:
    """Places that lead to a diagnostic: (run_id, ev, line_no, kind, file, loc), before it or by notes after it."""
    req = r"^([^:\s][^:]*):(\d+)((?::\d+)?):\s+(?:required from|required by|instantiated from)\b"
    inc = r"^(?:In file included from|from)\s+([^:\s][^:]*):(\d+)((?::\d+)?)[:,]?$"
    of = lambda p: f"concat({d.ext('s', p, 1)}, ':', {d.ext('s', p, 2)}, {d.ext('s', p, 3)})"
    k = f"""(SELECT *, CASE WHEN {d.match('s', req)} THEN {d.ext('s', req, 1)} WHEN {d.match('s', inc)} THEN {d.ext('s', inc, 1)} WHEN is_note THEN {d.ext('s', GCC, 1)} END AS file,
            CASE WHEN {d.match('s', req)} THEN {of(req)} WHEN {d.match('s', inc)} THEN {of(inc)} WHEN is_note THEN concat({d.ext('s', GCC, 1)}, ':', {d.ext('s', GCC, 2)}, CASE WHEN coalesce({d.ext('s', GCC, 3)}, '') <> '' THEN concat(':', {d.ext('s', GCC, 3)}) ELSE '' END) END AS loc,
            CASE WHEN {d.match('s', inc)} THEN 'include' ELSE 'instantiation' END AS kind
        FROM (SELECT run_id, line_no, s, {d.match('s', GCC)} AND {d.ext('s', GCC, 4)} <> 'note' AS is_ev, {d.match('s', GCC)} AND {d.ext('s', GCC, 4)} = 'note' AND {d.match('s', '(?i)requested here|required from|in instantiation of|instantiated from')} AS is_note
            FROM (SELECT run_id, line_no, {W.trim(d, 'x')} AS s FROM (SELECT *, lower(x) AS low FROM {lines(d)} l) w WHERE {any_of('low', 'required ', 'nstantiat', 'requested here', 'included from', 'error:', 'warning:')} OR ltrim(x) LIKE 'from %') a) b WHERE is_ev OR {d.match('s', req)} OR {d.match('s', inc)} OR is_note)"""
    return f"""(SELECT run_id, next_ev AS ev, line_no, kind, file, loc FROM {since(d, k, True, next_ev='is_ev')} w WHERE loc IS NOT NULL AND NOT is_note AND next_ev IS NOT NULL
        UNION ALL SELECT run_id, last_ev, line_no, kind, file, loc FROM {since(d, k, last_ev='is_ev')} w WHERE is_note AND last_ev IS NOT NULL)"""


@book.sql
def log07_compiler_events(d: Spark) -> str:
    """Diagnostics with where they were instantiated or included from: before the error, or by a note after it."""
    return f"""WITH g AS (SELECT run_id, ev, {d.text_agg('loc', ' ', 'line_no')} AS context FROM {contexts(d)} c GROUP BY run_id, ev)
        SELECT k.run_id, k.line_no, {d.ext('k.s', GCC, 1)} AS file, {d.try_int(d.ext('k.s', GCC, 2))} AS at_line, {d.ext('k.s', GCC, 4)} AS severity, {d.ext('k.s', GCC, 5)} AS message, coalesce(g.context, '') AS context
        FROM (SELECT run_id, line_no, {W.trim(d, 'x')} AS s FROM {lines(d)} l) k LEFT JOIN g ON k.run_id = g.run_id AND k.line_no = g.ev WHERE {d.match('k.s', GCC)} AND {d.ext('k.s', GCC, 4)} <> 'note'"""


def user_locations(d: Spark) -> str:
    """Of each diagnostic the first place in a user's file that it was instantiated from, else included from."""
    return f"""(SELECT run_id, ev, loc FROM (SELECT *, row_number() OVER (PARTITION BY run_id, ev ORDER BY CASE kind WHEN 'instantiation' THEN 0 ELSE 1 END, line_no) AS k FROM {contexts(d)} c WHERE {W.user_path(d, 'file')}) t WHERE k = 1)"""


@book.sql
def scl14_user_locations(d: Spark) -> str:
    """Where a user's own code led to a diagnostic of a file that isn't the user's."""
    return f"SELECT run_id, ev AS line_no, loc FROM {user_locations(d)} u"


@book.sql
def log08_build_events(d: Spark) -> str:
    """Diagnostics and linker failures of any run."""
    s = W.trim(d, "x")
    return f"""SELECT run_id, line_no, CASE WHEN {d.match(s, GCC)} THEN {d.ext(s, GCC, 4)} ELSE 'error' END AS severity, {s} AS message FROM {lines(d)} l
        WHERE ({d.match(s, GCC)} AND {d.ext(s, GCC, 4)} <> 'note') OR {d.match('x', LINKER)}"""


@book.sql
def log09_cmake_events(d: Spark) -> str:
    """Each header with the indented lines after it."""
    head = r"^CMake (Error|Warning)(?: \(dev\))? at ([^:]+):(\d+)"
    return f"""WITH m AS (SELECT run_id, line_no, x, {d.match(W.trim(d, 'x'), head)} AS is_head, {d.match('x', '^  ')} OR {W.trim(d, 'x')} = '' AS goes_on FROM {lines(d)} l),
        w AS (SELECT * FROM {since(d, 'm', owner='NOT goes_on')} k),
        h AS (SELECT run_id, line_no, {W.trim(d, 'x')} AS s FROM m WHERE is_head AND NOT goes_on),
        p AS (SELECT run_id, owner, {d.text_agg(W.trim(d, 'x'), ' ', 'line_no')} AS body FROM w WHERE goes_on AND {W.trim(d, 'x')} <> '' GROUP BY run_id, owner)
        SELECT h.run_id, h.line_no, lower({d.ext('s', head, 1)}) AS severity, concat({d.ext('s', head, 2)}, ':', {d.ext('s', head, 3)}, ': ', coalesce(body, s)) AS message FROM h LEFT JOIN p ON h.run_id = p.run_id AND h.line_no = p.owner"""


@book.sql
def log10_tracebacks(d: Spark) -> str:
    """The exception line of each traceback: the first that isn't indented or blank."""
    return f"""WITH m AS (SELECT run_id, line_no, {W.trim(d, 'x')} AS s, {W.trim(d, 'x')} = 'Traceback (most recent call last):' AS is_head, {d.match('x', '^[ ' + chr(92) + 't]')} OR {W.trim(d, 'x')} = '' AS inner_line FROM {lines(d)} l),
        h AS (SELECT DISTINCT run_id, after AS line_no FROM (SELECT h.run_id, h.line_no, min(n.after) AS after FROM (SELECT run_id, line_no + 1 AS line_no FROM m WHERE is_head) h JOIN {since(d, 'm', True, after='NOT inner_line')} n ON n.run_id = h.run_id AND n.line_no = h.line_no GROUP BY h.run_id, h.line_no) t)
        SELECT m.run_id, m.line_no, m.s AS message FROM m JOIN h ON h.run_id = m.run_id AND h.line_no = m.line_no"""


@book.sql
def log11_scheduler_summary(d: Spark) -> str:
    """Why the scheduler ended a job, and its peak memory."""
    why = "CASE " + " ".join(f"WHEN {d.match('x', p)} THEN '{r}'" for p, r in ((r"(?i)oom-kill", "out_of_memory"), (r"(?i)due to time limit", "time_limit_exceeded"), (r"(?i)exceeded (?:step|job) memory limit", "memory_limit_exceeded"), (r"(?i)\bcancelled\b", "cancelled"), (r"(?i)slurmstepd: error", "step_error"))) + " END"
    mem = r"Max(?:RSS|VMSize)[=: ]+([\d.]+\s*\w*)"
    return f"""SELECT run_id, count(r) AS n_events, coalesce(min_by(r, line_no) FILTER (WHERE r IS NOT NULL), CASE WHEN max(exit_code) = 0 THEN 'clean_exit' ELSE 'unknown' END) AS reason,
        max_by(m, line_no) FILTER (WHERE m IS NOT NULL) AS peak FROM (SELECT run_id, line_no, coalesce(exit_code, 0) AS exit_code, {why} AS r, nullif(trim({d.ext('x', mem, 1)}), '') AS m FROM {lines(d)} l) t GROUP BY run_id HAVING count(r) > 0 OR count(m) > 0"""


def residuals(d: Spark) -> str:
    it = r"(?i)iter(?:ation)?\D{0,5}(\d+).{0,30}?resid\w*\D{0,5}?([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?|nan|-?inf)"
    own = f"SELECT run_id, line_no, lower({d.ext('x', it, 2)}) AS v FROM {lines(d)} l WHERE {d.match('x', it)}"
    stored = f"SELECT run_id, line_no, lower({d.ext('x', r'residual=([-+0-9.eE]+)', 1)}) AS v FROM {lines(d)} l WHERE {d.match('x', r'residual=[-+0-9.eE]+')}"
    return f"({own} UNION ALL {stored})"


@book.sql
def log12_solver_summary(d: Spark) -> str:
    """Iterations, first and last residual of each run and whether it met NaN."""
    num = "CASE WHEN v IN ('nan', 'inf', '-inf') THEN NULL ELSE cast(v AS DOUBLE) END"
    return f"""SELECT run_id, count(*) AS iterations, min_by(n, line_no) FILTER (WHERE n IS NOT NULL) AS first_residual, max_by(n, line_no) FILTER (WHERE n IS NOT NULL) AS last_residual, bool_or(n IS NULL) AS met_nan
        FROM (SELECT run_id, line_no, {num} AS n FROM {residuals(d)} r) t GROUP BY run_id"""


@book.sql
def log13_residual_trend(d: Spark) -> str:
    """Trend of the last 4,096 residuals: oscillatory, converging, diverging or mixed."""
    return f"""WITH v AS (SELECT run_id, line_no, cast(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS back FROM {residuals(d)} r WHERE v NOT IN ('nan', 'inf', '-inf')),
        s AS (SELECT run_id, line_no, v - lag(v) OVER (PARTITION BY run_id ORDER BY line_no) AS diff FROM v WHERE back <= 4096),
        t AS (SELECT *, diff * lead(diff) OVER (PARTITION BY run_id ORDER BY line_no) AS turn FROM s),
        g AS (SELECT run_id, count(diff) AS n, count_if(diff < 0) AS down, count_if(diff > 0) AS up, count_if(turn < 0) AS turns FROM t GROUP BY run_id)
        SELECT run_id, CASE WHEN n < 1 THEN 'insufficient_data' WHEN n >= 3 AND turns >= n * 0.4 THEN 'oscillatory' WHEN down >= up * 2 THEN 'converging' WHEN up >= down * 2 THEN 'diverging' ELSE 'mixed' END AS trend FROM g"""


def events(d: Spark) -> str:
    """All events of all runs: diagnostics before keywords, markers last, one per line."""
    sev = f"""CASE WHEN gcc THEN {d.ext('s', GCC, 4)} WHEN link THEN 'error' WHEN err THEN CASE WHEN coalesce(exit_code, 0) <> 0 THEN 'error' ELSE 'warning' END
        WHEN warns THEN 'warning' WHEN upper({d.ext('x', MARK, 1)}) = 'WARNING' THEN 'warning' ELSE 'error' END"""
    sig = f"CASE WHEN gcc THEN concat({d.ext('s', GCC, 1)}, ': ', {W.normalise(d, d.ext('s', GCC, 5))}) ELSE {W.normalise(d, 'x')} END"
    may = any_of("low", "error", "exception", "fatal", "failed", "failure", "warning", "undefined", "ld: symbol", "ld returned", "linker command")
    flags = f"""{d.match('s', GCC)} AND {d.ext('s', GCC, 4)} <> 'note' AS gcc, {any_of('low', 'undefined', 'ld: symbol', 'ld returned', 'linker command')} AND {d.match('x', LINKER)} AS link, {failing(d, 'x', 'low')} AS err,
        contains(low, 'warning') AND {d.match('x', r'(?i)\bwarning\b')} AS warns, {d.match('x', MARK)} AS marked"""
    return f"""(SELECT run_id, command, exit_code, line_no, s AS message, {sev} AS severity, {sig} AS signature, CASE WHEN gcc THEN {d.ext('s', GCC, 1)} END AS file
        FROM (SELECT *, {flags} FROM (SELECT *, {W.trim(d, 'x')} AS s FROM (SELECT *, lower(x) AS low FROM {lines(d)} l) a WHERE {may}) b) c WHERE gcc OR link OR err OR warns OR marked)"""


@book.sql
def log14_all_events(d: Spark) -> str:
    """Every event of every run."""
    return f"SELECT run_id, line_no, message, severity FROM {events(d)} e"


@book.sql
def agg01_24_event_clusters(d: Spark) -> str:
    """Events by signature within a run: first message, count, first 20 lines."""
    return f"""WITH e AS (SELECT * FROM {events(d)} e), g AS (SELECT run_id, signature, min_by(message, line_no) AS representative, min_by(severity, line_no) AS severity, count(*) AS n, min(line_no) AS first_line FROM e GROUP BY run_id, signature),
        f AS (SELECT run_id, signature, {d.gather('line_no')} AS first_lines FROM (SELECT run_id, signature, line_no, row_number() OVER (PARTITION BY run_id, signature ORDER BY line_no) AS k FROM e) t WHERE k <= {FIRST_LINES} GROUP BY run_id, signature)
        SELECT g.*, f.first_lines FROM g JOIN f ON f.run_id = g.run_id AND f.signature = g.signature"""


@book.sql
def log_clusters(d: Spark) -> str:
    """Events of all runs by signature, most frequent first: the flagship report."""
    return f"""SELECT signature, count(*) AS n, count(DISTINCT run_id) AS n_runs, min(message) AS example FROM {events(d)} e GROUP BY signature ORDER BY n DESC, signature"""


def clusters(d: Spark) -> str:
    return f"(SELECT run_id, signature, min_by(severity, line_no) AS severity, min_by(message, line_no) AS message, count(*) AS n, min(line_no) AS first_line FROM {events(d)} e GROUP BY run_id, signature)"


def roots(d: Spark) -> str:
    tier = f"CASE WHEN file IS NOT NULL AND {W.user_path(d, 'file')} THEN 0 WHEN u.loc IS NOT NULL THEN 1 ELSE 2 END"
    return f"""(SELECT run_id, line_no, message, signature, tier FROM (SELECT e.run_id, e.line_no, e.message, e.signature, {tier} AS tier, row_number() OVER (PARTITION BY e.run_id ORDER BY {tier}, e.line_no) AS k FROM {events(d)} e LEFT JOIN {user_locations(d)} u ON u.run_id = e.run_id AND u.ev = e.line_no WHERE e.severity = 'error') t WHERE k = 1)"""


@book.sql
def win01_root_errors(d: Spark) -> str:
    """The event that each run is told by: the first error in a user's file, else the first that a user's code led to, else the first."""
    return f"SELECT run_id, line_no, message, tier FROM {roots(d)} r"


def run_order(d: Spark) -> str:
    key = f"trim({d.sub('command', r'\s+', ' ')})"
    return f"(SELECT run_id, {key} AS k, max(started_at) AS began, max(exit_code) AS exit_code, max(n_lines) AS n_lines FROM runs WHERE run_id IS NOT NULL AND command IS NOT NULL GROUP BY run_id, {key})"


@book.sql
def win04_previous_runs(d: Spark) -> str:
    """The run of the same command before each run."""
    return f"SELECT run_id, k AS command_key, lag(run_id) OVER (PARTITION BY k ORDER BY began, run_id) AS previous FROM {run_order(d)} r"


@book.sql
def win05_recent_runs(d: Spark) -> str:
    """The 20 newest runs."""
    return f"SELECT run_id, k AS command_key, exit_code FROM {run_order(d)} r ORDER BY began DESC, run_id DESC LIMIT 20"


@book.sql
def jon13_33_run_diffs(d: Spark) -> str:
    """Signatures of each run that are new, gone or of another count than in the run before."""
    return f"""WITH p AS (SELECT run_id, lag(run_id) OVER (PARTITION BY k ORDER BY began, run_id) AS previous FROM {run_order(d)} r),
        c AS (SELECT * FROM {clusters(d)} c), a AS (SELECT p.run_id AS id, c.signature, c.n FROM p JOIN c ON c.run_id = p.run_id WHERE previous IS NOT NULL), b AS (SELECT p.run_id AS id, c.signature, c.n FROM p JOIN c ON c.run_id = p.previous)
        SELECT coalesce(a.id, b.id) AS run_id, coalesce(a.signature, b.signature) AS signature, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'resolved' ELSE 'changed' END AS change, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS n_before
        FROM a FULL OUTER JOIN b ON a.id = b.id AND a.signature = b.signature WHERE a.id IS NULL OR b.id IS NULL OR a.n <> b.n"""


def aged_runs(d: Spark) -> str:
    return f"(SELECT run_id, began, n_lines, k_back, CASE WHEN k_back > 1 AND k_back <= {KEPT_RUNS} THEN n_lines ELSE 0 END AS size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY began DESC, run_id DESC) AS k_back FROM {run_order(d)} r) t)"


@book.frame(lambda d: f"""SELECT run_id, CASE WHEN k_back > {KEPT_RUNS} THEN 'count' ELSE 'size' END AS reason FROM (SELECT *, sum(coalesce(size, 0)) OVER (ORDER BY began DESC NULLS LAST, run_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM {aged_runs(d)} r) s
    WHERE k_back > {KEPT_RUNS} OR (k_back > 1 AND kept > {KEPT_LINES})""")
def win03_retention(spark: SparkSession, d: str) -> DataFrame:
    """Runs to drop: past the last 10 of a command, then the oldest until the rest is small enough; the newest of a command stays."""
    r = running_sum(ask(spark, d, lambda x: f"SELECT * FROM {aged_runs(x)} r"), [F.desc_nulls_last("began"), F.desc("run_id")], "size")
    return r.where((F.col("k_back") > KEPT_RUNS) | ((F.col("k_back") > 1) & (F.col("upto") > KEPT_LINES))).select("run_id", F.when(F.col("k_back") > KEPT_RUNS, "count").otherwise("size").alias("reason"))


@book.sql
def win06_07_flt03_context(d: Spark) -> str:
    """Lines within two of a fatal one, in its run."""
    hit = d.match("x", r"(?i)\b(?:fatal|critical)\b")
    near = f"(SELECT DISTINCT run_id, line_no + o AS line_no FROM (SELECT run_id, line_no FROM {lines(d)} l WHERE {hit}) h CROSS JOIN (SELECT -2 AS o UNION ALL SELECT -1 UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2) p)"
    return f"""SELECT l.run_id, l.line_no, {d.match('l.x', r'(?i)\b(?:fatal|critical)\b')} AS is_hit FROM {lines(d)} l JOIN {near} n ON n.run_id = l.run_id AND n.line_no = l.line_no"""


@book.sql
def flt04_line_ranges(d: Spark) -> str:
    """The lines that noted events name, each with those up to the next noted one of its run, 400 at most."""
    return f"""WITH e AS (SELECT DISTINCT run_id, signature, x AS a FROM (SELECT run_id, signature, lines FROM log_events WHERE lines IS NOT NULL AND run_id IS NOT NULL) t {d.unnest('lines', 'x')}), n AS (SELECT DISTINCT run_id, a FROM e WHERE a IS NOT NULL),
        m AS (SELECT coalesce(l.run_id, n.run_id) AS run_id, coalesce(l.line_no, n.a) AS x, l.line_no, n.a FROM (SELECT DISTINCT run_id, line_no FROM log_lines) l FULL OUTER JOIN n ON n.run_id = l.run_id AND n.a = l.line_no),
        s AS (SELECT run_id, line_no, max(a) OVER (PARTITION BY run_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM m)
        SELECT e.run_id, e.signature, s.line_no FROM s JOIN e ON e.run_id = s.run_id AND e.a = s.a WHERE s.line_no - s.a < 400"""


def ranked(d: Spark) -> str:
    """Groups of each run and severity in the order a summary shows them: the root's first, then by count and place."""
    return f"""(SELECT c.*, row_number() OVER (PARTITION BY c.run_id, c.severity ORDER BY CASE WHEN c.signature = r.signature THEN 0 ELSE 1 END, c.n DESC, c.first_line) AS k, count(*) OVER (PARTITION BY c.run_id, c.severity) AS n_groups
        FROM {clusters(d)} c LEFT JOIN {roots(d)} r ON r.run_id = c.run_id)"""


def statuses(d: Spark) -> str:
    return f"""(SELECT r.*, coalesce(e.n, 0) AS n_errors, CASE WHEN r.exit_code = 124 THEN 'TIMEOUT' WHEN coalesce(r.exit_code, 0) <> 0 OR coalesce(e.n, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
        FROM (SELECT run_id, max(command) AS command, max(exit_code) AS exit_code, max(duration_s) AS duration_s, max(n_lines) AS n_lines FROM runs WHERE run_id IS NOT NULL GROUP BY run_id) r LEFT JOIN (SELECT run_id, count_if(severity = 'error') AS n FROM {events(d)} e GROUP BY run_id) e ON r.run_id = e.run_id)"""


@book.sql
def flt12_run_status(d: Spark) -> str:
    """Status of each run: failed by its exit code or by an error of its own; 124 is a timeout."""
    return f"SELECT run_id, status FROM {statuses(d)} s"


@book.sql
def win08_summary(d: Spark) -> str:
    """Per run and severity: the groups shown under caps, and how many are left out."""
    cap = f"CASE WHEN severity = 'error' THEN {ROOT_SHOWN + ERRORS_SHOWN} ELSE {WARNINGS_SHOWN} END"
    return f"""SELECT run_id, severity, least(count(*), {cap}) AS shown, greatest(0, count(*) - {cap}) AS omitted, {d.big('sum(n)')} AS events FROM {clusters(d)} c GROUP BY run_id, severity"""


def summaries(d: Spark) -> str:
    text = lambda x: f"cast({x} AS VARCHAR(20))"
    nl = "\n"
    return f"""WITH s AS (SELECT * FROM {d.held.get('statuses') or statuses(d)} s), k AS (SELECT * FROM {d.held.get('ranked') or ranked(d)} k), p AS (SELECT * FROM {d.held.get('profiles') or profiles(d)} p),
        z AS (SELECT run_id, n FROM {d.held.get('counts') or f'(SELECT run_id, count(*) AS n FROM {lines(d)} l GROUP BY run_id)'} c),
        t AS (SELECT run_id, line_no, x, back FROM {d.held.get('tails') or f'(SELECT run_id, line_no, x, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS back FROM {lines(d)} l)'} t),
        parts AS (
            SELECT run_id, 1 AS o, concat('$ ', coalesce(command, '')) AS line FROM s
            UNION ALL SELECT s.run_id, 2, concat('exit=', coalesce({text('s.exit_code')}, 'none'), ' duration_ms=', coalesce({text(d.big('round(s.duration_s * 1000)'))}, 'none'), ' status=', s.status, ' profile=', coalesce(p.profile, 'generic'), ' lines=', {text('coalesce(z.n, 0)')}) FROM s LEFT JOIN p ON p.run_id = s.run_id LEFT JOIN z ON z.run_id = s.run_id
            UNION ALL SELECT t.run_id, cast(100 + {SMALL} - t.back AS INT), concat('  ', t.x) FROM t JOIN z ON z.run_id = t.run_id WHERE t.back <= {SMALL} AND z.n <= {SMALL}
            UNION ALL SELECT k.run_id, cast(200 + k.k AS INT), concat(CASE WHEN k.k <= {ROOT_SHOWN} THEN 'Root error: ' ELSE '  - ' END, k.message, ' x', {text('k.n')}, ' (first line ', {text('k.first_line')}, ')') FROM k JOIN z ON z.run_id = k.run_id WHERE k.severity = 'error' AND k.k <= {ROOT_SHOWN + ERRORS_SHOWN} AND z.n > {SMALL}
            UNION ALL SELECT k.run_id, 290, concat('  (+', {text(f'k.n_groups - {ROOT_SHOWN + ERRORS_SHOWN}')}, ' more groups)') FROM k JOIN z ON z.run_id = k.run_id WHERE k.severity = 'error' AND k.k = 1 AND k.n_groups > {ROOT_SHOWN + ERRORS_SHOWN} AND z.n > {SMALL}
            UNION ALL SELECT k.run_id, 300, concat('Warnings: ', {text('k.n_groups')}, ' unique') FROM k JOIN z ON z.run_id = k.run_id WHERE k.severity = 'warning' AND k.k = 1 AND z.n > {SMALL}
            UNION ALL SELECT k.run_id, cast(300 + k.k AS INT), concat('  - ', k.message, ' x', {text('k.n')}) FROM k JOIN z ON z.run_id = k.run_id WHERE k.severity = 'warning' AND k.k <= {WARNINGS_SHOWN} AND z.n > {SMALL}
            UNION ALL SELECT k.run_id, 390, concat('  (+', {text(f'k.n_groups - {WARNINGS_SHOWN}')}, ' more groups)') FROM k JOIN z ON z.run_id = k.run_id WHERE k.severity = 'warning' AND k.k = 1 AND k.n_groups > {WARNINGS_SHOWN} AND z.n > {SMALL}
            UNION ALL SELECT t.run_id, cast(500 - t.back AS INT), concat('  ', {text('t.line_no')}, ': ', t.x) FROM t JOIN z ON z.run_id = t.run_id JOIN s ON s.run_id = t.run_id WHERE t.back <= {TAIL} AND z.n > {SMALL} AND s.status <> 'PASS' AND s.n_errors = 0
            UNION ALL SELECT run_id, 600, 'No errors detected.' FROM s WHERE status = 'PASS' AND n_errors = 0)
        SELECT run_id, {d.text_agg('line', nl, 'o')} AS summary FROM parts GROUP BY run_id"""


@book.frame(summaries)
def win08_snk17_run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The text of each run's summary: small output whole, else the root error, other groups and warnings under caps; the tail of a failure that shows no error.

    Lines are cleaned and written once; groups carry their own best candidate for the root, so
    runs are told from groups, and only the last lines of a run are kept for its tail.
    """
    hold = lambda df, name: written(df, name)[0].createOrReplaceTempView(f"held_{name}")
    hold(ask(spark, d, lambda x: f"SELECT run_id, exit_code, line_no, x FROM {lines(x)} l"), "lines")
    x = Spark(lines="(SELECT *, cast(NULL AS string) AS command FROM held_lines)")
    tier = f"CASE WHEN e.file IS NOT NULL AND {W.user_path(x, 'e.file')} THEN 0 WHEN u.loc IS NOT NULL THEN 1 ELSE 2 END"
    hold(spark.sql(f"""SELECT e.run_id, e.signature, min_by(e.severity, e.line_no) AS severity, min_by(e.message, e.line_no) AS message, count(*) AS n, min(e.line_no) AS first_line, count_if(e.severity = 'error') AS n_errors, min(CASE WHEN e.severity = 'error' THEN struct({tier} AS tier, e.line_no AS line_no) END) AS root
        FROM {events(x)} e LEFT JOIN {user_locations(x)} u ON u.run_id = e.run_id AND u.ev = e.line_no GROUP BY e.run_id, e.signature"""), "clusters")
    hold(spark.sql("SELECT run_id, min_by(signature, root) FILTER (WHERE root IS NOT NULL) AS signature, sum(n_errors) AS n_errors FROM held_clusters GROUP BY run_id"), "roots")
    most = ROOT_SHOWN + max(ERRORS_SHOWN, WARNINGS_SHOWN)
    order = "PARTITION BY c.run_id, c.severity ORDER BY CASE WHEN c.signature = r.signature THEN 0 ELSE 1 END, c.n DESC, c.first_line"
    hold(spark.sql(f"""SELECT k.*, g.n_groups FROM (SELECT * FROM (SELECT c.run_id, c.severity, c.signature, c.message, c.n, c.first_line, row_number() OVER ({order}) AS k FROM held_clusters c LEFT JOIN held_roots r ON r.run_id = c.run_id) a WHERE k <= {most}) k
        JOIN (SELECT run_id, severity, count(*) AS n_groups FROM held_clusters GROUP BY run_id, severity) g ON g.run_id = k.run_id AND g.severity = k.severity"""), "ranked")
    hold(spark.sql(f"SELECT * FROM (SELECT run_id, line_no, x, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS back FROM held_lines) t WHERE back <= {max(SMALL, TAIL)}"), "tails")
    hold(spark.sql("SELECT run_id, count(*) AS n FROM held_lines GROUP BY run_id"), "counts")
    load(spark, d, "runs").createOrReplaceTempView("runs")
    runs = "(SELECT run_id, max(command) AS command, max(exit_code) AS exit_code, max(duration_s) AS duration_s, max(n_lines) AS n_lines FROM runs WHERE run_id IS NOT NULL GROUP BY run_id)"
    hold(spark.sql(f"SELECT r.*, coalesce(e.n_errors, 0) AS n_errors, CASE WHEN r.exit_code = 124 THEN 'TIMEOUT' WHEN coalesce(r.exit_code, 0) <> 0 OR coalesce(e.n_errors, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM {runs} r LEFT JOIN held_roots e ON e.run_id = r.run_id"), "statuses")
    hold(spark.sql(f"SELECT p.* FROM {profiles(Spark(lines='(SELECT l.run_id, l.line_no, l.x, c.command FROM held_lines l LEFT JOIN ' + runs + ' c ON c.run_id = l.run_id)'))} p"), "profiles")
    return spark.sql(summaries(Spark(statuses="held_statuses", ranked="held_ranked", profiles="held_profiles", counts="held_counts", tails="held_tails")))


@book.sql
def agg20_sizes(d: Spark) -> str:
    """Characters of each run's output, and of each folder's files."""
    return f"""SELECT 'run' AS kind, run_id AS name, {d.big('sum(length(x))')} AS size FROM {lines(d)} l GROUP BY run_id
        UNION ALL SELECT 'folder', {d.ext('path', '^([^/]+)/', 1)}, {d.big('sum(n)')} FROM (SELECT path, max(length(content)) AS n FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY path) f GROUP BY {d.ext('path', '^([^/]+)/', 1)}"""


@book.sql
def log14_artifacts(d: Spark) -> str:
    """Files that lines say were written."""
    p = r"(?i)\b(?:wrote|saved|generated|created|writing)\b.*?([./\w-]+\.\w{1,6})"
    return f"SELECT DISTINCT run_id, {d.ext('x', p, 1)} AS artifact FROM {lines(d)} l WHERE {d.match('x', p)}"
