"""Statistics, values and budgets (MTH, AGG02-AGG14, WIN02, WIN09-WIN15, TOP) over events, runs and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import words as W
from cairn.operators.selection import running_sum
from cairn.plans.dialect import Book, Spark, ask

book = Book()

# The normal quantile of a two-sided 95 % interval, and Student's for 1 to 30 degrees of freedom.
Z = 1.959963984540054
T95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def t_crit(d: Spark, df: str) -> str:
    """Student's quantile: the table, between its entries a line, above it the Cornish-Fisher series."""
    table = ("array(" if d.name == "spark" else "[") + ", ".join(f"{x}D" if d.name == "spark" else f"{x}" for x in T95) + (")" if d.name == "spark" else "]")
    lo, hi = f"greatest(1, cast(floor({df}) AS INT))", f"greatest(1, cast(ceil({df}) AS INT))"
    line = f"({d.at(table, lo)} + ({d.at(table, hi)} - {d.at(table, lo)}) * ({df} - floor({df})))"
    above = f"({Z} + {Z**3 + Z} / (4 * {df}) + {5 * Z**5 + 16 * Z**3 + 3 * Z} / (96 * {df} * {df}))"
    return f"(CASE WHEN {df} IS NULL OR {df} <= 0 THEN NULL WHEN {df} <= 30 THEN {line} ELSE {above} END)"


def wilson(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"(cast({k} AS DOUBLE) / nullif({n}, 0))", f"cast({Z * Z} AS DOUBLE)"
    denom = f"(1 + {z2} / nullif({n}, 0))"
    centre = f"(({p} + {z2} / (2.0 * nullif({n}, 0))) / {denom})"
    half = f"({Z} * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z2} / (4.0 * nullif({n}, 0) * nullif({n}, 0))) / {denom})"
    return f"greatest(0.0, {centre} - {half})", f"least(1.0, {centre} + {half})"


ARMS = "(SELECT event_type AS task, user_id % 3 AS arm, value, value > 50 AS passed FROM events WHERE value IS NOT NULL)"
MOMENTS = f"(SELECT task, arm, count(*) AS n, count_if(passed) AS k, avg(value) AS m, stddev_samp(value) AS sd, var_samp(value) AS v FROM {ARMS} a GROUP BY task, arm)"


@book.sql
def mth01_03_agg05_arm_statistics(d: Spark) -> str:
    """Trials, passes with Wilson interval, and mean with t interval of each task and arm."""
    lo, hi = wilson("k", "n")
    half = f"{t_crit(d, '(n - 1.0)')} * sd / sqrt(n)"
    return f"SELECT task, arm, n, k, round(k * 1.0 / n, 6) AS rate, round({lo}, 6) AS rate_lo, round({hi}, 6) AS rate_hi, round(m, 6) AS mean, round(m - {half}, 6) AS mean_lo, round(m + {half}, 6) AS mean_hi FROM {MOMENTS} t"


@book.sql
def mth04_05_agg06_arm_deltas(d: Spark) -> str:
    """Differences of each arm to arm 0: Welch interval of means, Newcombe interval of rates, percent."""
    la, ha = wilson("a.k", "a.n")
    lb, hb = wilson("b.k", "b.n")
    df = "(va + vb) * (va + vb) / nullif(va * va / (na - 1) + vb * vb / (nb - 1), 0)"
    half = f"{t_crit(d, 'df')} * sqrt(va + vb)"
    return f"""WITH s AS (SELECT a.task, a.arm, a.n AS na, b.n AS nb, a.m - b.m AS diff, b.m AS base, a.v / a.n AS va, b.v / b.n AS vb, cast(a.k AS DOUBLE) / a.n AS pa, cast(b.k AS DOUBLE) / b.n AS pb, {la} AS la, {ha} AS ha, {lb} AS lb, {hb} AS hb
        FROM {MOMENTS} a JOIN {MOMENTS} b ON a.task = b.task AND b.arm = 0 WHERE a.arm <> 0), f AS (SELECT *, {df} AS df FROM s)
        SELECT task, arm, round(diff, 6) AS diff, round(diff - {half}, 6) AS lo, round(diff + {half}, 6) AS hi, round(100 * diff / base, 6) AS pct,
        round(pa - pb, 6) AS rate_diff, round(pa - pb - sqrt((pa - la) * (pa - la) + (hb - pb) * (hb - pb)), 6) AS rate_lo, round(pa - pb + sqrt((ha - pa) * (ha - pa) + (pb - lb) * (pb - lb)), 6) AS rate_hi FROM f"""


@book.sql
def src04_06_torn_lines(d: Spark) -> str:
    """Lines of each type that read, and that are torn or missing."""
    ok = "try_parse_json(message) IS NOT NULL" if d.name == "spark" else "json_valid(message)"
    return f"SELECT type, count(*) AS n, count_if(message IS NULL) AS n_null, count_if(message IS NOT NULL AND NOT coalesce({ok}, false)) AS n_torn FROM transcripts GROUP BY type"


def usage(d: Spark) -> str:
    """One row per line with a message: id and token counters."""
    v = "try_parse_json(message) IS NOT NULL" if d.name == "spark" else "json_valid(message)"
    m = "message" if d.name == "spark" else "CASE WHEN json_valid(message) THEN message END"
    cols = ", ".join(f"{d.try_int(d.json(m, f'usage.{c}'))} AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))
    return f"(SELECT line_id, session_id, line_no, type, received_at, {d.json(m, 'id')} AS id, {d.json(m, 'model')} AS model, {cols} FROM transcripts WHERE message IS NOT NULL AND {v})"


@book.sql
def src18_20_agg12_usage(d: Spark) -> str:
    """Sessions and token sums by model, each message id once."""
    sums = ", ".join(f"{d.big(f'coalesce(sum({c}), 0)')} AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))
    return f"""SELECT coalesce(model, '') AS model, count(DISTINCT session_id) AS sessions, count(*) AS messages, {sums} FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY output_tokens DESC NULLS LAST, line_id) AS k FROM {usage(d)} u WHERE id IS NOT NULL AND id <> '') t WHERE k = 1 GROUP BY coalesce(model, '')"""


@book.sql
def src19_last_totals(d: Spark) -> str:
    """The last counters of each session, cached input taken off."""
    return f"""SELECT session_id, input_tokens, greatest(0, input_tokens - coalesce(cache_read_input_tokens, 0)) AS fresh, output_tokens FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC, line_id DESC) AS k FROM {usage(d)} u WHERE output_tokens IS NOT NULL) t WHERE k = 1"""


@book.sql
def src21_attributed_tokens(d: Spark) -> str:
    """Cache tokens of messages that directly follow a tool's result, by session."""
    return f"""SELECT session_id, {d.big('sum(CASE WHEN before = ' + chr(39) + 'user' + chr(39) + ' THEN coalesce(cache_creation_input_tokens, 0) ELSE 0 END)')} AS attributed, {d.big('sum(coalesce(cache_creation_input_tokens, 0))')} AS total FROM (
        SELECT *, lag(type) OVER (PARTITION BY session_id ORDER BY line_no, line_id) AS before FROM {usage(d)} u) t WHERE type = 'assistant' GROUP BY session_id"""


@book.sql
def src22_last_locations(d: Spark) -> str:
    """The file that each session touched last."""
    p = r'"file_path": ?"([^"\\]+)"'
    return f"""SELECT session_id, path FROM (SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC, line_id DESC) AS k
        FROM (SELECT session_id, line_no, line_id, {d.ext('message', p, 1)} AS path FROM transcripts WHERE message IS NOT NULL) t WHERE path <> '') u WHERE k = 1"""


@book.sql
def src40_first_user_messages(d: Spark) -> str:
    """What each session was first asked, where that is plain text."""
    m = "message" if d.name == "spark" else "CASE WHEN json_valid(message) THEN message END"
    return f"""SELECT session_id, brief FROM (SELECT session_id, {d.json(m, 'content')} AS brief, row_number() OVER (PARTITION BY session_id ORDER BY line_no, line_id) AS k FROM transcripts
        WHERE type = 'user' AND {d.match("coalesce(message, '')", r'^.*"content": ?"[^"\\]*"')} AND message LIKE '%}}') t WHERE k = 1"""


@book.sql
def mth17_23_totals(d: Spark) -> str:
    """Token totals and prompt sizes by message."""
    s = " + ".join(f"coalesce({c}, 0)" for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))
    return f"SELECT line_id, {s} AS total, coalesce(input_tokens, 0) + coalesce(cache_read_input_tokens, 0) + coalesce(cache_creation_input_tokens, 0) AS prompt FROM {usage(d)} u WHERE type = 'assistant'"


@book.sql
def src05_jon14_resume(d: Spark) -> str:
    """Commands run but without a noted event: what is left to look at."""
    key = lambda c: f"trim({d.sub(c, r'\s+', ' ')})"
    return f"""SELECT k, count(*) AS n_runs FROM (SELECT DISTINCT run_id, {key('command')} AS k FROM runs WHERE command IS NOT NULL AND run_id IS NOT NULL) r
        WHERE NOT EXISTS (SELECT 1 FROM log_events e WHERE e.run_id = r.run_id) GROUP BY k"""


#: Tokens that kept keys may have.
KEPT_TOKENS = 8000
KEYS = "(SELECT event_id, concat(user_id, ':', event_type) AS k, user_id, event_type, value, ts, cast(floor(value / 100) AS BIGINT) AS hash FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"


#: What a failure, and a fact of which no failure is recorded, counts as lost.
FAILURE_COST, FACT_FAILURE = 150, 150


def stats(d: Spark) -> str:
    return f"""(SELECT k, max(event_type) AS kind, count(*) AS accesses, count(DISTINCT {d.day('ts')}) AS sessions, sum(value) AS cost, sum(CASE WHEN value > 200 THEN {FAILURE_COST} ELSE 0 END) AS failures, count_if(hash <> before) AS changes, max({d.epoch('ts')}) / 1000000.0 AS last_access
        FROM (SELECT *, lag(hash) OVER (PARTITION BY k ORDER BY ts, event_id) AS before FROM {KEYS} e) w GROUP BY k)"""


@book.sql
def agg02_key_stats(d: Spark) -> str:
    """Accesses, distinct sessions, costs and source changes of each key."""
    return f"SELECT k, accesses, sessions, round(cost, 4) AS cost, changes FROM {stats(d)} s"


def valued(d: Spark) -> str:
    """Value of each key: what repeats and failures cost, by stability and decay, per token kept.

    The first session is sunk cost; a purchase is a fact, which counts a failure even where
    none is recorded and no session is known; a view is critical and never decays.
    """
    top = f"(SELECT max({d.epoch('ts')}) / 1000000.0 AS now FROM events)"
    decay = "CASE WHEN kind = 'view' THEN 1.0 ELSE power(0.5, greatest(0.0, (now - last_access) / 86400.0) / 30.0) END"
    failure = f"CASE WHEN failures = 0 AND kind = 'purchase' AND sessions = 0 THEN {FACT_FAILURE} ELSE failures END"
    return f"""(SELECT *, ((greatest(1, sessions) - 1) * (cost / greatest(1, accesses)) + failure) * stability * decay / greatest(1, cast(ceil(length(k) / 4.0) AS INT)) AS value FROM (
        SELECT k, kind, accesses, sessions, cost, changes, {failure} AS failure, 1.0 / (1 + changes) AS stability, {decay} AS decay, cast(greatest(1, length(k) * 3) AS BIGINT) AS tokens FROM {stats(d)} s CROSS JOIN {top} n) f)"""


@book.sql
def mth06_10_19_20_values(d: Spark) -> str:
    """Value of keeping each key, with its parts."""
    return f"SELECT k, failure, round(stability, 6) AS stability, round(decay, 6) AS decay, round(value, 6) AS value, tokens FROM {valued(d)} v"


@book.sql
def top04_candidates(d: Spark) -> str:
    """Keys over a threshold, most valuable first."""
    return f"SELECT k, round(value, 6) AS value FROM {valued(d)} v WHERE value >= 1 ORDER BY value DESC, k"


@book.frame(lambda d: f"SELECT k, tokens FROM (SELECT k, tokens, sum(tokens) OVER () AS total, coalesce(sum(tokens) OVER (ORDER BY value, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM {valued(d)} v) t WHERE total - freed > {KEPT_TOKENS}")
def win11_evictions(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest keys to give up until the rest fits the budget."""
    v = ask(spark, d, lambda x: f"SELECT k, tokens, value FROM {valued(x)} v")
    return running_sum(v, [F.asc("value"), F.asc("k")], "tokens").where(F.col("total") - (F.col("upto") - F.col("tokens")) > KEPT_TOKENS).select("k", "tokens")


@book.sql
def agg13_14_flt05_savings(d: Spark) -> str:
    """Savings of keys that pay, in total and by kind."""
    return f"""SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(sum(saved), 4) AS saved, {d.big('sum(tokens)')} AS tokens FROM (
        SELECT split_part(k, ':', 2) AS kind, greatest(0.0, cost - tokens) AS saved, tokens FROM {valued(d)} v WHERE value > 0) t GROUP BY GROUPING SETS ((kind), ())"""


@book.sql
def win02_last_per_key(d: Spark) -> str:
    """The last five observations of each key."""
    return f"SELECT k, event_id FROM (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS back FROM {KEYS} e) t WHERE back <= 5"


@book.sql
def agg23_maintenance(d: Spark) -> str:
    """Observations by what upkeep does with them."""
    return f"SELECT CASE WHEN back <= 5 THEN 'kept' ELSE 'pruned' END AS fate, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS back FROM {KEYS} e) t GROUP BY CASE WHEN back <= 5 THEN 'kept' ELSE 'pruned' END"


@book.sql
def src33_36_observations(d: Spark) -> str:
    """Observations of reads, searches and failures with their costs."""
    return f"""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'fact' WHEN 'click' THEN 'search' ELSE 'read' END AS kind, CASE WHEN event_type = 'click' THEN 30 ELSE {W.tokens_half_even(d, 'props')} END AS cost,
        CASE WHEN value > 200 THEN 150 ELSE 0 END AS failure_cost FROM events"""


@book.sql
def str02_call_budgets(d: Spark) -> str:
    """Batch twin of the call counter: each call's number in its session, and what the budget says."""
    return """SELECT line_id, n, CASE WHEN n > 40 THEN 'deny' WHEN n > 37 THEN 'warn' ELSE 'allow' END AS verdict FROM (
        SELECT line_id, count(*) OVER (PARTITION BY session_id ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM transcripts WHERE type = 'assistant') t"""


@book.sql
def str06_once_per_session(d: Spark) -> str:
    """Batch twin of the nudge: the first answer of each session."""
    return "SELECT session_id, line_id FROM (SELECT session_id, line_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no, line_id) AS k FROM transcripts WHERE type = 'assistant') t WHERE k = 1"


@book.sql
def agg09_mth22_src41_calibration(d: Spark) -> str:
    """Characters per word by kind of text, and how far single texts are off."""
    code = f"length(text) - length({W.strip_code(d, 'text')})"
    n = d.size(d.all("text", "[A-Za-z0-9_]+"))
    return f"""WITH s AS (SELECT CASE WHEN {code} > 40 THEN 'code' ELSE 'prose' END AS kind, length(text) AS chars, {n} AS words FROM documents WHERE text IS NOT NULL AND length(text) >= 40),
        r AS (SELECT kind, sum(chars) * 1.0 / sum(words) AS ratio FROM s WHERE words > 0 GROUP BY kind)
        SELECT s.kind, round(max(ratio), 6) AS ratio, round(min(100 * (chars / ratio - words) / words), 4) AS worst_low, round(max(100 * (chars / ratio - words) / words), 4) AS worst_high FROM s JOIN r ON s.kind = r.kind WHERE words > 0 GROUP BY s.kind"""


@book.sql
def win10_12_prefix_budgets(d: Spark) -> str:
    """Texts of each source in order until the first that doesn't fit 20,000 tokens."""
    return f"""SELECT doc_id, source, upto FROM (SELECT doc_id, source, {d.big('sum(t) OVER (PARTITION BY source ORDER BY t, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS upto
        FROM (SELECT doc_id, source, {W.tokens_half_even(d, 'text')} AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) a) b WHERE upto <= 20000"""


def trials(d: Spark) -> str:
    return f"(SELECT item_id, rep, {d.sha1("concat('42:', item_id, ':', rep)")} AS h FROM (SELECT item_id, {d.big('rep')} AS rep FROM eval_items CROSS JOIN (SELECT 1 AS rep UNION ALL SELECT 2 UNION ALL SELECT 3) r) t)"


@book.frame(lambda d: f"SELECT item_id, rep, row_number() OVER (ORDER BY rep, h, item_id) AS place FROM {trials(d)} t")
def win14_trial_order(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by repetition, in an order that a seed shuffles."""
    t = ask(spark, d, lambda x: f"SELECT item_id, rep, h, 1 AS one FROM {trials(x)} t")
    return running_sum(t, [F.asc("rep"), F.asc("h"), F.asc("item_id")], "one").select("item_id", "rep", F.col("upto").alias("place"))


@book.sql
def win15_flt13_15_checks(d: Spark) -> str:
    """Checks of texts: one stated number, all needles there, within a budget."""
    return f"""SELECT item_id, {d.size(d.distinct(d.all('text', r'within ([0-9]+) ms')))} = 1 AS one_answer, text LIKE '%the%' AND text LIKE '%.%' AS has_all, {W.tokens_half_even(d, 'text')} <= 150 AS fits FROM eval_items"""


@book.sql
def flt10_11_card_states(d: Spark) -> str:
    """Documents that call themselves obsolete, and whether they are newer than the runs' end."""
    return f"""SELECT doc_id, {d.match("coalesce(text, '')", r'(?i)\b(?:obsolete|deprecated|archived)\b')} AS obsolete, CASE WHEN added_at IS NULL THEN 'unknown' WHEN added_at >= (SELECT max(started_at) FROM runs) THEN 'current' ELSE 'stale' END AS state FROM documents"""


@book.sql
def agg21_session_merges(d: Spark) -> str:
    """Batches merged: counters summed, flags anded, models listed once."""
    return f"""SELECT batch_id, count(*) AS n, {d.big('coalesce(sum(o), 0)')} AS output_tokens, bool_and(m IS NOT NULL) AS all_named, {d.gather_set('m')} AS models FROM (
        SELECT t.batch_id, u.output_tokens AS o, u.model AS m FROM transcripts t JOIN {usage(d)} u ON u.line_id = t.line_id WHERE t.type = 'assistant') x GROUP BY batch_id"""


@book.sql
def agg22_outline(d: Spark) -> str:
    """Sources with their languages, one line each."""
    return f"SELECT source, {d.join(d.gather_set('lower(lang)'), ', ')} AS langs, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source"


@book.sql
def top05_presets(d: Spark) -> str:
    """Size class of each source by its documents."""
    return "SELECT source, CASE WHEN count(*) < 2 THEN 'small' WHEN count(*) < 10 THEN 'medium' ELSE 'large' END AS preset FROM documents WHERE source IS NOT NULL GROUP BY source"
