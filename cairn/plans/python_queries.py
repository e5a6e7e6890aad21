"""Queries whose operators need Python or a stream: symbols, shell commands, formats, rewriting, sinks and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.code_symbols import cpp_symbols, python_symbols
from cairn.functions.formats import list_id, manifest
from cairn.functions.rewrite import without_repeats
from cairn.functions.shell import decision, is_long, routed, tool_observations
from cairn.functions.checklists import checklist
from cairn.operators.nested import nested_objects
from cairn.operators.selection import bootstrap_deltas, greedy_selection
from cairn.plans.dialect import Book, rows_of
from cairn.session import shared_path
from cairn.sources.sinks import KeyedTable, fact_blocks, merge_block, write_records
from cairn.streaming.stateful import call_budgets, drain, follow, once, repeated_briefs, running_stats
from cairn.tables import load

book = Book()

#: The program that commands with long output are sent through.
WRAPPER = "condense"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_files").where("path is not null and content is not null").groupBy("path").agg(F.max("language").alias("language"), F.max("content").alias("content"))


@book.frame()
def txt34_python_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of Python files by their syntax trees."""
    make = lambda p, x: [(p, *s[:6], " ".join(s[6])) for s in python_symbols(x)[0]]
    return rows_of(_sources(spark, d).where("language = 'python'").select("path", "content"), make, "path string, qualname string, name string, type string, start_line bigint, end_line bigint, parent string, calls string")


@book.frame()
def txt35_37_cpp_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of C++ files by the braces of the blanked text."""
    make = lambda p, x: [(p, *s[:6], " ".join(s[6])) for s in cpp_symbols(x)]
    return rows_of(_sources(spark, d).where("language = 'cpp'").select("path", "content"), make, "path string, qualname string, name string, type string, start_line bigint, end_line bigint, parent string, calls string")


@book.frame()
def txt25_27_48_str01_observations(spark: SparkSession, d: str) -> DataFrame:
    """What the tool calls of transcripts read and searched: reads, searches by tool or pattern, shell commands."""
    o = nested_objects(load(spark, d, "transcripts")).where("block")
    v = F.try_parse_json("json")
    text = lambda p: F.try_variant_get(v, p, "string")
    inner = F.coalesce(F.try_parse_json(text("$.input")), F.try_variant_get(v, "$.input", "variant"))
    names = ("command", "file_path", "pattern", "path", "glob")
    calls = o.where(text("$.type") == "tool_use").select("line_id", text("$.name").alias("tool"), *(F.try_variant_get(inner, f"$.{n}", "string").alias(n) for n in names))
    make = lambda i, t, *x: [(i, k, y) for k, y in tool_observations(t, dict(zip(names, x)))]
    return rows_of(calls, make, "line_id bigint, kind string, value string")


@book.frame()
def txt28_43_flt18_routing(spark: SparkSession, d: str) -> DataFrame:
    """Commands that print much, and what the routing does with each by mode."""
    c = load(spark, d, "runs").where("command is not null").select("command").distinct()
    modes = ("redirect", "ask", "rewrite", "off")

    def make(x: str) -> list[tuple]:
        got = [decision("Bash", x, False, m, WRAPPER) for m in modes]
        return [(x, is_long(x, WRAPPER), *(g[0] if g else "none" for g in got), routed(x, WRAPPER, True))]

    return rows_of(c, make, "command string, is_long boolean, redirect string, ask string, rewrite string, off string, moved string")


@book.frame()
def txt39_checklists(spark: SparkSession, d: str) -> DataFrame:
    """The last list of each text that is meant for its reader: title, kind, items, how many are done, and its id."""
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", "text")

    def make(i: int, t: str) -> list[tuple]:
        c = checklist(t)
        return [(i, c[0], c[1], len(c[2]), sum(x for _, x in c[2]), list_id([x for x, _ in c[2]]))] if c else []

    return rows_of(docs, make, "doc_id bigint, title string, kind string, n bigint, n_done bigint, list_id string")


@book.frame()
def win09_13_set01_greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    """Longest texts of each source first that still fit 5,000 tokens."""
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return greedy_selection(docs, "source", "doc_id", "n_chars", "tokens", 5000)


@book.frame()
def mth13_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percent differences of arms to arm 0 with resampled intervals."""
    e = load(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 3).cast("string").alias("arm"), "value")
    return bootstrap_deltas(e, "event_id", "event_type", "arm", "value", "0")


@book.frame()
def rwr09_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Documents with repeated sentences taken out."""
    make = lambda i, t: [(i, *without_repeats(t))]
    return rows_of(load(spark, d, "documents").where("text is not null").select("doc_id", "text"), make, "doc_id bigint, text string, removed bigint")


@book.frame()
def scl40_list_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id of each document's list."""
    items = F.regexp_extract_all("text", F.lit(r"(?m)^(?:[-*]|\d+\.) (.+)$"), F.lit(1))
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", items.alias("i")).where("size(i) > 0")
    return rows_of(docs, lambda i, x: [(i, list_id(x), len(x))], "doc_id bigint, list_id string, n bigint")


@book.frame()
def src26_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Packages that manifests among the files provide and need."""
    make = lambda p, t: [(p, *(" ".join(x) for x in manifest(p.rpartition("/")[2], t)))]
    names = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "requirements.txt")
    return rows_of(_sources(spark, d).where(F.substring_index("path", "/", -1).isin(*names)).select("path", "content"), make, "path string, provides string, needs string")


@book.frame("SELECT event_id, user_id, event_type, value FROM events")
def snk01_03_records(spark: SparkSession, d: str) -> DataFrame:
    """Events written as records and read again."""
    path = shared_path(spark, "records")
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    write_records(e, path)
    return spark.read.schema(e.schema).json(path)


@book.frame("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) t WHERE k = 1 AND user_id % 10 <> 3")
def snk04_06_set04_08_keyed_table(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user by two upserts and a delete."""
    e = load(spark, d, "events").select("user_id", "event_id", "value")
    t = KeyedTable(spark, shared_path(spark, "keyed"), "user_id")
    t.upsert(e.where("event_id % 2 = 0"), "event_id")
    t.upsert(e.where("event_id % 2 = 1"), "event_id")
    t.delete(e.where("user_id % 10 = 3"))
    return t.read()


@book.frame("SELECT scope, 0 AS part, string_agg('- ' || lang, chr(10) ORDER BY lang) AS block FROM (SELECT DISTINCT lower(source) AS scope, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) t GROUP BY scope")
def snk07_fact_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Bullets of each scope in blocks."""
    return fact_blocks(load(spark, d, "documents").select(F.lower("source").alias("scope"), F.col("lang").alias("text")))


@book.frame("SELECT scope, n, '<!-- facts:begin -->' || chr(10) || block || chr(10) || '<!-- facts:end -->' AS region FROM (SELECT lower(source) AS scope, count(DISTINCT lang) AS n, string_agg(DISTINCT '- ' || lang, chr(10) ORDER BY '- ' || lang) AS block FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY lower(source)) t")
def snk07_14_merged_regions(spark: SparkSession, d: str) -> DataFrame:
    """The marked region that each scope's facts give, put into a text that has an old one."""
    b = fact_blocks(load(spark, d, "documents").select(F.lower("source").alias("scope"), F.col("lang").alias("text")))
    old = "# Facts\n\n<!-- facts:begin -->\n- gone\n<!-- facts:end -->\n"
    make = lambda s, x: [(s, x.count("\n") + 1, merge_block(old, x).removeprefix("# Facts\n\n").removesuffix("\n"))]
    return rows_of(b.where("part = 0").select("scope", "block"), make, "scope string, n bigint, region string")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    s = follow(spark, f"{d}/transcripts.parquet", load(spark, d, "transcripts").schema)
    return s.where("type = 'assistant'").select("session_id", (F.col("line_no").cast("bigint") * 10_000_000 + F.col("line_id")).alias("seq"), F.lit("call").alias("kind"), F.regexp_extract("message", '"description": ?"([^"\\\\]+)"', 1).alias("text"))


@book.frame("""WITH a AS (SELECT session_id, line_no, line_id, coalesce(message, '') LIKE '%"stop_reason": "end_turn"%' AS stops FROM transcripts WHERE type = 'assistant' AND session_id IS NOT NULL),
    g AS (SELECT *, coalesce(sum(CASE WHEN stops THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM a)
    SELECT line_id, n, CASE WHEN n > 5 THEN 'deny' WHEN n > 2 THEN 'warn' ELSE 'allow' END AS verdict FROM (SELECT line_id, count(*) OVER (PARTITION BY session_id, turn ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g) t""")
def str02_04_05_streamed_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The call counter as a stream with keyed state, five calls a turn: the end of a turn forgets it."""
    s = follow(spark, f"{d}/transcripts.parquet", load(spark, d, "transcripts").schema).where("type = 'assistant' and session_id is not null")
    seq = 2 * (F.col("line_no").cast("bigint") * 10_000_000 + F.col("line_id"))
    ends = F.when(F.coalesce("message", F.lit("")).contains('"stop_reason": "end_turn"'), F.array(F.lit("call"), F.lit("stop"))).otherwise(F.array(F.lit("call")))
    e = s.select("session_id", seq.alias("at"), F.posexplode(ends).alias("i", "kind")).select("session_id", (F.col("at") + F.col("i")).alias("seq"), "kind")
    return drain(spark, call_budgets(e, limit=5, live_ms=None)).select((F.floor(F.col("seq") / 2) % 10_000_000).alias("line_id"), "n", "verdict")


@book.frame("SELECT session_id, line_id FROM (SELECT session_id, line_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no, line_id) AS k FROM transcripts WHERE type = 'assistant') t WHERE k = 1")
def str06_streamed_once(spark: SparkSession, d: str) -> DataFrame:
    """The nudge as a stream: the first answer of each session."""
    return drain(spark, once(_answers(spark, d), live_ms=None)).select("session_id", (F.col("seq") % 10_000_000).alias("line_id"))


@book.frame()
def str07_streamed_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Briefs of sessions against those let through before."""
    return drain(spark, repeated_briefs(_answers(spark, d).where("text != ''"), live_ms=None))


@book.frame("""SELECT k AS key, count(*) AS accesses, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS sessions FROM (SELECT concat(user_id, ':', event_type) AS k, ts FROM events) t GROUP BY k""")
def str03_streamed_stats(spark: SparkSession, d: str) -> DataFrame:
    """Key stats as a stream; the last row of each key, where no key has over 32 days."""
    s = follow(spark, f"{d}/events.parquet", load(spark, d, "events").schema)
    e = s.select(F.concat("user_id", F.lit(":"), "event_type").alias("key"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("session"), F.col("value").alias("cost"))
    return drain(spark, running_stats(e, live_ms=None)).groupBy("key").agg(F.max("accesses").alias("accesses"), F.max("sessions").alias("sessions"))
