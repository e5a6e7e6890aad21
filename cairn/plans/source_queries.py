"""Bullets, notes, ranges, budgets and rewriting over documents, and checks over files and sessions (SRC28, TXT29, TXT33, TXT46, FLT09, FLT14, FLT16, SCL15, MTH14-15, RWR01-08, STR09, STR11)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import words as W
from cairn.functions.checklists import draft
from cairn.functions.formats import flat_yaml, json_items
from cairn.functions.repeats import groups
from cairn.functions.rewrite import consolidate, front_value, move_sections, requests
from cairn.operators.selection import bootstrap_deltas
from cairn.plans.code_queries import files, symbols
from cairn.plans.dialect import Book, Spark, ask, rows_of
from cairn.plans.similarity_queries import RUN, SENTENCES, repeats
from cairn.plans.stats_queries import usage
from cairn.plans.text_queries import texts
from cairn.tables import load

book = Book()

#: Bullets taken of a text, lines of a range at most, milliseconds of quiet input and output, and how long a message is held at most.
BULLETS, RANGE_LINES, QUIET_INPUT, QUIET_OUTPUT, HELD = 12, 400, 4000, 1500, 120_000
#: Days that a file counts as recent.
RECENT_DAYS = 30
#: What a brief may spend by default, by kind of worker, and the factors of the levels; bounds of both.
BUDGETS = {"routing": 20, "reuse": 25, "compaction": 40, "ranking": 50}
LEVELS = {"low": 0.5, "medium": 1.0, "high": 2.0, "extreme": 4.0}
LEAST, MOST = 5, 400


def _lines(d: Spark, x: str) -> str:
    return d.split(x, "\n") if d.name == "spark" else f"string_split({x}, chr(10))"


@book.sql
def src28_bullets(d: Spark) -> str:
    """Bullets of documents as candidates under the heading above them, once a document and text."""
    head, bullet = r"^#{1,6}[ \t]+([^\n]*)$", r"^[ \t]*[-*][ \t]+([^\n]+)$"
    last = "last_value(h) IGNORE NULLS" if d.name == "spark" else "last_value(h IGNORE NULLS)"
    return f"""SELECT doc_id, scope, text, min(pos) AS pos FROM (SELECT doc_id, {d.big('pos')} AS pos, coalesce({last} OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS scope, {W.trim(d, d.ext('x', bullet, 1))} AS text
        FROM (SELECT doc_id, pos, x, CASE WHEN {d.match('x', head)} THEN {W.trim(d, d.ext('x', head, 1))} END AS h FROM {texts(d)} t {d.unnest(_lines(d, 'text'), 'x')}) l) b WHERE text <> '' GROUP BY doc_id, scope, text"""


@book.sql
def txt33_hot_bullets(d: Spark) -> str:
    """The first bullets of each text: of its marked block if it has one, else of the whole."""
    block = r"(?s)<!-- facts:begin -->(.*?)<!-- facts:end -->"
    body = f"CASE WHEN {d.match('text', block)} THEN {d.ext('text', block, 1)} ELSE text END"
    kept = d.filter(d.map(_lines(d, "body"), "y", W.trim(d, "y")), "y", "y LIKE '- %' OR y LIKE '* %'")
    return f"SELECT doc_id, {d.big('pos')} AS pos, substr(x, 3) AS bullet FROM (SELECT doc_id, {body} AS body FROM {texts(d)} t) b {d.unnest(d.slice(kept, '1', str(BULLETS)), 'x')}"


@book.sql
def txt29_str11_notes(d: Spark) -> str:
    """Notes of replies: the bullets of topic, finding and files right after a Notes line, those files kept that are there."""
    header, note = r"(?i)^\s*\**notes\**\s*:\**\s*$", r"^\s*[-*]\s+([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*(\S[^|]*?)\s*$"
    return f"""WITH l AS (SELECT doc_id, {d.big('pos')} AS pos, x, {d.match('x', header)} AS is_head, {d.match('x', note)} AS is_note FROM {texts(d)} t {d.unnest(_lines(d, 'text'), 'x')}),
        h AS (SELECT doc_id, min(pos) AS h FROM l WHERE is_head GROUP BY doc_id), n AS (SELECT l.doc_id, min(l.pos) AS n FROM l JOIN h ON h.doc_id = l.doc_id WHERE l.is_note AND l.pos > h.h GROUP BY l.doc_id),
        b AS (SELECT l.doc_id, min(l.pos) AS b FROM l JOIN h ON h.doc_id = l.doc_id LEFT JOIN n ON n.doc_id = l.doc_id WHERE l.pos > h.h AND NOT l.is_head AND NOT l.is_note AND ({W.trim(d, 'l.x')} <> '' OR l.pos > n.n) GROUP BY l.doc_id),
        k AS (SELECT l.doc_id, l.pos, {d.sub(d.ext('l.x', note, 1), '^[`*]+|[`*]+$', '')} AS topic, {d.ext('l.x', note, 2)} AS finding, {d.ext('l.x', note, 3)} AS paths FROM l JOIN h ON h.doc_id = l.doc_id LEFT JOIN b ON b.doc_id = l.doc_id WHERE l.is_note AND l.pos > h.h AND (b.b IS NULL OR l.pos < b.b)),
        p AS (SELECT doc_id, pos, topic, finding, {d.sub(d.sub('y', '^[`,]+|[`,]+$', ''), r':[0-9]+(?:-[0-9]+)?$', '')} AS path FROM (SELECT doc_id, pos AS at, topic, finding, paths FROM k) k2 {d.unnest(d.all('paths', '[^ ]+'), 'y')})
        SELECT p.doc_id, p.topic, p.finding, p.path FROM p JOIN (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL) f ON f.path = p.path"""


@book.sql
def txt46_bundle_kinds(d: Spark) -> str:
    """Whether a text is a bundle (an object that names its format) or plain."""
    m = "message" if d.name == "spark" else "CASE WHEN json_valid(message) THEN message END"
    return f"SELECT 'line' AS kind, line_id AS id, CASE WHEN {d.json(m, 'format')} IS NOT NULL THEN 'bundle' ELSE 'plain' END AS form FROM transcripts WHERE message IS NOT NULL"


@book.sql
def flt09_recent_files(d: Spark) -> str:
    """Files changed within 30 days of the newest."""
    return f"SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL AND mtime >= (SELECT max(mtime) FROM source_files) - INTERVAL '{RECENT_DAYS}' DAY"


@book.sql
def flt14_file_contains(d: Spark) -> str:
    """Whether the file of each symbol is there and holds its name, and a definition of it."""
    return f"SELECT s.id, f.content IS NOT NULL AS there, coalesce(contains(f.content, s.name), false) AS has_name, coalesce(contains(f.content, concat('def ', s.name, '(')) OR contains(f.content, concat('class ', s.name)) OR contains(f.content, concat(' ', s.name, '(')), false) AS has_head FROM {symbols(d)} s LEFT JOIN {files(d)} f ON f.path = s.path"


@book.sql
def flt16_str08_deliverable(d: Spark) -> str:
    """Lines that others put into a session, and whether each may be delivered at once, later, or is held at most two minutes, by when its user and its worker were last heard."""
    ms = lambda x: f"({d.epoch('received_at')} - {x}) / 1000"
    last = lambda t: f"max(CASE WHEN type = '{t}' THEN {d.epoch('received_at')} END) OVER (PARTITION BY session_id ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    m = "coalesce(message, '')"
    return f"""SELECT line_id, CASE WHEN asking THEN 'blocked' WHEN quiet_in IS NOT NULL AND quiet_in < {QUIET_INPUT} THEN 'wait' WHEN quiet_out IS NULL OR quiet_out >= {QUIET_OUTPUT} THEN 'deliver' ELSE 'hold' END AS verdict FROM (
        SELECT line_id, type, {d.match(m, r'(?i)enter to select|esc to cancel|do you want to (?:proceed|make this edit|create|run)|\(y/n\)|\[y/n\]')} AS asking, {ms(last('user'))} AS quiet_in, {ms(last('assistant'))} AS quiet_out FROM transcripts WHERE session_id IS NOT NULL AND received_at IS NOT NULL) t WHERE type = 'user'"""


@book.sql
def scl15_range_specs(d: Spark) -> str:
    """Range texts of noted events (N, A:B or all) as first and last line, 400 lines at most; what doesn't read has none."""
    spec = "(SELECT run_id, signature, CASE WHEN size_ = 1 THEN cast(a AS VARCHAR(20)) WHEN size_ > 40 THEN 'all' ELSE concat(a, ':', b) END AS spec FROM (SELECT run_id, signature, min(x) AS a, max(x) AS b, count(*) AS size_ FROM (SELECT run_id, signature, lines FROM log_events WHERE lines IS NOT NULL) e " + d.unnest("lines", "x") + " GROUP BY run_id, signature) g)"
    a, b = d.try_int(f"nullif({d.ext('spec', r'^([0-9]+)(?::[0-9]+)?$', 1)}, '')"), d.try_int(f"nullif({d.ext('spec', r'^[0-9]+:([0-9]+)$', 1)}, '')")
    return f"""SELECT run_id, signature, spec, first_line, CASE WHEN last_line < first_line THEN NULL ELSE least(last_line, first_line + {RANGE_LINES - 1}) END AS last_line FROM (
        SELECT run_id, signature, spec, CASE WHEN spec = 'all' THEN 1 ELSE {a} END AS first_line, CASE WHEN spec = 'all' THEN {RANGE_LINES} ELSE coalesce({b}, {a}) END AS last_line FROM {spec} s) t"""


@book.sql
def mth14_15_18_21_budgets(d: Spark) -> str:
    """Budgets of task texts: by kind and level within bounds, stated on a Budget line of their own, and tight ones from the size."""
    base = "CASE suite " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BUDGETS.items()) + " ELSE 50 END"
    level = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items()) + " END"
    line = r"(?im)^\s*[-*]?\s*\**Budget\**\s*:[^0-9\n]*([0-9]+)"
    default = f"least({MOST}, greatest({LEAST}, {d.big(d.half_even(f'{base} * {level}'))}))"
    stated = d.try_int(f"nullif({d.ext('text', line, 1)}, '')")
    return f"""SELECT item_id, level, {default} AS budget, coalesce(least({MOST}, greatest({LEAST}, {stated})), {default}) AS limit_, greatest(100, {d.big("ceil(1.3 * length(text) / 4.0 / 25) * 25")}) AS tight
        FROM eval_items CROSS JOIN (SELECT 'low' AS level UNION ALL SELECT 'medium' UNION ALL SELECT 'high' UNION ALL SELECT 'extreme') l"""


@book.sql
def flt01_02_trials(d: Spark) -> str:
    """Answers without tokens, which a model never gave, and whether a session's model is of one family, by the part after its last colon."""
    return f"SELECT line_id, coalesce(input_tokens, 0) = 0 AND coalesce(output_tokens, 0) = 0 AS infra_error, coalesce({d.sub('model', '^.*:', '')} LIKE 'fern%', false) AS invoked FROM {usage(d)} u WHERE type = 'assistant'"


@book.frame()
def rwr01_section_moves(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their background and example sections moved out: the text with pointers, the texts moved, tokens before and after."""
    make = lambda i, t: [(i, r[0], json.dumps(r[1], ensure_ascii=False), len(r[1]), r[2], r[3]) for r in [move_sections(t)] if r[1]]
    return rows_of(_texts_of(spark, d), make, "doc_id bigint, text string, moved string, n bigint, before bigint, after bigint")


def _texts_of(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, lambda x: f"SELECT doc_id, text FROM {texts(x)} t")


@book.frame()
def rwr02_07_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with each group of repeated sentences brought to its longest member, where it first stands; members not found as they stand are counted."""

    def make(i: int, t: str, _: list[str], sentences: list[str]) -> list[tuple]:
        found, lost = groups(sentences, SENTENCES, RUN), 0
        for m, _j in found:
            g = [sentences[k] for k in m]
            t, missing = consolidate(t, g, 0, max(g, key=len))
            lost += len(missing)
        return [(i, t, len(found), lost)] if found else []

    return repeats(spark, d, make, "doc_id bigint, text string, n_groups bigint, n_missing bigint")


@book.frame()
def rwr08_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose description is replaced by its first sentence, whatever lines the old value took."""
    docs = _texts_of(spark, d).where(F.col("text").rlike(r"(?sm)\A---\n.*?^description:"))
    first = F.regexp_extract("text", r"(?m)^description:[ \t]*(.*?[.!?](?:\s|$)|[^\n]*)", 1)
    return rows_of(docs.select("doc_id", "text", F.trim(first).alias("value")), lambda i, t, v: [(i, front_value(t, "description", v))] if v else [], "doc_id bigint, text string")


@book.frame()
def rwr03_requests(spark: SparkSession, d: str) -> DataFrame:
    """The requests that a rewriting at each level makes of a document: none, its description, or that with its repeats and filler."""
    filler = ask(spark, d, lambda x: f"SELECT doc_id, count(*) AS n FROM {texts(x)} t {x.unnest(W.sentences(x, 'text'), 's')} WHERE {W.is_filler(x, 's')} GROUP BY doc_id")
    own = repeats(spark, d, lambda i, _, p, x: [(i, len(groups(x, SENTENCES, RUN)))], "doc_id bigint, repeats bigint")
    docs = own.join(filler.withColumnRenamed("n", "filler"), "doc_id", "left")
    make = lambda i, r, f: [(i, level, kind, n) for level in ("none", "slight", "lot") for kind, n in requests(level, r, f or 0)]
    return rows_of(docs, make, "doc_id bigint, level string, kind string, n bigint")


@book.frame()
def str09_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as keystrokes: lines entered, and lines that can't be trusted as a tab was among them."""

    def make(i: int, t: str) -> list[tuple]:
        got = draft(t.replace("\n", "\r"))
        return [(i, len(got), sum(x is None for x in got))]

    return rows_of(_texts_of(spark, d), make, "doc_id bigint, n_lines bigint, n_untrusted bigint")


@book.frame()
def snk08_12_summary(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the summary of trials, one per task and arm with its interval: the table behind the figure."""
    e = load(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 3).cast("string").alias("arm"), "value")
    b = bootstrap_deltas(e, "event_id", "event_type", "arm", "value", "0")
    return b.select("task", "arm", F.format_string("| %s | %s | %.2f %% | [%.2f, %.2f] |", "task", "arm", "delta", "lo", "hi").alias("line"))


@book.frame("""SELECT u AS seq, user_id, event_type, CASE WHEN n > 1 THEN 'again' ELSE 'first' END AS state FROM (SELECT event_id AS u, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) t""")
def set12_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """Marks carried over to rows of the same user and type: the first is new, later ones keep its mark."""
    e = load(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    first = e.groupBy("user_id", "event_type").agg(F.min("seq").alias("first"))
    return e.join(first, ["user_id", "event_type"]).select("seq", "user_id", "event_type", F.when(F.col("seq") > F.col("first"), "again").otherwise("first").alias("state"))


#: Keys that a spec has to have.
REQUIRED = ("name", "description")


@book.frame()
def src30_31_specs(spark: SparkSession, d: str) -> DataFrame:
    """Front blocks read as flat keys and values, and which required keys they lack."""
    docs = _texts_of(spark, d).where(F.col("text").startswith("---\n")).select("doc_id", F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1).alias("block"))

    def make(i: int, block: str) -> list[tuple]:
        keys = flat_yaml(block)
        return [(i, ",".join(sorted(keys)), ",".join(k for k in REQUIRED if not keys.get(k)))]

    return rows_of(docs.where("block != ''"), make, "doc_id bigint, keys string, missing string")


@book.frame("SELECT line_id, 1::BIGINT AS n FROM transcripts WHERE json_valid(message) AND json_type(message::JSON) <> 'ARRAY'")
def src29_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Items of JSON written one after another in each line, where it reads to the end: one of a whole message."""
    m = load(spark, d, "transcripts").where("message is not null").select("line_id", "message")
    return rows_of(m, lambda i, t: [(i, len(x))] if (x := json_items(t)) else [], "line_id bigint, n bigint")
