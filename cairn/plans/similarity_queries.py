"""Near duplicates, contradictions, graphs and retrieval (JON16-JON18, JON23-JON30, GRA, AGG15-AGG19, SET, RWR)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import words as W
from cairn.functions.repeats import groups, longest_run, word_sequence
from cairn.operators.graph import cycle_links, distances
from cairn.operators.similarity import contradictions, near_duplicates, repeated
from cairn.plans.code_queries import files, imports
from cairn.plans.dialect import SPARK, Book, Spark, ask, rows_of
from cairn.plans.text_queries import texts
from cairn.session import written
from cairn.tables import load

book = Book()

_SIMILAR = r"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
    h AS (SELECT id, w, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE 'id:' || id END AS h FROM w), r AS (SELECT h, min(id) AS rep FROM h GROUP BY h),
    s AS (SELECT DISTINCT h.id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM h JOIN r ON h.id = r.rep, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 4))) AS i) WHERE len(w) > 0),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
    p AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k * 1.0 / (x.n + y.n - k) >= 0.8),
    e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
    t AS (SELECT a, a AS m FROM e UNION SELECT e.a, t.m FROM e JOIN t ON e.b = t.a), g AS (SELECT a, min(m) AS m FROM t GROUP BY a)
    SELECT h.id, coalesce(g.m, r.rep) AS class_id, coalesce(l.n_links, 0) AS n_links FROM h JOIN r ON r.h = h.h LEFT JOIN l ON l.a = r.rep LEFT JOIN g ON g.a = r.rep"""


@book.frame(_SIMILAR)
def jon17_gra02_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Class and links of each document by five-word shingles at similarity 0.8."""
    return near_duplicates(load(spark, d, "documents"))


#: Overlap of words from which paragraphs and sentences of a document repeat each other, and the words in a row that do it for sentences.
PARAGRAPHS, SENTENCES, RUN = 0.6, 0.45, 6


def blocks(d: Spark) -> tuple[str, str]:
    """Paragraphs of at least 8 words and sentences of at least 6 of ``text``, as they stand, as arrays."""
    n = lambda x: d.size(d.all(W.strip_code(d, x), r"[^ \n\t\r]+"))
    nl = d.lit("\n") if d.name == "spark" else "chr(10)"
    paras = d.filter(d.map(d.split(d.sub(d.sub("text", W.FENCE, "\n\n"), r"\n\s*\n", "\x01"), chr(1)), "y", W.trim(d, "y")), "y", "y <> ''")
    marked = d.sub(d.sub(d.sub("text", W.FENCE, "\x01"), W.HEADING_LINE, "\x01"), W.LIST_MARKER, "\x01")
    return d.filter(paras, "z", f"{n('z')} >= 8"), d.filter(W.pieces(d, f"replace({marked}, {nl}, {d.lit(chr(32))})"), "z", f"{n('z')} >= 6")


def units(d: Spark) -> str:
    """Those paragraphs and sentences as rows, with the words of their prose."""
    prose = W.strip_code(d, "u")
    of = lambda kind, x, s: f"SELECT doc_id AS scope, '{kind}' AS kind, {d.big('pos')} AS pos, u, {W.tokens_half_even(d, 'u')} AS tokens, {W.plain_words(d, prose)} AS w, {s} AS seq FROM {texts(d)} t {d.unnest(x, 'u')}"
    paras, sents = blocks(d)
    no = "cast(NULL as array<string>)" if d.name == "spark" else "CAST(NULL AS VARCHAR[])"
    return f"({of('paragraph', paras, no)} UNION ALL {of('sentence', sents, d.all(f'lower({prose})', '[a-z0-9]+'))})"


def _groups(d: Spark) -> str:
    return f"""WITH RECURSIVE u AS (SELECT *, list_transform(generate_series(1, len(seq) - {RUN - 1}), lambda i: array_to_string(list_slice(seq, i, i + {RUN - 1}), ' ')) AS g FROM {units(d)} u WHERE len(w) > 0),
        p AS (SELECT a.scope, a.kind, a.pos AS a, b.pos AS b, {W.jaccard(d, 'a.w', 'b.w')} AS j, coalesce(list_has_any(a.g, b.g), false) AS r FROM u a JOIN u b ON a.scope = b.scope AND a.kind = b.kind AND a.pos < b.pos),
        l AS (SELECT * FROM p WHERE j >= CASE kind WHEN 'paragraph' THEN {PARAGRAPHS} ELSE {SENTENCES} END OR r), e AS (SELECT scope, kind, a, b FROM l UNION SELECT scope, kind, b, a FROM l),
        t AS (SELECT scope, kind, a, a AS m FROM e UNION SELECT e.scope, e.kind, e.b, t.m FROM t JOIN e ON e.scope = t.scope AND e.kind = t.kind AND e.a = t.a WHERE t.m < e.b),
        c AS (SELECT scope, kind, a, min(m) AS m FROM t GROUP BY ALL), o AS (SELECT l.scope, l.kind, c.m, max(CASE WHEN j >= CASE l.kind WHEN 'paragraph' THEN {PARAGRAPHS} ELSE {SENTENCES} END THEN j END) AS j FROM l JOIN c ON c.scope = l.scope AND c.kind = l.kind AND c.a = l.a GROUP BY ALL),
        q AS (SELECT c.scope, c.kind, c.m, count(*) AS n, CAST(sum(u.tokens) - max(u.tokens) AS BIGINT) AS wasted FROM c JOIN u ON u.scope = c.scope AND u.kind = c.kind AND u.pos = c.a GROUP BY ALL)
        SELECT q.scope AS doc_id, q.kind, q.m AS first_pos, q.n, round(o.j, 6) AS max_overlap, q.wasted FROM q JOIN o ON o.scope = q.scope AND o.kind = q.kind AND o.m = q.m"""


def repeats(spark: SparkSession, d: str, make: Callable, schema: str) -> DataFrame:
    """What ``make`` gives of each document's id, text, paragraphs and sentences: a document is one row and is compared with itself only."""
    docs = ask(spark, d, lambda x: f"SELECT doc_id, text, {blocks(x)[0]} AS paragraphs, {blocks(x)[1]} AS sentences FROM {texts(x)} t")
    return rows_of(docs, make, schema)


@book.frame(_groups)
def jon17_scl27_agg16_repeated_units(spark: SparkSession, d: str) -> DataFrame:
    """Groups of paragraphs and of sentences of a document that repeat each other: by overlap of words, sentences also by six words in a row; with the tokens that costs."""

    def make(i: int, _: str, paragraphs: list[str], sentences: list[str]) -> list[tuple]:
        out = []
        for kind, x, t, run in (("paragraph", paragraphs, PARAGRAPHS, None), ("sentence", sentences, SENTENCES, RUN)):
            for m, j in groups(x, t, run):
                sizes = [max(1, round(len(x[k]) / 4)) for k in m]
                out.append((i, kind, m[0], len(m), None if j is None else round(j, 6), sum(sizes) - max(sizes)))
        return out

    return repeats(spark, d, make, "doc_id bigint, kind string, first_pos bigint, n bigint, max_overlap double, wasted bigint")


@book.frame()
def gra02_sentence_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of repeated sentences with the longest run that the first shares with another, those left out whose members all stand in repeated paragraphs of their document."""

    def make(i: int, _: str, paragraphs: list[str], sentences: list[str]) -> list[tuple]:
        flat = lambda x: " ".join(x.split())
        inside = [flat(paragraphs[k]) for m, _ in groups(paragraphs, PARAGRAPHS) for k in m]
        out = []
        for m, _ in groups(sentences, SENTENCES, RUN):
            alone = [k for k in m if not any(flat(sentences[k]) in p for p in inside)]
            if alone:
                first = word_sequence(sentences[m[0]])
                out.append((i, m[0], len(m), len(alone), max(longest_run(first, word_sequence(sentences[k])) for k in m[1:])))
        return out

    return repeats(spark, d, make, "doc_id bigint, first_pos bigint, n bigint, n_alone bigint, longest_run bigint")


@book.sql
def agg16_shared_sentences(d: Spark) -> str:
    """Sentences that many documents hold, and the tokens that repeating them costs."""
    return f"""SELECT s AS sentence, count(DISTINCT doc_id) AS n_docs, {d.big(f'sum({W.tokens_half_even(d, "s")}) - max({W.tokens_half_even(d, "s")})')} AS wasted FROM {texts(d)} t {d.unnest(W.sentences(d, 'text'), 's')}
        WHERE {d.size(d.all('s', '[^ ]+'))} >= 6 GROUP BY s HAVING count(DISTINCT doc_id) > 1"""


def statements(d: Spark) -> str:
    """Distinct statements of each scope with polarity and content words; documents without a source are a scope."""
    return f"""(SELECT scope, s, {W.negated(d, 's')} AS neg, {W.content_words(d, 's')} AS w FROM (SELECT DISTINCT coalesce(source, '') AS scope, s FROM (SELECT t.text, a.source FROM {texts(d)} t JOIN documents a ON a.doc_id = t.doc_id) q {d.unnest(W.sentences(d, 'text'), 's')}) u)"""


#: Ids with several sources up to which they are sent to all executors.
MOST_SENT = 100_000


@book.frame(lambda d: f"""WITH f AS (SELECT * FROM {statements(d)} x) SELECT a.scope, a.s AS denies, b.s AS states, round({W.jaccard(d, 'a.w', 'b.w')}, 6) AS overlap FROM f a JOIN f b ON a.scope = b.scope AND a.neg AND NOT b.neg WHERE {W.jaccard(d, 'a.w', 'b.w')} >= 0.4""")
def jon16_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Statements of one scope that speak of the same with opposite polarity, words overlapping by 0.4.

    A text stands under the sources of all documents of its id: those of ids with several are
    looked up, so texts aren't shuffled.
    """
    docs = load(spark, d, "documents").where("doc_id is not null").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("scope"))
    several, _ = written(docs.groupBy("doc_id").agg(F.collect_set("scope").alias("scopes")).where("size(scopes) > 1"), "several-sources")
    few = several.count() <= MOST_SENT
    texts = docs.where("text is not null").join(F.broadcast(several) if few else several, "doc_id", "left").withColumn("scope", F.explode(F.coalesce("scopes", F.array("scope"))))
    sizes = texts.groupBy("scope").agg(F.sum(F.length("text")).alias("n"))
    said = texts.withColumn("text", F.expr("replace(text, chr(13), '')")).select("scope", F.explode(F.array_distinct(F.expr(W.sentences(SPARK, "text")))).alias("s"))
    neg = F.expr(f"{SPARK.match('s', W.MAYBE_NEGATED)} AND {W.negated(SPARK, 's')}")
    return contradictions(said.select("scope", "s", neg.alias("neg")), 0.4, lambda: W.ContentWords().of, sizes)


#: Overlap of words from which a brief is denied, and from which it gets a hint.
DENY, HINT = 0.9, 0.6


def briefs(d: Spark) -> str:
    """Briefs of tool calls with their words: session_id, line_no, line_id, w."""
    return f"(SELECT session_id, line_no, line_id, {d.sorted(W.note_words(d, 'b'))} AS w FROM (SELECT session_id, line_no, line_id, {d.ext('message', BRIEF, 1)} AS b FROM transcripts WHERE message LIKE '%\"description\"%') t WHERE b <> '')"


BRIEF = r'"description": ?"([^"\\]+)"'


@book.frame(lambda d: f"""WITH b AS (SELECT *, cast(line_no AS BIGINT) * 1000000000 + line_id AS o FROM {briefs(d)} b WHERE session_id IS NOT NULL), p AS (
        SELECT x.line_id, y.line_id AS first_line, y.o, len(list_intersect(x.w, y.w)) * 1.0 / nullif(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)), 0) AS sim FROM b x JOIN b y ON x.session_id = y.session_id AND y.o < x.o)
    SELECT line_id, first_line, round(sim, 6) AS overlap, CASE WHEN sim >= {DENY} THEN 'deny' ELSE 'hint' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY o) AS k FROM p WHERE sim >= {HINT}) q WHERE k = 1""")
def jon18_repeated_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Briefs much like an earlier one of their session: the first such one, denied or hinted at by its overlap."""
    b = ask(spark, d, lambda x: f"SELECT session_id, cast(line_no AS BIGINT) * 1000000000 + line_id AS o, line_id, w FROM {briefs(x)} b WHERE session_id IS NOT NULL AND size(w) > 0")
    return repeated(b, HINT).select("line_id", "first_line", F.round("overlap", 6).alias("overlap"), F.when(F.col("overlap") >= DENY, "deny").otherwise("hint").alias("verdict"))


def routing(d: Spark) -> str:
    """Each task text with the suite whose vocabulary covers most of its words, by the words they share."""
    own = f"(SELECT item_id, suite, {d.distinct(W.keywords_b(d, 'text'))} AS kw FROM eval_items)"
    return f"""(SELECT i.item_id, i.suite AS truth, coalesce(h.suite, f.suite) AS suite, coalesce(h.n, 0) * 1.0 / greatest(1, {d.size('i.kw')}) AS score, row_number() OVER (PARTITION BY i.item_id ORDER BY coalesce(h.n, 0) DESC, coalesce(h.suite, f.suite)) AS k
        FROM {own} i CROSS JOIN (SELECT min(suite) AS suite FROM eval_items) f LEFT JOIN (SELECT a.item_id, v.suite, count(*) AS n FROM (SELECT item_id, w FROM {own} t {d.unnest('kw', 'w')}) a
            JOIN (SELECT DISTINCT suite, w FROM {own} t {d.unnest('kw', 'w')}) v ON v.w = a.w GROUP BY a.item_id, v.suite) h ON h.item_id = i.item_id)"""


@book.sql
def jon23_mth16_routing(d: Spark) -> str:
    """The suite that covers each task text best, none under 0.2."""
    return f"SELECT item_id, CASE WHEN score >= 0.2 THEN suite END AS suite, round(score, 6) AS score FROM {routing(d)} r WHERE k = 1"


@book.sql
def jon27_agg17_confusion(d: Spark) -> str:
    """Routing against the truth: counts by pair."""
    return f"SELECT truth, suite AS routed, count(*) AS n FROM {routing(d)} r WHERE k = 1 GROUP BY truth, suite"


def bindings(d: Spark) -> tuple[str, str]:
    """Distinct binding sentences (s, k key words, m markers, n whether they deny) of documents, and distinct word sets of task sentences (w, n)."""
    src = lambda t: f"(SELECT DISTINCT s FROM (SELECT replace(text, chr(13), '') AS text FROM {t} WHERE text IS NOT NULL) t {d.unnest(W.sentences(d, 'text'), 's')})"
    ws = lambda x: d.distinct(d.all(W.expand_contractions(d, x), "[a-z0-9]+"))
    keys = d.filter("w", "x", f"length(x) > 3 AND NOT {d.has(d.strings(W.CONSTRAINT_STOPWORDS + W.CONSTRAINT_MARKERS), 'x')}")
    marks = d.filter("w", "x", d.has(d.strings(W.CONSTRAINT_MARKERS), "x"))
    neg = lambda x: d.any(x, "x", d.has(d.strings(["never", "not", "no", "nor"]), "x"))
    return (
        f"(SELECT s, {keys} AS k, {marks} AS m, {neg('w')} AS n FROM (SELECT s, {ws('s')} AS w FROM {src('documents')} a WHERE {d.match('s', W.CONSTRAINT)}) t)",
        f"(SELECT DISTINCT w, {neg('w')} AS n FROM (SELECT {d.sorted(ws('s'))} AS w FROM {src('eval_items')} b) t)",
    )


def _kept(d: Spark) -> str:
    c, o = bindings(d)
    return f"""WITH c AS (SELECT * FROM {c} c), o AS (SELECT * FROM {o} o)
        SELECT s AS sentence, EXISTS (SELECT 1 FROM o WHERE o.n = c.n AND {d.size(d.meet('c.m', 'o.w'))} = {d.size('c.m')} AND {d.size(d.meet('c.k', 'o.w'))} >= 0.6 * {d.size('c.k')}) AS kept FROM c"""


@book.frame(_kept)
def jon24_agg18_constraints_kept(spark: SparkSession, d: str) -> DataFrame:
    """Binding sentences of documents that some task text still holds: markers, polarity and 60 % of the words.

    A sentence that is held has one of its rarest key words in the task's (one of its markers
    where it has no key words): only those are joined, then the whole rule is tested.
    """
    c = ask(spark, d, lambda x: f"SELECT * FROM {bindings(x)[0]} c")
    c, _ = written(c.withColumn("id", F.xxhash64("s")), "bindings")
    o, _ = written(ask(spark, d, lambda x: f"SELECT * FROM {bindings(x)[1]} o").withColumn("oid", F.xxhash64("w")), "task-sentences")
    index = o.select("oid", "n", F.explode("w").alias("x"))
    df = index.groupBy("x").agg(F.count("*").alias("df"))
    probe = F.when(F.size("k") > 0, F.col("k")).otherwise(F.col("m"))
    most = F.when(F.size("k") > 0, F.size("k") - F.ceil(0.6 * F.size("k")).cast("int") + 1).otherwise(1)
    each = c.select("id", "n", most.alias("most"), F.explode(probe).alias("x")).join(df, "x", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "x"))).where("rank <= most and df > 0")
    cand = first.join(index, ["n", "x"]).select("id", "oid").distinct()
    test = (F.size(F.array_intersect("m", "w")) == F.size("m")) & (F.size(F.array_intersect("k", "w")) >= 0.6 * F.size("k"))
    held = cand.join(c.select("id", "k", "m"), "id").join(o.select("oid", "w"), "oid").where(test).select("id").distinct().withColumn("held", F.lit(True))
    bare = c.where(F.size(probe) == 0).select("n").distinct().join(o.select("n").distinct(), "n").select("n", F.lit(True).alias("any"))
    out = c.join(held, "id", "left").join(bare, "n", "left")
    return out.select(F.col("s").alias("sentence"), (F.coalesce("held", F.lit(False)) | ((F.size(probe) == 0) & F.coalesce("any", F.lit(False)))).alias("kept"))


@book.sql
def jon25_26_set08_resync(d: Spark) -> str:
    """Repositories that only one of the two tables has."""
    repo = lambda x: d.ext(x, "^([^/]+)/", 1)
    return f"""SELECT coalesce(a.repo, b.repo) AS repo, CASE WHEN a.repo IS NULL THEN 'new' WHEN b.repo IS NULL THEN 'gone' ELSE 'matched' END AS state FROM (SELECT DISTINCT {repo('path')} AS repo FROM source_files WHERE path IS NOT NULL) a
        FULL OUTER JOIN (SELECT DISTINCT repo FROM documents WHERE repo IS NOT NULL) b ON a.repo = b.repo"""


@book.frame("""WITH RECURSIVE e AS (SELECT DISTINCT id AS a, parent AS b FROM symbols WHERE id IS NOT NULL AND parent IS NOT NULL AND parent <> ''), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT DISTINCT e.a, e.b FROM e JOIN r ON r.a = e.a AND r.b = e.a""")
def gra03_set11_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Parent links that lie on a cycle."""
    s = load(spark, d, "symbols").where("id is not null and parent is not null and parent != ''")
    return cycle_links(s.select(F.col("id").alias("a"), F.col("parent").alias("b")))


@book.frame(lambda d: f"""WITH RECURSIVE e AS (SELECT path AS a, target AS b FROM {imports(d)} i UNION SELECT target, path FROM {imports(d)} i), r AS (SELECT path AS id, 0 AS depth FROM {files(d)} f WHERE kind = 'test' UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.id WHERE r.depth < 5)
    SELECT id, min(depth) AS distance FROM r GROUP BY id""")
def gra01_file_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distance of files from the tests over imports either way, by frontier joins."""
    e = ask(spark, d, lambda x: f"SELECT path AS a, target AS b FROM {imports(x)} i")
    seeds = ask(spark, d, lambda x: f"SELECT path AS id FROM {files(x)} f WHERE kind = 'test'")
    return distances(e, seeds, 5)


@book.sql
def jon29_30_note_retrieval(d: Spark) -> str:
    """The five notes of each store (source) that share most rare words and paths with each task text; k is their place with the stores one after another."""
    docs = "(SELECT doc_id, coalesce(source, '') AS store, text FROM documents WHERE text IS NOT NULL)"
    paths = d.distinct(d.all("text", r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*/[A-Za-z0-9_-]+[.][a-z]+"))
    q = lambda x: f"(SELECT item_id, w FROM (SELECT item_id, text FROM eval_items WHERE text IS NOT NULL) t {d.unnest(x, 'w')})"
    n = lambda x: f"(SELECT store, doc_id, w FROM {docs} t {d.unnest(x, 'w')})"
    return f"""WITH q AS (SELECT * FROM {q(W.note_words(d, 'text'))} x), p AS (SELECT * FROM {q(paths)} x), c AS (SELECT store, count(*) AS n FROM {docs} t GROUP BY store),
        f AS (SELECT store, doc_id, n.w, count(*) OVER (PARTITION BY store, n.w) AS df FROM {n(W.note_words(d, 'text'))} n JOIN (SELECT DISTINCT w FROM q) v ON v.w = n.w),
        s AS (SELECT item_id, store, doc_id, {d.big('sum(worth)')} AS shared FROM (SELECT q.item_id, f.store, f.doc_id, 1 AS worth FROM f JOIN c ON c.store = f.store JOIN q ON q.w = f.w WHERE c.n < 4 OR f.df * 3 <= c.n
            UNION ALL SELECT p.item_id, n.store, n.doc_id, 3 FROM {n(paths)} n JOIN p ON p.w = n.w) t GROUP BY item_id, store, doc_id HAVING sum(worth) >= 2)
        SELECT item_id, store, doc_id, shared, {d.big('row_number() OVER (PARTITION BY item_id ORDER BY store, k)')} AS k FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store ORDER BY shared DESC, doc_id) AS k FROM s) t WHERE k <= 5"""


@book.sql
def agg15_audit(d: Spark) -> str:
    """Tokens of each document by what they are: code, headings, prose."""
    code = f"length(text) - length({W.strip_code(d, 'text')})"
    return f"SELECT doc_id, greatest(0, {code}) AS code_chars, {d.size(d.all('text', '(?m)^#{1,6} '))} AS headings, {W.tokens_half_even(d, 'text')} AS tokens, {d.size(W.sentences(d, 'text'))} AS sentences FROM {texts(d)} t"


@book.sql
def agg19_votes(d: Spark) -> str:
    """The repository that most files of a run's paths lie in, the first on a tie."""
    return f"""SELECT run_id, repo, n FROM (SELECT run_id, repo, n, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, repo) AS k FROM (
        SELECT run_id, x AS repo, count(*) AS n FROM (SELECT run_id, text FROM log_lines WHERE text IS NOT NULL) t {d.unnest(d.all('text', r'/srv/([a-z-]+)', 1), 'x')} GROUP BY run_id, x) c) r WHERE k = 1"""


@book.sql
def set01_02_merge_imports(d: Spark) -> str:
    """Two halves of the events merged by user and type: the newer wins, both sides' ids kept."""
    half = lambda p: f"(SELECT user_id, event_type, max({d.epoch('ts')}) AS at, max_by(value, event_id) AS value, count(*) AS n FROM events WHERE event_id % 2 = {p} GROUP BY user_id, event_type)"
    return f"""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN b.at IS NULL OR a.at >= b.at THEN a.value ELSE b.value END AS value, coalesce(a.n, 0) + coalesce(b.n, 0) AS n
        FROM {half(0)} a FULL OUTER JOIN {half(1)} b ON a.user_id = b.user_id AND a.event_type = b.event_type"""


@book.sql
def set03_04_curated(d: Spark) -> str:
    """Models of each session united with those of its batch, in order, once each."""
    u = f"(SELECT DISTINCT session_id, batch_id, {d.ext('message', r'\"model\": ?\"([^\"]+)\"', 1)} AS m FROM transcripts WHERE message IS NOT NULL)"
    return f"SELECT session_id, {d.gather_set('m')} AS models FROM {u} u WHERE m <> '' GROUP BY session_id"


@book.sql
def set05_07_note_upserts(d: Spark) -> str:
    """The newest note of each topic, whatever its case, with when it was first made."""
    topic = d.ext("text", r"(?m)^#{1,6}[ ]+([^\n]*)$", 1)
    return f"""SELECT topic, doc_id, first_id FROM (SELECT lower({topic}) AS topic, doc_id, min(doc_id) OVER (PARTITION BY lower({topic})) AS first_id, row_number() OVER (PARTITION BY lower({topic}) ORDER BY added_at DESC NULLS LAST, doc_id DESC) AS k
        FROM (SELECT t.doc_id, t.text, a.added_at FROM {texts(d)} t JOIN documents a ON a.doc_id = t.doc_id) x WHERE {topic} <> '') y WHERE k = 1"""


@book.sql
def set10_tiers(d: Spark) -> str:
    """Sources with the tier they come to by size, cold ones dropped, earlier marks carried over."""
    return f"""SELECT s.source, CASE WHEN s.n >= 60 THEN 'hot' ELSE 'warm' END AS tier, m.mix_id IS NOT NULL AS carried FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) s
        LEFT JOIN (SELECT source, min(mix_id) AS mix_id FROM mix_targets GROUP BY source) m ON m.source = s.source WHERE s.n >= 10"""


@book.sql
def rwr04_flt17_reports(d: Spark) -> str:
    """Tokens before and after code and structure are taken out, and whether that is enough."""
    after = W.tokens_half_even(d, W.strip_structure(d, "text"))
    before = W.tokens_half_even(d, "text")
    return f"SELECT doc_id, {before} AS before, {after} AS after, ({before} - {after}) * 10 >= {before} AS enough FROM {texts(d)} t"


@book.sql
def rwr05_06_marked_blocks(d: Spark) -> str:
    """Texts with the first fenced block replaced by a note, else the note put behind; on one line."""
    note = "<kept elsewhere>"
    return f"SELECT doc_id, CASE WHEN {d.match('text', W.FENCE)} THEN {d.sub('text', W.FENCE, note)} ELSE concat(text, ' ', {d.lit(note)}) END AS text FROM {texts(d)} t"


@book.sql
def snk11_14_bundles(d: Spark) -> str:
    """Bullets by scope: documents of each source with their first heading, a row each in the order of the bundle."""
    h = d.ext("t.text", r"(?m)^#{1,6}[ ]+([^\n]*)$", 1)
    return f"""SELECT source, doc_id, concat('- ', h) AS bullet FROM (SELECT a.source, t.doc_id, {h} AS h FROM {texts(d)} t JOIN documents a ON a.doc_id = t.doc_id WHERE a.source IS NOT NULL) x WHERE h <> ''"""
