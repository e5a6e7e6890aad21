"""Symbols, references, imports and ranking (JON01-JON12, MTH11-MTH12, TOP01-TOP02, AGG03-AGG10, GRA)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import words as W
from cairn.functions.scoring import Queries
from cairn.operators.selection import slices
from cairn.plans.dialect import SPARK, Book, Spark, ask

book = Book()


def symbols(d: Spark) -> str:
    """Symbols once each."""
    return "(SELECT id, max(path) AS path, max(name) AS name, max(qualname) AS qualname, max(lower(trim(type))) AS type, max(start_line) AS a, max(end_line) AS b, max(nullif(parent, '')) AS parent, max(coalesce(doc, '')) AS doc FROM symbols WHERE id IS NOT NULL AND path IS NOT NULL AND name IS NOT NULL GROUP BY id)"


def files(d: Spark) -> str:
    return "(SELECT path, max(content) AS content, max(kind) AS kind, max(language) AS language FROM source_files WHERE path IS NOT NULL GROUP BY path)"


def imports(d: Spark) -> str:
    return f"(SELECT DISTINCT path, target FROM (SELECT path, resolved_imports FROM source_files WHERE path IS NOT NULL AND resolved_imports IS NOT NULL) f {d.unnest('resolved_imports', 'target')} WHERE target IS NOT NULL)"


def code_lines(d: Spark) -> str:
    ls = d.split("content", "\n") if d.name == "spark" else "string_split(content, chr(10))"
    return f"(SELECT path, {d.big('pos + 1')} AS line_no, x FROM {files(d)} f {d.unnest(ls, 'x')})"


def calls(d: Spark) -> str:
    """Names that lines call, once per line."""
    return f"(SELECT DISTINCT path, line_no, name FROM {code_lines(d)} l {d.unnest(d.all('x', r'([a-z_][a-z_]+)\(', 1), 'name')} WHERE NOT {d.match('x', r'^\s*(?:async )?def ')})"


def edges(d: Spark) -> str:
    """Each call with the innermost symbol around it: (src, path, name)."""
    return f"""(SELECT DISTINCT src, path, name FROM (SELECT s.id AS src, c.path, c.name, row_number() OVER (PARTITION BY c.path, c.line_no, c.name ORDER BY s.b - s.a, s.a DESC, s.id) AS k
        FROM {calls(d)} c JOIN {symbols(d)} s ON s.path = c.path AND c.line_no BETWEEN s.a AND s.b) t WHERE k = 1)"""


def resolved(d: Spark) -> str:
    """Each reference with its target: in the same file, else the only one imported, else the only one anywhere."""
    return f"""(SELECT e.src, e.path, e.name, CASE WHEN same.n = 1 THEN same.id WHEN imp.n = 1 THEN imp.id WHEN uni.n = 1 THEN uni.id END AS target,
        CASE WHEN same.n = 1 THEN 'same_file' WHEN imp.n = 1 THEN 'resolved_import' WHEN uni.n = 1 THEN 'unique_name' WHEN uni.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how
        FROM {edges(d)} e LEFT JOIN (SELECT path, name, count(*) AS n, min(id) AS id FROM {symbols(d)} s GROUP BY path, name) same ON same.path = e.path AND same.name = e.name
        LEFT JOIN (SELECT i.path, s.name, count(*) AS n, min(s.id) AS id FROM {imports(d)} i JOIN {symbols(d)} s ON s.path = i.target GROUP BY i.path, s.name) imp ON imp.path = e.path AND imp.name = e.name
        LEFT JOIN (SELECT name, count(*) AS n, min(id) AS id FROM {symbols(d)} s GROUP BY name) uni ON uni.name = e.name)"""


@book.sql
def src11_12_index(d: Spark) -> str:
    """Symbols with their file and parent, and the marker that repeated names get."""
    return f"""SELECT s.id, f.language, p.id IS NOT NULL AS has_parent, CASE WHEN count(*) OVER (PARTITION BY s.path, s.qualname) > 1 THEN concat(s.path, ':', s.qualname, '@', s.a) ELSE concat(s.path, ':', s.qualname) END AS built
        FROM {symbols(d)} s LEFT JOIN {files(d)} f ON f.path = s.path LEFT JOIN {symbols(d)} p ON p.id = s.parent"""


@book.sql
def src17_undirected_edges(d: Spark) -> str:
    """Parent links in both directions, once each."""
    return f"SELECT DISTINCT a, b FROM (SELECT id AS a, parent AS b FROM {symbols(d)} s WHERE parent IS NOT NULL UNION ALL SELECT parent, id FROM {symbols(d)} s WHERE parent IS NOT NULL) t WHERE a <> b"


@book.sql
def src32_line_counts(d: Spark) -> str:
    """Line ends by extension."""
    lf = "chr(10)"
    return f"SELECT {d.ext('path', r'\.(\w+)$', 1)} AS extension, count(*) AS n_files, {d.big(f"coalesce(sum(length(content) - length(replace(content, {lf}, ''))), 0)")} AS n_lines FROM {files(d)} f GROUP BY {d.ext('path', r'\.(\w+)$', 1)}"


@book.sql
def src38_source_roots(d: Spark) -> str:
    """Folders that sources start from, by depth."""
    return f"SELECT root, {d.size(d.split('root', '/'))} AS depth, count(*) AS n FROM (SELECT {d.ext('path', '^([^/]+(?:/(?:src|lib|app|tools))?)/', 1)} AS root FROM {files(d)} f) t GROUP BY root"


@book.sql
def jon01_name_resolution(d: Spark) -> str:
    """References with the symbol they mean and how that was found."""
    return f"SELECT src, name, target, how FROM {resolved(d)} r"


@book.sql
def jon02_callees(d: Spark) -> str:
    """Symbols that each symbol calls, itself left out."""
    return f"SELECT DISTINCT src, target FROM {resolved(d)} r WHERE target IS NOT NULL AND target <> src"


#: Callers from which on only those in the same folder count as neighbours.
MANY_CALLERS = 200


@book.sql
def jon03_neighbours(d: Spark) -> str:
    """Callees, callers, parents and children of each symbol; of one with very many callers only those of its folder."""
    folder = lambda x: d.sub(x, r"[^/]*$", "")
    return f"""WITH c AS (SELECT DISTINCT src, target FROM {resolved(d)} r WHERE target IS NOT NULL AND target <> src), s AS (SELECT id, path, parent FROM {symbols(d)} s), m AS (SELECT target, count(*) AS n FROM c GROUP BY target),
        k AS (SELECT c.target AS id, c.src AS other FROM c JOIN m ON m.target = c.target JOIN s a ON a.id = c.src JOIN s b ON b.id = c.target WHERE m.n <= {MANY_CALLERS} OR {folder('a.path')} = {folder('b.path')}),
        p AS (SELECT s.id, q.id AS other FROM s JOIN s q ON q.id = s.parent WHERE s.id <> q.id)
        SELECT src AS id, target AS other, 'callee' AS kind FROM c UNION SELECT id, other, 'caller' FROM k UNION SELECT id, other, 'parent' FROM p UNION SELECT other, id, 'child' FROM p"""


@book.sql
def jon04_importers(d: Spark) -> str:
    """Files that import each file, a row each, and how many there are."""
    return f"SELECT i.target, i.path, n.n FROM {imports(d)} i JOIN (SELECT target, count(*) AS n FROM {imports(d)} j GROUP BY target) n ON n.target = i.target"


@book.sql
def jon05_test_targets(d: Spark) -> str:
    """Files that each test file is about: what it imports, or what its name points at."""
    stem = lambda x: d.ext(x, r"([^/]+)\.\w+$", 1)
    return f"""SELECT i.path AS test, i.target FROM {imports(d)} i JOIN {files(d)} f ON f.path = i.path AND f.kind = 'test' JOIN {files(d)} g ON g.path = i.target AND g.kind <> 'test'
        UNION SELECT f.path, g.path FROM {files(d)} f JOIN {files(d)} g ON {d.sub(stem('f.path'), '^test_', '')} = {stem('g.path')} AND f.language = g.language WHERE f.kind = 'test' AND g.kind <> 'test'"""


def import_targets(d: Spark) -> str:
    mod = d.ext("x", r'^(?:import|from) ([a-z_]+)|^#include "([a-z_]+)', 0)
    name = d.sub(mod, r'^(?:import |from |#include ")', "")
    stem = d.ext("f.path", r"([^/]+)\.\w+$", 1)
    return f"""WITH i AS (SELECT DISTINCT path, {name} AS module FROM {code_lines(d)} l WHERE {d.match('x', r'^(?:import|from) [a-z_]+|^#include "[a-z_]+')}),
        n AS (SELECT path, {d.sub(stem, '_[0-9a-z]+$', '')} AS module FROM {files(d)} f UNION SELECT path, {stem} FROM {files(d)} f UNION SELECT path, x FROM (SELECT path FROM {files(d)} f) t {d.unnest(d.split('path', '/'), 'x')} WHERE pos > 0 AND pos < {d.size(d.split('path', '/'))} - 1),
        c AS (SELECT i.path, i.module, n.path AS target, CASE WHEN {d.ext('i.path', '^([^/]+)/', 1)} = {d.ext('n.path', '^([^/]+)/', 1)} THEN 1 ELSE 0 END AS near FROM i JOIN n ON n.module = i.module),
        k AS (SELECT *, row_number() OVER (PARTITION BY path, module ORDER BY near DESC, length(target), target) AS k FROM c)
        SELECT i.path, i.module, k.target FROM i LEFT JOIN k ON k.path = i.path AND k.module = i.module AND k.k = 1"""


@book.sql
def jon06_07_import_resolution(d: Spark) -> str:
    """Import and include lines with the file of that name that shares the longest folder with the importer."""
    return import_targets(d)


@book.sql
def jon08_09_suffix_paths(d: Spark) -> str:
    """Paths that log lines name, joined to files of the same base name; the longest shared tail wins."""
    base = lambda x: d.ext(x, r"([^/]+)$", 1)
    frag = d.ext("text", r'File "([^"]+)", line', 1)
    tail = "CASE WHEN frag LIKE concat('%', path) THEN length(path) ELSE length(base) END"
    return f"""SELECT frag, path FROM (SELECT frag, path, rank() OVER (PARTITION BY frag ORDER BY {tail} DESC) AS k FROM (
        SELECT l.frag, f.path, {base('f.path')} AS base FROM (SELECT DISTINCT {frag} AS frag FROM log_lines WHERE text LIKE '%File \"%') l JOIN {files(d)} f ON {base('l.frag')} = {d.sub(base('f.path'), r'_[0-9a-z]+\.(\w+)$', r'.\1')}) c) t WHERE k = 1"""


#: Lines on either side of a place that lies in no symbol.
AROUND = 15


@book.sql
def jon10_point_in_range(d: Spark) -> str:
    """Comment lines with the innermost symbol around them; where there is none, the lines around."""
    return f"""SELECT path, line_no, id, CASE WHEN id IS NULL THEN greatest(1, line_no - {AROUND}) ELSE a END AS first_line, CASE WHEN id IS NULL THEN line_no + {AROUND} ELSE b END AS last_line FROM (SELECT l.path, l.line_no, s.id, {d.big('s.a')} AS a, {d.big('s.b')} AS b, row_number() OVER (PARTITION BY l.path, l.line_no ORDER BY s.b - s.a, s.a DESC, s.id) AS k
        FROM (SELECT path, line_no FROM {code_lines(d)} c WHERE {d.match('x', r'^\s*(?:#|//) ')}) l LEFT JOIN {symbols(d)} s ON s.path = l.path AND l.line_no BETWEEN s.a AND s.b) t WHERE k = 1"""


def ancestors(d: Spark, x: str) -> str:
    parts = d.split(x, "/")
    n = f"size({parts})" if d.name == "spark" else f"len({parts})"
    seq = f"sequence(1, greatest(1, {n} - 1))" if d.name == "spark" else f"generate_series(1, greatest(1, {n} - 1))"
    return d.map(seq, "i", d.join(d.slice(parts, "1", "i") if d.name == "duck" else f"slice({parts}, 1, i)", "/"))


@book.sql
def jon11_31_32_nearest_ancestor(d: Spark) -> str:
    """The nearest folder above each file that holds a test."""
    return f"""WITH c AS (SELECT DISTINCT {d.sub('path', '/tests/[^/]+$', '')} AS dir FROM {files(d)} f WHERE path LIKE '%/tests/%'),
        a AS (SELECT path, dir, length(dir) AS depth FROM {files(d)} f {d.unnest(ancestors(d, 'path'), 'dir')})
        SELECT path, max_by(dir, depth) AS owner FROM (SELECT a.path, a.dir, a.depth FROM a JOIN c ON c.dir = a.dir) t GROUP BY path"""


@book.sql
def jon12_linked_files(d: Spark) -> str:
    """Files linked to each other by import, with 5 where one names the other."""
    stem = d.ext("i.target", r"([^/]+)\.\w+$", 1)
    return f"SELECT i.path, i.target, CASE WHEN {'contains' if d.name == 'spark' else 'contains'}(coalesce(f.content, ''), {stem}) THEN 5 ELSE 1 END AS score FROM {imports(d)} i LEFT JOIN {files(d)} f ON f.path = i.path"


@book.sql
def jon19_20_repo_links(d: Spark) -> str:
    """Links between repositories by what their files import."""
    repo = lambda x: d.ext(x, "^([^/]+)/", 1)
    return f"SELECT {repo('path')} AS source, {repo('target')} AS target, count(*) AS n FROM {imports(d)} i WHERE {repo('path')} <> {repo('target')} GROUP BY {repo('path')}, {repo('target')}"


@book.sql
def agg03_04_idf(d: Spark) -> str:
    """Weight of each word by the documents that hold it, clamped and not."""
    return f"""WITH w AS (SELECT doc_id, w FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) t {d.unnest(W.plain_words(d, 'text'), 'w')}), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
        f AS (SELECT w, count(*) AS df FROM w GROUP BY w)
        SELECT w AS word, df, round(least(1.0, greatest(0.05, ln((n + 1) / (df + 0.5)) / ln(n + 1))), 6) AS idf, round(ln((n + 1) / (df + 0.5)), 6) AS raw FROM f CROSS JOIN n"""


def name_index(d: Spark) -> str:
    return f"""(SELECT id, w, idf FROM (SELECT s.id, s.w, least(1.0, greatest(0.05, ln((n.n + 1) / (f.df + 0.5)) / ln(n.n + 1))) AS idf
        FROM (SELECT id, w FROM (SELECT id, name FROM {symbols(d)} y) x {d.unnest(W.name_words(d, 'name'), 'w')}) s
        JOIN (SELECT w, count(*) AS df FROM (SELECT id, w FROM (SELECT id, name FROM {symbols(d)} y) x {d.unnest(W.name_words(d, 'name'), 'w')}) q GROUP BY w) f ON f.w = s.w
        CROSS JOIN (SELECT count(*) AS n FROM {symbols(d)} y) n) t)"""


#: Lines from which a class is given by its head, and lines of such a head at most.
LARGE_CLASS, HEAD_LINES = 30, 20


def chunks(d: Spark) -> str:
    big = f"c.a IS NOT NULL AND s.type IN ('class', 'type') AND s.b - s.a + 1 > {LARGE_CLASS}"
    return f"""SELECT s.id, s.a AS start_line, CASE WHEN {big} THEN least(s.a + {HEAD_LINES - 1}, greatest(s.a, CASE WHEN c.first_name IN ('__init__', s.name) THEN c.a ELSE c.a - 1 END)) ELSE s.b END AS end_line, CASE WHEN {big} THEN 'class_header' ELSE s.type END AS kind
        FROM {symbols(d)} s LEFT JOIN (SELECT parent, min(a) AS a, min_by(name, a) AS first_name FROM {symbols(d)} y WHERE parent IS NOT NULL GROUP BY parent) c ON c.parent = s.id
        UNION ALL SELECT concat(f.path, ':__file__'), 1, greatest(1, coalesce(f.n, 1)), 'file' FROM (SELECT path, max(line_count) AS n FROM source_files WHERE path IS NOT NULL GROUP BY path) f WHERE NOT EXISTS (SELECT 1 FROM {symbols(d)} y WHERE y.path = f.path)"""


def lexical(d: Spark) -> str:
    """The plain text of the scores, every word of a task against every word of a symbol."""
    task = f"(SELECT item_id, w FROM (SELECT item_id, text FROM eval_items) t {d.unnest(W.keywords_a(d, 'text'), 'w')})"
    whole = f"(SELECT DISTINCT item_id, w FROM (SELECT item_id, text FROM eval_items) t {d.unnest(W.word_list(d, 'lower(text)'), 'w')})"
    docs = f"(SELECT id, w FROM (SELECT id, doc FROM {symbols(d)} y WHERE doc <> '') t {d.unnest(W.keywords_a(d, 'doc'), 'w')})"
    return f"""WITH s AS (SELECT t.item_id, i.id, 3.0 * i.idf AS score FROM {task} t JOIN {name_index(d)} i ON i.w = t.w UNION ALL SELECT t.item_id, s.id, 12.0 FROM {whole} t JOIN {symbols(d)} s ON lower(s.name) = t.w WHERE length(s.name) > 2
            UNION ALL SELECT t.item_id, x.id, 0.5 FROM {task} t JOIN {docs} x ON x.w = t.w),
        g AS (SELECT item_id, id, {d.half_even('sum(score) * 100')} / 100 AS score FROM s GROUP BY item_id, id), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS k FROM g)
        SELECT item_id, id, score, {d.big('k')} AS k FROM k WHERE k <= 10"""


#: Tasks that one pass over the symbols takes along.
TASKS = 5_000


def lexical_scores(spark: SparkSession, d: str, only: str = "item_id IS NOT NULL", most: int | None = None) -> DataFrame:
    """item_id, id, score over 0 and whether the symbol is called by name, of the tasks ``only`` keeps: all, or the ``most`` best of a chunk of symbols.

    The tasks are the query set: their words and weights go to the symbols, which are scored where
    they are, a chunk against all tasks at once; nothing is shuffled but the scores that are kept.
    More than ``TASKS`` tasks go in blocks, a pass over the symbols each.
    """
    total = ask(spark, d, lambda x: f"SELECT item_id FROM eval_items WHERE {only}").count()
    n = -(-total // TASKS)
    if n > 1:
        return reduce(DataFrame.unionByName, (_scores(spark, d, f"{only} AND pmod(xxhash64(item_id), {n}) = {k}", most) for k in range(n)))
    return _scores(spark, d, only, most)


def _scores(spark: SparkSession, d: str, only: str, most: int | None) -> DataFrame:
    kw, names, doc = W.keywords_a(SPARK, "text"), W.name_words(SPARK, "name"), W.keywords_a(SPARK, "doc")
    sym = ask(spark, d, lambda x: f"SELECT id, lower(name) AS whole, length(name) > 2 AS counts, {names} AS names, CASE WHEN doc <> '' THEN {doc} END AS docs FROM {symbols(x)} s")
    tasks = [tuple(r) for r in ask(spark, d, lambda x: f"SELECT item_id, {kw} AS kw, {W.word_list(x, 'lower(text)')} AS whole FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL AND {only}").collect()]
    every = spark.createDataFrame([(w,) for w in sorted({w for _, k, _ in tasks for w in k})], "w string")
    n = sym.count()
    df = dict(tuple(r) for r in sym.select(F.explode("names").alias("w")).join(F.broadcast(every), "w").groupBy("w").count().collect())
    weight = {w: 3.0 * min(1.0, max(0.05, math.log((n + 1) / (k + 0.5)) / math.log(n + 1))) for w, k in df.items()} if n else {}
    rows = [(f"n:{w}", i, weight[w], False) for i, k, _ in tasks for w in set(k) if w in weight]
    rows += [(f"d:{w}", i, 0.5, False) for i, k, _ in tasks for w in set(k)] + [(f"w:{w}", i, 12.0, True) for i, _, x in tasks for w in set(x)]
    queries = Queries(rows)
    tag = lambda c, k: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(k), x))
    terms = F.concat(tag(F.col("names"), "n:"), tag(F.col("docs"), "d:"), tag(F.when(F.col("counts"), F.array("whole")), "w:"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, q, score, named in queries.score(b.column(1).to_pylist(), b.column(0).to_pylist(), most):
                yield pa.RecordBatch.from_arrays([pa.array(q), b.column(0).take(pa.array(r)), pa.array(score), pa.array(named)], names=["item_id", "id", "score", "named"])

    return sym.select("id", terms.alias("terms")).mapInArrow(run, "item_id bigint, id string, score double, named boolean")


@book.frame(lexical)
def mth11_12_top01_lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ten symbols that each task text speaks of most: shared name words by weight, whole names by 12, documentation words added."""
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "id"))
    return lexical_scores(spark, d, most=10).withColumn("k", k).where("k <= 10").select("item_id", "id", "score", F.col("k").cast("bigint").alias("k"))


#: Tokens of a slice, tokens that expanding it adds, and the share of the best score that chunks need.
SLICE, EXTRA, FLOOR = 1500, 500, 0.15


@book.frame()
def win09_13_15_top01_slices(spark: SparkSession, d: str) -> DataFrame:
    """What to read for each task whose id is divisible by 50: chunks by score within a budget, then named ones beyond it."""
    c = ask(spark, d, lambda x: f"""SELECT c.id, c.start_line AS a, c.end_line AS b, s.path, coalesce(f.kind, '') = 'test' AS test, cast(greatest(1, coalesce(t.tokens, 4 * (c.end_line - c.start_line + 1))) AS bigint) AS tokens FROM ({chunks(x)}) c
        JOIN {symbols(x)} s ON s.id = c.id LEFT JOIN {files(x)} f ON f.path = s.path LEFT JOIN (SELECT id, max(CASE WHEN tokens > 0 THEN tokens END) AS tokens FROM symbols WHERE id IS NOT NULL GROUP BY id) t ON t.id = c.id""")
    scored = lexical_scores(spark, d, "item_id % 50 = 0").join(c, "id")
    out = slices(scored.select(F.col("item_id").cast("string").alias("grp"), F.col("id").alias("key"), "score", "tokens", "path", "a", "b", "test", "named"), SLICE, EXTRA, floor=FLOOR)
    return out.select(F.col("grp").cast("bigint").alias("item_id"), F.col("key").alias("id"), "how", "cost", "used")


@book.sql
def top02_chunks(d: Spark) -> str:
    """One chunk per symbol and per file without any; a large class with members is its head up to the first, a constructor included."""
    return chunks(d)


@book.sql
def agg07_counts(d: Spark) -> str:
    """Rows of each table."""
    return " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("symbols", "source_files", "log_lines", "runs", "log_events", "transcripts", "documents", "eval_items", "mix_targets"))


@book.sql
def agg08_src39_harvest(d: Spark) -> str:
    """Top languages and folders of each repository, and all repositories it depends on."""
    repo = d.ext("path", "^([^/]+)/", 1)
    return f"""SELECT repo, what, name, n FROM (SELECT *, row_number() OVER (PARTITION BY repo, what ORDER BY n DESC, name) AS k FROM (
        SELECT {repo} AS repo, 'language' AS what, language AS name, count(*) AS n FROM {files(d)} f WHERE language IS NOT NULL GROUP BY {repo}, language
        UNION ALL SELECT {repo}, 'folder', {d.ext('path', '^[^/]+/([^/]+)/', 1)}, count(*) FROM {files(d)} f GROUP BY {repo}, {d.ext('path', '^[^/]+/([^/]+)/', 1)}
        UNION ALL SELECT {repo}, 'depends', {d.ext('target', '^([^/]+)/', 1)}, count(*) FROM {imports(d)} i WHERE {repo} <> {d.ext('target', '^([^/]+)/', 1)} GROUP BY {repo}, {d.ext('target', '^([^/]+)/', 1)}) u) t WHERE what = 'depends' OR k <= CASE what WHEN 'language' THEN 4 ELSE 10 END"""


@book.sql
def agg10_selection_quality(d: Spark) -> str:
    """How much of the lines of documented symbols a selection of all imported files covers, and how much of it they are."""
    return f"""WITH sel AS (SELECT DISTINCT i.target AS path FROM {imports(d)} i), t AS (SELECT path, sum(CASE WHEN doc <> '' THEN b - a + 1 ELSE 0 END) AS n, sum(b - a + 1) AS every FROM {symbols(d)} s GROUP BY path)
        SELECT count(*) AS n_files, count_if(sel.path IS NOT NULL) AS n_hit, round(sum(CASE WHEN sel.path IS NOT NULL THEN n ELSE 0 END) * 1.0 / sum(n), 6) AS recall, round(sum(CASE WHEN sel.path IS NOT NULL THEN n ELSE 0 END) * 1.0 / sum(CASE WHEN sel.path IS NOT NULL THEN every ELSE 0 END), 6) AS precision_ FROM t LEFT JOIN sel ON sel.path = t.path"""


@book.sql
def agg11_rollup(d: Spark) -> str:
    """Files, lines and tokens by repository and language with totals of both levels."""
    repo = d.ext("path", "^([^/]+)/", 1)
    return f"""SELECT coalesce(repo, 'all') AS repo, coalesce(language, 'all') AS language, count(*) AS files, {d.big('coalesce(sum(n), 0)')} AS chars FROM (SELECT {repo} AS repo, coalesce(language, '') AS language, length(content) AS n FROM {files(d)} f) t GROUP BY ROLLUP (repo, language)"""


@book.sql
def gra01_04_distances(d: Spark) -> str:
    """Distance of every file from the test files by imports either way, up to 5, and what it scores."""
    return f"""WITH RECURSIVE e AS (SELECT path AS a, target AS b FROM {imports(d)} i UNION SELECT target, path FROM {imports(d)} i), r AS (
        SELECT path AS id, 0 AS depth FROM {files(d)} f WHERE kind = 'test' UNION ALL SELECT e.b, r.depth + 1 FROM (SELECT DISTINCT id, depth FROM r) r JOIN e ON e.a = r.id WHERE r.depth < 5)
        SELECT id, min(depth) AS distance, CASE WHEN min(depth) = 0 THEN 6 ELSE greatest(0, 6 - min(depth)) END AS score FROM r GROUP BY id"""


@book.sql
def flt06_08_stale(d: Spark) -> str:
    """Symbols whose file is gone or has no content."""
    return f"SELECT s.id, CASE WHEN f.path IS NULL THEN 'missing' ELSE 'empty' END AS reason FROM {symbols(d)} s LEFT JOIN {files(d)} f ON f.path = s.path WHERE f.content IS NULL"
