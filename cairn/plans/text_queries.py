"""Text scalars and classifiers (SCL and TXT operators) over whole tables."""

from __future__ import annotations

from cairn.functions import words as W
from cairn.functions.rewrite import CATEGORIES, OTHERWISE
from cairn.plans.dialect import Book, Spark

book = Book()


def texts(d: Spark) -> str:
    """Documents with a text, line ends brought to LF."""

    return f"(SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text IS NOT NULL)"


D4 = {"spark": "4.0D", "duck": "4.0"}


@book.sql
def scl01_05_token_estimates(d: Spark) -> str:
    """Tokens as a quarter of the characters: half even, rounded up, of bytes, by kind of text, and per line."""
    code = d.sum(d.map(d.all("text", W.FENCE), "c", "length(c) * 1.0"))
    kinds = f"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, {d.half_even(f'{code} / 3.2 + (length(text) - {code}) / 4.2')}) END"
    per_line = d.sum(d.map(d.split("text", "\n") if d.name == "spark" else "string_split(text, chr(10))", "x", f"greatest(1, {d.half_even(f'(length(x) + 1) / {D4[d.name]}')}) * 1.0"))
    return f"""SELECT doc_id, {W.tokens_half_even(d, 'text')} AS half_even, {d.big(d.div('length(text) + 3', '4'))} AS rounded_up,
        {d.big(d.div(d.bytes('text') + ' + 3', '4'))} AS by_bytes, {d.big(kinds)} AS by_kind, {d.big(per_line)} AS by_line FROM documents WHERE text IS NOT NULL"""


@book.sql
def scl06_07_normalised_messages(d: Spark) -> str:
    """Log lines without colour codes and volatile tokens."""
    clean = d.sub("text", W.ANSI, "")
    return f"SELECT run_id, line_no, {clean} AS plain, {W.normalise(d, clean)} AS message FROM (SELECT DISTINCT run_id, line_no, text FROM log_lines WHERE text IS NOT NULL) t"


@book.sql
def scl08_event_signatures(d: Spark) -> str:
    """Key that events cluster by: file and message of a diagnostic, else the message; counted."""
    clean = d.sub("text", W.ANSI, "")
    diag = r"^([^:\s][^:]*):(\d+):(?:\d+:)?\s*(?:error|warning):\s*(.*)$"
    s = f"CASE WHEN {d.match('x', diag)} THEN concat({d.ext('x', diag, 1)}, ': ', {W.normalise(d, d.ext('x', diag, 3))}) ELSE {W.normalise(d, 'x')} END"
    return f"SELECT s AS signature, count(*) AS n FROM (SELECT {s} AS s FROM (SELECT {clean} AS x FROM log_lines WHERE text IS NOT NULL) a) b GROUP BY s"


@book.sql
def scl09_11_hashes(d: Spark) -> str:
    """Commands by key and signature with their runs, and a hash of each."""
    key = f"trim({d.sub('command', r'\s+', ' ')})"
    return f"""SELECT {key} AS command_key, left({d.sha1(key)}, 12) AS signature, left({d.sha256(key)}, 16) AS hash, count(DISTINCT run_id) AS n_runs
        FROM runs WHERE command IS NOT NULL GROUP BY {key}"""


@book.sql
def scl45_content_hashes(d: Spark) -> str:
    """Files by hash of their content; null where there is none."""
    return f"SELECT DISTINCT path, {d.sha256('content')} AS hash, left({d.sha256('content')}, 16) AS short FROM source_files WHERE path IS NOT NULL"


@book.sql
def scl12_range_compaction(d: Spark) -> str:
    """Lines of each run that warn, as ranges; the first 20 and how many more."""
    warn = d.match("text", r"(?i)\bwarn(?:ing)?\b")
    return f"""WITH n AS (SELECT DISTINCT run_id, line_no FROM log_lines WHERE text IS NOT NULL AND {warn}),
        g AS (SELECT run_id, line_no, line_no - row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS island FROM n),
        r AS (SELECT run_id, min(line_no) AS a, max(line_no) AS b FROM g GROUP BY run_id, island),
        k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM r),
        t AS (SELECT run_id, max(n) AS n, {d.text_agg("CASE WHEN a = b THEN cast(a AS VARCHAR(20)) ELSE concat(a, '-', b) END", ",", "a")} AS s FROM k WHERE k <= 20 GROUP BY run_id)
        SELECT run_id, CASE WHEN n > 20 THEN concat(s, ',+', n - 20, ' more') ELSE s END AS ranges FROM t"""


@book.sql
def scl13_user_paths(d: Spark) -> str:
    """Paths that a user owns: not of a system, a toolchain, a vendor or a build."""
    paths = d.all("text", r"/[\w./-]+\.\w+")
    return f"SELECT p AS path, {W.user_path(d, 'p')} AS is_user, count(*) AS n FROM (SELECT text FROM log_lines WHERE text IS NOT NULL) t {d.unnest(paths, 'p')} GROUP BY p"


@book.sql
def scl16_19_name_words(d: Spark) -> str:
    """Parts of symbol names, stemmed name words, and keywords of documentation."""
    return f"""SELECT id, {W.identifier_parts(d, 'name')} AS parts, {W.name_words(d, 'name')} AS name_words, {W.keywords_a(d, "coalesce(doc, '')")} AS doc_keywords
        FROM (SELECT DISTINCT id, name, doc FROM symbols WHERE id IS NOT NULL AND name IS NOT NULL) t"""


@book.sql
def scl20_21_routing_keywords(d: Spark) -> str:
    """Keywords of task texts with the second stemmer."""
    return f"SELECT item_id, {W.keywords_b(d, 'text')} AS keywords FROM eval_items"


@book.sql
def scl22_28_content_words(d: Spark) -> str:
    """Content words and polarity of each document."""
    return f"SELECT doc_id, {W.content_words(d, 'text')} AS words, {W.negated(d, 'text')} AS negated FROM documents WHERE text IS NOT NULL"


@book.sql
def scl23_25_word_sets(d: Spark) -> str:
    """Word sets of documents under three definitions."""
    return f"SELECT doc_id, {d.size(W.note_words(d, 'text'))} AS n_notes, {d.size(W.note_words(d, 'text', True))} AS n_folded, {W.plain_words(d, 'text')} AS plain FROM documents WHERE text IS NOT NULL"


@book.sql
def scl26_jaccard(d: Spark) -> str:
    """Word overlap of each symbol's documentation with its name."""
    return f"""SELECT id, round({W.jaccard(d, 'a', 'b')}, 6) AS overlap FROM (SELECT id, {W.plain_words(d, 'replace(name, ' + d.lit('_') + ', ' + d.lit(' ') + ')')} AS a, {W.plain_words(d, 'doc')} AS b
        FROM (SELECT DISTINCT id, name, doc FROM symbols WHERE id IS NOT NULL AND doc IS NOT NULL AND name IS NOT NULL) s) t"""


@book.sql
def scl29_30_declared_keys(d: Spark) -> str:
    """Normalised statement and the key it is declared under."""
    norm = d.sub(f"trim({d.sub('lower(s)', r'\s+', ' ')})", r"[\s.!;,]+$", "")
    return f"""SELECT {norm} AS norm, concat('fact:', left({d.sha1(norm)}, 12)) AS key, count(*) AS n
        FROM (SELECT text FROM documents WHERE text IS NOT NULL) t {d.unnest(W.sentences(d, 'text'), 's')} GROUP BY {norm}"""


@book.sql
def scl31_34_slugs(d: Spark) -> str:
    """Slugs of headings under four rules, with a suffix where a document repeats one."""
    heads = d.all("text", r"(?m)^#{1,6}[ \t]+\S[^\n]*$")
    s = lambda p, strip, default: f"coalesce(nullif({d.sub(d.sub('lower(trim(h))', p, '-'), strip, '')}, ''), '{default}')"
    return f"""SELECT doc_id, pos, {s('[^a-z0-9_-]+', '^-+|-+$', 'general')} AS scope, {s('[^a-z0-9_.-]+', '^[-_.]+|[-_.]+$', 'repo')} AS repo,
        CASE WHEN k = 1 THEN slug ELSE concat(slug, '-', k) END AS heading, {d.sub('lower(h)', '[^a-z0-9._]+', '-')} AS app FROM (
            SELECT doc_id, pos, h, slug, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS k FROM (
                SELECT doc_id, {d.big('pos')} AS pos, {d.sub('x', '^#+[ \t]+', '')} AS h, {d.sub(d.sub('lower(' + d.sub('x', '^#+[ \t]+', '') + ')', '[^a-z0-9]+', '-'), '^-+|-+$', '')} AS slug
                FROM {texts(d)} t {d.unnest(heads, 'x')}) a) b"""


@book.sql
def scl37_38_names(d: Spark) -> str:
    """Package names brought to one form, and paths as one folder name, over parts and files."""
    return f"""SELECT 'part' AS kind, cast(p_partkey AS VARCHAR(20)) AS id, {d.sub('lower(trim(p_name))', '[-_. ]+', '-')} AS package, {d.sub('p_type', '[^A-Za-z0-9]', '-')} AS folder FROM part
        UNION ALL SELECT DISTINCT 'file', path, {d.sub('lower(trim(' + d.ext('path', '^([^/]+)/', 1) + '))', '[-_. ]+', '-')}, {d.sub('path', '[^A-Za-z0-9]', '-')} FROM source_files WHERE path IS NOT NULL"""


@book.sql
def scl42_43_common_paths(d: Spark) -> str:
    """Leading and trailing path parts that each file shares with the file it imports."""
    def same(a: str, b: str) -> str:
        n = f"least({d.size(a)}, {d.size(b)})"
        seq = d.seq("1", d.big(n)) if d.name == "spark" else f"generate_series(1, {n})"
        miss = d.filter(seq, "i", f"{d.at(a, 'cast(i AS INT)')} <> {d.at(b, 'cast(i AS INT)')}")
        first = d.at(miss, "1")
        return d.big(f"coalesce({first} - 1, {n})")
    rev = (lambda x: f"reverse({x})") if d.name == "spark" else (lambda x: f"list_reverse({x})")
    return f"""SELECT path, target, {same('a', 'b')} AS prefix, {same(rev('a'), rev('b'))} AS suffix FROM (
        SELECT DISTINCT path, target, {d.split('path', '/')} AS a, {d.split('target', '/')} AS b FROM (SELECT path, resolved_imports FROM source_files WHERE path IS NOT NULL AND resolved_imports IS NOT NULL) f {d.unnest('resolved_imports', 'target')}) t"""


@book.sql
def txt01_02_stripped(d: Spark) -> str:
    """Characters of text left without code, and without code and structure."""
    return f"SELECT doc_id, length({W.strip_code(d, 'text')}) AS no_code, length({W.strip_structure(d, 'text')}) AS prose FROM {texts(d)} t"


@book.sql
def txt03_06_sentences(d: Spark) -> str:
    """Sentences with at least six words, by document, with their word sets."""
    return f"""SELECT doc_id, {d.big('pos')} AS pos, s AS sentence, {W.plain_words(d, 's')} AS words FROM {texts(d)} t
        {d.unnest(W.sentences(d, 'text'), 's')} WHERE {d.size(d.all('s', '[^ ]+'))} >= 6"""


@book.sql
def txt04_verbatim_sentences(d: Spark) -> str:
    """Sentences as they stand, with inline code; code blocks, headings and list marks are boundaries."""
    marked = d.sub(d.sub(d.sub("text", W.FENCE, "\x01"), W.HEADING_LINE, "\x01"), W.LIST_MARKER, "\x01")
    nl = d.lit("\n") if d.name == "spark" else "chr(10)"
    return f"SELECT doc_id, {d.big('pos')} AS pos, s AS sentence FROM {texts(d)} t {d.unnest(W.pieces(d, f'replace({marked}, {nl}, {d.lit(chr(32))})'), 's')}"


@book.sql
def txt05_paragraphs(d: Spark) -> str:
    """Blocks between blank lines with at least eight words of prose."""
    marked = d.sub(d.sub("text", W.FENCE, "\n\n"), r"\n\s*\n", "\x01")
    return f"""SELECT doc_id, {d.big('pos')} AS pos, {d.size(d.all(W.strip_code(d, 'p'), r'[^ \n\t\r]+'))} AS n_words FROM {texts(d)} t
        {d.unnest(d.filter(d.map(d.split(marked, chr(1)), 'y', W.trim(d, 'y')), 'y', "y <> ''"), 'p')} WHERE {d.size(d.all(W.strip_code(d, 'p'), r'[^ \n\t\r]+'))} >= 8"""


@book.sql
def txt07_09_44_constraints(d: Spark) -> str:
    """Sentences that bind, once per document, with their words after contractions are written out."""
    keys = d.filter(d.all(W.expand_contractions(d, "s"), "[a-z0-9]+"), "w", f"length(w) > 3 AND NOT {d.has(d.strings(W.CONSTRAINT_STOPWORDS + W.CONSTRAINT_MARKERS), 'w')}")
    return f"""SELECT DISTINCT doc_id, s AS sentence, {d.sorted(d.distinct(keys))} AS keywords FROM {texts(d)} t
        {d.unnest(W.sentences(d, 'text'), 's')} WHERE {d.match('s', W.CONSTRAINT)}"""


@book.sql
def txt10_13_filler(d: Spark) -> str:
    """Sentences by document that instruct, and that are filler."""
    return f"""SELECT doc_id, count(*) AS n, count_if({W.base_verb(d, 's')}) AS n_verbs, count_if({W.is_instruction(d, 's')}) AS n_instructions, count_if({W.is_filler(d, 's')}) AS n_filler
        FROM {texts(d)} t {d.unnest(W.sentences(d, 'text'), 's')} GROUP BY doc_id"""


@book.sql
def txt14_frontmatter(d: Spark) -> str:
    """Keys and values of a text's front block."""
    block = d.ext("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    return f"""SELECT doc_id, {d.ext('x', '^([A-Za-z_-]+):', 1)} AS k, {d.sub(W.trim(d, d.sub('x', '^[A-Za-z_-]+:', '')), '^' + chr(34) + '|' + chr(34) + '$', '')} AS v
        FROM (SELECT doc_id, text FROM documents WHERE text LIKE '---%') t {d.unnest(d.all(block, '(?m)^[A-Za-z_-]+:[^\\n]*$'), 'x')}"""


@book.sql
def txt15_16_sections(d: Spark) -> str:
    """Sections under headings of level 1 and 2 outside fences, with class and tokens."""
    lines = d.split("text", "\n") if d.name == "spark" else "string_split(text, chr(10))"
    nl = "\n"
    cls = " ".join(f"WHEN {d.match('heading', '(?i)' + p)} THEN '{c}'" for c, p in CATEGORIES.items())
    return f"""WITH l AS (SELECT doc_id, pos, x, sum(CASE WHEN {d.match('x', '^[ ]*(```|~~~)')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS f FROM {texts(d)} t {d.unnest(lines, 'x')}),
        h AS (SELECT *, CASE WHEN f % 2 = 0 AND {d.match('x', '^#{1,2}[ ]+')} THEN 1 ELSE 0 END AS is_head FROM l),
        s AS (SELECT *, sum(is_head) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
        g AS (SELECT doc_id, {d.big('section')} AS section, max(CASE WHEN is_head = 1 THEN {d.sub('x', '^#+[ ]+', '')} END) AS heading, sum(length(x) + 1) - 1 AS chars FROM s GROUP BY doc_id, section)
        SELECT doc_id, section, heading, CASE WHEN heading IS NULL THEN '{OTHERWISE}' {cls} ELSE '{OTHERWISE}' END AS class, {d.big(f'greatest(1, {d.half_even("chars / " + D4[d.name])})')} AS tokens FROM g"""


@book.sql
def txt17_19_files(d: Spark) -> str:
    """Kinds of files by path, whether they are fixtures, and the names a test points at."""
    name, stem = d.ext("lower(path)", r"([^/]+)$", 1), d.ext("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    code = d.match(name, r"\.(?:pyi?|c|cc|cpp|cxx|h|hh|hpp|hxx)$")
    kind = f"""CASE WHEN {d.match(name, r'^(?:makefile|dockerfile|cmakelists\.txt|requirements\.txt)$|\.(?:toml|ya?ml|json|cfg|ini|cmake)$')} THEN 'config' WHEN {d.match(name, r'\.(?:md|rst|txt)$')} THEN 'doc'
        WHEN {code} AND ({d.match(name, r'^test_|test\.[^.]*$')} OR {d.match('lower(path)', r'(?:^|/)tests?/')}) THEN 'test' WHEN {d.match(name, r'\.pyi?$')} THEN 'python' WHEN {code} THEN 'cpp' ELSE 'other' END"""
    return f"""SELECT DISTINCT path, {kind} AS kind, {d.match('path', '(?:^|/)(?:fixtures?|testdata|snapshots)/')} AS is_fixture,
        CASE WHEN {stem} LIKE 'test~_%' ESCAPE '~' THEN substr({stem}, 6) END AS guess_prefix, CASE WHEN {stem} LIKE '%~_test' ESCAPE '~' THEN left({stem}, length({stem}) - 5) END AS guess_suffix FROM source_files WHERE path IS NOT NULL"""


@book.sql
def txt29_30_answers(d: Spark) -> str:
    """KEY: value lines of texts."""
    return f"""SELECT doc_id, {d.ext('x', '^([A-Za-z][A-Za-z_]*):', 1)} AS k, count(*) AS n, min({W.trim(d, d.sub('x', '^[A-Za-z][A-Za-z_]*:', ''))}) AS first_value
        FROM {texts(d)} t {d.unnest(d.all('text', '(?m)^[A-Za-z][A-Za-z_]*:[^\\n]*$'), 'x')} GROUP BY doc_id, {d.ext('x', '^([A-Za-z][A-Za-z_]*):', 1)}"""


@book.sql
def txt32_summaries(d: Spark) -> str:
    """First paragraph of prose, cut to 300 characters."""
    marked = d.sub(d.sub("text", W.FENCE, "\n\n"), r"\n\s*\n", "\x01")
    paras = d.filter(d.map(d.split(marked, "\x01"), "y", f"trim({d.sub('y', r'\s+', ' ')})"), "y", f"y <> '' AND NOT {d.match('y', r'^(?:#|[-*>|!\[<]|---|\d+\.)')}")
    return f"SELECT doc_id, left({d.at(paras, '1')}, 300) AS summary FROM documents WHERE text IS NOT NULL"


@book.sql
def txt42_src25_repos_in_text(d: Spark) -> str:
    """Repositories that documents name, by first place of mention."""
    return f"""WITH r AS (SELECT DISTINCT {d.ext('path', '^([^/]+)/', 1)} AS repo FROM source_files WHERE path IS NOT NULL)
        SELECT doc_id, repo, min({d.big('pos')}) AS first_token FROM (SELECT doc_id, pos, x FROM {texts(d)} t {d.unnest(d.all('text', r'[a-z][a-z-]+'), 'x')}) w JOIN r ON r.repo = w.x GROUP BY doc_id, repo"""


# Verbs of edits, what a check runs, what waits for an answer, and how errors of several tools name places and things.
EDIT_VERBS = "implement fix edit write rewrite change modify refactor add create commit update rename delete remove patch migrate bump apply".split()
RUNS = r"(?i)\b(?:run|re-?run)\b.*\b(?:tests?|pytest|ctest|build|lint|suite|benchmark)s?\b|\b(?:pytest|ctest|npm (?:run )?test|cargo (?:test|build)|make)\b"
TASK_LINE = r"(?im)^\s*[-*]?\s*\**Task\**\s*:([^\n]*)$"
WAITING = [r"(?i)enter to select", r"(?i)↑/↓ to navigate|arrow keys to navigate", r"(?i)esc to cancel", r"(?i)do you want to (?:proceed|make this edit|create|run)", r"(?i)\(y/n\)|\[y/n\]", r"(?m)^\s*[❯›>]\s*1\.\s", r"(?i)press enter to confirm"]
MENTION = r'^@(?:"([^"]+)"|([^\s"]\S*))\s+(\S[\s\S]*)$'
ERROR_TEXT = [r"Traceback \(most recent call last\):", r"(?m)^\S+\.(?:c|cc|cpp|cxx|h|hh|hpp|hxx)(?::\d+){1,2}: (?:fatal )?error:", r"(?m)^(?:FAILED|ERROR) \S+\.py::\S+", r"(?m)^\S+\.py:\d+: in \S+"]
NOT_TASK = r"^(?:Traceback|File |E |FAILED|ERROR)"
PLACES = {
    "compiler": r"([^\s:()']+):(\d+):(?:\d+:)?\s*(?:fatal error|error|warning|note)\b",
    "instantiation": r"([^\s:()']+):(\d+):(?:\d+:)?\s+required from",
    "msvc": r"((?:[A-Za-z]:)?[^\s:()]+)\((\d+)(?:,\d+)?\)\s*:\s*(?:fatal error|error|warning|note)\b",
    "traceback": r'File "([^"]+)", line (\d+)',
    "pytest": r"^\s*([^\s:()]+\.[A-Za-z0-9]+):(\d+):(?:\s|$)",
}
THINGS = {
    "exception": r"\b([A-Za-z_]\w*(?:Error|Exception|Warning|Failure))\b",
    "frame": r'File "[^"]+", line \d+, in ([A-Za-z_]\w*)',
    "quoted": "['`\u2018\"]([A-Za-z_][\\w:]*)['\u2019\"]",
    "test": r"^(?:FAILED|ERROR)\s+\S*?::([A-Za-z_][\w:]*)",
    "echo": r"^(?:>\s+|\s*\d+\s+\|\s)(.*)$",
}
FOLDERS = {"entered": "Entering directory [`'\"]([^'`\"]+)['`\"]", "cd": r"(?:^|\s)cd\s+([^\s;&]+)\s*(?:&&|;)", "included": r"In file included from ([^\s:]+):\d+"}
#: Characters that clipped and cut texts have at most.
CLIP, CUT = 80, 200


def plain_lines(d: Spark) -> str:
    """Lines of all runs once each, without colour codes and trailing CR."""
    return f"(SELECT run_id, line_no, max({d.sub(d.sub('text', W.ANSI, ''), r'\r+$', '')}) AS x FROM log_lines WHERE run_id IS NOT NULL AND line_no IS NOT NULL AND text IS NOT NULL GROUP BY run_id, line_no)"


@book.sql
def txt20_error_places(d: Spark) -> str:
    """Files and lines that output names, by the form of the tool that wrote it."""
    part = lambda k, p: f"SELECT run_id, line_no, '{k}' AS form, file, {d.try_int('num')} AS at_line FROM (SELECT run_id, line_no, file, {d.at('nums', 'cast(pos + 1 AS INT)')} AS num FROM (SELECT run_id, line_no, {d.all('x', p, 1)} AS files, {d.all('x', p, 2)} AS nums FROM {plain_lines(d)} l WHERE {d.match('x', p)}) t {d.unnest('files', 'file')}) u"
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(part(k, p) for k, p in PLACES.items()) + ") v"


@book.sql
def txt21_22_error_names(d: Spark) -> str:
    """What output names: exceptions, frames, quoted names, failing tests and their parts, words of echoed code."""
    part = lambda k, p: f"SELECT run_id, line_no, '{k}' AS kind, n AS name FROM (SELECT run_id, line_no, {d.all('x', p, 1)} AS ns FROM {plain_lines(d)} l WHERE {d.match('x', p)}) t {d.unnest('ns', 'n')}"
    words = f"SELECT run_id, line_no, kind, w AS name FROM (SELECT * FROM ({part('echo', THINGS['echo'])}) e) t {d.unnest(d.all('name', '[A-Za-z_][A-Za-z0-9_]*'), 'w')} WHERE length(w) > 1"
    tests = f"SELECT run_id, line_no, kind, w AS name FROM (SELECT * FROM ({part('test', THINGS['test'])}) e) t {d.unnest(d.split('name', '::'), 'w')} WHERE w <> ''"
    rest = " UNION ALL ".join(part(k, THINGS[k]) for k in ("exception", "frame", "quoted"))
    return f"SELECT DISTINCT run_id, line_no, kind, name FROM ({rest} UNION ALL {words} UNION ALL {tests}) v WHERE name <> 'module' AND (kind = 'test' OR NOT {d.has(d.strings(W.TASK_STOPWORDS), 'lower(name)')})"


@book.sql
def txt23_build_folders(d: Spark) -> str:
    """Folders that a build says it works in."""
    up = lambda x: d.sub(d.sub(x, r"/?[^/]+$", ""), "^$", ".")
    part = lambda k, p: f"SELECT run_id, line_no, '{k}' AS how, replace(n, {d.lit(chr(92))}, '/') AS folder FROM (SELECT run_id, line_no, {d.all('x', p, 1)} AS ns FROM {plain_lines(d)} l WHERE {d.match('x', p)}) t {d.unnest('ns', 'n')}"
    return "SELECT DISTINCT run_id, line_no, how, " + f"CASE WHEN how = 'included' THEN {up('folder')} ELSE folder END AS folder FROM (" + " UNION ALL ".join(part(k, p) for k, p in FOLDERS.items()) + ") v"


@book.sql
def txt24_47_prompts(d: Spark) -> str:
    """Whether a text carries an error, and its first line that isn't error output."""
    has = lambda x: "(" + " OR ".join(d.match(x, p) for p in ERROR_TEXT) + ")"
    lines = d.split("replace(text, chr(13), chr(10))", "\n") if d.name == "spark" else "string_split(replace(text, chr(13), chr(10)), chr(10))"
    own = d.filter(d.map(lines, "x", W.trim(d, "x")), "x", f"x <> '' AND NOT {d.match('x', NOT_TASK)} AND NOT {has('x')}")
    return f"SELECT doc_id, {has('text')} AS has_error, coalesce(left({d.at(own, '1')}, {CUT}), 'Fix the error') AS task FROM documents WHERE text IS NOT NULL"


@book.sql
def txt31_router(d: Spark) -> str:
    """Which kind of worker a task text asks for: edits before runs, else a scout; a Task line speaks for its text."""
    task = f"CASE WHEN {d.match('text', TASK_LINE)} THEN {d.ext('text', TASK_LINE, 1)} ELSE text END"
    edit = rf"(?i)\b(?:{'|'.join(EDIT_VERBS)})\w*\b"
    return f"""SELECT kind, id, CASE WHEN {d.match('x', edit)} THEN 'edit' WHEN {d.match('x', RUNS)} THEN 'run' ELSE 'scout' END AS worker FROM (
        SELECT 'item' AS kind, item_id AS id, {task} AS x FROM eval_items WHERE text IS NOT NULL UNION ALL SELECT 'document', doc_id, {task} FROM documents WHERE text IS NOT NULL) t"""


@book.sql
def txt40_mentions(d: Spark) -> str:
    """Lines that address participants of a text (those who write in it): by full name, by the only name that begins so, or all."""
    lines = d.split("text", "\n") if d.name == "spark" else "string_split(text, chr(10))"
    x = W.trim(d, "x")
    return f"""WITH w AS (SELECT DISTINCT doc_id, lower(x) AS title FROM {texts(d)} t {d.unnest(d.all('text', '(?m)^@(' + chr(92) + 'S+) wrote:', 1), 'x')}),
        m AS (SELECT doc_id, {d.big('pos')} AS pos, {d.ext(x, MENTION, 1)} AS q, {d.ext(x, MENTION, 2)} AS b, {W.trim(d, d.ext(x, MENTION, 3))} AS body FROM {texts(d)} t {d.unnest(lines, 'x')} WHERE {d.match(x, MENTION)}),
        n AS (SELECT doc_id, pos, coalesce(q, '') <> '' AS quoted, {W.trim(d, "lower(CASE WHEN coalesce(q, '') <> '' THEN q ELSE b END)")} AS name, body FROM m),
        c AS (SELECT n.doc_id, n.pos, n.quoted, n.name, n.body, count(w.title) AS everyone, count_if(w.title = n.name) AS same, count_if(left(w.title, length(n.name)) = n.name) AS begin_so, min(CASE WHEN w.title = n.name THEN w.title END) AS exact, min(CASE WHEN left(w.title, length(n.name)) = n.name THEN w.title END) AS prefix FROM n JOIN w ON w.doc_id = n.doc_id GROUP BY n.doc_id, n.pos, n.quoted, n.name, n.body)
        SELECT doc_id, pos, name, body, CASE WHEN name = 'all' AND NOT quoted THEN everyone ELSE 1 END AS n_targets, CASE WHEN name = 'all' AND NOT quoted THEN '' ELSE coalesce(exact, prefix) END AS target
        FROM c WHERE (name = 'all' AND NOT quoted) OR same = 1 OR (same = 0 AND begin_so = 1)"""


@book.sql
def txt41_asking(d: Spark) -> str:
    """Whether the last 14 lines of a text show a choice or a question of a program."""
    lines = d.split("text", "\n") if d.name == "spark" else "string_split(text, chr(10))"
    last = f"slice({lines}, greatest(1, size({lines}) - 13), 14)" if d.name == "spark" else f"list_slice({lines}, greatest(1, len({lines}) - 13), len({lines}))"
    nl = "array_join(" + last + ", '\\n')" if d.name == "spark" else f"array_to_string({last}, chr(10))"
    return f"SELECT doc_id, {' OR '.join(d.match('tail', p) for p in WAITING)} AS asking FROM (SELECT doc_id, {nl} AS tail FROM documents WHERE text IS NOT NULL) t"


@book.sql
def scl41_44_46_clips(d: Spark) -> str:
    """Clipped to one line, cut at the last line end past half the limit, and quoted whole on one line."""
    flat = f"trim({d.sub('text', r'\s+', ' ')})"
    head = f"left(text, {CUT})"
    nl = d.lit("\n") if d.name == "spark" else "chr(10)"
    found = f"strpos(reverse({head}), {nl})" if d.name == "duck" else f"locate({nl}, reverse({head}))"
    back = f"(length({head}) - {found} + 1)"
    bs = d.lit("\\")
    quoted = f"concat('\"', replace(replace({flat}, {bs}, {d.lit(chr(92) * 2)}), '\"', {d.lit(chr(92) + chr(34))}), '\"')"
    return f"""SELECT doc_id, CASE WHEN length({flat}) > {CLIP} THEN concat(rtrim(left({flat}, {CLIP - 1})), '…') ELSE {flat} END AS clipped,
        CASE WHEN length(text) <= {CUT} THEN text WHEN {found} > 0 AND {back} > {CUT // 2} THEN left(text, cast({back} - 1 AS INT)) ELSE {head} END AS cut, {quoted} AS quoted FROM {texts(d)} t"""

