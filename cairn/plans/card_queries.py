"""Cards of repositories: remotes, fingerprints, versions and links (SCL35-36, SCL39, TOP03, SRC37, JON21-22, JON28, SET11)."""

from __future__ import annotations

from cairn.plans.code_queries import import_targets, imports
from cairn.plans.dialect import Book, Spark

book = Book()


def remote(d: Spark, r: str) -> tuple[str, str]:
    """Host and path of a remote: https, ssh, scp and bare forms; user, port and .git dropped, the host in lower case; a local path has none."""
    body = d.sub(r, r"^[a-z+]+://(?:[^@/]*@)?|^[^@/:]+@", "")
    form = r"^([A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)(?::\d+)?[:/]+(.+)$"
    host = f"lower({d.ext(body, form, 1)})"
    ok = f"({d.match(body, form)} AND NOT {d.match(r, '^file:')} AND ({host} = 'localhost' OR {host} LIKE '%.%'))"
    path = d.sub(d.sub(d.ext(body, form, 2), r"/+$", ""), r"\.git$", "")
    return f"CASE WHEN {ok} THEN {host} ELSE '' END", f"CASE WHEN {ok} THEN {path} ELSE '' END"


def cards(d: Spark) -> str:
    """Cards with their repository, the remote as one of four spellings has it, and a root by their packages."""
    repo = d.ext("text", r"(?m)^repo: ([^\s]+)", 1)
    return f"""(SELECT doc_id, repo, CASE doc_id % 4 WHEN 0 THEN concat('git@Example.org:garden/', repo, '.git') WHEN 1 THEN concat('https://user:x@EXAMPLE.org:8443/garden/', repo, '/') WHEN 2 THEN concat('ssh://git@example.org/garden/', repo) ELSE concat('/srv/', repo) END AS remote,
        left({d.sha1('packages')}, 12) AS root FROM (SELECT doc_id, {repo} AS repo, {d.ext('text', r'(?m)^packages: ([^\n]*)$', 1)} AS packages FROM documents WHERE text IS NOT NULL AND {d.match('text', r'(?m)^repo: [^\s]+')}) t)"""


def normal(d: Spark) -> str:
    host, path = remote(d, "remote")
    return f"(SELECT doc_id, repo, root, CASE WHEN h = '' THEN '' ELSE concat(h, '/', p) END AS remote, h AS host, p AS path FROM (SELECT *, {host} AS h, {path} AS p FROM {cards(d)} c) n)"


@book.sql
def scl35_36_remotes(d: Spark) -> str:
    """Remotes of cards brought to host and path."""
    return f"SELECT doc_id, remote, host, path FROM {normal(d)} n"


@book.sql
def src37_fingerprints(d: Spark) -> str:
    """Fingerprint of each repository: its remote and the sorted roots of its cards."""
    return f"SELECT repo, left({d.sha256("concat(remote, '|', roots)")}, 16) AS fingerprint, n FROM (SELECT repo, max(remote) AS remote, {d.join(d.gather_set('root'), ',')} AS roots, count(*) AS n FROM {normal(d)} n GROUP BY repo) t"


@book.sql
def jon21_22_same_repository(d: Spark) -> str:
    """The first card that is of the same repository as each card: by remote, else by a shared root."""
    return f"""SELECT doc_id, CASE WHEN remote <> '' AND by_remote < doc_id THEN by_remote WHEN by_root < doc_id THEN by_root END AS first_card, CASE WHEN remote <> '' AND by_remote < doc_id THEN 'remote' WHEN by_root < doc_id THEN 'root' ELSE 'new' END AS why
        FROM (SELECT n.doc_id, n.remote, r.m AS by_remote, o.m AS by_root FROM {normal(d)} n LEFT JOIN (SELECT remote, min(doc_id) AS m FROM {normal(d)} a WHERE remote <> '' GROUP BY remote) r ON r.remote = n.remote JOIN (SELECT root, min(doc_id) AS m FROM {normal(d)} b GROUP BY root) o ON o.root = n.root) t"""


@book.sql
def jon28_set11_links(d: Spark) -> str:
    """What each repository is linked to, in which role: distinct links by import, none to itself."""
    repo = lambda x: d.ext(x, "^([^/]+)/", 1)
    link = f"(SELECT DISTINCT {repo('path')} AS manager, {repo('target')} AS worker FROM {imports(d)} i WHERE {repo('path')} <> {repo('target')})"
    terms = "(SELECT repo, count(*) AS n FROM documents WHERE repo IS NOT NULL GROUP BY repo)"
    return f"""SELECT l.me, l.other, l.role, coalesce(t.n, 0) AS n_documents FROM (SELECT manager AS me, worker AS other, 'worker' AS role FROM {link} a UNION ALL SELECT worker, manager, 'manager' FROM {link} b) l LEFT JOIN {terms} t ON t.repo = l.other"""


#: The release that newer ones are looked for.
CURRENT = [5, 0]


@book.sql
def scl39_top03_versions(d: Spark) -> str:
    """Newest dotted number above the current release in each run's lines; parts compare as numbers, what has a suffix doesn't count."""
    tags = d.all("x", r"(?:^|[\s(=v])(\d+(?:\.\d+)+)(?:$|[\s),;])", 1)
    now = f"array({', '.join(f'{v}L' for v in CURRENT)})" if d.name == "spark" else str(CURRENT)
    parts = d.map(d.split("tag", "."), "y", d.try_int("y"))
    cmp = f"v > {now}" if d.name == "duck" else f"array_max(array(v, {now})) = v AND v <> {now}"
    return f"""SELECT run_id, tag FROM (SELECT run_id, tag, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, tag) AS k FROM (SELECT run_id, tag, {parts} AS v FROM (SELECT DISTINCT run_id, tag FROM (SELECT run_id, text AS x FROM log_lines WHERE text IS NOT NULL AND run_id IS NOT NULL) l {d.unnest(tags, 'tag')}) a) b WHERE {cmp}) c WHERE k = 1"""


def updates(d: Spark) -> str:
    """Two readings of the files: what an index held (each path's oldest row) and what is there now (its newest)."""
    return f"""(SELECT path, min(mtime) AS old_time, max(mtime) AS new_time, min_by({d.sha256('content')}, coalesce(mtime, TIMESTAMP '1970-01-01 00:00:00')) AS old_hash, max_by({d.sha256('content')}, coalesce(mtime, TIMESTAMP '1970-01-01 00:00:00')) AS new_hash, count(content) AS n FROM source_files WHERE path IS NOT NULL GROUP BY path)"""


def refreshed(d: Spark) -> str:
    return f"""(SELECT coalesce(f.path, s.path) AS path, CASE WHEN f.path IS NULL THEN 'removed' WHEN s.path IS NULL THEN 'added' WHEN f.old_time IS NOT DISTINCT FROM f.new_time THEN 'unchanged' WHEN f.old_hash IS NOT DISTINCT FROM f.new_hash THEN 'touched' ELSE 'changed' END AS state, coalesce(s.n, 0) AS n_symbols
        FROM {updates(d)} f FULL OUTER JOIN (SELECT path, count(DISTINCT id) AS n FROM symbols WHERE path IS NOT NULL GROUP BY path) s ON s.path = f.path)"""


@book.sql
def str12_refresh(d: Spark) -> str:
    """Files by what a refresh of the index (the symbols) does with them: added, removed, parsed anew, or left as they are."""
    return f"SELECT path, state, n_symbols FROM {refreshed(d)} r"


@book.sql
def str13_reresolved(d: Spark) -> str:
    """Imports looked up again by a refresh: of all files where the set of files changed, else of those parsed anew."""
    return f"""WITH r AS (SELECT * FROM {refreshed(d)} r), a AS (SELECT count_if(state IN ('added', 'removed')) AS n FROM r)
        SELECT i.path, i.module, i.target FROM ({import_targets(d)}) i JOIN r ON r.path = i.path CROSS JOIN a WHERE a.n > 0 OR r.state IN ('added', 'changed')"""


@book.sql
def flt07_set09_10_stale_symbols(d: Spark) -> str:
    """Symbols as facts: stale with the first reason why, else kept, promoted where documented, demoted where their file changed."""
    return f"""SELECT s.id, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.n = 0 THEN 'empty' WHEN f.old_hash IS DISTINCT FROM f.new_hash THEN 'changed' ELSE 'fresh' END AS reason,
        CASE WHEN f.path IS NULL OR f.n = 0 THEN 'evict' WHEN f.old_hash IS DISTINCT FROM f.new_hash THEN 'demote' WHEN s.doc <> '' THEN 'promote' ELSE 'keep' END AS step
        FROM (SELECT id, max(path) AS path, max(coalesce(doc, '')) AS doc FROM symbols WHERE id IS NOT NULL GROUP BY id) s LEFT JOIN {updates(d)} f ON f.path = s.path"""


@book.sql
def str14_recent_stores(d: Spark) -> str:
    """Sessions and the repositories of the files they touched within seven days before the session's end."""
    p = r'"file_path": ?"/srv/([^/"\\]+)/'
    return f"""WITH t AS (SELECT session_id, received_at, {d.ext('message', p, 1)} AS store FROM transcripts WHERE message IS NOT NULL AND session_id IS NOT NULL), e AS (SELECT session_id, max(received_at) AS ended FROM t GROUP BY session_id)
        SELECT t.session_id, t.store, count(*) AS n, max({d.epoch('t.received_at')}) AS last_micros FROM t JOIN e ON e.session_id = t.session_id WHERE t.store <> '' AND t.received_at >= e.ended - INTERVAL '7' DAY GROUP BY t.session_id, t.store"""


@book.sql
def jon15_session_candidates(d: Spark) -> str:
    """Files that a session read and didn't write itself, once a session."""
    read, wrote = r'"name": ?"Read"', r'"name": ?"(?:Edit|Write)"'
    path = r'"file_path": ?"(/srv/[^"\\]+)"'
    of = lambda p: f"(SELECT DISTINCT session_id, {d.ext('message', path, 1)} AS path FROM transcripts WHERE message IS NOT NULL AND session_id IS NOT NULL AND {d.match('message', p)})"
    return f"""SELECT r.session_id, r.path FROM {of(read)} r WHERE r.path <> '' AND NOT EXISTS (SELECT 1 FROM {of(wrote)} w WHERE w.session_id = r.session_id AND w.path = r.path)"""


@book.sql
def snk13_16_card_render(d: Spark) -> str:
    """One text per card: repository, languages, packages, facts and what it is linked to."""
    field = lambda k: d.ext("text", rf"(?m)^{k}: ([^\n]*)$", 1)
    facts = d.size(d.all("text", r"(?m)^  - [^\n]+$"))
    nl = "'\\n'" if d.name == "spark" else "chr(10)"
    return f"""SELECT c.doc_id, concat('# ', c.repo, {nl}, 'languages: ', c.languages, {nl}, 'packages: ', c.packages, {nl}, 'facts: ', c.n_facts, {nl}, 'links: ', coalesce(l.links, 'none')) AS card
        FROM (SELECT doc_id, {d.ext('text', r'(?m)^repo: ([^\s]+)', 1)} AS repo, {field('languages')} AS languages, {field('packages')} AS packages, {facts} AS n_facts FROM documents WHERE text IS NOT NULL AND {d.match('text', r'(?m)^repo: [^\s]+')}) c
        LEFT JOIN (SELECT repo, {d.join(d.gather_set('target'), ', ')} AS links FROM (SELECT {d.ext('path', '^([^/]+)/', 1)} AS repo, {d.ext('target', '^([^/]+)/', 1)} AS target FROM {imports(d)} i) x WHERE repo <> target GROUP BY repo) l ON l.repo = c.repo"""


@book.sql
def snk09_index_overview(d: Spark) -> str:
    """The overview of all repositories, one line each: documents, files and symbols."""
    repo = d.ext("path", "^([^/]+)/", 1)
    return f"""SELECT a.repo, concat('- ', a.repo, ' (', a.n_docs, ' notes, ', coalesce(f.n, 0), ' files, ', coalesce(s.n, 0), ' symbols)') AS line
        FROM (SELECT repo, count(*) AS n_docs FROM documents WHERE repo IS NOT NULL GROUP BY repo) a
        LEFT JOIN (SELECT {repo} AS repo, count(DISTINCT path) AS n FROM source_files WHERE path IS NOT NULL GROUP BY {repo}) f ON f.repo = a.repo LEFT JOIN (SELECT {repo} AS repo, count(DISTINCT id) AS n FROM symbols WHERE path IS NOT NULL GROUP BY {repo}) s ON s.repo = a.repo"""


@book.sql
def snk10_fact_bundle(d: Spark) -> str:
    """Facts that leave a store: not stale, portable fields only, sources relative to their repository."""
    return f"""SELECT s.id, s.name, s.type, {d.sub('s.path', '^[^/]+/', '')} AS source, left({d.sha256('s.doc')}, 16) AS hash FROM (SELECT id, max(name) AS name, max(lower(trim(type))) AS type, max(path) AS path, max(coalesce(doc, '')) AS doc FROM symbols WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id) s
        JOIN {updates(d)} f ON f.path = s.path WHERE s.doc <> '' AND f.n > 0 AND f.old_hash IS NOT DISTINCT FROM f.new_hash"""
