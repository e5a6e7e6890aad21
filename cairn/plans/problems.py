"""The pN_ queries whose operators lie in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.hierarchy import descendants, hierarchy
from cairn.operators.log_entries import log_entries
from cairn.operators.nested import nested_blocks, nested_messages, nested_objects
from cairn.streaming.deliveries import deliveries
from cairn.tables import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every symbol."""
    return hierarchy(load(spark, d, "symbols"), paths=False)


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of each symbol by distance, counted, and the longest path below it."""
    pairs = descendants(hierarchy(load(spark, d, "symbols")))
    return pairs.groupBy("ancestor").agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of every symbol from its root down, '' on or below a cycle."""
    return hierarchy(load(spark, d, "symbols")).select("id", "root", "depth", F.array_join("path", " > ").alias("path"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each symbol, with their distance."""
    return descendants(hierarchy(load(spark, d, "symbols")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object that is a list element of a message, with its parent."""
    return nested_objects(load(spark, d, "transcripts"), text=False).select("line_id", "path", "parent_path")


def p4_messages(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of messages."""
    return nested_messages(load(spark, d, "transcripts"))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of content blocks."""
    return nested_blocks(load(spark, d, "transcripts"))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every object of a list with its own JSON."""
    return nested_objects(load(spark, d, "transcripts"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """The copy that stands of every message, with its output tokens."""
    return deliveries(spark, f"{d}/transcripts.parquet", load(spark, d, "transcripts").schema).kept()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of messages delivered before or better elsewhere."""
    return deliveries(spark, f"{d}/transcripts.parquet", load(spark, d, "transcripts").schema).dropped()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all runs."""
    return log_entries(load(spark, d, "log_lines"), load(spark, d, "runs"), message=False)


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all runs with their messages."""
    return log_entries(load(spark, d, "log_lines"), load(spark, d, "runs"))


def p6_unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose entries leave out a line after the first entry or span one twice ('gap'), and entries whose message isn't in their first line ('message'): no rows where all holds."""
    e = log_entries(load(spark, d, "log_lines"), load(spark, d, "runs"))
    lines = load(spark, d, "log_lines").where("run_id is not null and line_no is not null").groupBy("run_id", "line_no").agg(F.max("text").alias("text"))
    first = e.groupBy("run_id").agg(F.min("first_line").alias("a"), F.max("last_line").alias("b"), F.sum(F.col("last_line") - F.col("first_line") + 1).alias("n"))
    ends = lines.groupBy("run_id").agg(F.max("line_no").alias("end"))
    gap = first.join(ends, "run_id").where("n <> b - a + 1 or b <> end").select("run_id", F.lit("gap").alias("kind"))
    plain = lambda c: F.regexp_replace(c, r"\x1b\[[0-9;]*[A-Za-z]|\\", "")
    off = e.join(lines, [e["run_id"] == lines["run_id"], e["first_line"] == lines["line_no"]]).where(~plain("text").contains(plain("message")))
    return gap.unionByName(off.select(e["run_id"], F.lit("message").alias("kind"))).groupBy("kind").count().select("kind", F.col("count").alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_descendants, p3_paths, p3_pairs, p4_found, p4_messages, p4_blocks, p4_objects, p5_found, p5_kept, p6_found, p6_entries, p6_unplaced)}

_TREE = """WITH RECURSIVE n AS (
            SELECT id, min(nullif(parent, '')) AS parent FROM symbols WHERE id IS NOT NULL GROUP BY id
        ), t AS (
            SELECT id, id AS root, 0 AS depth, id AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
            UNION ALL
            SELECT n.id, t.root, t.depth + 1, t.path || ' > ' || n.id FROM n JOIN t ON n.parent = t.id
        )"""

ORACLES = {
    "p3_found": """
        WITH RECURSIVE n AS (
            SELECT id, min(nullif(parent, '')) AS parent FROM symbols WHERE id IS NOT NULL GROUP BY id
        ), t AS (
            SELECT id, id AS root, 0 AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
            UNION ALL
            SELECT n.id, t.root, t.depth + 1 FROM n JOIN t ON n.parent = t.id
        )
        SELECT n.id, coalesce(t.root, '') AS root, CAST(coalesce(t.depth, -1) AS INT) AS depth FROM n LEFT JOIN t ON n.id = t.id""",
    "p3_descendants": """
        WITH RECURSIVE n AS (
            SELECT id, min(nullif(parent, '')) AS parent FROM symbols WHERE id IS NOT NULL GROUP BY id
        ), t AS (
            SELECT id, 0 AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
            UNION ALL
            SELECT n.id, t.depth + 1 FROM n JOIN t ON n.parent = t.id
        ), u AS (
            SELECT n.parent AS ancestor, n.id, 1 AS distance FROM n JOIN t ON n.id = t.id WHERE t.depth > 0
            UNION ALL
            SELECT n.parent, u.id, u.distance + 1 FROM u JOIN n ON n.id = u.ancestor WHERE n.parent IS NOT NULL AND n.parent IN (SELECT id FROM n)
        )
        SELECT ancestor, count(*) AS n_descendants, max(distance) AS height FROM u GROUP BY ancestor""",
    "p3_paths": _TREE + " SELECT n.id, coalesce(t.root, '') AS root, CAST(coalesce(t.depth, -1) AS INT) AS depth, coalesce(t.path, '') AS path FROM n LEFT JOIN t ON n.id = t.id",
    "p3_pairs": _TREE + """ SELECT ancestor, id, CAST(depth + 1 - pos AS INT) AS distance FROM (
        SELECT id, depth, unnest(string_split(path, ' > ')) AS ancestor, generate_subscripts(string_split(path, ' > '), 1) AS pos FROM t) u WHERE pos <= depth""",
    "p4_blocks": """
        WITH RECURSIVE m AS (
            SELECT line_id, '' AS base, '' AS ring, m->'content' AS c FROM (SELECT line_id, CASE WHEN json_valid(message) THEN message::JSON END AS m FROM transcripts) WHERE json_type(m) = 'OBJECT'
        ), b AS (
            SELECT line_id, base || 'content[' || (i - 1) || ']' AS path, ring AS parent_path, e, whole FROM (
                SELECT *, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT line_id, base, ring, json_type(c) <> 'ARRAY' AS whole, CASE WHEN json_type(c) = 'ARRAY' THEN c->'$[*]' WHEN json_type(c) IN ('OBJECT', 'VARCHAR') THEN [c] ELSE [] END AS l FROM m)) x
            UNION ALL
            SELECT line_id, path || '.content[' || (i - 1) || ']', path, e, whole FROM (
                SELECT line_id, path, whole, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (
                    SELECT line_id, path, json_type(e->'content') <> 'ARRAY' AS whole, CASE WHEN json_type(e->'content') = 'ARRAY' THEN e->'content'->'$[*]' WHEN json_type(e->'content') IN ('OBJECT', 'VARCHAR') THEN [e->'content'] ELSE [] END AS l FROM b WHERE json_type(e) = 'OBJECT')) y
        )
        SELECT line_id, path, parent_path, e->>'type' AS type, e->>'id' AS id, e->>'name' AS name, e->>'tool_use_id' AS tool_use_id,
            CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' ELSE e->>'text' END AS text FROM b WHERE json_type(e) = 'OBJECT' OR whole""",
    "p5_kept": """
        WITH m AS (
            SELECT line_id, m->>'id' AS message_id, TRY_CAST(m->'usage'->>'output_tokens' AS BIGINT) AS n
            FROM (SELECT line_id, CASE WHEN json_valid(message) THEN message::JSON END AS m FROM transcripts) WHERE m->>'id' <> ''
        )
        SELECT message_id, line_id, n AS tokens FROM (
            SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY n DESC NULLS LAST, line_id) AS k FROM m) WHERE k = 1""",
    "p6_unplaced": "SELECT '' AS kind, 0::BIGINT AS n WHERE false",
    "p4_messages": """
        SELECT line_id, m->>'id' AS id, m->>'role' AS role, m->>'model' AS model, m->>'stop_reason' AS stop_reason,
            TRY_CAST(m->'usage'->>'input_tokens' AS BIGINT) AS input_tokens, TRY_CAST(m->'usage'->>'output_tokens' AS BIGINT) AS output_tokens,
            TRY_CAST(m->'usage'->>'cache_read_input_tokens' AS BIGINT) AS cache_read_input_tokens,
            TRY_CAST(m->'usage'->>'cache_creation_input_tokens' AS BIGINT) AS cache_creation_input_tokens
        FROM (SELECT line_id, CASE WHEN json_valid(message) THEN message::JSON END AS m FROM transcripts) WHERE m IS NOT NULL""",
    "p5_found": """
        WITH m AS (
            SELECT line_id, m->>'id' AS message_id, TRY_CAST(m->'usage'->>'output_tokens' AS BIGINT) AS n
            FROM (SELECT line_id, CASE WHEN json_valid(message) THEN message::JSON END AS m FROM transcripts) WHERE m->>'id' <> ''
        )
        SELECT message_id, line_id FROM (
            SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY n DESC NULLS LAST, line_id) AS k FROM m) WHERE k > 1""",
}
