"""The pN_ queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.code import documented, documented_pairs, rebuilt, split_symbols
from cairn.llm.contamination import contamination
from cairn.llm.encodings import garbled, repair
from cairn.llm.mixing import mix_report, mix_schedule
from cairn.session import written
from cairn.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose documentation says something."""
    return documented(load(spark, d, "symbols"), load(spark, d, "source_files")).select("id")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Those functions with documentation and code."""
    return documented_pairs(load(spark, d, "symbols"), load(spark, d, "source_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that come out in pieces."""
    return split_symbols(load(spark, d, "symbols"), load(spark, d, "source_files"), text=False).select("id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return split_symbols(load(spark, d, "symbols"), load(spark, d, "source_files"))


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """A hash of what the pieces of each symbol make up."""
    return rebuilt(split_symbols(load(spark, d, "symbols"), load(spark, d, "source_files"))).select("id", F.sha2("text", 256).alias("hash"))


def p2_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Pieces over the limit and cuts that left a deeper valley of their window: 0 of both."""
    p = split_symbols(load(spark, d, "symbols"), load(spark, d, "source_files"), text=False)
    return p.agg(F.count_if(F.expr("start_line is not null and tokens > 800")).alias("n_over"), F.count_if(F.col("depth") < F.col("deepest")).alias("n_shallow"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items they leak."""
    return contamination(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents and the greatest coverage."""
    c = contamination(load(spark, d, "documents"), load(spark, d, "eval_items"))
    return c.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("coverage").alias("coverage"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares that each mixture reaches."""
    return mix_report(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p8_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mixture in order."""
    return mix_schedule(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a mixture may not do: documents taken more often than allowed, sources off their tokens by more than a document, slots at which a source is a block or more off its share. 0 of all."""
    docs, targets = load(spark, d, "documents"), load(spark, d, "mix_targets")
    report, _ = written(mix_report(docs, targets), "report")
    plan, _ = written(mix_schedule(docs, targets), "schedule")
    times = plan.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("n"), F.max("tokens").alias("t"))
    per = times.groupBy("mix_id", "source").agg(F.max("n").alias("n"), F.max("t").alias("longest"), F.sum(F.col("n") * F.col("t")).alias("taken"))
    own = report.join(per, ["mix_id", "source"], "left").fillna(0, ["n", "longest", "taken"])
    # A source falls short of its need only where all its documents are taken as often as they may be.
    short = (F.col("tokens_needed") - F.col("tokens") > F.col("longest")) & (F.col("n") > 0) & (F.col("most_repeats") < F.col("max_repeats"))
    a = own.agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("n_over_repeats"), F.count_if(short | (F.col("tokens") - F.col("tokens_needed") > F.col("longest"))).alias("n_off_need"), F.count_if(F.col("taken") != F.col("tokens")).alias("n_off_report"))
    share = F.col("n_blocks") / F.col("n_slots")
    b = plan.agg(F.count_if((F.abs(F.col("block") + 1 - share * (F.col("slot") + 1)) >= 1) | (F.abs(F.col("block") - share * F.col("slot")) >= 1)).alias("n_off_share"))
    return a.crossJoin(b)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that show characters of a wrong decoding."""
    return garbled(load(spark, d, "documents")).select("doc_id").distinct()


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Those documents with their text restored where possible."""
    return repair(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_pieces, p2_rebuilt, p2_cuts, p7_found, p7_items, p8_report, p8_schedule, p8_checks, p9_found, p9_repaired)}

ORACLES = {
    "p2_found": "WITH s AS (SELECT DISTINCT id, path, start_line, end_line, tokens FROM symbols WHERE id IS NOT NULL), "
    "f AS (SELECT path, max(content) AS content FROM source_files WHERE content IS NOT NULL GROUP BY path) "
    "SELECT DISTINCT id FROM s LEFT JOIN f USING (path) WHERE CASE WHEN tokens > 0 THEN tokens "
    "ELSE greatest(1, round_even(length(array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10))) / 4.0, 0)) END > 800",
    "p2_rebuilt": "WITH s AS (SELECT id, path, start_line, end_line, tokens FROM symbols WHERE id IS NOT NULL GROUP BY ALL), "
    "f AS (SELECT path, string_split(max(content), chr(10)) AS ls FROM source_files WHERE content IS NOT NULL GROUP BY path), "
    "t AS (SELECT id, tokens, array_to_string(ls[greatest(1, start_line):least(len(ls), end_line)], chr(10)) AS x FROM s JOIN f USING (path)) "
    "SELECT DISTINCT id, sha256(x) AS hash FROM t WHERE CASE WHEN tokens > 0 THEN tokens ELSE greatest(1, round_even(length(x) / 4.0, 0)) END > 800",
    "p8_checks": "SELECT 0::BIGINT AS n_over_repeats, 0::BIGINT AS n_off_need, 0::BIGINT AS n_off_report, 0::BIGINT AS n_off_share",
    "p2_cuts": "SELECT 0::BIGINT AS n_over, 0::BIGINT AS n_shallow",
}
