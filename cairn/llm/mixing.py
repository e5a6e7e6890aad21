"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import written

#: Ranks of a public byte-level BPE; a parameter, the file is never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text before merging, as public byte-level BPEs do.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one range of the hash order of all documents holds, about; a running sum goes over the rows of one source in a range.
RANGE_ROWS = 50_000
#: Blocks a mixture is scheduled in.
BLOCKS = 20_000


def _shipped(spark: SparkSession, path: str) -> str:
    """The name under which the workers find a file of the driver, sent to them once."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_cairn_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of every document that has an id; a null or empty text has none."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    name = _shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return src.mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def edf(blocks: dict[str, int]) -> list[str]:
    """The source of each slot: block k of n in m slots is released at k m / n and due by (k + 1) m / n.

    Of the blocks released the one due first runs; then at every slot each source has had
    its share of the slots up to less than one block.
    """
    m = sum(blocks.values())
    waiting = [(0, s, 0) for s, n in sorted(blocks.items()) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(m):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * m // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * m // blocks[s], s, k + 1))
    return out


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for mix, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            order = edf({r["source"]: r["n_blocks"] for r in rows})
            nth: dict[str, int] = {}
            block = [nth.__setitem__(s, nth.get(s, -1) + 1) or nth[s] for s in order]
            yield pa.RecordBatch.from_arrays([pa.array([mix] * len(order), pa.string()), pa.array(order, pa.string()), pa.array(block, pa.int64()), pa.array(range(len(order)), pa.int64())], names=["mix_id", "source", "block", "slot"])


def _plan(docs: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """Counted documents in hash order with what precedes them in their source, and the plan of each mixture and source."""
    counted, _ = written(token_counts(docs, vocabulary).dropDuplicates(["doc_id"]), "tokens")
    bits = max(4, (counted.count() // RANGE_ROWS).bit_length())
    h = F.xxhash64("doc_id")
    ranged = counted.where("source is not null").select("source", "doc_id", "tokens", h.alias("h"), F.shiftrightunsigned(h, 64 - bits).cast("int").alias("r"))
    sums = ranged.groupBy("source", "r").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    sums = sums.select("source", "r", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("before_range"), F.sum("t").over(whole).alias("source_tokens"))
    inside = Window.partitionBy("source", "r").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before_doc", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["source", "r"]).select("source", "doc_id", "tokens", (F.col("before_range") + F.col("before_doc")).alias("at"))
    have = sums.groupBy("source").agg(F.max("source_tokens").alias("source_tokens"))
    total = counted.agg(F.sum("tokens").alias("all_tokens"))
    t = targets.select(F.col("mix_id").cast("string").alias("mix_id"), F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    t = t.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = t.join(have, "source", "left").crossJoin(F.broadcast(total)).select(
        "mix_id",
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        "max_repeats",
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("all_tokens", F.lit(0))).cast("bigint").alias("need"),
    )
    return placed, plan


def _chosen(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per mixture and document chosen, with the times it is taken.

    A source is gone through in hash order again and again until its need is met; the last
    document is taken if more than half of it is needed.
    """
    p = plan.where("source_tokens > 0 and need > 0 and max_repeats > 0")
    x = placed.where("tokens > 0").join(p, "source")
    full = F.least(F.col("max_repeats").cast("bigint"), F.expr("need div source_tokens"))
    part = (full < F.col("max_repeats")) & (F.col("at") + F.col("tokens") / 2 <= F.expr("need % source_tokens"))
    times = (full + part.cast("bigint")).cast("int")
    return x.select("mix_id", "source", "doc_id", "tokens", "at", "source_tokens", times.alias("times")).where("times > 0")


def mix_report(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per mixture and source: target, tokens needed and taken, documents, most repeats, share reached.

    Each source is to have its share of all tokens of the documents; a source with too few
    is repeated up to ``max_repeats`` times and then stays below it.  Shares reached are of
    the mixture's own tokens.

    Defined results: documents with a null source belong to no mixture but count in the
    total; null targets are 0, null repeats 1; repeated rows count once; a source without
    documents has 0 tokens; empty tables give no rows or zeros; other columns aren't read.
    """
    placed, plan = _plan(docs, targets, vocabulary)
    got = _chosen(placed, plan).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("n_docs"), F.max("times").alias("most_repeats"))
    out = plan.join(got, ["mix_id", "source"], "left").select("mix_id", "source", "target_share", "max_repeats", F.col("need").alias("tokens_needed"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    mix = Window.partitionBy("mix_id")
    return out.withColumn("share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(mix)), F.lit(0.0)))


def mix_schedule(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, blocks: int = BLOCKS) -> DataFrame:
    """The documents of each mixture in order: mix_id, slot, seq, source, doc_id, copy, tokens, and the block of its source that slot is, of n_blocks, in n_slots.

    The tokens of a mixture are cut into about ``blocks`` equal blocks.  Pfair scheduling
    gives every block of a source a release time and a deadline from the source's share
    and takes the released block with the earliest deadline, so at every slot each source
    is less than one block off its share.  A copy of a document belongs to the block its
    first token falls in; ``seq`` orders the copies in a slot.

    Scale: positions are running sums in two steps, over hash ranges and inside one, so a
    source with a third of all documents is many tasks; the schedule is bounded by ``blocks``.
    """
    placed, plan = _plan(docs, targets, vocabulary)
    chosen, _ = written(_chosen(placed, plan), "chosen")
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("t"), F.max(F.col("at") + (F.col("times") - 1) * F.col("source_tokens")).alias("last"))
    block = F.greatest(F.lit(1), F.ceil(F.sum("t").over(Window.partitionBy("mix_id")) / F.lit(blocks)))
    sized = got.select("mix_id", "source", block.alias("block_tokens"), "last").withColumn("n_blocks", F.expr("last div block_tokens + 1"))
    slots = sized.groupBy("mix_id").agg(F.collect_list(F.struct("source", "n_blocks")).alias("s")).mapInArrow(_slots, "mix_id string, source string, block bigint, slot bigint")
    copies = chosen.select("mix_id", "source", "doc_id", "tokens", "at", "source_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    copies = copies.join(sized.select("mix_id", "source", "block_tokens"), ["mix_id", "source"])
    start = F.col("at") + (F.col("copy") - 1) * F.col("source_tokens")
    copies = copies.select("mix_id", "source", "doc_id", "copy", "tokens", start.alias("seq"), F.floor(start / F.col("block_tokens")).alias("block"))
    sums = sized.groupBy("mix_id").agg(F.sum("n_blocks").alias("n_slots"))
    slots = slots.join(sized.select("mix_id", "source", "n_blocks"), ["mix_id", "source"]).join(sums, "mix_id")
    return copies.join(slots, ["mix_id", "source", "block"]).select("mix_id", "slot", "seq", "source", "doc_id", "copy", "tokens", "block", "n_blocks", "n_slots")
