"""Evaluation texts that leak into training text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tiling import Items, edges, leaked, words
from cairn.session import written

#: Characters of evaluation items that one pass over the documents takes along.
BLOCK_CHARS = 8_000_000

_OUT = "doc_id bigint, item_id bigint, words int, edits int, coverage double"


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the words of each text, by which items are the same."""
    for b in batches:
        key = pa.array([" ".join(words(t)) for t in b.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), key], names=["item_id", "text", "same"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings and ends of texts with what is next to them, and their distinct words."""
    for b in batches:
        for t in b.column(0).to_pylist():
            rows = [(0, k, after) for k, after in edges(t)] + [(1, w, None) for w in set(words(t))]
            kind, key, after = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.string()), pa.array(after, pa.string())], names=["kind", "key", "after"])


def contamination(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item it holds, wholly or in a passage of 15 words or more.

    Columns: doc_id, item_id, the words and edits of the longest passage, and coverage, the
    share of the item's words in it.  Greedy string tiling: seeds are runs of three tokens
    that a document and an item share, found by a rolling Karp-Rabin hash; the longest
    matches that don't overlap are marked first; tiles with short gaps make a passage, in
    the item's order or reordered, of whose words at most one in six is changed.  Beginnings
    and ends of whole sentences that items share and then go on differently are standing
    instructions and never count; a passage has to hold most of the weight of its stretch of
    the item, a token weighing by how few items hold it, so tasks put in the same phrases
    aren't taken for the item.  Items of the same words are compared as one and all come out.

    Defined results: null and empty texts hold nothing; null keys are dropped; items that
    repeat count once; documents that repeat give their rows each; other columns are not
    read; an empty side gives an empty result.

    Scale: a map over the documents without a shuffle.  The items are a query set; they go
    along in blocks of at most ``block_chars`` characters, a pass over the documents each,
    so what is sent to executors is bounded however many items there are.
    """
    spark = docs.sparkSession
    q = items.select(F.col(item_key).cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
    total = q.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    src = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    parts = []
    kinds = "kind int, key string, after string"
    counted = None
    if n > 1:  # of the whole set: how many items differ, hold a word, and go on after an edge
        one = q.mapInArrow(_same, "item_id bigint, text string, same string").groupBy("same").agg(F.min("text").alias("text")).select("text")
        one, _ = written(one, "items")
        counted, _ = written(one.mapInArrow(_parts, kinds).groupBy("kind", "key").agg(F.count("*").alias("n"), (F.min("after") < F.max("after")).alias("differ")), "item-words")
        differing = one.count()
    for k in range(n):
        mine = q if n == 1 else q.where((F.pmod(F.xxhash64("item_id"), F.lit(n)) == k))
        if n > 1:
            here = mine.select("text").mapInArrow(_parts, kinds).select("kind", "key").distinct()
            standing, held = set(), {}
            for kind, key, many, differ in here.join(counted, ["kind", "key"]).where("kind = 1 or differ").select("kind", "key", "n", "differ").collect():
                if kind:
                    held[key] = many
                else:
                    standing.add(key)
            block = Items([tuple(r) for r in mine.collect()], standing, held, differing)
        else:
            block = Items([tuple(r) for r in mine.collect()])
        size = [max(1, len({g for g, i in zip(x.group, x.ids) if i})) for x in block.items]

        def run(batches: Iterator[pa.RecordBatch], block: Items = block, size: list[int] = size) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                got = [(w, i, hit, edits, hit / size[x]) for w, x, hit, edits in leaked(texts, block) for i in block.items[x].item_ids]
                if got:
                    w, item, hit, edits, share = zip(*got)
                    cols = [ids.take(pa.array(w)), pa.array(item, pa.int64()), pa.array(hit, pa.int32()), pa.array(edits, pa.int32()), pa.array(share, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "words", "edits", "coverage"])

        parts.append(src.mapInArrow(run, _OUT))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _OUT)
