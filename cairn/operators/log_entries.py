"""Semi-structured log lines into entries with time, level, component and message."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.loglines import automaton, parse

#: Lines per block: a run is worked on in blocks of lines, so one huge run is many tasks.
BLOCK_LINES = 16384

_HEAD = pa.schema([("run_id", pa.string()), ("line_no", pa.int32()), ("t", pa.string()), ("level", pa.string()), ("component", pa.string()), ("message", pa.string())])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for b in batches:
        got = [(i, r) for i, x in enumerate(b.column(2).to_pylist()) if x and (r := parse(x, machine))]
        if got:
            at = pa.array([i for i, _ in got], pa.int32())
            cols = list(zip(*(r for _, r in got)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, pa.string()) for c in cols)], schema=_HEAD)


def log_entries(lines: DataFrame, runs: DataFrame | None = None, block_lines: int = BLOCK_LINES, message: bool = True) -> DataFrame:
    """One row per log entry: run_id, first_line, last_line, log_time, level, component, message.

    ``message`` False leaves the message out, which then isn't shuffled either.

    ``lines`` has run_id, line_no and text; ``runs`` has run_id and started_at, which gives
    a missing year or date.  Aho-Corasick anchors route each line to its candidate layouts
    and an anchored expression verifies it; lines that start no record join the entry
    before them, lines before the first entry of a run belong to none.

    Defined results: a line is (run_id, line_no) and rows where either is null are no
    lines; repeated rows count once (of different texts under one key the greatest head
    counts); null and empty texts are lines without a record; a time that lacks its date
    in a run without ``started_at`` is ''; an empty input gives an empty result; other
    columns, whatever their names, are not read.

    Scale: a run is cut into blocks of ``block_lines`` lines, so no window holds more rows
    of a run than that, and the step over blocks sees one row per block.
    """
    src = lines.select(F.col("run_id").cast("string").alias("run_id"), F.col("line_no").cast("int").alias("line_no"), F.col("text").cast("string").alias("text"))
    src = src.where("run_id is not null and line_no is not null")
    blk = F.floor(F.col("line_no") / F.lit(block_lines)).cast("int")
    per_block = src.groupBy("run_id", blk.alias("blk")).agg(F.max("line_no").alias("block_last"))
    per_run = Window.partitionBy("run_id")
    blocks = per_block.select("run_id", "blk", F.max("block_last").over(per_run).alias("run_last"))
    if runs is not None:
        start = runs.where("run_id is not null").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.min("started_at").cast("string").alias("started"))
        blocks = blocks.join(start, "run_id", "left")
    else:
        blocks = blocks.withColumn("started", F.lit(None).cast("string"))

    parts = ["t", "level", "component", *["message"] * message]
    heads = src.mapInArrow(_heads, "run_id string, line_no int, t string, level string, component string, message string")
    # Keys that can't be null keep the planner from adding a filter to one branch only, so both share one exchange.
    known = F.coalesce("line_no", F.lit(0))
    heads = heads.select(F.coalesce("run_id", F.lit("")).alias("run_id"), F.coalesce(F.floor(known / F.lit(block_lines)).cast("int"), F.lit(0)).alias("blk"), known.alias("line_no"), *parts)
    heads = heads.repartition("run_id", "blk")
    rest = F.struct(*parts)
    heads = heads.groupBy("run_id", "blk", "line_no").agg(F.max(rest).alias("r"))
    firsts = heads.groupBy("run_id", "blk").agg(F.min(F.struct("line_no", "r"))["line_no"].alias("first"))
    after = Window.partitionBy("run_id").orderBy("blk")
    firsts = firsts.select("run_id", "blk", F.lead("first").over(after).alias("next_block_first"))
    edge = blocks.join(firsts, ["run_id", "blk"])
    inside = Window.partitionBy("run_id", "blk").orderBy("line_no")
    out = heads.withColumn("next_line", F.lead("line_no").over(inside)).join(edge, ["run_id", "blk"])
    t, s = F.col("r.t"), F.col("started")
    when = (
        F.when(~t.startswith("????"), t)
        .when(s.isNull(), F.lit(""))
        .when(t.startswith("????-??"), F.concat(F.substring(s, 1, 10), F.substring(t, 11, 9)))
        .otherwise(F.concat(F.substring(s, 1, 4), F.substring(t, 5, 15)))
    )
    last = F.coalesce(F.col("next_line") - 1, F.col("next_block_first") - 1, F.col("run_last"))
    return out.select(
        "run_id",
        F.col("line_no").alias("first_line"),
        last.cast("int").alias("last_line"),
        when.alias("log_time"),
        F.col("r.level").alias("level"),
        F.col("r.component").alias("component"),
        *[F.col("r.message").alias("message")] * message,
    )
