"""Exactly one copy of messages that were delivered at least once.

A stream of lines keeps a keyed store of the identifiers seen.  A micro-batch is taken in
steps of arrival time.  A step meets the live part of the store, which holds the identifiers
seen within the event-time horizon, and writes it anew; what has expired becomes a segment of
the archive.  An identifier that comes back after it expired gets a second record, and the two
meet when segments are merged (four of a level make one of the next) or when the result is
read.  So a step's cost goes with the step and the horizon, and each record is written again
only as often as there are levels, the logarithm of the steps: nothing grows with the square of
the batches.  Store, archive and output of a step become visible by one commit file, renamed
into place last; a step that was interrupted is done again over the same names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import hadoop, shared_path

#: How long an identifier stays in the live part of the store after its last copy, in seconds.
HORIZON_S = 2 * 86_400
#: Bytes of new files that one micro-batch takes.
BATCH_BYTES = 2 << 30
#: Steps of equal arrival time that a micro-batch is taken in.
STEPS = 4
#: Segments of a level of the archive that are merged into one of the next.
FAN = 4
#: Tasks that write one step of a batch.
PARTS = 4

_BEST = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("minus_line", T.LongType())])
_NEW = "message_id string, line_id bigint, tokens bigint, at timestamp"
_STATE = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("best", _BEST), T.StructField("last", T.TimestampType())])
_STORE = T.StructType([*_STATE, T.StructField("old_line", T.LongType()), T.StructField("archived", T.BooleanType())])
_OUT = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("line_id", T.LongType())])


def copies(lines: DataFrame) -> DataFrame:
    """message_id, line_id, tokens and at of the lines that are valid JSON with an id.

    The parser stops after a first value; inside brackets whatever follows it is an error.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("message").cast("string"), F.lit("]")))
    v = F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), whole)
    text = F.try_variant_get(v, "$[0].usage.output_tokens", "string")
    n = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return lines.select(
        F.try_variant_get(v, "$[0].id", "string").alias("message_id"),
        F.col("line_id").cast("bigint").alias("line_id"),
        F.coalesce(n, F.lit(-(2**62))).alias("tokens"),
        F.col("received_at").cast("timestamp").alias("at"),
    ).where("message_id is not null and message_id != '' and line_id is not null")


class DeliveryStore:
    """The keyed store of one stream below ``root``; :meth:`take` is its ``foreachBatch``."""

    def __init__(self, spark: SparkSession, root: str, horizon_s: int = HORIZON_S, steps: int = STEPS):
        self.spark, self.root, self.horizon_s, self.steps = spark, root, horizon_s, steps

    def committed(self) -> dict:
        """What the last commit says: step, batch, segments, results, and the newest arrival in microseconds."""
        fs, at = hadoop(self.spark, f"{self.root}/commits")
        steps = [int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()] if fs.exists(at) else []
        if not steps:
            return {"step": -1, "batch": -1, "of": 0, "segments": [], "out": [], "top": None}
        fs, at = hadoop(self.spark, f"{self.root}/commits/{max(steps)}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        fs, half = hadoop(self.spark, f"{self.root}/commits/_{state['step']}")
        out = fs.create(half, True)
        out.writeBytes(json.dumps(state))
        out.close()
        _, whole = hadoop(self.spark, f"{self.root}/commits/{state['step']}")
        fs.rename(half, whole)

    def _drop(self, path: str) -> None:
        fs, at = hadoop(self.spark, f"{self.root}/{path}")
        fs.delete(at, True)

    def _rows(self, *paths: str) -> DataFrame:
        """Records of parts of the store."""
        have = []
        for p in paths:
            fs, at = hadoop(self.spark, f"{self.root}/{p}")
            if fs.exists(at):
                have.append(f"{self.root}/{p}")
        return self.spark.read.schema(_STATE).parquet(*have) if have else self.spark.createDataFrame([], _STATE)

    def take(self, batch: DataFrame, n: int) -> None:
        """One micro-batch, a step of arrival time after the other; steps that are committed aren't taken again."""
        done = self.committed()
        if n < done["batch"] or (n == done["batch"] and done["of"] >= self.steps):
            return
        at = F.unix_micros(F.col("received_at").cast("timestamp"))
        low, high = batch.agg(F.min(at), F.max(at)).first()
        width = max(1, -(-((high or 0) - (low or 0) + 1) // self.steps))
        step = F.coalesce(((F.unix_micros("at") - F.lit(low or 0)) / F.lit(width)).cast("int"), F.lit(0))
        stage = f"{self.root}/stage/{n}"
        rows = copies(batch).withColumn("part", step)
        rows.repartition(self.steps * PARTS, "part", F.pmod("line_id", F.lit(PARTS))).write.mode("overwrite").partitionBy("part").parquet(stage)
        for k in range(done["of"] if n == done["batch"] else 0, self.steps):
            fs, here = hadoop(self.spark, f"{stage}/part={k}")
            if fs.exists(here):
                done = self._step(self.spark.read.schema(_NEW).parquet(f"{stage}/part={k}"), done, n, k + 1, (low or 0) + (k + 1) * width)
            else:
                done = done | {"step": done["step"] + 1, "batch": n, "of": k + 1}
                self._commit(done)
        self._drop(f"stage/{n}")

    def _step(self, new: DataFrame, done: dict, n: int, of: int, upto: int) -> dict:
        s, top = done["step"] + 1, done["top"]
        got = new.groupBy("message_id").agg(F.max(F.struct("tokens", (-F.col("line_id")).alias("minus_line"))).alias("b"), F.max("at").alias("t"))
        live = self._rows(f"store/{done.get('live', -1)}/archived=false")
        got = got.join(live.withColumnRenamed("last", "seen"), "message_id", "full")
        best, last = F.greatest("b", "best"), F.greatest("t", "seen")
        # Expiry as of the rows seen before this step, as a watermark has it.
        gone = F.coalesce(F.unix_micros(last) < F.lit(top - self.horizon_s * 1_000_000), F.lit(False)) if top is not None else F.lit(False)
        state = got.select("message_id", best.alias("now"), last.alias("last"), F.when(F.col("best") < best, -F.col("best.minus_line")).alias("old_line"), gone.alias("archived"))
        state.withColumnRenamed("now", "best").write.mode("overwrite").partitionBy("archived").parquet(f"{self.root}/store/{s}")
        now = self.spark.read.schema(_STORE).parquet(f"{self.root}/store/{s}")
        kept = now.select((-F.col("best.minus_line")).alias("line_id"))
        drops = new.select("message_id", "line_id").join(kept, "line_id", "left_anti").select("message_id", "line_id")
        lost = now.where("old_line is not null").select("message_id", F.col("old_line").alias("line_id"))
        drops.unionByName(lost).write.mode("overwrite").parquet(f"{self.root}/out/{s}")
        segments, out = done["segments"], [*done["out"], str(s)]
        fs, at = hadoop(self.spark, f"{self.root}/store/{s}/archived=true")
        old = []
        if fs.exists(at):
            segments = [*segments, [0, f"store/{s}/archived=true"]]
            while len(run := [p for lv, p in segments if lv == segments[-1][0]]) >= FAN:
                level = segments[-1][0] + 1
                lines = self._rows(*run)
                lines.groupBy("message_id").agg(F.max("best").alias("best"), F.max("last").alias("last")).write.mode("overwrite").parquet(f"{self.root}/archive/{level}-{s}")
                _beaten(lines).write.mode("overwrite").parquet(f"{self.root}/out/{s}-{level}")
                out.append(f"{s}-{level}")
                segments = [*[x for x in segments if x[1] not in run], [level, f"archive/{level}-{s}"]]
                old += run
        was = done.get("live", -1)
        done = {"step": s, "batch": n, "of": of, "segments": segments, "out": out, "top": upto if top is None else max(top, upto), "live": s}
        self._commit(done)
        for p in [*old, f"store/{was}/archived=false"]:  # nothing committed names them any more
            self._drop(p)
        return done

    def _records(self) -> DataFrame:
        done = self.committed()
        return self._rows(f"store/{done.get('live', -1)}/archived=false", *(p for _, p in done["segments"]))

    def dropped(self) -> DataFrame:
        """message_id and line_id of every line dropped by the committed steps, late copies looked up in the archive."""
        done = self.committed()
        paths = [f"{self.root}/out/{x}" for x in done["out"]]
        rows = self.spark.read.schema(_OUT).parquet(*paths) if paths else self.spark.createDataFrame([], _OUT)
        return (rows.unionByName(_beaten(self._records())) if done["segments"] else rows).distinct()

    def kept(self) -> DataFrame:
        """message_id, line_id and tokens of the copy that stands, of every id seen."""
        best = self._records().groupBy("message_id").agg(F.max("best").alias("b"))
        return best.select("message_id", (-F.col("b.minus_line")).alias("line_id"), F.nullif("b.tokens", F.lit(-(2**62))).alias("tokens"))


def _beaten(records: DataFrame) -> DataFrame:
    """The lines of records of one id that a better record beats; an id has one record of a segment at most."""
    best = records.groupBy("message_id").agg(F.max("best").alias("b"), F.collect_set("best.minus_line").alias("all")).where("size(all) > 1")
    return best.select("message_id", F.explode(F.array_except("all", F.array("b.minus_line"))).alias("minus")).select("message_id", (-F.col("minus")).alias("line_id"))


def deliveries(spark: SparkSession, source: str, schema: T.StructType, root: str | None = None, horizon_s: int = HORIZON_S, batch_bytes: int = BATCH_BYTES, files: int | None = None, steps: int = STEPS) -> DeliveryStore:
    """Runs the stream over all lines now at ``source`` and gives its store.

    Lines whose message is valid JSON with the same ``id`` (neither null nor empty) are
    copies; the one with the most ``usage.output_tokens`` stands, of equals the smallest
    ``line_id``.  A missing or unreadable count is smallest.  Each line that loses, now or
    by a later copy, comes out of :meth:`DeliveryStore.dropped` once.

    Defined results: null or torn messages and null line ids are no copies; a null
    ``received_at`` never expires an id and counts as the first arrival of its batch;
    repeated rows of one line are that line; an empty source gives empty results; other
    columns are not read.

    Calling it again with the same ``root`` goes on where the last commit stands.

    Scale: messages are parsed once and only ids, numbers and times are written on; a step is
    combined to one row per id before it meets the store (a hot id is one row per task),
    losers are found by an anti join on the unique line id.  A record is written once a step
    while it is live and once a level of the archive, so cost is linear in the batches but for
    that logarithm.
    """
    root = root or shared_path(spark, "deliveries")
    store = DeliveryStore(spark, root, horizon_s, steps)
    need = [f for f in schema if f.name in ("line_id", "received_at", "message")]
    reader = spark.readStream.schema(T.StructType(need)).option("maxBytesPerTrigger", str(batch_bytes))
    if files:
        reader = spark.readStream.schema(T.StructType(need)).option("maxFilesPerTrigger", files)
    pattern = f"{source[:-1]}[{source[-1]}]"  # a pattern may name one file as well as a folder, a plain path only a folder
    run = reader.parquet(pattern).writeStream.foreachBatch(store.take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return store
