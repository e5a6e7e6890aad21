"""Windows over event streams: tumbling, sliding and session windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import shared_path


def windowed(events: DataFrame, at: str, keys: list[str], totals: dict[str, Column], width: str, slide: str | None = None, gap: bool = False, late: str = "1 day") -> DataFrame:
    """A stream of (start, end, keys, totals) of windows of ``width`` every ``slide``, or of sessions that ``width`` of silence ends.

    Rows later than ``late`` behind the newest of the batches before are dropped, and state of
    windows that are over goes with them.  Null times are in no window.
    """
    w = F.session_window(at, width) if gap else F.window(at, width, slide) if slide else F.window(at, width)
    sums = events.where(F.col(at).isNotNull()).withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(*(c.alias(n) for n, c in totals.items()))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *totals)


def settle(spark: SparkSession, stream: DataFrame, keys: list[str], mode: str = "update", root: str | None = None) -> DataFrame:
    """Runs a stream of windows over all there is now; of each window and keys its last totals.

    Each batch's changed windows are a table of their own, written again whole if the batch is
    taken again; sessions, which can grow into each other, are asked for whole (``complete``).
    """
    root = root or shared_path(spark, "windows")

    def take(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    last = Window.partitionBy("start", "end", *keys).orderBy(F.desc("batch"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "batch")
