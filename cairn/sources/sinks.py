"""Sinks: record files, keyed tables whose versions are swapped whole, and rendered blocks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import exists, hadoop


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON records, one a line; the commit protocol leaves no torn line."""
    df.write.mode("append" if append else "overwrite").json(path)


class KeyedTable:
    """A table by key in versions; a write is a new version, and readers see it once its pointer is there."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version whole, -1 before the first."""
        p, fs = self._fs(f"{self.root}/pointers")
        return max((int(x.getPath().getName()) for x in fs.listStatus(p)), default=-1) if fs.exists(p) else -1

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/v{v}") if v >= 0 and exists(self.spark, f"{self.root}/v{v}") else None

    def replace(self, df: DataFrame) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{v}")
        p, fs = self._fs(f"{self.root}/pointers/{v}")
        fs.create(p, False).close()
        return v

    def upsert(self, df: DataFrame, newest: str) -> int:
        """Rows by key, of a key the one with the greatest ``newest``; ties keep what is there."""
        old = self.read()
        new = df.withColumn("_side", F.lit(1))
        both = new if old is None else old.withColumn("_side", F.lit(2)).unionByName(new, allowMissingColumns=True)
        cols = [c for c in both.columns if c not in ("_side", self.key)]
        best = both.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*cols), F.struct(F.col(newest), "_side")).alias("r"))
        return self.replace(best.select(self.key, "r.*"))

    def delete(self, keys: DataFrame) -> int:
        old = self.read()
        return self.replace(old.join(keys.select(self.key).distinct(), self.key, "left_anti")) if old is not None else -1


#: Bullets of one block.
BLOCK_LINES = 1000


def fact_blocks(facts: DataFrame, most: int = BLOCK_LINES) -> DataFrame:
    """(scope, part, block): bullets in order, each once a scope, at most ``most`` a block; comment marks broken so that they can't end the block.

    A scope with very many facts is many blocks, never one value.
    """
    line = F.concat(F.lit("- "), F.regexp_replace(F.regexp_replace(F.trim("text"), r"\s+", " "), "-->", "-- >"))
    each = facts.where("scope is not null and text is not null").select("scope", line.alias("line")).distinct()
    part = F.floor((F.row_number().over(Window.partitionBy("scope").orderBy("line")) - 1) / F.lit(most)).cast("int")
    return each.withColumn("part", part).groupBy("scope", "part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("block"))


def merge_block(text: str, block: str, name: str = "facts") -> str:
    """A text with its marked region replaced, or the region put at its end."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    region = f"{begin}\n{block}\n{end}"
    out, n = re.subn(re.escape(begin) + r"[\s\S]*?" + re.escape(end), lambda m: region, text, count=1)
    return out if n else text.rstrip("\n") + "\n\n" + region + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file that is there whole or not at all."""
    fs, half = hadoop(spark, f"{path}._part")
    out = fs.create(half, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, whole = hadoop(spark, path)
    fs.delete(whole, False)
    fs.rename(half, whole)


def write_summary(deltas: DataFrame, folder: str) -> None:
    """summary.json and summary.md of trials (task, arm, delta, lo, hi): one row per task and arm, a report's worth."""
    rows = [r.asDict() for r in deltas.orderBy("task", "arm").collect()]
    spark = deltas.sparkSession
    write_text(spark, f"{folder}/summary.json", json.dumps({"results": rows}, indent=1, default=str))
    table = "\n".join(f"| {r['task']} | {r['arm']} | {r['delta']:.2f} % | [{r['lo']:.2f}, {r['hi']:.2f}] |" for r in rows)
    write_text(spark, f"{folder}/summary.md", f"| task | arm | difference | interval |\n| --- | --- | --- | --- |\n{table}\n")


def write_schedule(order: DataFrame, path: str, seed: int, arms: list[str]) -> None:
    """The schedule of trials (task, rep, place) with its seed, arms and sorted tasks; bounded by the tasks of one run."""
    rows = order.orderBy("place").collect()
    write_text(order.sparkSession, path, json.dumps({"seed": seed, "arms": arms, "tasks": sorted({r.task for r in rows}), "order": [[r.task, r.rep] for r in rows]}))
