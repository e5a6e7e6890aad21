"""Order-dependent selection under a budget, and resampled intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import written


def greedy_selection(items: DataFrame, group: str, key: str, score: str, cost: str, budget: int) -> DataFrame:
    """(group, key, used): items in falling order of score that still fit the budget; one that doesn't is skipped.

    A running sum would be wrong, as later cheaper items may fit.  The fold runs over
    sorted partitions in batches and holds one number per group, never a group.

    Defined results: null groups, keys and costs are dropped, null scores come last, ties
    go by key; costs of 0 or less are free; an empty input gives an empty result.
    """
    src = items.select(F.col(group).cast("string").alias("g"), F.col(key).cast("bigint").alias("k"), F.col(score).cast("double").alias("s"), F.col(cost).cast("bigint").alias("c"))
    # What alone is over the budget can never be taken.
    src = src.where(f"g is not null and k is not null and c is not null and c <= {budget}").repartition("g").sortWithinPartitions("g", F.desc_nulls_last("s"), "k")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for b in batches:
            at, spent = [], []
            for i, (g, c) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                if g != now:
                    now, used = g, 0
                if used + max(0, c) <= budget:
                    used += max(0, c)
                    at.append(i)
                    spent.append(used)
            if at:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(spent, pa.int64())], names=["grp", "key", "used"])

    return src.mapInArrow(fold, "grp string, key bigint, used bigint")


def slices(chunks: DataFrame, budget: int, extra: int = 0, test_share: float = 0.2, named_share: float = 0.1, floor: float = 0.0) -> DataFrame:
    """(grp, key, how, cost, used): for each group the chunks that make up a slice of at most ``budget`` tokens.

    ``chunks`` has grp, key, score, tokens, path, a, b (first and last line), test (of a test file) and
    named (called by name in the task).  Falling scores, ties by key: a chunk whose lines
    are all chosen is nested and free, lines chosen already don't count again, what doesn't fit is skipped, and
    tests that aren't named may fill ``test_share`` of the budget (``named_share`` where some test is named).
    Scores of 0 or below ``floor`` of the group's best are left out.  Then named chunks that
    were left out are added in order while they fit ``extra`` more tokens ('expanded').

    Defined results: rows with a null group, key, path, lines or tokens are dropped; an empty
    input gives an empty result.

    Scale: a fold over sorted partitions in batches, which holds the chosen lines of one
    group (no more than the budget pays for) and its named chunks left out.
    """
    cols = {"grp": "string", "key": "string", "score": "double", "tokens": "bigint", "path": "string", "a": "int", "b": "int", "test": "boolean", "named": "boolean"}
    src = chunks.select(*(F.col(c).cast(t).alias(c) for c, t in cols.items())).where("grp is not null and key is not null and path is not null and a is not null and b is not null and tokens is not null")
    best = src.groupBy("grp").agg(F.max("score").alias("_top"), F.max(F.col("test") & F.col("named")).alias("_named"))
    src = src.join(best, "grp").where((F.col("score") > 0) & (F.col("score") >= F.lit(floor) * F.col("_top"))).drop("_top")
    src = src.repartition("grp").sortWithinPartitions("grp", F.desc("score"), "key")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        used = tests = 0
        seen: dict[str, set[int]] = {}
        left: list[tuple[str, int]] = []

        def late(out: list[tuple]) -> None:
            nonlocal used
            for k, c in left:
                if used + c <= budget + extra:
                    used += c
                    out.append((now, k, "expanded", c, used))

        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if r["grp"] != now:
                    late(out)
                    now, used, tests, seen, left = r["grp"], 0, 0, {}, []
                lines = set(range(r["a"], max(r["a"], r["b"]) + 1))
                fresh = lines - seen.get(r["path"], set())
                cost = round(max(0, r["tokens"]) * len(fresh) / len(lines))
                capped = r["test"] and not r["named"]
                if not fresh:
                    out.append((now, r["key"], "nested", 0, used))
                elif used + cost > budget or (capped and tests + cost > int(budget * (named_share if r["_named"] else test_share))):
                    if r["named"] and extra:
                        left.append((r["key"], cost))
                else:
                    used += cost
                    tests += cost * bool(capped)
                    seen.setdefault(r["path"], set()).update(lines)
                    out.append((now, r["key"], "chosen", cost, used))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["grp", "key", "how", "cost", "used"])
        out = []
        late(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["grp", "key", "how", "cost", "used"])

    return src.mapInArrow(fold, "grp string, key string, how string, cost bigint, used bigint")


def running_sum(rows: DataFrame, order: list[Column], size: str) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``size`` up to and with each row in this order, and ``total``.

    ``order`` has to leave no ties, or equal rows share ranges as they fall.  Rows are cut into
    ranges of the order, which are windowed by themselves; one row per range carries the sums
    before it, so no task holds more than a range.

    Defined results: null sizes count 0; an empty input gives an empty result; columns named
    upto and total are replaced.
    """
    cut, _ = written(rows.drop("upto", "total", "_part").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    parts = cut.groupBy("_part").agg(F.sum(n).alias("_own"))
    every = Window.orderBy("_part")  # one row per range
    parts = parts.select("_part", (F.sum("_own").over(every) - F.col("_own")).alias("_before"), F.sum("_own").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("_sum", F.sum(n).over(inside)).join(F.broadcast(parts), "_part").withColumn("upto", F.col("_before") + F.col("_sum")).drop("_part", "_before", "_sum")


def bootstrap_deltas(rows: DataFrame, key: str, task: str, arm: str, value: str, base: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """(task, arm, delta, lo, hi): percent by which an arm's mean differs from the base's, with a 95 % interval.

    Poisson bootstrap: each row has a weight per resample drawn from its key, the resample
    and the seed alone, so rows are counted where they are and only ``samples`` sums per
    task and arm are shuffled; the result doesn't depend on the partitions.
    """
    src = rows.select(F.col(key).cast("bigint").alias("k"), F.col(task).cast("string").alias("t"), F.col(arm).cast("string").alias("a"), F.col(value).cast("double").alias("v")).where("k is not null and t is not null and a is not null and v is not null")
    steps = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 13)]))
    cuts = (np.cumsum(steps) * 2.0**53).astype(np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        salt = np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for b in batches:
            ks, vs = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), b.column(3).to_numpy(zero_copy_only=False)
            names = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            for s in range(0, len(ks), 2048):
                with np.errstate(over="ignore"):
                    z = (ks[s : s + 2048, None] * np.uint64(0xD1342543DE82EF95)) ^ salt[None, :]
                    for m in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
                        z = (z ^ (z >> np.uint64(30))) * m
                    z = (z ^ (z >> np.uint64(31))) >> np.uint64(11)
                w = np.searchsorted(cuts, z.astype(np.int64), "right").astype(np.float64)
                for g in set(names[s : s + 2048]):
                    pick = np.array([n == g for n in names[s : s + 2048]])
                    acc = sums.setdefault(g, np.zeros((2, samples + 1)))
                    acc[0, 1:] += (w[pick] * vs[s : s + 2048][pick, None]).sum(0)
                    acc[1, 1:] += w[pick].sum(0)
                    acc[0, 0] += vs[s : s + 2048][pick].sum()
                    acc[1, 0] += pick.sum()
        for (t, a), acc in sums.items():
            n = samples + 1
            yield pa.RecordBatch.from_arrays([pa.array([t] * n), pa.array([a] * n), pa.array(range(n), pa.int32()), pa.array(acc[0]), pa.array(acc[1])], names=["t", "a", "b", "s", "n"])

    sums = src.mapInArrow(weigh, "t string, a string, b int, s double, n double").groupBy("t", "a", "b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    own = sums.where(F.col("a") != base)
    ref = sums.where(F.col("a") == base).select("t", "b", F.col("m").alias("m0"))
    d = own.join(ref, ["t", "b"]).select("t", "a", "b", (100 * (F.try_divide("m", "m0") - 1)).alias("d"))
    return d.groupBy(F.col("t").alias("task"), F.col("a").alias("arm")).agg(F.max(F.when(F.col("b") == 0, F.col("d"))).alias("delta"), F.expr("percentile(d, 0.025) filter (where b > 0)").alias("lo"), F.expr("percentile(d, 0.975) filter (where b > 0)").alias("hi"))
