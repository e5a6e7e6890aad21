"""Graph operators over edge frames: distances, components, cycles.

Every round is a table in the shared folder, so plans stay short and lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import written


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of all nodes within ``depth`` steps of a seed; ``edges`` (a, b) count either way.

    Defined results: null ends are dropped, self links and repeats don't matter, seeds
    without edges have distance 0; an empty side gives no rows.

    Scale: each round joins the frontier only; nodes seen are left out by an anti join.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a != b")
    both, _ = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    front, _ = written(seeds.select("id").where("id is not null").distinct().withColumn("distance", F.lit(0)), "front")
    seen = front
    for k in range(1, depth + 1):
        step = front.join(both, front["id"] == both["a"]).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(k))
        front, _ = written(step, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge; a component is named by its smallest node.

    Stars alternate: every node points its larger neighbours to the smallest one, then
    itself and its smaller ones, until nothing changes; the rounds grow with the logarithm
    of the longest chain.

    Defined results: null ends are dropped; nodes only linked to themselves have no row.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a != b")
    now, _ = written(e.distinct(), "links")
    sign = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large, _ = written(large.distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select("b", "m", "a")
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        now, _ = written(step, "small")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == sign:
            break
        sign = mark
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def cycle_links(edges: DataFrame) -> DataFrame:
    """The (a, b) edges left when ends without a way on or a way in are taken off again and again.

    Where each node has one parent these are exactly the edges of cycles.
    """
    now, _ = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "links")
    n = now.count()
    while n:
        ins, outs = now.select(F.col("b").alias("a")).distinct(), now.select(F.col("a").alias("b")).distinct()
        now, _ = written(now.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b"), "links")
        m = now.count()
        if m == n:
            break
        n = m
    return now
