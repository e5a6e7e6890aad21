"""Parent-child rows into full hierarchies, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import exists, shared_path, written


#: Levels that one pass extends the frontier by.
STRIDE = 8


def hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", paths: bool = True, stride: int = STRIDE) -> DataFrame:
    """One row per id: id, root, depth and, with ``paths``, the ids from the root down.

    A frontier starts at the roots and is joined to its children level by level, ``stride``
    levels a pass; the children of all frontiers of a pass come out by one join, and the rows
    it doesn't match go on to the next pass.  Each pass is a table in the shared folder, split
    into reached and left; the loop ends at a pass that reaches nothing, and what is then left
    lies on a cycle or below one.

    Defined results: a null, empty or unknown parent makes a root of depth 0; rows with a
    null id are dropped; of rows that repeat an id the smallest non-empty parent counts;
    nodes on or below a cycle have root '' and depth -1 (and an empty path); an empty input
    gives an empty result; other columns are not read.

    Scale: ids meet by 128-bit hashes, so a row left is shuffled once a pass with its own id
    only, and a row reached only as a frontier.  A parent with a third of all rows is one key
    of joins whose other side has one row for it, so adaptive execution splits it.
    """
    spark = nodes.sparkSession
    clean = nodes.select(F.col(id_col).cast("string").alias("id"), F.expr(f"nullif(cast(`{parent_col}` as string), '')").alias("parent"))
    base = clean.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    h = lambda c: [F.xxhash64(c), F.xxhash64(F.lit(1), c)]
    p = [F.when(F.col("parent").isNotNull(), x) for x in h("parent")]
    base, _ = written(base.select("id", *(x.alias(n) for x, n in zip([*h("id"), *p], ("h1", "h2", "p1", "p2")))), "nodes")
    known = base.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.lit(True).alias("found"))
    none = F.array().cast("array<string>")
    own = ["id", "h1", "h2", "p1", "p2"]
    step = base.join(known, ["p1", "p2"], "left").select(*own, F.col("id").alias("root"), F.lit(0).alias("depth"), *([F.array("id").alias("path")] if paths else []), F.when(F.col("found").isNull(), "end").otherwise("left").alias("hit"))
    body = T.StructType([f for f in step.schema if f.name != "hit"])
    where = shared_path(spark, "levels")
    level, turn, reached, rest = 0, 0, [], None
    while True:
        path = f"{where}/{turn}"
        step.write.mode("overwrite").partitionBy("hit").parquet(path)
        part = {k: f"{path}/hit={k}" for k in ("end", "new", "left")}
        part = {k: x for k, x in part.items() if exists(spark, x)}
        reached += [x for k, x in part.items() if k != "left"]
        read = lambda k: spark.read.schema(body).parquet(part[k])  # noqa: B023, E731
        rest = read("left").select(*own) if "left" in part else None
        if rest is None or "end" not in part:
            break
        keep = [F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("root"), F.col("depth"), *[F.col("path")] * paths]
        grow = ["root", (F.col("depth") + 1).alias("depth"), *([F.concat("path", F.array("id")).alias("path")] if paths else [])]
        fronts = [read("end").select(*keep)]
        for _ in range(stride - 1):
            fronts.append(rest.join(fronts[-1], ["p1", "p2"]).select("id", "h1", "h2", *grow).select(*keep))
        level, turn = level + stride, turn + 1
        hit = F.when(F.col("root").isNull(), "left").when(F.col("depth") == level, "end").otherwise("new").alias("hit")
        step = rest.join(reduce(DataFrame.unionByName, fronts), ["p1", "p2"], "left").select(*own, *grow).select("*", hit)
    cols = ["id", "root", "depth", *(["path"] if paths else [])]
    out = spark.read.schema(body).parquet(*reached).select(*cols) if reached else spark.createDataFrame([], body).select(*cols)
    if rest is not None:
        out = out.unionByName(rest.select("id", F.lit("").alias("root"), F.lit(-1).alias("depth"), *([none.alias("path")] if paths else [])))
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, id, distance) pairs of a :func:`hierarchy` with paths, distance 1 and up.

    The pairs are read off the paths without a join.  Nodes on or below a cycle have none.
    """
    up = F.expr("transform(slice(path, 1, size(path) - 1), (x, i) -> struct(x as ancestor, size(path) - 1 - i as distance))")
    return tree.where("depth > 0").select("id", F.explode(up).alias("u")).select("u.ancestor", "id", "u.distance")
