"""Session helpers: builder, shared folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "cairn", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings are the cluster's."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and the master is this machine (tests) a folder of our own is
    taken; on a cluster it has to be set.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared root; :func:`release` deletes it."""
    path = f"{shared_root(spark).rstrip('/')}/cairn-{label}-{uuid.uuid4().hex[:12]}"
    spark.sparkContext.__dict__.setdefault("_cairn_paths", []).append(path)
    return path


def written(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written once as a table in the shared folder: the table and its path.

    ``by`` partitions the files by a column, whose folders then tell which values occur.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path as it knows it; asking them takes no job."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this session's operators wrote into the shared folder.

    Results that are still to be computed read them, so call it when results are stored.
    """
    sc = spark.sparkContext
    for path in sc.__dict__.pop("_cairn_paths", []):
        fs, at = hadoop(spark, path)
        fs.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per context, so that no path has to be set on them."""
    sc = spark.sparkContext
    if getattr(sc, "_cairn_shipped", False):
        return
    root = Path(__file__).resolve().parent
    into = Path(tempfile.mkdtemp(prefix="cairn-code-"))
    with zipfile.ZipFile(into / "cairn.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"cairn/{p.relative_to(root)}")
    sc.addPyFile(str(into / "cairn.zip"))
    sc._cairn_shipped = True
