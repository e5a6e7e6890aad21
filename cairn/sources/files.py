"""Sources: lines, records that may be torn, whole files with a sniff for binary content, and columnar files."""

from __future__ import annotations

import os
import signal
import subprocess
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import hadoop

#: Folders left out of a repository scan, and bytes over which a file isn't read.
SKIPPED = ("/.git/", "/node_modules/", "/__pycache__/", "/.venv/", "/build/")
MOST_BYTES = 2_000_000


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): lines of text files from 1, split at LF with trailing CR dropped.

    Line numbers need whole files, so a file is one task's work; a stream of lines without
    numbers is ``spark.read.text``.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("p", "t")).select("file", (F.col("p") + 1).alias("line_no"), F.regexp_replace("t", "\r$", "").alias("text"))


def records(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON records, one a line; torn lines are left out, or with ``strict`` are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, sorted out by its file name."""
    return spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def repository_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, modified, size, state, content) of the files of a tree without its skipped folders.

    ``state`` is text, large (over ``most_bytes``, the limit a parameter) or binary (a NUL in the
    first 8,192 bytes); large and binary ones have no content, but are reported. Contents of
    large files aren't read; bytes that aren't UTF-8 are replaced.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    for s in SKIPPED:
        read = read.where(~F.col("path").contains(s))
    cols = ["path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")]
    large = read.where(F.col("length") > most_bytes).select(*cols, F.lit("large").alias("state"), F.lit(None).cast("string").alias("content"))
    head = F.decode(F.expr("substring(content, 1, 8192)"), "ISO-8859-1")
    binary = F.contains(head, F.lit("\x00"))
    small = read.where(F.col("length") <= most_bytes).select(*cols, F.when(binary, "binary").otherwise("text").alias("state"), F.when(~binary, F.expr("make_valid_utf8(cast(content as string))")).alias("content"))
    return small.unionByName(large)


def real_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, target) of the files of a local tree, each target once: of links to one file the file itself, else the first path.

    Links that lead out of the tree or in a circle are left out.  Walks the tree on the driver.
    """
    top = os.path.realpath(root)
    found: dict[str, str] = {}
    for folder, _, names in os.walk(top):
        for name in sorted(names):
            path = os.path.join(folder, name)
            target = os.path.realpath(path)
            if os.path.isfile(target) and target.startswith(top + os.sep) and (target not in found or target == path):
                found[target] = path
    return spark.createDataFrame(sorted((p, t) for t, p in found.items()), "path string, target string")


def changed_files(spark: SparkSession, repository: str, base: str = "HEAD") -> DataFrame:
    """(path) of the files that a git work tree changes against ``base``, new ones included; none where git fails."""
    run = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, timeout=60)
    out: set[str] = set()
    for a in (("diff", "--name-only", "-z", base), ("ls-files", "--others", "--exclude-standard", "-z")):
        r = run(*a)
        out |= {x for x in r.stdout.decode(errors="replace").split("\0") if x} if r.returncode == 0 else set()
    return spark.createDataFrame([(x,) for x in sorted(out)], "path string")


def tail_text(spark: SparkSession, path: str, most_bytes: int) -> str:
    """The last bytes of a file from the first line that is whole; only these bytes are read."""
    fs, at = hadoop(spark, path)
    size = fs.getFileStatus(at).getLen()
    start = max(0, size - most_bytes)
    stream = fs.open(at)
    try:
        stream.seek(start)
        raw = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    text = raw.decode("utf-8", "replace")
    return text if not start else text.partition("\n")[2]


def captured(spark: SparkSession, command: list[str], path: str, timeout_s: float | None = None) -> dict:
    """Runs a command on the driver, its output streamed to ``path`` as it comes: exit_code, duration_s, timed_out, n_lines.

    At the timeout the whole process group is killed; output up to then is kept.
    """
    began = time.monotonic()
    fs, at = hadoop(spark, path)
    out, lines, timed_out = fs.create(at, True), 0, False
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, start_new_session=True) as p:
        os.set_blocking(p.stdout.fileno(), False)
        while True:
            chunk = p.stdout.read(1 << 16)
            if chunk:
                out.write(bytearray(chunk))
                lines += chunk.count(b"\n")
            elif chunk == b"" or p.poll() is not None:
                break
            elif timeout_s is not None and time.monotonic() - began > timeout_s:
                timed_out = True
                os.killpg(p.pid, signal.SIGKILL)
            else:
                time.sleep(0.01)
    out.close()
    return {"exit_code": 124 if timed_out else p.returncode, "duration_s": time.monotonic() - began, "timed_out": timed_out, "n_lines": lines}


def columnar(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV or JSON files; filters and columns reach the scan."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def changed_since(spark: SparkSession, path: str, moment: str, form: str = "parquet") -> DataFrame:
    """Files changed after a moment (ISO time), by the reader's own filter."""
    return spark.read.format(form).option("modifiedAfter", moment).load(path)
