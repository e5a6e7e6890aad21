"""Functions with their documentation, and oversized symbols cut at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.codespans import cpp_spans, is_python, python_spans
from cairn.llm.docwords import described
from cairn.llm.segment import pieces

FUNCTIONS = ("function", "method", "async_function", "async_method", "async function", "async method")


def _files(files: DataFrame) -> DataFrame:
    """Rows with path and content: path, language, content, h. Of contents of one path that with the greatest hash h counts."""
    src = files.select(F.col("path").cast("string").alias("path"), F.col("language").cast("string").alias("language"), F.col("content").cast("string").alias("content"))
    return src.where("path is not null and content is not null").withColumn("h", F.xxhash64("content"))


def _contents(files: DataFrame) -> DataFrame:
    """path and the content that counts."""
    return _files(files).groupBy("path").agg(F.max_by("content", "h").alias("content"))


def _symbols(symbols: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """One row per id: the greatest of rows that repeat it, of those of ``only`` these types."""
    cols = {"path": "string", "name": "string", "qualname": "string", "type": "string", "start_line": "int", "end_line": "int", "tokens": "int"}
    s = symbols.where(F.lower(F.trim(F.col("type").cast("string"))).isin(*only)) if only else symbols
    s = s.select(F.col("id").cast("string").alias("id"), F.struct(*[F.col(c).cast(t).alias(c) for c, t in cols.items()]).alias("s"))
    return s.where("id is not null").groupBy("id").agg(F.max("s").alias("s")).select("id", "s.*")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, at = [], []
        for k, (path, lang, text) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
            python = is_python(path, lang)
            for kind, line, pos, after, doc in (python_spans if python else cpp_spans)(text):
                # Of a head the line it begins on, of a span what it has to follow; in Python positions count from the end.
                rows.append((line if kind == "head" else None, -pos if python else pos, None if kind == "head" else after, doc))
                at.append(k)
        if rows:
            line, pos, after, doc = zip(*rows)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(3).take(take), pa.array(line, pa.int32()), pa.array(pos, pa.int64()), pa.array(after, pa.int64()), pa.array(doc, pa.string())], names=["path", "h", "line", "k", "after", "doc"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = pa.array([described(d, n or "", q or "") for n, q, d in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("name", "qualname", "doc")))], pa.bool_())
        yield b.filter(keep)


def documented(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, path, name, qualname, type, start_line, end_line and doc of functions whose documentation says something.

    Spans of docstrings, comments and function heads are taken from the files without
    regard to symbols.  An as-of join then gives each function the nearest span: in Python
    the first after its head, in C++ the last above it; it is rejected if a statement (or,
    in C++, a blank line) lies between.  Documentation that is only marks, tags, tool
    directives, a placeholder, a pointer elsewhere or the name of the symbol is dropped.

    Defined results: symbols with a null id, path or start line, other types, and symbols
    of a file without content give nothing; case and blanks of ``type`` don't matter;
    repeated rows count once; the ``doc`` of the table isn't used; other columns aren't read.

    Scale: file contents are mapped where they are read, once, and never shuffled; spans, heads
    and functions meet in one exchange by path, whose rows are bounded by the lines of one file.
    """
    s = _symbols(symbols, FUNCTIONS).where("path is not null and start_line is not null")
    spans = _files(files).mapInArrow(_spans, "path string, h bigint, line int, k bigint, after bigint, doc string")
    f = F.struct("id", "name", "qualname", "type", "start_line", "end_line")
    rows = spans.withColumn("f", F.lit(None).cast("struct<id:string,name:string,qualname:string,type:string,start_line:int,end_line:int>"))
    rows = rows.unionByName(s.select("path", F.col("start_line").alias("line"), f.alias("f")), allowMissingColumns=True)
    path = Window.partitionBy("path")
    rows = rows.withColumn("h", F.coalesce("h", F.max("h").over(path))).withColumn("newest", F.max("h").over(path)).where("h = newest")
    # A function begins where its head does; without a head (C++) at its line.
    heads = path.orderBy("line").rangeBetween(Window.currentRow, Window.currentRow)
    head = F.max(F.when(F.col("f").isNull() & F.col("line").isNotNull(), F.col("k"))).over(heads)
    rows = rows.withColumn("k", F.when(F.col("f").isNotNull(), F.coalesce(head, F.col("line").cast("bigint"))).otherwise(F.col("k")))
    rows = rows.where("f is not null or line is null")
    before = path.orderBy("k", F.col("f").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.last(F.when(F.col("f").isNull(), F.struct("after", "doc")), ignorenulls=True).over(before)).where(F.col("f").isNotNull() & (F.col("near.after") == F.abs("k")))
    out = near.select("f.id", "path", "f.name", "f.qualname", "f.type", "f.start_line", "f.end_line", F.col("near.doc").alias("doc"))
    return out.mapInArrow(_described, out.schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lines = content.split("\n")
            rows = [(i["id"], i["qualname"], i["type"], i["doc"], "\n".join(lines[i["start_line"] - 1 : i["end_line"] or i["start_line"]])) for i in items]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["id", "qualname", "type", "doc", "code"])


def documented_pairs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, qualname, type, doc and code of the :func:`documented` functions.

    A file's functions meet its content as one row, so content isn't repeated in a shuffle.
    """
    d = documented(symbols, files).groupBy("path").agg(F.collect_list(F.struct("id", "qualname", "type", "doc", "start_line", "end_line")).alias("items"))
    return _contents(files).join(d, "path").select("content", "items").mapInArrow(_cut, "id string, qualname string, type string, doc string, code string")


_PIECE = "id string, piece int, start_line int, end_line int, start_char int, end_char int, tokens int, text string, depth double, deepest double"


def split_symbols(symbols: DataFrame, files: DataFrame, limit: int = 800, overlap: int = 3, text: bool = True) -> DataFrame:
    """Pieces of the symbols of more than ``limit`` tokens: id, piece, start_line, end_line, start_char, end_char, tokens, text, depth, deepest.

    A piece is a run of whole lines of at most ``limit`` tokens (a quarter of their
    characters) and begins with the last ``overlap`` lines of the one before.  Lexical
    cohesion is measured at every line gap of the file: blocks of lines on either side are
    compared by their words, and the valleys of the similarity mark boundaries; a piece
    ends at the deepest valley that lies at a natural boundary of its size window (a blank
    line or a lone closing bracket), at the deepest of any line where the window has none.
    ``depth`` is that of the valley taken and ``deepest`` that of the deepest such gap, null
    where there was no choice.  A line too long by itself is cut inside (start_char and end_char).

    Defined results: the size is ``tokens`` where positive, else a quarter of the
    characters of the symbol's lines, rounded half to even, at least 1; without both it
    is unknown and gives no row; an oversized symbol whose file has no content gives one
    row with null lines; a symbol whose content is within the limit although ``tokens``
    is not is one piece; repeated rows count once; other columns are not read.

    Scale: only candidates meet the contents, as one row per file; cohesion is computed
    once per file however many nested symbols share it.
    """
    s = _symbols(symbols).where("path is not null")
    s = s.where(f"tokens is null or tokens <= 0 or tokens > {limit}")
    groups = s.groupBy("path").agg(F.collect_list(F.struct("id", "start_line", "end_line", F.when(F.col("tokens") > 0, F.col("tokens")).alias("size"))).alias("items"))
    one = _contents(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(pieces(content, [(i["id"], i["start_line"], i["end_line"], i["size"]) for i in items], limit, overlap, text))
                if rows:
                    c = list(zip(*rows))
                    kinds = [pa.string(), *[pa.int32()] * 6, pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=["id", "piece", "start_line", "end_line", "start_char", "end_char", "tokens", "text", "depth", "deepest"])

    return groups.join(one, "path", "left").select("content", "items").mapInArrow(run, _PIECE)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, own, upto = None, [], 0

    def done() -> Iterator[pa.RecordBatch]:
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array(["".join(own)], pa.string())], names=["id", "text"])

    for b in batches:
        for r in b.to_pylist():
            if r["start_line"] is None:
                continue
            if r["id"] != now or r["piece"] == 0:
                yield from done()
                now, own, upto = r["id"], [], 0
            if r["start_char"]:
                own.append(r["text"])
            else:
                again = max(0, upto + 1 - r["start_line"]) if own else 0
                own.append("\n" * bool(own) + "\n".join(r["text"].split("\n")[again:]))
            upto = r["end_line"]
    yield from done()


def rebuilt(parts: DataFrame) -> DataFrame:
    """id and the text that the pieces of :func:`split_symbols` give without what they repeat.

    The pieces of a symbol have to stand together and in order, as they come from there; they
    are joined where they are, without a shuffle.  Symbols without lines give no row.
    """
    return parts.select("id", "piece", "start_line", "end_line", "start_char", "text").mapInArrow(_joined, "id string, text string")
