"""One text for two SQL dialects: the engine's own, and that of the database results are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.tables import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings log_lines runs log_events source_files symbols transcripts eval_items mix_targets".split()


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def rows_of(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows that ``make`` gives for each row of ``df``, batch by batch as Arrow columns."""
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in make(*row)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, _TYPES[t]) for x, (_, t) in zip(zip(*got), fields)], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


class Spark:
    """Spark SQL."""

    name = "spark"

    def __init__(self, **held: str):
        self.held = held  #: what stands for a part of a text that is computed already

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def match(self, x: str, p: str) -> str:
        return f"regexp_like({x}, {self.lit(p)})"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(re.sub(r'\\(\d)', r'$\1', r))})"

    def ext(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def all(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep) if sep != chr(1) else sep)})"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})"

    def half_even(self, x: str) -> str:
        return f"bround({x}, 0)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def map(self, a: str, v: str, f: str) -> str:
        return f"transform({a}, {v} -> {f})"

    def filter(self, a: str, v: str, f: str) -> str:
        return f"filter({a}, {v} -> {f})"

    def any(self, a: str, v: str, f: str) -> str:
        return f"exists({a}, {v} -> {f})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def concat(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def meet(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def strings(self, items: list[str]) -> str:
        return f"array({', '.join(map(self.lit, items))})"

    def sum(self, a: str) -> str:
        return f"aggregate({a}, 0D, (s, y) -> s + y)"

    def at(self, a: str, k: str) -> str:
        return f"try_element_at({a}, {k})"

    def slice(self, a: str, i: str, n: str) -> str:
        return f"slice({a}, {i}, {n})"

    def unnest(self, a: str, x: str, pos: str = "pos") -> str:
        return f"LATERAL VIEW posexplode({a}) AS {pos}, {x}"

    def gather(self, x: str, by: str | None = None) -> str:
        return f"array_sort(collect_list({x}))" if by is None else f"transform(array_sort(collect_list(struct({by} AS k, {x} AS v))), z -> z.v)"

    def gather_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def text_agg(self, x: str, sep: str, by: str) -> str:
        return f"array_join({self.gather(x, by)}, {self.lit(sep)})"

    def rows(self, rows: list[tuple], cols: str) -> str:
        return f"(SELECT * FROM VALUES {', '.join('(' + ', '.join('NULL' if v is None else self.lit(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)} AS v({cols}))"

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def epoch(self, x: str) -> str:
        return f"unix_micros(cast({x} as timestamp))"

    def day(self, x: str) -> str:
        return f"cast(date_format({x}, 'yyyy-MM-dd') as string)"

    def seq(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def big(self, x: str) -> str:
        return f"cast({x} as bigint)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"

    def try_int(self, x: str) -> str:
        return f"try_cast({x} as bigint)"


class Duck(Spark):
    """The other dialect; only what differs."""

    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def match(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)}, 'g')"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep) if sep != chr(1) else 'chr(1)'})"

    def bytes(self, x: str) -> str:
        return f"strlen({x})"

    def half_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def map(self, a: str, v: str, f: str) -> str:
        return f"list_transform({a}, lambda {v}: {f})"

    def filter(self, a: str, v: str, f: str) -> str:
        return f"list_filter({a}, lambda {v}: {f})"

    def any(self, a: str, v: str, f: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: {f})) > 0)"

    def size(self, a: str) -> str:
        return f"len({a})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def concat(self, *a: str) -> str:
        out = a[0]
        for x in a[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def meet(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def strings(self, items: list[str]) -> str:
        return f"[{', '.join(map(self.lit, items))}]"

    def sum(self, a: str) -> str:
        return f"coalesce(list_sum({a}), 0)"

    def at(self, a: str, k: str) -> str:
        return f"list_extract({a}, {k})"

    def slice(self, a: str, i: str, n: str) -> str:
        return f"list_slice({a}, {i}, ({i}) + ({n}) - 1)"

    def unnest(self, a: str, x: str, pos: str = "pos") -> str:
        return f", LATERAL (SELECT unnest({a}) AS {x}, generate_subscripts({a}, 1) - 1 AS {pos})"

    def gather(self, x: str, by: str | None = None) -> str:
        return f"list({x} ORDER BY {by or x}) FILTER ({x} IS NOT NULL)"

    def gather_set(self, x: str) -> str:
        return f"coalesce(list(DISTINCT {x} ORDER BY {x}) FILTER ({x} IS NOT NULL), [])"

    def text_agg(self, x: str, sep: str, by: str) -> str:
        return f"string_agg({x}, {self.lit(sep)} ORDER BY {by})"

    def rows(self, rows: list[tuple], cols: str) -> str:
        return super().rows(rows, cols).replace("FROM VALUES", "FROM (VALUES", 1).replace(f" AS v({cols}))", f") AS v({cols}))")

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def epoch(self, x: str) -> str:
        return f"epoch_us({x})"

    def day(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')"

    def seq(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '$.{path}')"


SPARK, DUCK = Spark(), Duck()
Text = Callable[[Spark], str]


def ask(spark: SparkSession, d: str, text: Text) -> DataFrame:
    """The query over the tables of folder ``d`` that it names."""
    sql = text(SPARK)
    for t in TABLES:
        if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql):
            load(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(sql)


class Book:
    """Named queries of a module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}
        self.shared: set[str] = set()  # names whose query is one text for both dialects

    def sql(self, f: Text) -> Text:
        """A query that is one text for both dialects."""
        self.queries[f.__name__] = lambda spark, d: ask(spark, d, f)
        self.queries[f.__name__].__doc__ = f.__doc__
        self.oracles[f.__name__] = f(DUCK)
        self.shared.add(f.__name__)
        return f

    def frame(self, oracle: Text | str | None = None) -> Callable:
        """A query built of frames, checked against a text of its own."""

        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracles[f.__name__] = oracle if isinstance(oracle, str) else oracle(DUCK)
            return f

        return keep
