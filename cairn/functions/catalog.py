"""Functions of this package for SQL texts, by name, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from cairn.functions.checklists import checklist
from cairn.functions.formats import list_id
from cairn.functions.repeats import longest_run, word_sequence
from cairn.functions.rewrite import category, without_repeats
from cairn.functions.shell import is_long
from cairn.session import ship

#: Name -> (type of the result, function of one or two texts).
FUNCTIONS = {
    "checklist_size": ("int", lambda t: len(c[2]) if (c := checklist(t)) else 0),
    "list_id": ("string", lambda t: list_id(t.split("\n"))),
    "longest_run": ("int", lambda a, b: longest_run(word_sequence(a), word_sequence(b))),
    "section_category": ("string", category),
    "without_repeats": ("string", lambda t: without_repeats(t)[0]),
    "prints_much": ("boolean", lambda t: is_long(t, "condense")),
}


def _one(f: Callable) -> Callable:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a], dtype=object)

    return run


def _two(f: Callable) -> Callable:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def register(spark: SparkSession, prefix: str = "cairn_") -> list[str]:
    """Makes the functions known to SQL; a null argument gives null.  The names come back."""
    ship(spark)
    for name, (kind, f) in FUNCTIONS.items():
        many = pandas_udf(_two(f) if f.__code__.co_argcount > 1 else _one(f), kind)
        spark.udf.register(prefix + name, many)
    return [prefix + n for n in FUNCTIONS]
