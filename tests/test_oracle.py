"""Every query that SQL can express gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from cairn.plans import registry

DATA = "/root/testdata/sf0.001"


#: Queries without SQL; here they only run, and what they give is checked in the file named.
CHECKED_ELSEWHERE = {
    "test_log_entries.py": "p6_found p6_entries",
    "test_nested.py": "p4_found p4_objects",
    "test_functions.py": "scl40_list_ids src26_manifests str09_drafts txt25_27_48_str01_observations txt28_43_flt18_routing txt34_python_symbols txt35_37_cpp_symbols txt39_checklists rwr09_without_repeats src30_31_specs",
    "test_operators.py": "mth13_bootstrap snk08_12_summary win09_13_set01_greedy_selection win09_13_15_top01_slices str07_streamed_briefs gra02_sentence_groups",
    "test_sources_more.py": "rwr01_section_moves rwr02_07_consolidated rwr03_requests rwr08_descriptions",
    "": "rel27_approximate",
}


def test_queries_without_sql_are_named():
    assert set(registry.queries()) - set(registry.oracles()) == {n for x in CHECKED_ELSEWHERE.values() for n in x.split()}


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    sql = registry.oracles().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


def test_no_python_in_sql_queries(spark):
    """Queries with SQL of their own text run without a Python step."""
    for b in registry.BOOKS:
        for name in sorted(b.shared):
            plan = b.queries[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
            assert "PythonUDF" not in plan and "MapInArrow" not in plan, name
