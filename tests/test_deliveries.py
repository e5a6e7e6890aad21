"""Messages delivered more than once: one copy stands, whatever the batches."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cairn.streaming.deliveries import DeliveryStore, copies, deliveries


def message(i, n=None, quoted=False):
    return json.dumps({"id": i, "usage": {"output_tokens": str(n) if quoted else n}})


ROWS = [
    (1, message("a", 5)), (2, message("a", 9)), (3, message("a", 9, True)), (4, message("b")), (5, message("b", None)), (6, message("c", 1)), (7, message("", 3)), (8, message(None, 3)), (9, None), (10, "{"), (11, '{"id": "c", "usage": null}'),
    (12, message("a", 20)), (13, message("d", 1)), (14, message("c", 7)), (15, message("A", 1)), (16, message("d", 1)), (17, message("a", 2)), (18, '{"id": "c"} x'), (19, '{"id": "e", "usage": {"output_tokens": "many"}}'), (20, message("e", -1)),
]


def want(rows):
    best, by = {}, {}
    for line, m in rows:
        try:
            o = json.loads(m)
        except (TypeError, ValueError):
            continue
        i = o.get("id")
        if i:
            n = (o.get("usage") or {}).get("output_tokens")
            try:
                n = int(n)
            except (TypeError, ValueError):
                n = float("-inf")
            by.setdefault(i, set()).add(line)
            best[i] = max(best.get(i, (float("-inf"), -(10**9))), (n, -line))
    return {(i, line) for i, ls in by.items() for line in ls if line != -best[i][1]}


def write(spark, where, parts):
    at = datetime(2026, 1, 1)
    for k, rows in enumerate(parts):
        df = spark.createDataFrame([(line, m, at + timedelta(days=3 * k, hours=line), "x") for line, m in rows], "line_id bigint, message string, received_at timestamp, at string")
        df.coalesce(1).write.mode("append").parquet(where)


def test_batches_expiry_and_late_copies(spark, tmp_path):
    where = f"{tmp_path}/in"
    write(spark, where, [ROWS[:5], ROWS[5:11], ROWS[11:14], ROWS[14:18], ROWS[18:] + ROWS[:2]])
    schema = spark.read.parquet(where).schema
    for horizon, steps in ((3600, 4), (30 * 86_400, 4), (3600, 1), (1, 9)):
        store = deliveries(spark, where, schema, horizon_s=horizon, files=1, steps=steps)
        assert {tuple(r) for r in store.dropped().collect()} == want(ROWS)
        kept = {r.message_id: r.line_id for r in store.kept().collect()}
        assert kept == {"a": 12, "b": 4, "c": 14, "d": 13, "A": 15, "e": 20}
    assert {lv for lv, _ in store.committed()["segments"]} & {1, 2}  # segments were merged


def test_archive_is_looked_up(spark, tmp_path):
    """Ids that come back long after they expired, in steps that all read the store before them."""
    at = datetime(2026, 1, 1)
    rows = [(k, message(f"m{k % 150}", (k * 7) % 11), at + timedelta(days=k)) for k in range(400)]
    spark.createDataFrame(rows, "line_id bigint, message string, received_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for steps in (4, 16):
        store = deliveries(spark, f"{tmp_path}/in", schema, steps=steps)
        assert {tuple(r) for r in store.dropped().collect()} == want([(a, b) for a, b, _ in rows])
        done = store.committed()
        assert done["step"] == steps - 1 and done["segments"] and len(done["segments"]) <= 3 * 2


def test_step_is_taken_again(spark, tmp_path):
    """A step that was interrupted before its commit is done again over the same names."""
    where = f"{tmp_path}/in"
    write(spark, where, [ROWS])
    lines = spark.read.parquet(where)
    store = DeliveryStore(spark, f"file://{tmp_path}/root", 3600, 4)
    commit, seen = store._commit, []

    def stop(state):
        seen.append(state["step"])
        if seen == [0, 1]:
            raise RuntimeError("lost")
        commit(state)

    store._commit = stop
    try:
        store.take(lines, 0)
    except RuntimeError:
        pass
    assert store.committed()["of"] == 1
    store.take(lines, 0)
    assert seen == [0, 1, 1, 2, 3]
    assert {tuple(r) for r in store.dropped().collect()} == want(ROWS)


def test_goes_on_where_it_stopped(spark, tmp_path):
    where, root = f"{tmp_path}/in", f"file://{tmp_path}/root"
    write(spark, where, [ROWS[:9]])
    schema = spark.read.parquet(where).schema
    first = deliveries(spark, where, schema, root=root)
    assert {tuple(r) for r in first.dropped().collect()} == want(ROWS[:9])
    first.take(spark.read.parquet(where), 0)  # a batch that is given again changes nothing
    write(spark, where, [ROWS[9:]])
    again = deliveries(spark, where, schema, root=root)
    assert {tuple(r) for r in again.dropped().collect()} == want(ROWS)


def test_empty_and_one_file(spark, tmp_path):
    df = spark.createDataFrame([], "line_id bigint, message string, received_at timestamp")
    df.write.parquet(f"{tmp_path}/e")
    assert deliveries(spark, f"{tmp_path}/e", df.schema).dropped().count() == 0
    assert copies(df).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("line_id"), F.lit(message("hot", 1)).alias("message"), F.lit(None).cast("timestamp").alias("received_at"))
    hot.write.parquet(f"{tmp_path}/h")
    assert deliveries(spark, f"{tmp_path}/h", hot.schema).dropped().count() == 2999
