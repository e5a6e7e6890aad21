"""Stateful operators over event streams: call budgets, once-only signals, repeated briefs, running key stats.

Each is keyed state with a time to live; rows of one key that arrive in a batch are taken
in the order of ``seq``.  Rows are never dropped for being late: expiry goes by processing
time, so a key that comes back after it starts anew.  A stream that is to end (as
:func:`drain` runs it) takes ``live_ms`` None: timers ask for another batch for ever.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.functions.words import NOTE_STOPWORDS
from cairn.session import shared_path

#: A key untouched for so long is forgotten.
LIVE_MS = 86_400_000
#: Sessions of a key that are remembered; one that was pushed out counts again.
SESSIONS = 32


_TASK = re.compile(r"^\s*[-*]?\s*\**Task\**\s*:(.*)$", re.I | re.M)
_OTHER = re.compile(r"^\s*[-*]?\s*\**Not a duplicate\**\s*:", re.I | re.M)


def _keyed(events: DataFrame, key: str, step: Callable, out: T.StructType, state: T.StructType, first: tuple, live_ms: int | None, opened: Callable = lambda x: x, closed: Callable = lambda x: x) -> DataFrame:
    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = opened(held.get if held.exists else first)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        got = []
        for r in rows.itertuples(index=False):
            now, row = step(now, r)
            if row is not None:
                got.append((k[0], *row))
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(closed(now))
            if live_ms:
                held.setTimeoutDuration(live_ms)
        yield pd.DataFrame(got, columns=out.fieldNames()) if got else pd.DataFrame({f: [] for f in out.fieldNames()})

    return events.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout if live_ms else GroupStateTimeout.NoTimeout)


def call_budgets(events: DataFrame, key: str = "session_id", limit: int = 40, warn: int = 3, live_ms: int | None = LIVE_MS) -> DataFrame:
    """(key, seq, n, verdict) of each call: its number, and allow, warn or deny; an event of kind 'stop' forgets the key.

    ``events`` has the key, seq and kind.
    """
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("seq", T.LongType()), T.StructField("n", T.LongType()), T.StructField("verdict", T.StringType())])
    state = T.StructType([T.StructField("n", T.LongType())])

    def step(now: tuple, r):  # noqa: ANN001, ANN202
        if r.kind == "stop":
            return (0,), None
        n = now[0] + 1
        return (n,), (r.seq, n, "deny" if n > limit else "warn" if n > limit - warn else "allow")

    return _keyed(events, key, step, out, state, (0,), live_ms)


def once(events: DataFrame, key: str = "session_id", live_ms: int | None = LIVE_MS) -> DataFrame:
    """(key, seq) of the first event of each key."""
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("seq", T.LongType())])
    state = T.StructType([T.StructField("done", T.BooleanType())])
    return _keyed(events, key, lambda now, r: ((True,), None if now[0] else (r.seq,)), out, state, (False,), live_ms)


class _Briefs:
    """The briefs let through in a session, in order, and which of them have a word."""

    def __init__(self, seqs: Iterable[int], words: Iterable[str]) -> None:
        self.seqs: list[int] = []
        self.sets: list[frozenset[str]] = []
        self.having: dict[str, list[int]] = {}
        for s, w in zip(seqs, words):
            self.add(int(s), frozenset(map(sys.intern, w.split())))

    def add(self, seq: int, words: frozenset[str]) -> None:
        for w in words:
            self.having.setdefault(w, []).append(len(self.seqs))
        self.seqs.append(seq)
        self.sets.append(words)

    def near(self, words: set[str], least: float) -> Iterable[int]:
        """All briefs that may be as similar as ``least``, in order: of the words too many to miss all of, one is shared."""
        if least <= 0:
            return range(len(self.seqs))
        n = len(words)
        needed = max(1, math.ceil(least * n - 1e-9))
        rarest = sorted((self.having.get(w, ()) for w in words), key=len)[: n - needed + 1]
        return sorted({k for x in rarest for k in x if least * n - 1e-9 <= len(self.sets[k]) <= n / least + 1e-9})

    def row(self) -> tuple[list[int], list[str]]:
        return self.seqs, [" ".join(sorted(x)) for x in self.sets]


def repeated_briefs(events: DataFrame, key: str = "session_id", deny: float = 0.9, hint: float = 0.6, live_ms: int | None = LIVE_MS) -> DataFrame:
    """(key, seq, verdict, similarity, like) of each brief against those let through before in its session.

    The first brief alike decides.  Denied briefs don't enter the state, so what is compared
    depends on earlier verdicts; all others stay in it as long as the session lives.  A Task line
    speaks for its brief, and a line that says it is not a duplicate lets it through.  ``events`` has the key, seq and text.

    Scale: a brief meets only those that share one of its rarest words, by an index made once
    per batch; the words of all briefs let through in one session are held by one task.
    """
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("seq", T.LongType()), T.StructField("verdict", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("like", T.LongType())])
    state = T.StructType([T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.StringType()))])

    def step(now: _Briefs, r):  # noqa: ANN001, ANN202
        text = r.text if isinstance(r.text, str) else ""
        task = _TASK.search(text)
        mine = {w for w in re.findall(r"[a-z0-9_]{3,}", (task[1] if task else text).lower()) if w not in NOTE_STOPWORDS}
        verdict, sim, like = "allow", 0.0, None
        for k in () if _OTHER.search(text) else now.near(mine, hint):
            other = now.sets[k]
            x = len(mine & other) / len(mine | other) if mine and other else 0.0
            if x >= hint:  # the first that is alike tells, even if a later one is more so
                verdict, sim, like = ("deny" if x >= deny else "hint"), x, now.seqs[k]
                break
        if verdict != "deny":
            now.add(int(r.seq), frozenset(mine))
        return now, (r.seq, verdict, sim, like)

    return _keyed(events, key, step, out, state, ([], []), live_ms, lambda x: _Briefs(*x), _Briefs.row)


def running_stats(events: DataFrame, key: str = "key", live_ms: int | None = LIVE_MS) -> DataFrame:
    """(key, seq, accesses, sessions, cost) after each event; of the sessions only the last 32 are remembered, a null cost is 0.

    ``events`` has the key, seq, session and cost.
    """
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("seq", T.LongType()), T.StructField("accesses", T.LongType()), T.StructField("sessions", T.LongType()), T.StructField("cost", T.DoubleType())])
    state = T.StructType([T.StructField("accesses", T.LongType()), T.StructField("sessions", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("last", T.ArrayType(T.StringType()))])

    def step(now: tuple, r):  # noqa: ANN001, ANN202
        n, s, c, last = now
        last = list(last)
        if r.session not in last:
            s, last = s + 1, [*last, r.session][-SESSIONS:]
        n, c = n + 1, c + (0.0 if pd.isna(r.cost) else float(r.cost))
        return (n, s, c, last), (r.seq, n, s, c)

    return _keyed(events, key, step, out, state, (0, 0, 0.0, []), live_ms)


def drain(spark: SparkSession, stream: DataFrame, root: str | None = None) -> DataFrame:
    """Runs a stream over all there is now; what it put out, each row once.  The same ``root`` goes on."""
    root = root or shared_path(spark, "stream")
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def follow(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of Parquet files of a folder, or of one file."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
