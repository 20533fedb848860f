"""Streams that keep state of their own: frames of connections, states of jobs, steps of sessions; and their batch forms.

The streams use transformWithState, which needs the RocksDB state store: set spark.sql.streaming.stateStore.providerClass to
STORE (tracequarry.session does). State is one value or a small map a key; it ends by a timer or by its time to live. Where state
lives by the clock (jobs, steps), a run with the availableNow trigger ends only if spark.sql.streaming.noDataMicroBatches.enabled
is false.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracequarry.functions import code
from tracequarry.operators import evidence
from tracequarry.streaming.feeds import ENVELOPE, STATES

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What parts frames, and what a frame of data begins with.
BLANK, DATA = "\n\n", "data: "


def _told(rows: list[tuple], *columns: str) -> Iterator[pd.DataFrame]:
    """Rows, if any, as plain objects: extension types of strings come as chunks, which Spark's writer doesn't take."""
    if rows:
        yield pd.DataFrame(rows, columns=[*columns], dtype=object)


# ---- frames ----


def frames(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, frame, text): what blank lines part in a connection's chunks, joined in order; the unfinished rest isn't a frame.

    A frame may begin and end in any chunk, and so may the blank line itself: an odd newline at a chunk's end is moved to the next
    chunk, as the first of a pair. Chunks are numbered by running sums over their connection, and only the pieces of one frame
    are brought together. Null chunks are empty; of chunks with one order the first text counts, as when a chunk is sent again."""
    rows = chunks.groupBy(key, order).agg(F.min(F.coalesce(text, F.lit(""))).alias("c"))
    rows = rows.withColumn("bare", F.rtrim(F.col("c"), F.lit("\n")))
    by = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("solid", F.sum(F.when(F.col("bare") != "", 1).otherwise(0)).over(by))
    ends = F.sum(F.length("c") - F.length("bare")).over(W.partitionBy(key, "solid").orderBy(order))
    rows = rows.withColumn("odd", ends % 2 == 1)
    rows = rows.withColumn("had", F.coalesce(F.lag("odd").over(by), F.lit(False)))
    whole = F.concat(F.when(F.col("had"), "\n").otherwise(""), "c")
    rows = rows.withColumn("parts", F.split(F.when(F.col("odd"), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole), BLANK))
    before = F.coalesce(F.sum(F.size("parts") - 1).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)  # on its own: beside a generator it would be summed over pieces
    pieces = rows.select(key, order, "before", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "piece"))
    pieces = pieces.select(key, order, (F.col("before") + F.col("i")).alias("frame"), (F.col("i") < F.col("n") - 1).alias("ends"), "piece")
    joined = pieces.groupBy(key, "frame").agg(F.bool_or("ends").alias("ends"), F.array_sort(F.collect_list(F.struct(order, "piece"))).alias("p"))
    return joined.where("ends").select(key, "frame", F.array_join(F.col("p.piece"), "").alias("text"))


def envelopes(framed: DataFrame, *keys: str) -> DataFrame:
    """(keys, type, message, apk_details, telemetry) of the frames that hold data of a known type. Works on streams too."""
    told = framed.withColumn("line", code.clean_text(F.col("text"))).where(F.col("line").startswith(DATA))
    made = told.select(*keys, F.from_json(F.substring("line", len(DATA) + 1, 1 << 30), ENVELOPE).alias("e"))
    return made.select(*keys, "e.*").where(F.col("type").isin("log", "metadata", "result", "error"))


class Framing(StatefulProcessor):
    """A connection's unfinished rest, the number of its next chunk, and chunks that came too early."""

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "upto long, frame long, tail string, timer long")
        self.early = handle.getMapState("early", "seq long", "chunk string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        upto, frame, tail, timer = self.rest.get() if self.rest.exists() else (0, 0, "", 0)
        waiting, last = {}, 0
        for batch in rows:
            for seq, ts, chunk in zip(batch["seq"], batch["ts"], batch["chunk"], strict=True):
                last = max(last, pd.Timestamp(ts).value // 1_000_000)
                if int(seq) >= upto:
                    waiting[int(seq)] = min(chunk or "", waiting.get(int(seq), chunk or ""))
        out, start = [], upto
        while upto in waiting or (upto > start or waiting) and self.early.containsKey((upto,)):
            if upto in waiting:
                tail += waiting.pop(upto)
            else:
                tail += self.early.getValue((upto,))[0]
                self.early.removeKey((upto,))
            upto += 1
        for seq, chunk in waiting.items():
            if not self.early.containsKey((seq,)):
                self.early.updateValue((seq,), (chunk,))
        *whole, tail = tail.split(BLANK)
        for text in whole:
            out.append((key[0], frame, text))
            frame += 1
        expires = max(last + self.idle, timerValues.getCurrentWatermarkInMs() + 1)
        if expires > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expires)
            timer = expires
        self.rest.update((upto, frame, tail, timer))
        yield from _told(out, self.key, "frame", "text")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.rest.clear()
        self.early.clear()
        yield from ()

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame, key: str = "connection", idle: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """frames() of a stream (key, seq from 0, ts, chunk): each frame once it is whole. A chunk that comes before its turn waits, one
    that comes again counts once; a connection that has been idle past the watermark is dropped with its unfinished rest."""
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(Framing(key, _millis(idle)), f"{key} {kind}, frame long, text string", "Append", "EventTime")


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


# ---- jobs ----


class JobState(StatefulProcessor):
    """A job's latest event; at one time the state further on counts."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "micros long, name string, changes int", self.ttl)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for ts, name, changes in zip(initialState["ts"], initialState["state"], initialState["changes"], strict=True):
            self.state.update((pd.Timestamp(ts).value // 1000, name, int(changes)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, name, changes = self.state.get() if self.state.exists() else (None, None, 0)
        old = name
        for batch in rows:
            for ts, new in sorted(zip(batch["ts"], batch["state"], strict=True), key=lambda x: (x[0], STATES.get(x[1], -1))):
                micros = pd.Timestamp(ts).value // 1000
                if at is None or micros > at or (micros == at and STATES.get(new, -1) >= STATES.get(name, -1)):
                    at, name = micros, new
        changes += name != old
        self.state.update((at, name, int(changes)))
        told = [] if name == old else [(key[0], name, pd.Timestamp(at * 1000), changes)]
        yield from _told(told, "job", "state", "ts", "changes")

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, known: DataFrame | None = None, ttl: str = "24 hours") -> DataFrame:
    """events (job, state, ts) as they come: (job, state, ts, changes) whenever a job's state changes.

    known, a stored table (job, state, ts, changes), is what jobs start from in the first batch of a new checkpoint; a restart goes
    on from the checkpoint's own state. A job without events for ttl, by the clock, is forgotten."""
    kind = events.schema["job"].dataType.simpleString()
    seed = None if known is None else known.groupBy("job")
    return events.groupBy("job").transformWithStateInPandas(JobState(_millis(ttl)), f"job {kind}, state string, ts timestamp, changes int", "Update", "ProcessingTime", seed)


def stored_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job, state, ts, changes) as the state of a stopped or running job_stream has them; fit to be another one's known."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
    value = F.col("value")
    value = value["value"] if "value" in [f.name for f in rows.schema["value"].dataType.fields] else value
    return rows.select("key.job", value["name"].alias("state"), F.timestamp_micros(value["micros"]).alias("ts"), value["changes"].alias("changes"))


# ---- steps and feeds ----


class Steps(StatefulProcessor):
    """The first time of each step of a session."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "step string", "micros long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}
        for batch in rows:
            for step, ts in zip(batch["step"], batch["ts"], strict=True):
                micros = pd.Timestamp(ts).value // 1000
                found[step] = min(micros, found.get(step, micros))
        told = []
        for step, micros in sorted(found.items()):
            if not self.first.containsKey((step,)) or micros < self.first.getValue((step,))[0]:
                self.first.updateValue((step,), (micros,))
                told.append((key[0], step, pd.Timestamp(micros * 1000)))
        yield from _told(told, "session", "step", "first_ts")

    def close(self) -> None:
        pass


def step_stream(lines: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """lines (session, ts, line) as they come: (session, step, first_ts) when a step becomes active, and again if an earlier line
    turns up. Lines that show no step don't reach the state; a session's steps are forgotten ttl after they were set."""
    kind = lines.schema["session"].dataType.simpleString()
    shown = lines.select("session", "ts", F.explode(F.array_compact(F.array(*[F.when(shows, F.lit(s)) for s, shows in evidence.steps_shown().items()]))).alias("step"))
    return shown.groupBy("session").transformWithStateInPandas(Steps(_millis(ttl)), f"session {kind}, step string, first_ts timestamp", "Update", "ProcessingTime")


def feed_stream(events: DataFrame, length: str = "30 days", slide: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, kind, n): events (ts, kind) in sliding windows, given out as the watermark passes their ends.

    Panes of one slide are counted first, so what the long windows multiply is one row a pane and kind."""
    panes = events.withWatermark("ts", delay).groupBy(F.window("ts", slide).alias("w"), "kind").agg(F.count("*").alias("m"))
    panes = panes.select(F.window_time("w").alias("at"), "kind", "m")
    return panes.groupBy(F.window("at", length, slide).alias("w"), "kind").agg(F.sum("m").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def sliding_counts(events: DataFrame, length_s: int = 30 * 86400, slide_s: int = 3600) -> DataFrame:
    """Batch form of feed_stream, without a row for each pane and window: events are counted by pane, and windows are differences of
    the panes' running sums. Rows that a kind's sums take are as many as its span of time has panes, however many its events."""
    panes = events.groupBy("kind", F.floor(F.unix_seconds("ts") / slide_s).alias("pane")).agg(F.count("*").alias("m"))
    n = length_s // slide_s
    span = panes.groupBy("kind").agg(F.min("pane").alias("a"), F.max("pane").alias("b"))
    grid = span.select("kind", F.explode(F.sequence(F.col("a") - n + 1, F.col("b"))).alias("pane"))
    ahead = W.partitionBy("kind").orderBy("pane").rowsBetween(0, n - 1)
    rows = grid.join(panes, ["kind", "pane"], "left").withColumn("n", F.sum(F.coalesce("m", F.lit(0))).over(ahead))
    return rows.where("n > 0").select(F.timestamp_seconds(F.col("pane") * slide_s).alias("start"), "kind", "n")
