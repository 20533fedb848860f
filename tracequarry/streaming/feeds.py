"""Streams of log lines: the batch operators with watermarks, so that state stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import telemetry

LINES = "event_id long, session long, ts timestamp, line string"


def read_lines(spark: SparkSession, folder: str, files_at_a_time: int = 1000) -> DataFrame:
    """Log lines as they arrive in a folder of JSON files."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_at_a_time).json(folder)


def first_seen(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each file, socket and library of a session once within the delay. State: the items of the last delay."""
    events = telemetry.parse_log(lines).where(F.col("kind").isin("file", "socket", "library"))
    item = F.coalesce("file", F.concat("ip", F.lit(":"), F.col("port").cast("string")), "library")
    return events.withColumn("item", item).select("session", "kind", "item", "ts").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "kind", "item"])


def sessions(lines: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """A telemetry row for each run of a session's lines without a gap; given out once it can't grow."""
    events = telemetry.parse_log(lines).withWatermark("ts", delay)
    grouped = events.groupBy("session", F.session_window("ts", gap).alias("w"))
    sockets = F.collect_set(F.when(F.col("ip").isNotNull(), F.struct("ip", "port")))
    return grouped.agg(
        F.bool_or("root").alias("root"), F.bool_or("ssl").alias("ssl"), F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(sockets).alias("sockets"), F.array_sort(F.collect_set("library")).alias("libraries"),
    ).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "root", "ssl", "files", "sockets", "libraries")


def counts(lines: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling or sliding windows."""
    return telemetry.windowed_counts(telemetry.parse_log(lines).withWatermark("ts", delay), length, slide)


def late_fusion(static: DataFrame, dynamic: DataFrame, bound: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """static (apk, probability, ts) with the dynamic row (apk, dynamic_score, ts) that comes within the bound, or null."""
    s, d = static.withWatermark("ts", delay).alias("s"), dynamic.withWatermark("ts", delay).alias("d")
    soon = F.expr(f"s.apk = d.apk AND d.ts >= s.ts AND d.ts <= s.ts + INTERVAL {bound}")
    return s.join(d, soon, "leftOuter").select(F.col("s.apk").alias("apk"), "s.probability", F.col("s.ts").alias("ts"), "d.dynamic_score")


def sliding_feed(events: DataFrame, length: str, slide: str) -> DataFrame:
    """Batch form: events by kind in sliding windows. Rows are summed to one for each step and kind before windows multiply them."""
    steps = events.groupBy(F.window("ts", slide).alias("w"), "kind").agg(F.count("*").alias("m")).select(F.col("w.start").alias("ts"), "kind", "m")
    return steps.groupBy(F.window("ts", length, slide).alias("w"), "kind").agg(F.sum("m").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


STATES = {"QUEUED": 0, "PROCESSING": 1, "COMPLETED": 2, "FAILED": 2}


def job_states(events: DataFrame) -> DataFrame:
    """Batch form: (job, state, ts, n), each job's latest state."""
    return events.groupBy("job").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"), F.count("*").alias("n"))


def job_state_stream(events: DataFrame, timeout_ms: int = 24 * 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """events (job, state, ts) as they come: a row (job, state, ts, changes) whenever a job's state changes. The latest event
    counts; at one time, the state further on. A job's state is dropped once the watermark is timeout_ms past its last event."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def follow(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        at, name, changes = state.get if state.exists else (None, None, 0)
        old = name
        for batch in batches:
            for ts, new in sorted(zip(batch["ts"], batch["state"], strict=True), key=lambda x: (x[0], STATES.get(x[1], -1))):
                micros = pd.Timestamp(ts).value // 1000
                if at is None or micros > at or (micros == at and STATES.get(new, -1) >= STATES.get(name, -1)):
                    at, name = micros, new
        state.update((at, name, changes + (name != old)))
        state.setTimeoutTimestamp(max(at // 1000 + timeout_ms, state.getCurrentWatermarkMs() + 1))
        if name != old:
            yield pd.DataFrame({"job": [key[0]], "state": [name], "ts": [pd.Timestamp(at * 1000, tz="UTC")], "changes": [changes + 1]})

    kind = events.schema["job"].dataType.simpleString()
    return events.withWatermark("ts", delay).groupBy("job").applyInPandasWithState(follow, f"job {kind}, state string, ts timestamp, changes int", "at long, name string, changes int", "update", GroupStateTimeout.EventTimeTimeout)


ENVELOPE = "type string, message string, apk_details struct<name: string, size: string, package: string>, telemetry string"


def decode_envelopes(raw: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, type, message, apk_details, telemetry) of `data: {...}` frames that blank lines part; others are no envelopes.
    Works on streams too."""
    frame = raw.select(*keys, F.explode(F.split(text, "\n\n")).alias("frame")).where(F.col("frame").startswith("data: "))
    made = frame.select(*keys, F.from_json(F.substring("frame", 7, 1 << 30), ENVELOPE).alias("e"))
    return made.select(*keys, "e.*").where(F.col("type").isin("log", "metadata", "result", "error"))


def ingest(uploads: DataFrame, known_path: str, checkpoint: str):
    """A stream of uploads (apk_hash, job): new contents are appended to the table at known_path, once each; a query to await.

    Known contents are left out by an anti join with the table; what is written carries its batch's number, so a batch that
    runs again after a failure first leaves out its own rows and writes them anew."""

    def admit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("apk_hash").agg(F.min("job").alias("job")).withColumn("batch", F.lit(number))
        schema = fresh.schema
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(known_path)
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            known = spark.read.schema(schema).parquet(known_path).where(F.col("batch") != number)
            fresh = fresh.join(known.select("apk_hash"), "apk_hash", "left_anti").select(*schema.names)
        fresh.drop("batch").write.mode("overwrite").parquet(f"{known_path}/batch={number}")

    return uploads.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint)
