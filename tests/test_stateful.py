"""Streams with state of their own, against their batch forms and known rows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import evidence, telemetry
from tracequarry.streaming import feeds, stateful



@pytest.fixture(autouse=True)
def one_task(spark):
    """A store for each task of each small batch would take most of the time."""
    name = "spark.sql.shuffle.partitions"
    had = spark.conf.get(name)
    spark.conf.set(name, "1")
    yield
    spark.conf.set(name, had)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


CHUNKS = "connection string, seq long, ts timestamp, chunk string"


def run(out, folder, name, mode):
    """All rows that the stream of this name has given out so far."""
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(str(folder / name / str(number)))
    # with a clock of its own a stream would go on with empty batches for ever
    out.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(mode == "append").lower())
    query = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(folder / f"{name}-check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return out.sparkSession.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(str(folder / name)).collect()


def files(folder, rows, of=1):
    """Rows as JSON files, one for each batch."""
    folder.mkdir(exist_ok=True)
    have = len([*folder.iterdir()])
    for k in range(0, len(rows), of):
        path = folder / f"{have + k:05}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows[k : k + of]))
        os.utime(path, (1_700_000_000 + have + k,) * 2)  # streams take files by age


def as_client_reads(text):
    """What a client that splits its buffer at blank lines gets of a whole connection."""
    out = []
    for part in text.split("\n\n")[:-1]:
        part = part.strip()
        if part.startswith("data: "):
            try:
                data = json.loads(part[6:])
            except ValueError:
                continue
            if data.get("type") in ("log", "metadata", "result", "error"):
                out.append((data["type"], data.get("message")))
    return sorted(out, key=repr)


SENT = 'data: {"type":"log","message":"é one"}\n\n: ping\n\n\n\n\ndata: {"type":"error","message":"two\\n\\nlines"}\n\n\n data: {"type":"result","telemetry":{}}\n\ndata: {no\n\ndata: {"type":"other"}\n\ndata: {"type":"log","message":"unfinished"}\n'


def test_frames_are_the_same_wherever_chunks_are_cut(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(60):
        at = sorted(rng.sample(range(len(SENT) + 1), rng.randint(0, 25))) if k else range(len(SENT))
        cuts = [0, *at, len(SENT)]
        chunks = [SENT[a:b] for a, b in zip(cuts, cuts[1:])]
        rows += [(f"c{k}", i, "2024-01-01", x) for i, x in enumerate(chunks)]
        want[f"c{k}"] = as_client_reads(SENT)
    text = ["\n" * rng.randint(0, 3) + rng.choice(["", "a", "data: {}"]) + "\n" * rng.randint(0, 4) for _ in range(200)]
    rows += [("n", i, "2024-01-01", x) for i, x in enumerate(text)] + [("n", 3, "2024-01-01", text[3]), ("gone", 0, "2024-01-01", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "connection string, seq long, ts string, chunk string")
    framed = stateful.frames(df, "connection", "seq", "chunk")
    got = {}
    for r in stateful.envelopes(framed, "connection", "frame").collect():
        got.setdefault(r["connection"], []).append((r["type"], r["message"]))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == want
    assert [tuple(r) for r in framed.where("connection = 'n'").select("frame", "text").orderBy("frame").collect()] == [*enumerate("".join(text).split("\n\n")[:-1])]


def test_frames_of_a_stream(spark, tmp_path):
    rng, rows = random.Random(2), []
    for k in range(3):
        step = rng.randint(5, 30)
        chunks = [SENT[i : i + step] for i in range(0, len(SENT), step)]
        rows += [{"connection": f"c{k}", "seq": i, "ts": f"2024-01-01T00:00:{i % 60:02}Z", "chunk": x} for i, x in enumerate(chunks)]
    rng.shuffle(rows)
    rows += rows[:5]  # sent again
    files(tmp_path / "in", rows[: len(rows) // 2], len(rows) // 4 + 1)
    stream = lambda: stateful.frame_stream(spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    run(stream(), tmp_path, "framed", "append")
    files(tmp_path / "in", rows[len(rows) // 2 :], len(rows))
    got = run(stream(), tmp_path, "framed", "append")  # goes on from the checkpoint
    batch = stateful.frames(spark.createDataFrame([(r["connection"], r["seq"], r["chunk"]) for r in rows], "connection string, seq long, chunk string"), "connection", "seq", "chunk")
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))
    assert len({(r["connection"], r["frame"]) for r in got}) == len(got)


def test_dead_connections_are_dropped(spark, tmp_path):
    row = lambda c, seq, ts, x: {"connection": c, "seq": seq, "ts": ts, "chunk": x}
    files(tmp_path / "in", [row("a", 0, "2024-01-01T00:00:00Z", "begun "), row("b", 0, "2024-01-01T02:00:00Z", "x\n\n"), row("b", 1, "2024-01-01T02:00:01Z", "y\n\n"), row("a", 1, "2024-01-01T02:00:02Z", "ended\n\n")])
    got = run(stateful.frame_stream(spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))), tmp_path, "dead", "append")
    assert sorted(map(tuple, got)) == [("b", 0, "x"), ("b", 1, "y")]


def test_job_states_survive_a_restart_and_start_from_a_table(spark, tmp_path):
    row = lambda job, state, minute: {"job": job, "state": state, "ts": f"2024-01-01T00:{minute:02}:00Z"}
    known = spark.createDataFrame([(7, "PROCESSING", 1)], "job long, state string, changes int").withColumn("ts", F.lit("2024-01-01T00:30:00Z").cast("timestamp"))
    stream = lambda: stateful.job_stream(spark.readStream.schema("job long, state string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "jobs")), known)
    files(tmp_path / "jobs", [row(1, "QUEUED", 0), row(1, "PROCESSING", 2), row(7, "QUEUED", 5)], 1)
    first = [(1, "PROCESSING", 2), (1, "QUEUED", 1)]  # what is known of 7 is later
    assert sorted((r["job"], r["state"], r["changes"]) for r in run(stream(), tmp_path, "states", "update")) == first
    files(tmp_path / "jobs", [row(1, "QUEUED", 1), row(1, "COMPLETED", 9), row(7, "FAILED", 31), row(7, "PROCESSING", 31)], 2)
    assert sorted((r["job"], r["state"], r["changes"]) for r in run(stream(), tmp_path, "states", "update")) == [(1, "COMPLETED", 3), *first, (7, "FAILED", 2)]
    stored = stateful.stored_jobs(spark, str(tmp_path / "states-check"))
    assert sorted((r["job"], r["state"], str(r["ts"]), r["changes"]) for r in stored.collect()) == [(1, "COMPLETED", "2024-01-01 00:09:00", 3), (7, "FAILED", "2024-01-01 00:31:00", 2)]


def test_steps_and_feeds_of_a_stream(spark, tmp_path):
    rng, kinds = random.Random(4), ["[Sandbox] File read: /a", "Installing on device", "frida hooks", "Root check blocked", "nothing", "syncing complete"]
    lines = [{"event_id": i, "session": i % 4, "ts": f"2024-01-{1 + i // 40:02}T{rng.randrange(24):02}:{rng.randrange(60):02}:00Z", "line": rng.choice(kinds)} for i in range(200)]
    files(tmp_path / "in", lines, 70)
    batch = spark.read.schema(feeds.LINES).json(str(tmp_path / "in"))
    read = lambda: feeds.read_lines(spark, str(tmp_path / "in"), 1)
    last = {}
    for r in run(stateful.step_stream(read().drop("event_id")), tmp_path, "steps", "update"):
        last[r["session"], r["step"]] = min(r["first_ts"], last.get((r["session"], r["step"]), r["first_ts"]))
    want = {(r["session"], r["step"]): r["first_ts"] for r in evidence.checkpoints(batch).where("active").collect()}
    assert last == want and len(want) > 10
    fed = run(stateful.feed_stream(telemetry.parse_log(read()), "6 hours", "1 hour", "24 hours"), tmp_path, "feed", "append")
    whole = stateful.sliding_counts(telemetry.parse_log(batch), 6 * 3600, 3600)
    got = sorted(map(tuple, fed))
    mark = max(r["ts"] for r in batch.collect()).replace(hour=0, minute=0)
    closed = [tuple(r) for r in whole.collect() if r["start"] < mark.replace(day=mark.day - 2)]
    assert set(closed) <= set(got) and set(got) <= {tuple(r) for r in whole.collect()} and len(closed) > 50
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, feeds.sliding_feed(telemetry.parse_log(batch), "6 hours", "1 hour").collect()))
