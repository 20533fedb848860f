"""What the deduplication of repeated windows moves and writes follows the input, and carries no text keys from row to row."""

import random

from tracequarry.llm import runindex, windows

WORDS = [f"w{i}" for i in range(300)]


def _docs(spark):
    rng = random.Random(8)
    passage = " ".join(rng.choices(WORDS, k=80))
    rows = [(i, " ".join([*rng.choices(WORDS, k=120), passage if i % 4 == 0 else ""])) for i in range(60)]
    rows += [(i + 60, rows[i][1]) for i in range(3)] + [(5, rows[4][1] + " more"), (5, rows[8][1] + " more")]  # copies; one id, two texts
    return rows, spark.createDataFrame(rows, "doc long, text string").selectExpr("unhex(sha2(text, 256)) AS key", "doc", "text")


def test_runs_number_their_texts(spark):
    rows, docs = _docs(spark)
    index = runindex.FingerprintIndex()
    got = {}
    for part in runindex.batches(docs, 2):
        got |= {r["text"]: runindex.remove(r["text"], r["starts"], 50)[1] for r in index.ingest(part).collect()}
    assert all({*run.columns} == {"t", "h", "run"} for run in index.runs)
    numbers = [r for batch in index.numbers for r in batch.collect()]
    assert len(numbers) == len({r["t"] for r in numbers}) == len({r["key"] for r in numbers}) == len({t for _, t in rows})
    first = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            first[tuple(w[j : j + 50])] = min(i, first.get(tuple(w[j : j + 50]), i))
    for t in {t for _, t in rows}:
        w, doc = t.split(), min(i for i, other in rows if other == t)
        assert got.get(t, 0) == len({k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < doc for k in range(j, j + 50)})


def test_short_lists_are_merged_like_long_ones(spark):
    member = spark.range(2000).selectExpr("id % 500 AS h", "id AS t")
    keys = spark.range(400).selectExpr("id AS h", "4L AS n")
    kept = windows.with_keys(member, keys)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and kept.count() == 1600
    hot = spark.range(1).selectExpr("7L AS h", "4L AS n")
    assert {r["h"] for r in windows.with_keys(member, hot).collect()} == {7}


def test_segments_are_written_once(spark, monkeypatch):
    """An anchor with many segments doesn't have all others written a second time."""
    _, docs = _docs(spark)
    cut, written = windows.cut, []
    monkeypatch.setattr(windows, "cut", lambda df: written.append({*df.columns}) or cut(df))
    runindex.FingerprintIndex(together=1).ingest(docs).collect()
    assert any({"p", "content"} <= columns for columns in written)  # there are such anchors
    assert not any({"d", "content"} <= columns for columns in written)
