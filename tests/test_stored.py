"""Stored tables, digests and sketches against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions import canonical
from tracequarry.operators import sketches
from tracequarry.sources.stored import Conflict, StoredTable


def rows_of(df):
    return {r["apk"]: (r["at"], r["score"]) for r in df.collect()}


def test_updates_rewrite_touched_buckets(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "apk", "at", 16)
    make = lambda rows: spark.createDataFrame(rows, "apk string, at int, score double")
    assert len(table.upsert(make([(f"a{i}", 1, float(i)) for i in range(400)]))["files"]) == 16
    before = table.manifest()["files"]
    done = table.upsert(make([("a1", 2, 0.5), ("a1", 1, 0.7), ("a2", 0, 9.0), (None, 1, 1.0), ("new", 1, 2.0)]))
    assert len(done["touched"]) <= 4
    assert {b for b in before if before[b] != done["files"][b]} <= set(done["touched"])
    got = rows_of(table.read())
    assert len(got) == 402 and got["a1"] == (2, 0.5) and got["a2"] == (1, 2.0) and got[None] == (1, 1.0)
    assert rows_of(StoredTable(spark, str(tmp_path / "t"), "apk", "at", 16).read()) == got
    table.upsert(make([("a1", 2, 0.5), ("a1", 1, 0.7), ("a2", 0, 9.0), (None, 1, 1.0), ("new", 1, 2.0)]))  # again
    assert rows_of(table.read()) == got
    table.upsert(make([("a3", 1, 77.0)]))  # at one time the incoming row stays
    assert rows_of(table.read())["a3"] == (1, 77.0)
    assert table.upsert(make([]))["version"] == 4
    assert table.vacuum() > 0 and rows_of(table.read())["a3"] == (1, 77.0) and table.versions() == [4]


def test_failures_before_the_swap_change_nothing(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, str(tmp_path / "t"), "apk", "at", 4)
    make = lambda rows: spark.createDataFrame(rows, "apk string, at int, score double")
    table.upsert(make([("a", 1, 1.0), ("b", 1, 1.0)]))
    monkeypatch.setattr(StoredTable, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(make([("a", 2, 2.0)]))
    monkeypatch.undo()
    assert rows_of(table.read()) == {"a": (1, 1.0), "b": (1, 1.0)}
    table.upsert(make([("a", 2, 2.0)]))
    assert rows_of(table.read())["a"] == (2, 2.0)
    old = table.manifest() | {"version": 1}
    monkeypatch.setattr(StoredTable, "manifest", lambda self: old)
    with pytest.raises(Conflict):
        table.upsert(make([("b", 9, 9.0)]))
    monkeypatch.undo()
    assert rows_of(table.read())["b"] == (1, 1.0)


TEXTS = ["plain", 'quote " and \\ back', "é ß ж 漢", "\U0001f600 face", "\x00\x1f\x7f\x80", "tab\tline\nend\r\b\f", "", "/slash", None]


def spelled(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def test_canonical_json(spark):
    kind = T.StructType.fromDDL("b string, a int, z struct<y: boolean, x: array<string>>, m map<string,bigint>")
    rows = [(t, i, (i % 2 == 0, [t, "é"]), {"é": 1, "b": 2, t or "": -3}) for i, t in enumerate(TEXTS)] + [(None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).coalesce(1).select(canonical.canonical_json(F.struct("b", "a", "z", "m"), kind)).collect()]
    want = [spelled({"b": b, "a": a, "z": z and {"y": z[0], "x": z[1]}, "m": m}) for b, a, z, m in rows]
    assert got == want
    with pytest.raises(TypeError):
        canonical.canonical_json(F.lit(1.5), T.DoubleType())


def test_ids_of_names_beyond_ascii(spark):
    made = canonical.with_example_id(spark.createDataFrame([("a" * 64, "Lé/漢;->f()V", 3)], "h string, m string, i int"), F.col("h"), rule_id=F.lit("r"), dex_name=F.lit("classes.dex"), source_method=F.col("m"), instruction_index=F.col("i"), invoked_signature=F.lit("Lx/Y;->s()V"))
    identity = {"apk_hash": "a" * 64, "rule_id": "r", "dex_name": "classes.dex", "source_method": "Lé/漢;->f()V", "instruction_index": 3, "invoked_signature": "Lx/Y;->s()V"}
    assert made.first()["example_id"] == "a" * 64 + ":" + hashlib.sha256(spelled(identity).encode()).hexdigest()


@pytest.mark.parametrize("parts", [2, 60])
def test_mapping_digest_is_that_of_the_whole_text(spark, parts):
    rng = random.Random(1)
    mapping = {hashlib.sha256(str(i).encode()).hexdigest(): rng.choice(["train", "test", "é"]) for i in range(9000)} | {"schlüssel": "x"}
    rows = [*mapping.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v string").repartition(parts)
    assert tuple(canonical.mapping_sha256(df, "k", "v").first()) == (9001, hashlib.sha256(spelled(mapping).encode()).hexdigest())
    assert tuple(canonical.mapping_sha256(df.limit(0), "k", "v").first()) == (0, hashlib.sha256(b"{}").hexdigest())
    with pytest.raises(Exception, match="twice"):
        canonical.mapping_sha256(df.union(df.limit(1)), "k", "v").collect()


def test_sketches_keep_ranks(spark):
    rng = random.Random(2)
    rows = [(i % 3, "ab"[i % 2], int(rng.lognormvariate(5, 2)) if i % 50 else None) for i in range(60_000)] + [(7, "c", None)]
    df = spark.createDataFrame(rows, "day int, label string, v long")
    stored = sketches.sketched(df, "v", "day", "label")
    got = {(r["grouping"], r["member"]): r for r in sketches.distribution(sketches.grouping_sets(stored, "day", "label")).collect()}
    assert len(got) == 1 + 4 + 3
    for (grouping, member), r in got.items():
        values = sorted(v for d, x, v in rows if v is not None and (grouping == "all" or member == str({"day": d, "label": x}[grouping])))
        assert (r["n"], r["most"]) == (len(values), max(values, default=None))
        for level in sketches.LEVELS:
            at = r[f"p{str(level)[2:]}"]
            if not values:
                assert at is None
                continue
            below, upto = sum(v < at for v in values) / len(values), sum(v <= at for v in values) / len(values)
            assert below - 0.01 <= level <= upto + 0.01, (grouping, member, level)
