"""Bytecode text, slice text, sources, sinks and streams on small rows with known results."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import code
from tracequarry.operators import dataset, flow, learn, outcomes, slice_text
from tracequarry.sources import files
from tracequarry.sources.shared import cut
from tracequarry.streaming import feeds

FAMILIES = [
    ("move", "v0, v1", {"v1"}, {"v0"}), ("const-string", 'v0, "x"', set(), {"v0"}), ("add-int", "v0, v1, v2", {"v1", "v2"}, {"v0"}), ("iget", "v0, v1, LA;->f:I", {"v1", "field:LA;->f:I"}, {"v0"}),
    ("iput", "v0, v1, LA;->f:I", {"v0", "v1"}, {"field:LA;->f:I"}), ("aget", "v0, v1, v2", {"v1", "v2", "array:v1"}, {"v0"}), ("aput", "v0, v1, v2", {"v0", "v1", "v2"}, {"array:v1"}), ("if-eq", "v0, v1, :x", {"v0", "v1"}, set()),
    ("return", "v0", {"v0"}, set()), ("monitor-enter", "v0", {"v0"}, set()), ("add-int/2addr", "v0, v1", {"v0", "v1"}, {"v0"}), ("check-cast", "v2, Ljava/lang/String;", {"v2"}, {"v2"}), ("fill-array-data", "v0, :data", {"v0"}, {"array:v0"}),
    ("int-to-long", "v0, v1", {"v1"}, {"v0"}), ("rsub-int/lit8", "v0, v1, 0x2", {"v1"}, {"v0"}), ("cmpg-double", "v0, v1, v2", {"v1", "v2"}, {"v0"}), ("neg-int", "v0, v1", {"v1"}, {"v0"}), ("new-instance", "v0, LX;", set(), {"v0"}),
    ("instance-of", "v0, v1, LX;", {"v1"}, {"v0"}), ("array-length", "v0, v1", {"v1"}, {"v0"}), ("sput-object", "v0, LA;->g:LB;", {"v0"}, {"field:LA;->g:LB;"}), ("packed-switch", "v0, :p", {"v0"}, set()), ("nop", "", set(), set()),
    ("invoke-static/range", "{v2 .. v5}, LX;->f()I", {"v2", "v3", "v4", "v5"}, {"result:LX;->f()I"}), ("move-result", "v0", {"result:LX;->f()I"}, {"v0"}), ("filled-new-array", "{v1, v2}, [I", {"v1", "v2"}, {"result:filled-new-array"}),
    ("move-result-object", "v0", {"result:filled-new-array"}, {"v0"}), ("invoke-static", "{v1}, LX;->g()V", {"v1"}, set()), ("move-result", "v0", set(), {"v0"}),
]


def test_uses_and_definitions(spark):
    rows = [(1, 1, i, op, x, f"{op} {x}") for i, (op, x, _, _) in enumerate(FAMILIES)] + [(1, 1, len(FAMILIES), "mystery-op", "v3, v4", "")]
    made = {r["idx"]: r for r in flow.use_def(spark.createDataFrame(rows, "apk int, method int, idx int, opcode string, operands string, raw_text string")).collect()}
    for i, (op, x, uses, defs) in enumerate(FAMILIES):
        assert (set(made[i]["uses"]), set(made[i]["defs"]), made[i]["is_unknown"]) == (uses, defs, False), (op, x)
    assert made[len(FAMILIES)]["is_unknown"] and set(made[len(FAMILIES)]["uses"]) == {"v3", "v4"}


def test_slice_text_keeps_quotes(spark):
    raw = ["const/4 v9, 0x1", 'const-string   v2,   "v9   :cond_7"', "if-eqz v2, :cond_7", "invoke-static {v2}, Lx/Y;->sink(Ljava/lang/String;)V"]
    instr = spark.createDataFrame([(1, 1, i, t.split()[0], t.split(None, 1)[1], t) for i, t in enumerate(raw)], "apk int, method int, idx int, opcode string, operands string, raw_text string")
    labels = spark.createDataFrame([(1, 1, ":cond_7", 3)], "apk int, method int, label string, idx int")
    none = spark.createDataFrame([], "apk int, method int, label string, pos int, target string")
    items = slice_text.normalized(instr, labels, none).where("idx > 0").withColumn("full_signature", F.lit("Lapp/Main;->run()V"))
    ends = spark.createDataFrame([(1, 1, 3, "external_call", "Lx/Y;->sink(Ljava/lang/String;)V"), (1, 1, 0, "recursion", None)], "apk int, method int, idx int, kind string, target string")
    row = slice_text.slice_text(items, ends, "apk").first()
    assert row["normalized"].split("\n") == [
        "[METHOD] Lapp/Main;->run()V", 'const-string v1, "v9   :cond_7"', "if-eqz v1, :label_0", "invoke-static {v1}, Lx/Y;->sink(Ljava/lang/String;)V",
        "[BOUNDARY] kind=external_call target=Lx/Y;->sink(Ljava/lang/String;)V", "[BOUNDARY] kind=recursion target=NONE",
    ]
    assert row["raw"] == "\n".join(raw[1:])


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(code.split_operands(F.lit('{v0, v1}, "a, \\" b", v2,'))) == ["{v0, v1}", '"a, \\" b"', "v2"]
    assert [one(code.parse_smali_int(F.lit(x))) for x in ("0x1ft", "-0x10", "7L", "0b101", "0o17", "010", "v1", " +3s ", "")] == [31, -16, 7, 5, 15, None, None, 3, None]
    assert one(code.registers(F.lit("{v1 .. v3}, v9, v9"))) == ["v1", "v2", "v3", "v9"]
    assert one(code.raw_register(F.lit("add v1, v5, Lv7/x;"), F.lit(3))) == "add v1, p2, Lv7/x;"
    assert [r["register"] for r in one(code.parameter_registers(F.array(*map(F.lit, ("I", "J", "I"))), F.lit(False)))] == ["p1", "p2", "p4"]
    assert [one(code.valid_descriptor(F.lit(x))) for x in ("(I[[JLa/b;)V", "(V)V", "()La.b;", "([)I", "(I)", "()[V")] == [True, False, False, False, False, False]
    assert one(code.valid_identity(F.lit("La/B;"), F.lit("<init>"), F.lit("()V"), F.lit("La/B;-><init>()V"))) and not one(code.valid_identity(F.lit("La/B;"), F.lit("<x>"), F.lit("()V"), F.lit("La/B;-><x>()V")))
    assert one(code.json_string(F.lit('"a\\u00e9\\n"'))) == "aé\n" and one(code.json_string(F.lit("12"))) is None
    assert one(code.clean_text(F.lit("\t a b \n"))) == "a b" and one(code.clean_text(F.lit(None).cast("string"))) == ""
    assert tuple(one(code.host_port(F.lit("::1:443")))) == ("::1", 443) and tuple(one(code.host_port(F.lit("h:x")))) == (None, None)
    assert one(outcomes.extraction_status(F.lit(0), F.lit(True), F.lit(False), F.lit(False), F.lit(2))) == "PARTIAL"
    assert one(outcomes.processing_status(F.lit("SUCCESS"), F.lit(False), F.lit(False), F.lit(3), F.lit("x"), F.lit(1))) == "capped"


def test_padding(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (1, [4])], "b int, input_ids array<int>")
    assert sorted(map(tuple, slice_text.pad_batch(rows, "b").select("input_ids", "attention_mask").collect())) == [([1, 2, 3], [1, 1, 1]), ([4, 0, 0], [1, 0, 0])]
    assert {len(r["input_ids"]) for r in slice_text.pad_batch(rows, "b", 8).collect()} == {8}


def test_constants_follow_moves(spark):
    body = [("const-string", 'v1, "foo"'), ("move-object", "v2, v1"), ("nop", ""), ("invoke-static", "{v2}, LS;->l(I)V"), ("sget", "v2, LA;->f:I"), ("invoke-static", "{v2}, LS;->l(I)V"), ("invoke-static", "{v7}, LS;->l(I)V")]
    instr = spark.createDataFrame([(1, 1, i, op, x) for i, (op, x) in enumerate(body)], "apk int, method int, idx int, opcode string, operands string")
    assert {r["idx"]: r["value"] for r in outcomes.resolve_constants(instr).collect()} == {3: "foo", 5: None, 6: None}
    assert {r["idx"]: r["value"] for r in outcomes.resolve_constants(instr, 2).collect()}[3] is None


def test_smali_text(spark):
    text = """.class public final La/B;
.super Ljava/lang/Object;

.method public static m(IJ)V
    .registers 6
    # a comment
    .annotation Lx;
        value = 1
    .end annotation
    :start
    const/4 v0, 0x1
    if-eqz v0, :end
    :stop
    packed-switch v0, :data
    :end
    return-void
    :data
    .packed-switch 0x0
        :start
    .end packed-switch
    .catch Ljava/io/IOException; {:start .. :stop} :end
.end method

.method abstract n()I
.end method

.method open()V
    nop
"""
    methods, instr, labels, handlers = files.parse_smali(spark.createDataFrame([("f", text)], "k string, text string"), "k", "text")
    found = {r["method_name"]: r for r in methods.collect()}
    assert found["m"]["full_signature"] == "La/B;->m(IJ)V" and found["m"]["flags"] == ["public", "static"] and found["m"]["register_count"] == 6 and found["m"]["terminated"]
    assert found["n"]["flags"] == ["abstract"] and not found["open"]["terminated"]
    assert [(r["idx"], r["opcode"], r["operands"]) for r in instr.where("method_no = 1").orderBy("idx").collect()] == [(0, "const/4", "v0, 0x1"), (1, "if-eqz", "v0, :end"), (2, "packed-switch", "v0, :data"), (3, "return-void", "")]
    assert {r["label"]: r["idx"] for r in labels.collect()} == {":start": 0, ":stop": 2, ":end": 3, ":data": 4}
    assert [tuple(r)[3:] for r in handlers.collect()] == [("Ljava/io/IOException;", ":start", ":stop", ":end")]


def test_files_in_and_out(spark, tmp_path):
    for name, content in (("Benign/a.apk", b"one"), ("Benign/b.apk", b"one"), ("Malicious/c.apk", b"two")):
        (tmp_path / "apks" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "apks" / name).write_bytes(content)
    got = sorted((r["label"], r["apk_size_bytes"], r["copies"], r["source_path"].rpartition("/")[2]) for r in files.inventory(spark, str(tmp_path / "apks")).collect())
    assert got == [("Benign", 3, 1, "a.apk"), ("Malicious", 3, 0, "c.apk")]
    (tmp_path / "apks/Malicious/d.apk").write_bytes(b"one")
    with pytest.raises(Exception, match="conflicting labels"):
        files.inventory(spark, str(tmp_path / "apks")).collect()
    rows = spark.createDataFrame([(2, "b\nc"), (1, 'a "q", x')], "n int, t string")
    assert files.write_csv_checked(rows, str(tmp_path / "csv")) == 2
    files.write_records(rows.select("t", "n"), str(tmp_path / "json"))
    lines = [line for part in (tmp_path / "json").glob("part-*.gz") for line in gzip.open(part, "rt")]
    assert len(lines) == 2 and all([*json.loads(line)] == ["n", "t"] for line in lines)
    assert sorted(map(tuple, files.read_records(spark, str(tmp_path / "json"), "n int, t string").collect())) == [(1, 'a "q", x'), (2, "b\nc")]
    (tmp_path / "bad.json").write_text('{"n": 1}\n\n{"n": oops}\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_records(spark, str(tmp_path / "bad.json"), "n int").collect()
    files.write_shards(rows.withColumnRenamed("t", "apk_hash"), str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2
    library = spark.createDataFrame([("x", ("f", "arm", "p", "s", 9), "0x1")], "source_path string, library struct<filename: string, abi: string, archive_path: string, sha256: string, size_bytes: long>, address string")
    assert files.compact_ir(library).columns == ["library"] and len(files.compact_ir(library).first()["library"]) == 4
    cases = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "job string, v int, updated_at int")
    files.write_case_tables({"jobs": (cases, "job")}, str(tmp_path / "cases"))
    assert sorted((r["job"], r["v"]) for r in spark.read.parquet(str(tmp_path / "cases/jobs")).collect()) == [("a", 2), ("b", 3)]


def test_odd_manifests_and_documents(spark):
    rows = spark.createDataFrame([(1, "<manifest package='p'><application/></manifest>"), (2, "<<"), (3, None)], "k int, xml string")
    got = {r["k"]: r for r in files.parse_manifests(rows, "k", "xml").collect()}
    assert got[1]["package"] == "p" and got[1]["components"] == [] and got[2]["package"] is None and got[3]["permissions"] == []
    docs = spark.createDataFrame([(1, "{}"), (2, "no json"), (3, None)], "k int, d string")
    assert {tuple(r)[1:] for r in map(lambda r: (r["k"], r["root"], tuple(r["files"]), tuple(r["sockets"])), files.parse_telemetry(docs, "k", "d").collect())} == {(False, (), ())}


def test_ranks_are_those_of_one_window(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("o"), "id")
    got = {r["id"]: r["rank"] for r in dataset.ranked(rows, "g", "o", cut=cut).collect()}
    data = sorted(map(tuple, rows.collect()))
    want = {i: n for g in (0, 1) for n, (_, _, i) in enumerate([x for x in data if x[0] == g], 1)}
    assert got == want


def test_attributions_and_tokenizers(spark):
    rows = spark.createDataFrame([(i, "Malicious" if i % 2 else "Benign", "exec send sms" if i % 2 else "draw view text") for i in range(20)] + [(99, "Benign", None)], "example_id long, label string, text string")
    model = learn.fit(rows)
    p = {r["example_id"]: r["probability"] for r in learn.score(model, rows).collect()}
    assert p[1] > 0.7 > 0.3 > p[2] and len(p) == 21
    top = {r["example_id"]: r["token"] for r in learn.attribute(model, rows, 1).collect()}
    assert top[1] in ("exec", "send", "sms", "draw", "view", "text") and 99 not in top
    made = learn.tokenize(rows, lambda: lambda t: [len(w) for w in t.split()]).where("example_id IN (1, 99)").orderBy("example_id").collect()
    assert [(r["input_ids"], r["token_count"]) for r in made] == [([4, 4, 3], 3), ([], 0)]
    with pytest.raises(ValueError, match="both labels"):
        learn.fit(rows.where("label = 'Benign'"))


def _streamed(spark, df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_job_states_and_late_results_as_streams(spark, tmp_path):
    spark.createDataFrame([(1, "QUEUED", "2024-01-01T00:00:00Z"), (1, "COMPLETED", "2024-01-01T00:02:00Z"), (1, "PROCESSING", "2024-01-01T00:01:00Z"), (2, "FAILED", "2024-01-01T00:00:00Z")], "job long, state string, ts string").coalesce(1).write.json(str(tmp_path / "jobs"))
    states = feeds.job_state_stream(spark.readStream.schema("job long, state string, ts timestamp").json(str(tmp_path / "jobs")))
    assert {r["job"]: r["state"] for r in _streamed(spark, states, "states", "update", tmp_path)} == {1: "COMPLETED", 2: "FAILED"}
    spark.createDataFrame([(1, 0.5, "2024-01-01T00:00:00Z"), (2, 0.1, "2024-01-01T00:00:00Z"), (9, 0.1, "2024-01-02T00:00:00Z")], "apk long, probability double, ts string").write.json(str(tmp_path / "static"))
    spark.createDataFrame([(1, 25, "2024-01-01T00:30:00Z"), (2, 40, "2024-01-01T05:00:00Z"), (8, 1, "2024-01-02T00:00:00Z")], "apk long, dynamic_score int, ts string").write.json(str(tmp_path / "dynamic"))
    read = lambda name, schema: spark.readStream.schema(schema).json(str(tmp_path / name))
    late = feeds.late_fusion(read("static", "apk long, probability double, ts timestamp"), read("dynamic", "apk long, dynamic_score int, ts timestamp"))
    got = {r["apk"]: r["dynamic_score"] for r in _streamed(spark, late, "late", "append", tmp_path)}
    assert got[1] == 25 and got.get(2) is None


def test_ingest_admits_each_content_once(spark, tmp_path):
    up = lambda n, rows: spark.createDataFrame(rows, "apk_hash string, job string").coalesce(1).write.json(str(tmp_path / f"up/{n}"))
    stream = lambda: feeds.ingest(spark.readStream.schema("apk_hash string, job string").option("recursiveFileLookup", "true").json(str(tmp_path / "up")), str(tmp_path / "known"), str(tmp_path / "check"))
    up(1, [("h1", "b"), ("h1", "a"), ("h2", "c")])
    stream().trigger(availableNow=True).start().awaitTermination()
    up(2, [("h2", "d"), ("h3", "e")])
    stream().trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["apk_hash"], r["job"]) for r in spark.read.parquet(str(tmp_path / "known")).collect()) == [("h1", "a"), ("h2", "c"), ("h3", "e")]


def test_envelopes(spark):
    raw = spark.createDataFrame([(1, 'data: {"type":"log","message":"a"}\n\n: ping\n\ndata: {"type":"result","telemetry":{"x":1}}\n\ndata: {oops\n\n')], "k int, raw string")
    assert [(r["type"], r["message"]) for r in feeds.decode_envelopes(raw, ["k"], "raw").collect()] == [("log", "a"), ("result", None)]


def test_no_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tracequarry.sources.shared import shared_dir

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(bare)
    bare.sparkContext.getCheckpointDir = lambda: "/somewhere"
    assert shared_dir(bare) == "/somewhere"


def test_lines_under_names_in_one_pass(spark):
    import random
    import re

    quoted, token = r'"(?:\\.|[^"\\])*"?|[^"]+', r"[A-Za-z0-9_$]+:?|:[A-Za-z0-9_$.-]+|[^A-Za-z0-9_$:]|:"
    rnd = random.Random(7)
    signs = ["v1", "v12", "v3", "x", ":a", ":b.c-d", ":", ",", " ", " ", "  ", "\t", '"', "\\", "$", ".", "-", "{", "}", ";->", "p0", "v2:", "(", ")"]
    lines = ["".join(rnd.choices(signs, k=rnd.randint(0, 14))) for _ in range(3000)]
    of = lambda t: [x for p in re.findall(quoted, t) if p[0] != '"' for x in re.findall(token, p) if re.fullmatch(r"v[0-9]+|:[A-Za-z0-9_$.-]+", x)]

    def line(t: str, names: dict) -> str:
        plain = lambda p: re.sub(r",\s*", ", ", re.sub(r"\s+", " ", "".join(names.get(x, x) for x in re.findall(token, p))))
        return "".join(p if p[0] == '"' else plain(p) for p in re.findall(quoted, t.strip(" "))).strip(" ")

    instr = spark.createDataFrame([(1, i // 5, i % 5, t) for i, t in enumerate(lines)], "apk int, method int, idx int, raw_text string")
    names = {}
    for m in range(600):
        kinds = {True: {}, False: {}}
        for x in [x for t in lines[5 * m : 5 * m + 5] for x in of(t)]:
            mine = kinds[x[0] == ":"]
            mine.setdefault(x, f":label_{len(mine)}" if x[0] == ":" else f"v{len(mine)}")
        names[m] = kinds[True] | kinds[False]
    made = slice_text.normalized(instr)
    got = {(r["method"], r["idx"]): r["line"] for r in made.collect()}
    assert got == {(i // 5, i % 5): line(t, names[i // 5]) for i, t in enumerate(lines)}
    # first places are found by hashing, not by sorting
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
