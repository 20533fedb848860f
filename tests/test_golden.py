"""Small rows with known results."""

from pyspark.sql import functions as F

from tracequarry.functions import scalars
from tracequarry.operators import bytecode, dataset, evidence, native, rules as checks, telemetry, triage
from tracequarry.plans import rules
from tracequarry.sources.shared import cut
from tracequarry.streaming import feeds


def test_score_of_known_counts(spark):
    row = spark.range(1).select(triage.triage_score(*[F.lit(n) for n in (2, 2, 3, 3, 3)]).alias("all"), triage.triage_score(F.lit(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("some")).first()
    assert (row["all"], row["some"]) == (81.0, 41.5)


def test_code_counts_in_triage(spark):
    perms = spark.createDataFrame([(1, "android.permission.CAMERA"), (2, "android.permission.CAMERA"), (3, "android.permission.CAMERA")], "apk long, permission string")
    parts = spark.createDataFrame([], "apk long, no int, kind string, raw_name string, raw_exported string, has_filter boolean, action string, target_sdk int")
    calls = ["Ljava/lang/Class;->forName(I)V", "Ljava/lang/Class;->forName(J)V", "Ldalvik/system/DexClassLoader;->loadClass(I)V", "Ldalvik/system/DexClassLoader;-><init>(I)V", "Ljava/lang/System;->load(I)V"]
    code = spark.createDataFrame([(1, 1, i, "invoke-static", c) for i, c in enumerate(calls)], "apk long, method long, idx int, opcode string, call string")
    names = spark.createDataFrame([(1, False), (2, True), (4, False)], "apk long, obfuscated boolean")
    got = triage.full_triage(perms, parts, rules.combinations(spark), bytecode.code_markers(code, rules.indicators(spark)), names, spark.createDataFrame([(3,)], "apk long"))
    # one reflection marker 6, two loading markers 16, both present 10
    assert {r["apk"]: (r["reflection"], r["loading"], r["obfuscation"], r["score"], r["needs_dynamic"]) for r in got.collect()} == {1: (1, 2, 2, 32.0, True), 2: (0, 0, 1, 5.0, True), 3: (0, 0, 0, 0.0, True), 4: (0, 0, 0, 0.0, False)}


def test_combinations_need_all_their_permissions(spark):
    perms = spark.createDataFrame([(1, f"android.permission.{p}") for p in ("INTERNET", "READ_SMS", "RECEIVE_SMS")] + [(2, "android.permission.READ_SMS")], "apk long, permission string")
    assert sorted(r["combination"] for r in triage.permission_combos(perms, rules.combinations(spark)).collect()) == ["SMS_EXFILTRATION", "SMS_INTERCEPTION"]


def test_length_distribution(spark):
    row = spark.createDataFrame([(n,) for n in (512, 513, 1024, 1025)], "n long").agg(*dataset.token_length_distribution("n", (512, 1024))).first()
    assert (row["over_512"], row["over_1024"], row["mean"]) == (75.0, 25.0, 768.5)
    assert spark.createDataFrame([], "n long").agg(*dataset.token_length_distribution("n")).first()["mean"] is None


def test_round_robin_over_categories(spark):
    sinks = spark.createDataFrame([(1, 1, i, "r", c) for i, c in enumerate(("zeta", "alpha", "alpha", "zeta"))], "apk long, method long, idx int, rule_id string, category string")
    assert [r["category"] for r in dataset.select_by_category(sinks, 3).orderBy("place").collect()] == ["alpha", "zeta", "alpha"]


def test_slice_keeps_what_the_sink_reads(spark):
    rows = [(1, 1, 0, "const/4", "v1", "v9", 0, None), (1, 1, 1, "const/4", "v7", "v9", 0, None), (1, 1, 2, "invoke-static", "v0", "v1", 0, "Ljava/lang/Runtime;->exec(I)V")]
    code = spark.createDataFrame(rows, "apk long, method long, idx int, opcode string, reg string, reg2 string, target int, call string")
    got = bytecode.backward_slices(code, bytecode.find_sinks(code, rules.sinks(spark)), cut)
    assert sorted(r["idx"] for r in got.collect()) == [0, 2]


def test_facts_cross_long_methods(spark):
    code = [(1, 1, 0, "const/4", "v1", "v9", 0, None), (1, 1, 1, "if-eqz", "v2", "v9", 3, None)] + [(1, 1, i, "const/4", "v7", "v9", 0, None) for i in range(2, 600)]
    code += [(1, 1, 600, "invoke-static", "v0", "v1", 0, "Ljava/lang/Runtime;->exec(I)V"), (1, 1, 601, "goto", "v0", "v0", 590, None)]
    instr = spark.createDataFrame(code, "apk long, method long, idx int, opcode string, reg string, reg2 string, target int, call string")
    assert sorted(r["idx"] for r in bytecode.backward_slices(instr, bytecode.find_sinks(instr, rules.sinks(spark)), cut).collect()) == [0, 600]
    got = [tuple(r) for r in bytecode.reachable(bytecode.cfg_edges(instr), cut).collect()]
    assert sorted(got) == [(1, 1, 1, n) for n in range(2, 602)]


def test_pending_skips_finished_and_retries_the_rest(spark):
    work = spark.createDataFrame([(k,) for k in "abcdefg"], "apk_hash string")
    rows = [("a", "completed", "p", "t"), ("b", "failed", "p", "t"), ("c", "capped", "old", "t"), ("d", "zero_sink", "p", "old"), ("e", "capped", None, "t"), *[("f", "failed", "p", "t")] * 9, ("f", "capped", "p", "t")]
    records = spark.createDataFrame(rows, "apk_hash string, status string, policy string, tokenizer string")
    assert sorted(r["apk_hash"] for r in dataset.pending(work, records, "apk_hash", {"policy": "p", "tokenizer": "t"}).collect()) == [*"bcdeg"]


def test_labels_and_overrides(spark):
    cases = [(70, True, False, "CONFIRMED_MALWARE"), (30, True, False, "PACKED_DROPPER"), (70, False, False, "DORMANT_MALWARE"), (50, False, True, "SANDBOX_EVASION_DETECTED"), (50, False, False, "LIKELY_BENIGN")]
    df = spark.createDataFrame(cases, "base int, high boolean, evasion boolean, label string")
    got = df.withColumn("got", telemetry.contradiction_label(F.col("base"), F.col("high"), F.col("evasion"))).withColumn("s", telemetry.apply_override(F.lit(50), F.col("base"), F.col("got")))
    assert all(r["got"] == r["label"] for r in got.collect())
    assert [r["s"] for r in got.orderBy("label").collect()] == [50, 70, 30, 85, 75]


def test_exported_names(spark):
    rows = [(1, "La/B_c;", "run", "[ILjava/lang/String;"), (2, "La/B;", "é", "")]
    got = {r["decl"]: (r["short_name"], r["long_name"]) for r in native.jni_names(spark.createDataFrame(rows, "decl long, class_name string, method_name string, params string")).collect()}
    assert got == {1: ("Java_a_B_1c_run", "Java_a_B_1c_run___3ILjava_lang_String_2"), 2: ("Java_a_B__000e9", "Java_a_B__000e9__")}


def test_name_matches(spark):
    named = spark.createDataFrame([(1, "a", "a__I"), (2, "b", "b__I"), (3, "c", "c__I"), (4, "c", "c__J"), (5, "d", "d__")], "decl long, short_name string, long_name string")
    got = native.jni_mappings(named, spark.createDataFrame([("a__I",), ("a",), ("b",), ("c",)], "symbol string"))
    assert {r["decl"]: r["kind"] for r in got.collect()} == {1: "exact_long", 2: "exact_short", 3: "ambiguous", 4: "ambiguous", 5: "unresolved"}


def test_findings_of_a_clean_session(spark):
    kind = "session long, root boolean, ssl boolean, files array<string>, sockets array<struct<ip string, port int>>, libraries array<string>"
    tele = spark.createDataFrame([(1, False, False, [], [], []), (2, True, False, ["/x/config"], [("h", 4444)], [])], kind)
    assert sorted((r["session"], r["id"]) for r in evidence.findings(tele).collect()) == [(1, "KAV-INFO-01"), (2, "KAV-CRIT-01"), (2, "KAV-CRIT-03"), (2, "KAV-HIGH-01")]


def test_unknown_label_raises(spark):
    splits = spark.createDataFrame([("h", "odd", "train")], "apk_hash string, label string, split string")
    tokens = spark.createDataFrame([(1, "h", 3)], "example_id long, apk_hash string, token_count long")
    try:
        checks.training_examples(splits, tokens, "train").collect()
    except Exception as e:
        assert "no id for label odd" in str(e)
    else:
        raise AssertionError("nothing was raised")


def test_parameter_words(spark):
    row = spark.range(1).select(scalars.param_types(F.lit("(I[JLa/B;D)V")).alias("t")).select("t", scalars.register_words(F.col("t")).alias("n")).first()
    assert (row["t"], row["n"]) == (["I", "[J", "La/B;", "D"], 5)


def test_streams_give_each_item_once_and_count_windows(spark, tmp_path):
    day = "2024-01-01T0"
    lines = [(1, 1, f"{day}0:00:00Z", "[Sandbox] File read: /a"), (2, 1, f"{day}0:01:00Z", "[Sandbox] File read: /a"), (3, 1, f"{day}0:02:00Z", "Root check blocked"), (4, 2, f"{day}5:00:00Z", "[Sandbox] Network connection: h:4444")]
    spark.createDataFrame(lines, "event_id long, session long, ts string, line string").write.json(str(tmp_path / "in"))
    for name, make, mode in (("seen", feeds.first_seen, "append"), ("hours", feeds.counts, "complete"), ("sessions", feeds.sessions, "append")):
        out = make(feeds.read_lines(spark, str(tmp_path / "in")))
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["session"], r["item"]) for r in spark.table("seen").collect()) == [(1, "/a"), (2, "h:4444")]
    assert sorted((r["kind"], r["n"]) for r in spark.table("hours").collect()) == [("bypass", 1), ("file", 2), ("socket", 1)]
    assert [(r["session"], r["root"], r["files"]) for r in spark.table("sessions").collect()] == [(1, True, ["/a"])]
