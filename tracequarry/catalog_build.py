"""Queries of sources, outcomes, data checks, native evidence and rankings, with their SQL; `catalog` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry import catalog as c
from tracequarry.functions import code, scalars
from tracequarry.operators import dataset, evidence, learn, outcomes, rules as checks, scan, telemetry, triage
from tracequarry.plans import rules
from tracequarry.plans.views import oracle, view
from tracequarry.sources.shared import cut
from tracequarry.sources import files
from tracequarry.streaming import feeds

_query = c._query


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- statuses ----
@_query("sco3_warnings", oracle(f"""SELECT apk, array_to_string(list_sort(list_filter([CASE WHEN sdk IS NULL THEN 'TARGET_SDK_UNAVAILABLE' END, CASE WHEN NOT entry THEN 'NO_DISCOVERABLE_ENTRY_POINT' END, CASE WHEN NOT code THEN 'NO_DEX_FILES' END], lambda x: x IS NOT NULL)), ',') AS warnings
  FROM (SELECT apk, max(target_sdk) AS sdk, bool_or(action IN ({c._ACTIONS})) AS entry, apk IN (SELECT apk FROM v_instr) AS code FROM v_component GROUP BY 1)""", "v_component", "v_instr"))
def _(spark, sf):
    by = view(spark, sf, "v_component").groupBy("apk").agg(F.max("target_sdk").alias("sdk"), F.bool_or(F.col("action").isin(*rules.ENTRY_ACTIONS)).alias("entry"))
    coded = view(spark, sf, "v_instr").select("apk").distinct().withColumn("code", F.lit(True))
    found = outcomes.triage_warnings(F.col("sdk").isNull(), ~F.col("entry"), F.col("code").isNull())
    return by.join(coded, "apk", "left").select("apk", F.array_join(found, ",").alias("warnings"))


_BACKEND = "backed AS (SELECT apk, count(*) FILTER (u) AS usable, CASE WHEN count(*) FILTER (u) = 0 THEN NULL WHEN count(*) FILTER (u AND backend = 'smali') = count(*) FILTER (u) THEN 'smali' WHEN count(*) FILTER (u AND backend = 'raw') = count(*) FILTER (u) THEN 'raw' ELSE 'mixed' END AS extracted_by FROM (SELECT *, NOT regexp_matches(lower(flags), 'native|abstract') AS u FROM v_method) GROUP BY 1)"
_EXTRACTED = f"{_BACKEND}, extracted AS (SELECT *, CASE WHEN usable > 0 AND (apk % 3 = 0 OR apk % 5 = 0 OR apk % 7 = 0) THEN 'PARTIAL' WHEN usable > 0 THEN 'SUCCESS' WHEN apk % 2 > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM backed)"


def _extracted(spark, sf):
    k = F.col("apk")
    return outcomes.extraction_backend(view(spark, sf, "v_method")).withColumn("status", outcomes.extraction_status(F.col("usable"), k % 3 != 0, k % 5 == 0, k % 7 == 0, k % 2))


@_query("sco4_extraction_status", oracle("SELECT apk, usable, extracted_by, status FROM extracted", "v_method", also=_EXTRACTED))
def _(spark, sf):
    return _extracted(spark, sf)


@_query("sco5_processing_status", oracle("""SELECT apk, CASE WHEN status = 'PARTIAL' THEN 'extraction_partial' WHEN status = 'FAILED' THEN 'failed' WHEN apk % 11 = 0 THEN 'timed_out' WHEN coalesce(n, 0) = 0 THEN 'zero_sink' WHEN n > 3 THEN 'capped' WHEN apk % 4 > 1 THEN 'completed_with_truncation' ELSE 'completed' END AS outcome
  FROM extracted LEFT JOIN (SELECT apk, count(*) AS n FROM sinks GROUP BY 1) USING (apk)""", "v_method", "v_instr", also=f"{_EXTRACTED}, {c._FOUND}"))
def _(spark, sf):
    sinks = c._sinks(spark, sf).groupBy("apk").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    outcome = outcomes.processing_status(F.col("status"), F.col("apk") % 11 == 0, F.lit(False), n, F.when(n > 3, "max_slices_per_apk"), F.greatest(F.col("apk") % 4 - 1, F.lit(0)))
    return _extracted(spark, sf).join(sinks, "apk", "left").select("apk", outcome.alias("outcome"))


@_query("agg12_sink_summary", oracle("""SELECT apk, total_sink_count, sink_method_count, coalesce(kept, 0) AS selected_sink_count, total_sink_count - coalesce(kept, 0) AS omitted_sink_count, cats AS retained_sink_categories, CASE WHEN total_sink_count > 3 THEN 'max_slices_per_apk' END AS cap_reason FROM
  (SELECT apk, count(*) AS total_sink_count, count(DISTINCT method) AS sink_method_count FROM sinks GROUP BY 1) LEFT JOIN (SELECT apk, CAST(sum(n) AS BIGINT) AS kept, string_agg(category || '=' || CAST(n AS VARCHAR), ',' ORDER BY category) AS cats FROM
  (SELECT apk, category, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY apk ORDER BY turn, category) AS place FROM (SELECT *, row_number() OVER (PARTITION BY apk, category ORDER BY method, idx, rule_id) AS turn FROM sinks)) WHERE place <= 3 GROUP BY 1, 2) GROUP BY 1) USING (apk)""", "v_instr", also=c._FOUND))
def _(spark, sf):
    sinks = c._sinks(spark, sf)
    made = outcomes.sink_summary(sinks, dataset.select_by_category(sinks, 3), 3)
    shown = F.array_join(F.transform(F.map_entries("retained_sink_categories"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return made.withColumn("retained_sink_categories", shown)


_OUTCOMES = "done AS (SELECT apk_hash, arg_min(status, example_id) AS status, count(*) FILTER (status <> 'failed') AS slices, count(*) FILTER (is_truncated AND status <> 'failed') AS truncated FROM v_token GROUP BY 1)"


def _outcomes(spark, sf):
    live = F.col("status") != "failed"
    return view(spark, sf, "v_token").groupBy("apk_hash").agg(F.min_by("status", "example_id").alias("status"), F.count_if(live).alias("slices"), F.count_if(F.col("is_truncated") & live).alias("truncated"))


@_query("agg17_run_summary", oracle("SELECT count(*) AS packages, count(*) FILTER (status IN ('failed', 'timed_out', 'extraction_partial')) AS failed, count(*) FILTER (slices = 0) AS zero_slice, CAST(sum(truncated) AS BIGINT) AS truncated, CAST(sum(slices) - sum(truncated) AS BIGINT) AS whole FROM done", "v_token", also=_OUTCOMES))
def _(spark, sf):
    return outcomes.run_summary(_outcomes(spark, sf))


@_query("src12_shard_index", oracle("SELECT apk_hash FROM done WHERE status IN ('completed', 'completed_with_truncation', 'capped', 'zero_sink') AND slices % 3 <> 0", "v_token", also=_OUTCOMES))
def _(spark, sf):
    done = _outcomes(spark, sf)
    return outcomes.shard_index(done, done.where("slices % 3 <> 0"))


@_query("jn12_missing_shards", oracle("SELECT apk_hash, CASE WHEN slices % 5 = 0 THEN 'no_outcome' WHEN status = 'failed' THEN 'tolerated' ELSE 'missing' END AS state FROM done WHERE slices % 3 = 0", "v_token", also=_OUTCOMES))
def _(spark, sf):
    done = _outcomes(spark, sf)
    return outcomes.missing_shards(done, done.where("slices % 3 <> 0"), done.where("slices % 5 <> 0"))


@_query("src14_dataset_manifest", oracle("""SELECT (SELECT string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM done WHERE status <> 'capped' GROUP BY 1)) AS counts, (SELECT count(*) FROM done WHERE status <> 'capped') AS processed,
  count(*) AS unique_apks, 'tokens-v1' AS token_schema_version, count(*) - (SELECT count(*) FROM done WHERE status <> 'capped') AS unprocessed FROM done""", "v_token", also=_OUTCOMES))
def _(spark, sf):
    done = _outcomes(spark, sf)
    made = files.dataset_manifest(done.where("status <> 'capped'"), done.select("apk_hash", F.lit("train").alias("split")), {"token_schema_version": "tokens-v1"})
    return made.drop("split_digest").withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@_query("agg4_slice_counts_by_class", oracle("SELECT label, count(n) AS n, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most FROM (SELECT label, apk_hash, count(*) AS n FROM v_token GROUP BY 1, 2) GROUP BY 1", "v_token"))
def _(spark, sf):
    sizes = view(spark, sf, "v_token").groupBy("label", "apk_hash").agg(F.count("*").alias("slices"))
    return sizes.groupBy("label").agg(*dataset.numeric_distribution("slices"))


# ---- data checks ----
@_query("dq1_incompatible", oracle("SELECT example_id FROM (SELECT example_id, CASE WHEN example_id % 7 = 0 THEN NULL ELSE 'slice-v1' END AS schema_version, 'p' || CAST(example_id % 3 AS VARCHAR) AS policy FROM v_token) WHERE schema_version IS DISTINCT FROM 'slice-v1' OR policy <> 'p1'", "v_token"))
def _(spark, sf):
    k = F.col("example_id")
    rows = view(spark, sf, "v_token").select("example_id", F.when(k % 7 != 0, "slice-v1").alias("schema_version"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("policy"))
    return outcomes.incompatible(rows, {"schema_version": "slice-v1", "policy": "p1"}).select("example_id")


@_query("dq3_token_lengths", oracle("SELECT example_id, token_count FROM v_token JOIN documents ON doc_id = example_id WHERE token_count <> len(string_split(text, ' ')) - CASE WHEN example_id % 9 = 0 THEN 1 ELSE 0 END", "v_token"))
def _(spark, sf):
    ids = _read(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.transform(F.split("text", " "), lambda w: F.length(w)).alias("input_ids"))
    rows = view(spark, sf, "v_token").select("example_id", "token_count").join(ids, "example_id").where("input_ids IS NOT NULL")
    short = rows.withColumn("input_ids", F.when(F.col("example_id") % 9 == 0, F.slice("input_ids", F.lit(1), F.size("input_ids") - 1)).otherwise(F.col("input_ids")))
    return outcomes.token_violations(short).select("example_id", "token_count")


@_query("set4_mapping_changes", oracle("SELECT apk_hash, 'new' AS split, 'fresh' AS side FROM uniq WHERE apk_size_bytes % 5 = 0 UNION ALL SELECT apk_hash, label, 'stored' FROM uniq WHERE apk_size_bytes % 5 = 0", "v_apk", also=c._UNIQUE))
def _(spark, sf):
    stored = c._unique(spark, sf).select("apk_hash", F.col("label").alias("split"), "apk_size_bytes")
    fresh = stored.withColumn("split", F.when(F.col("apk_size_bytes") % 5 == 0, "new").otherwise(F.col("split")))
    return outcomes.mapping_changes(stored.drop("apk_size_bytes"), fresh.drop("apk_size_bytes"))


@_query("set3_contains_all", oracle("SELECT apk, count(*) = 2 AS has_all FROM (SELECT DISTINCT apk, permission FROM v_perm WHERE permission IN ('android.permission.INTERNET', 'android.permission.CAMERA')) GROUP BY 1", "v_perm"))
def _(spark, sf):
    wanted = ["android.permission.INTERNET", "android.permission.CAMERA"]
    return checks.contains_all(view(spark, sf, "v_perm"), "apk", "permission", wanted)


# ---- native evidence ----
_SIGNED = ", ".join(f"('{k}', '{s}')" for k, several in outcomes.SIGNATURES.items() for s in several)
_BYTES = rf"sig AS (SELECT * FROM (VALUES {_SIGNED}) AS r(category, signature)), words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents) GROUP BY 1, 2), bysig AS (SELECT doc_id, category, signature, n FROM words JOIN sig ON w = signature)"


@_query("agg10_byte_signals", f"WITH {_BYTES} SELECT * FROM bysig")
def _(spark, sf):
    return outcomes.byte_signals(_read(spark, sf, "documents"), "doc_id", "text")


_SYMBOL = "CASE p_partkey % 6 WHEN 0 THEN 'fork' WHEN 1 THEN 'read@LIBC' WHEN 2 THEN 'su' WHEN 3 THEN 'JNI_OnLoad' ELSE 'Java_x' END"


@_query("jn10_merged_signals", f"""WITH {_BYTES}, bysym AS (SELECT p_partkey % 50 AS doc_id, category, signature, count(*) AS n FROM (SELECT p_partkey, string_split({_SYMBOL}, '@')[1] AS s FROM part) JOIN sig ON s = signature GROUP BY 1, 2, 3)
SELECT doc_id, category, signature, coalesce(y.n, b.n) AS n, CASE WHEN y.n IS NOT NULL THEN 'exported_symbol' ELSE 'binary_string' END AS source FROM bysig b FULL JOIN bysym y USING (doc_id, category, signature)""")
def _(spark, sf):
    symbols = _read(spark, sf, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.expr(_SYMBOL).alias("symbol"))
    return outcomes.merged_signals(outcomes.byte_signals(_read(spark, sf, "documents"), "doc_id", "text"), outcomes.symbol_signals(symbols, "doc_id"), "doc_id")


_LOADS = "SELECT s_nationkey AS key, CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE 'lib' || CAST(s_suppkey % 9 AS {s}) END AS requested, s_suppkey % 3 <> 0 AS resolved FROM {t}"
_KINDS = "SELECT s_nationkey AS key, CASE s_suppkey % 5 WHEN 0 THEN 'unresolved' ELSE 'exact_long' END AS kind FROM {t}"


@_query("sco6_jni_issues", f"""WITH loads AS ({_LOADS.format(s='VARCHAR', t='supplier')}), kinds AS ({_KINDS.format(t='supplier')})
SELECT key, CASE WHEN requested IS NULL THEN 'DYNAMIC_LIBRARY_LOAD_NAME' ELSE 'LOADED_LIBRARY_NOT_IN_APK' END AS issue, count(*) AS n FROM loads WHERE requested IS NULL OR NOT resolved GROUP BY 1, 2
UNION ALL SELECT key, 'DYNAMIC_JNI_REGISTRATION_POSSIBLE', count(*) FROM kinds WHERE kind = 'unresolved' AND key % 2 = 0 GROUP BY 1""")
def _(spark, sf):
    supplier = _read(spark, sf, "supplier")
    loads, kinds = spark.sql(_LOADS.format(s="STRING", t="{supplier}"), supplier=supplier), spark.sql(_KINDS.format(t="{supplier}"), supplier=supplier)
    signals = supplier.where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("key"), F.lit("JNI_OnLoad").alias("signature"))
    return outcomes.jni_issues(loads, kinds, signals)


@_query("sco6_jni_status", "SELECT s_nationkey AS key, CASE WHEN min(s_suppkey % 7) > 0 THEN 'SUCCESS' WHEN max(s_suppkey % 7) > 3 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM supplier GROUP BY 1")
def _(spark, sf):
    by = _read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.min(F.col("s_suppkey") % 7).alias("low"), F.max(F.col("s_suppkey") % 7).alias("high"))
    return by.select("key", outcomes.jni_status(F.col("low") > 0, F.col("high") > 3).alias("status"))


_WALK = r"""code AS (SELECT apk, method, idx, opcode, list_transform(list_sort(list_transform(list_distinct(r), lambda x: {'i': list_position(r, x), 'x': x})), lambda s: s.x) AS regs, CASE WHEN opcode = 'const-string' THEN json_extract_string('[' || trim(regexp_extract(operands, ',(.*)$', 1)) || ']', '$[0]') END AS literal
  FROM (SELECT *, CASE WHEN contains(operands, ' .. ') THEN ['v0', 'v1', 'v2'] ELSE regexp_extract_all(operands, '\b[vp][0-9]+\b') END AS r FROM v_code)),
walk AS (SELECT apk, method, idx, idx AS pos, regs[-1] AS reg, regs[-1] AS cur, false AS done, CAST(NULL AS VARCHAR) AS value FROM code WHERE opcode LIKE 'invoke-%'
  UNION ALL SELECT w.apk, w.method, w.idx, c.idx, w.reg, CASE WHEN c.regs[1] = w.cur AND c.opcode = 'move-object' AND len(c.regs) >= 2 THEN c.regs[2] ELSE w.cur END,
    c.regs[1] = w.cur AND (c.opcode LIKE 'const%' OR c.opcode IN ('iget-object', 'add-int/2addr') OR c.opcode = 'move-result-object') AND c.regs[1] IS NOT NULL, CASE WHEN c.regs[1] = w.cur AND c.opcode = 'const-string' THEN c.literal END
  FROM walk w JOIN code c ON c.apk = w.apk AND c.method = w.method AND c.idx = w.pos - 1 WHERE NOT w.done AND w.idx - c.idx <= 64)"""


@_query("jn18_constants", "WITH RECURSIVE" + oracle("SELECT apk, method, idx, reg AS register, arg_min(value, pos) AS value FROM (SELECT apk, method, idx, reg, pos, coalesce(value, CAST(NULL AS VARCHAR)) AS value FROM walk) GROUP BY 1, 2, 3, 4", "v_code", also=_WALK).removeprefix("WITH"))
def _(spark, sf):
    return outcomes.resolve_constants(view(spark, sf, "v_code"))


@_query("agg18_entropy", "WITH ch AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS x FROM documents) WHERE x <> '' GROUP BY 1, 2) SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM ch GROUP BY 1")
def _(spark, sf):
    return outcomes.text_entropy(_read(spark, sf, "documents"), "doc_id", "text")


@_query("sco26_native_opacity", f"WITH kinds AS ({_KINDS.format(t='supplier')}), ch AS (SELECT s_nationkey AS key, x, count(*) AS n FROM (SELECT s_nationkey, unnest(string_split(s_name, '')) AS x FROM supplier) WHERE x <> '' GROUP BY 1, 2), e AS (SELECT key, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM ch GROUP BY 1) SELECT key, round(0.5::DOUBLE * count(*) FILTER (kind = 'unresolved') / count(*) + 0.5::DOUBLE * any_value(entropy) / 8, 6) AS opacity FROM kinds JOIN e USING (key) GROUP BY 1")
def _(spark, sf):
    supplier = _read(spark, sf, "supplier")
    return outcomes.native_opacity(spark.sql(_KINDS.format(t="{supplier}"), supplier=supplier), outcomes.text_entropy(supplier.withColumnRenamed("s_nationkey", "key"), "key", "s_name"))


# ---- reports ----
@_query("sco11_static_proxy", oracle("SELECT session, CASE WHEN len(files) + len(sockets) > 0 OR root OR ssl THEN 0.82::DOUBLE ELSE 0.05::DOUBLE END AS probability, CASE WHEN len(files) + len(sockets) > 0 OR root OR ssl THEN 85.0::DOUBLE ELSE 10.0::DOUBLE END AS triage_score, root AS obfuscated FROM tele", "v_log", also=c._TELEMETRY))
def _(spark, sf):
    return outcomes.static_proxy(c._telemetry(spark, sf))


@_query("sco24_compliance", oracle("SELECT session, 'Sec 12.2' AS section, 'FAIL' AS result FROM tele WHERE root UNION ALL SELECT session, 'Sec 14.5', 'FAIL' FROM tele WHERE ssl UNION ALL SELECT session, 'Sec 8.1', 'PASS' FROM tele WHERE len(list_filter(files, lambda f: f LIKE '%.db')) > 0", "v_log", also=c._TELEMETRY))
def _(spark, sf):
    return outcomes.compliance(c._telemetry(spark, sf))


@_query("sco18_dns", "SELECT user_id AS session, 'd' || CAST(event_id % 9 AS VARCHAR) || '.example' AS domain, CASE WHEN event_id % 3 = 0 THEN '10.0.0.1' ELSE '—' END AS resolved_ip, CASE WHEN event_type = 'click' THEN 'RESOLVED' WHEN event_type = 'view' THEN 'NXDOMAIN' ELSE upper(event_type) END AS status FROM events")
def _(spark, sf):
    kind = F.col("event_type")
    answers = _read(spark, sf, "events").select(F.col("user_id").alias("session"), F.concat(F.lit("d"), (F.col("event_id") % 9).cast("string"), F.lit(".example")).alias("domain"), F.when(F.col("event_id") % 3 == 0, "10.0.0.1").when(F.col("event_id") % 3 == 1, "").alias("resolved_ip"), F.when(kind == "click", "resolved").when(kind == "view", "nxdomain").otherwise(kind).alias("status"))
    return outcomes.classify_dns(answers)


@_query("jn16_case_report", oracle("SELECT 'job' || CAST(session AS VARCHAR) AS job, CAST(session AS VARCHAR) AS apk_hash, CASE WHEN root THEN 'COMPLETED' ELSE 'PROCESSING' END AS status, CASE WHEN ssl THEN 'SANDBOX_EVASION_DETECTED' END AS compliance_status FROM tele", "v_log", also=c._TELEMETRY))
def _(spark, sf):
    tele = c._telemetry(spark, sf).withColumns({"job": F.concat(F.lit("job"), F.col("session").cast("string")), "apk_hash": F.col("session").cast("string")})
    packages = tele.select("job", "apk_hash", F.when(F.col("root"), "COMPLETED").otherwise("PROCESSING").alias("status"))
    return outcomes.case_report(tele.select("job"), packages, tele.where("ssl").select("apk_hash", F.lit("SANDBOX_EVASION_DETECTED").alias("compliance_status")))


_WEIGHED = "attr AS (SELECT doc_id AS slice_id, w AS token, ((length(w) * 7 + p) % 200 - 100) / 100.0::DOUBLE AS weight FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents WHERE text IS NOT NULL) WHERE w <> '')"


def _attributions(spark, sf):
    """Texts are dealt out by slice before they are cut into words, so that the words of a slice meet without a shuffle of theirs."""
    docs = _read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // 2_500))
    words = docs.repartition(parts, "doc_id").select(F.col("doc_id").alias("slice_id"), F.posexplode(F.split("text", " ")).alias("p", "token")).where("token <> ''")
    return words.select("slice_id", "token", (((F.length("token") * 7 + F.col("p")) % 200 - 100) / F.lit(100.0)).alias("weight"))


@_query("jn17_slice_attributions", f"WITH {_WEIGHED} SELECT slice_id, slice_id % 10 AS apk, token, arg_max(weight, (abs(weight), weight)) AS weight FROM attr GROUP BY 1, 2, 3")
def _(spark, sf):
    slices = _read(spark, sf, "documents").select(F.col("doc_id").alias("slice_id"), (F.col("doc_id") % 10).alias("apk"))
    return outcomes.slice_attributions(slices, _attributions(spark, sf))


@_query("srt2_top_attributions", f"WITH {_WEIGHED}, best AS (SELECT slice_id, token, arg_max(weight, (abs(weight), weight)) AS weight FROM attr GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY abs(weight) DESC, token) AS rank FROM best) WHERE rank <= 3")
def _(spark, sf):
    best = outcomes.strongest(_attributions(spark, sf), "slice_id", "token")
    return outcomes.top_attributions(best, "slice_id", 3)


@_query("srt3_canonical_methods", oracle("SELECT apk, full_signature, backend FROM v_method ORDER BY regexp_extract(full_signature, '^([^-]*)->', 1), full_signature, CASE backend WHEN 'smali' THEN 0 ELSE 1 END, apk", "v_method"))
def _(spark, sf):
    return outcomes.canonical_order(view(spark, sf, "v_method").select("apk", "full_signature", "backend"), "methods")


@_query("dq6_issues", oracle("SELECT DISTINCT apk, method, idx, 'MALFORMED' AS issue, opcode AS detail, 'warning' AS severity FROM v_instr WHERE idx % 4 = 0", "v_instr"))
def _(spark, sf):
    return outcomes.issue_table(view(spark, sf, "v_instr").where("idx % 4 = 0").select("apk", "method", "idx", F.lit("MALFORMED").alias("issue"), F.col("opcode").alias("detail")))


@_query("win13_time_stratified_split", """WITH aged AS (SELECT o_orderkey, o_orderpriority || '/' || CASE WHEN year(o_orderdate) > 1995 THEN 'new' ELSE 'old' END AS stratum, year(o_orderdate) > 1995 AS fresh FROM orders),
q AS (SELECT *, n - f0 - f1 AS spare, round(n * a - f0, 9) AS r0, round(n * (1 - a) - f1, 9) AS r1 FROM (SELECT stratum, n, a, floor(n * a)::BIGINT AS f0, floor(n * (1 - a))::BIGINT AS f1 FROM (SELECT stratum, count(*) AS n, CASE WHEN any_value(fresh) THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS a FROM aged GROUP BY 1)))
SELECT o_orderkey, stratum, CASE WHEN rn <= f0 + CASE WHEN (CASE WHEN r1 > r0 THEN 1 ELSE 0 END) < spare THEN 1 ELSE 0 END THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || stratum || ':' || CAST(o_orderkey AS VARCHAR))) AS rn FROM aged) JOIN q USING (stratum)""")
def _(spark, sf):
    return outcomes.time_stratified_split(_read(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "o_orderdate", 1995, (("train", 0.75), ("test", 0.25)), (("train", 0.5), ("test", 0.5)), cut=cut)


# ---- sources ----
_XML = "'<manifest package=\"p' || CAST({k} AS {s}) || '\"><uses-sdk android:targetSdkVersion=\"' || CAST({k} % 30 AS {s}) || '\"/><uses-permission android:name=\"a.INTERNET\"/><uses-permission android:name=\"a.P' || CAST({k} % 4 AS {s}) || '\"/><application><activity android:name=\".Main\" android:exported=\"true\"><intent-filter><action android:name=\"m.MAIN\"/></intent-filter></activity><service android:name=\"S' || CAST({k} % 3 AS {s}) || '\"/></application></manifest>'"


@_query("src2_manifests", "SELECT o_orderkey, 'p' || CAST(o_orderkey AS VARCHAR) AS package, CAST(o_orderkey % 30 AS INT) AS target_sdk, 'a.INTERNET,a.P' || CAST(o_orderkey % 4 AS VARCHAR) AS permissions, 'activity .Main true true m.MAIN;service S' || CAST(o_orderkey % 3 AS VARCHAR) || ' null false ' AS components FROM orders")
def _(spark, sf):
    texts = _read(spark, sf, "orders").select("o_orderkey", F.expr(_XML.format(k="o_orderkey", s="STRING")).alias("xml"))
    shown = F.transform("components", lambda x: F.concat_ws(" ", x["kind"], x["name"], F.coalesce(x["exported"], F.lit("null")), x["has_filter"].cast("string"), F.array_join(x["actions"], ",")))
    return files.parse_manifests(texts, "o_orderkey", "xml").select("o_orderkey", "package", "target_sdk", F.array_join("permissions", ",").alias("permissions"), F.array_join(shown, ";").alias("components"))




@_query("src3_smali_instructions", oracle("SELECT apk, method, idx, opcode, operands FROM v_code", "v_code"))
def _(spark, sf):
    """Each order's instructions printed as one smali text, and read again."""
    instr = view(spark, sf, "v_code")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(" ", "opcode", "operands").alias("line")))), lambda x: F.concat(F.lit("    "), x["line"])), "\n")
    text = F.concat(F.lit(".class public Lp/C;\n.super Ljava/lang/Object;\n\n.method public static m(II)I\n    .locals 4\n    .annotation Lx;\n        value = 1\n    .end annotation\n"), lines, F.lit("\n.end method\n"))
    texts = instr.groupBy("apk", "method").agg(text.alias("text")).select(F.concat_ws("/", "apk", "method").alias("key"), "text")
    _, instructions, _, _ = files.parse_smali(texts, "key", "text")
    at = lambda i: F.split("key", "/")[i].cast("long")
    return instructions.select(at(0).alias("apk"), at(1).alias("method"), "idx", "opcode", "operands")


@_query("src4_api_references", oracle(r"""SELECT apk, chunk_no, string_agg(r, chr(10) ORDER BY p) AS slice_text FROM (SELECT apk, r, row_number() OVER (PARTITION BY apk ORDER BY method, idx) - 1 AS p, CAST((row_number() OVER (PARTITION BY apk ORDER BY method, idx) - 1) // 15 AS INT) AS chunk_no FROM
  (SELECT apk, method, idx, nullif(regexp_extract(operands, '(L[a-zA-Z0-9_/$]+;->[a-zA-Z0-9_]+)', 1), '') AS r FROM v_code) WHERE r IS NOT NULL AND length(r) > 10) GROUP BY 1, 2 UNION ALL SELECT DISTINCT apk, 0, 'invoke-virtual {v0}, Landroid/content/Context;->getPackageName; //' || CAST(apk AS VARCHAR) FROM v_code WHERE apk NOT IN
  (SELECT apk FROM v_code WHERE length(regexp_extract(operands, '(L[a-zA-Z0-9_/$]+;->[a-zA-Z0-9_]+)', 1)) > 10)""", "v_code"))
def _(spark, sf):
    texts = view(spark, sf, "v_code").groupBy("apk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "idx", "operands"))), lambda x: x["operands"]), "\n").alias("content"))
    return files.api_references(texts, "apk", F.col("content"))


@_query("src6_training_rows", "SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN text END, CASE WHEN doc_id % 3 = 1 THEN text END) AS text, CAST(coalesce(CASE WHEN doc_id % 2 = 0 THEN 1 END, 0) AS INT) AS label FROM documents WHERE doc_id % 3 < 2 AND length(text) > 0")
def _(spark, sf):
    k = F.col("doc_id")
    rows = _read(spark, sf, "documents").select(F.when(k % 3 == 0, F.col("text")).alias("code"), F.when(k % 3 == 1, F.col("text")).alias("text"), F.when(k % 2 == 0, 1).alias("is_malware"))
    return files.training_rows(rows)


_DOC = "CASE WHEN k % 4 = 0 THEN '{\"objection_root_bypass\":true}' ELSE '{\"objection_ssl_pinning_bypass\":false,\"ebpf_telemetry\":{\"syscalls\":[\"sys_clone\"],\"files_accessed\":[\"/f' || CAST(k % 7 AS {s}) || '\"],\"network_connections\":[{\"ip\":\"10.0.0.1\",\"port\":' || CAST(k % 9 AS {s}) || '}],\"more\":1}}' END"


@_query("src7_telemetry", "SELECT event_id, event_id % 4 = 0 AS root, false AS ssl, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'sys_clone' END AS syscalls, CASE WHEN event_id % 4 = 0 THEN '' ELSE '/f' || CAST(event_id % 7 AS VARCHAR) END AS files, CASE WHEN event_id % 4 = 0 THEN '' ELSE '10.0.0.1:' || CAST(event_id % 9 AS VARCHAR) END AS sockets FROM events")
def _(spark, sf):
    rows = _read(spark, sf, "events").select("event_id", F.col("event_id").alias("k")).withColumn("document", F.expr(_DOC.replace("{s}", "STRING")))
    made = files.parse_telemetry(rows, "event_id", "document")
    return made.select("event_id", "root", "ssl", F.array_join("syscalls", ",").alias("syscalls"), F.array_join("files", ",").alias("files"), F.array_join(F.transform("sockets", lambda s: F.concat_ws(":", s["ip"], s["port"].cast("string"))), ",").alias("sockets"))


_NM = "CASE p_partkey % 5 WHEN 0 THEN 'sym' || CAST(p_partkey AS {s}) || ' T 1f' || CAST(p_size AS {s}) || ' 10' WHEN 1 THEN 'undef U' WHEN 2 THEN 'noaddress t' WHEN 3 THEN 'broken' ELSE 'odd 12 34' END"


@_query("src8_nm_lines", f"SELECT DISTINCT lib AS library, CASE WHEN NOT bad THEN p[1] END AS symbol, CASE WHEN NOT bad THEN p[2] END AS kind, CASE WHEN NOT bad AND regexp_full_match(coalesce(p[3], ''), '[0-9A-Fa-f]+') THEN p[3] END AS address, bad AS malformed FROM (SELECT *, NOT regexp_full_match(coalesce(p[2], ''), '[A-Za-z?]') AS bad FROM (SELECT p_partkey % 10 AS lib, string_split({_NM.format(s='VARCHAR')}, ' ') AS p FROM part)) WHERE bad OR p[2] <> 'U'")
def _(spark, sf):
    return files.parse_nm_lines(_read(spark, sf, "part").select((F.col("p_partkey") % 10).alias("library"), F.expr(_NM.format(s="STRING")).alias("line")))


_ELF = "'  ' || CAST(p_partkey % 40 AS {s}) || ': 000' || CAST(p_size AS {s}) || ' 12 FUNC ' || CASE p_partkey % 3 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'LOCAL' ELSE 'WEAK' END || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'HIDDEN' ELSE 'DEFAULT' END || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' UND f@LIBC' ELSE ' 12 f' || CAST(p_partkey % 20 AS {s}) || '@@V1' END"


@_query("src9_readelf", f"SELECT DISTINCT lib AS library, CASE WHEN NOT bad THEN string_split(p[8], '@')[1] END AS symbol, CASE WHEN NOT bad THEN p[4] END AS kind, CASE WHEN NOT bad THEN p[2] END AS address, bad AS malformed FROM (SELECT *, len(p) < 8 AS bad FROM (SELECT p_partkey % 10 AS lib, string_split(trim({_ELF.format(s='VARCHAR')}), ' ') AS p FROM part)) WHERE bad OR (p[5] IN ('GLOBAL', 'WEAK') AND p[7] <> 'UND' AND p[6] IN ('DEFAULT', 'PROTECTED'))")
def _(spark, sf):
    return files.parse_readelf(_read(spark, sf, "part").select((F.col("p_partkey") % 10).alias("library"), F.expr(_ELF.format(s="STRING")).alias("line")))


@_query("src15_latest_cases", oracle("SELECT session, ts, line FROM v_log QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) = 1", "v_log"))
def _(spark, sf):
    return dataset.latest(view(spark, sf, "v_log"), "session", F.desc("ts"), F.desc("event_id")).select("session", "ts", "line")


@_query("jn4_all_entry_points", oracle(f"SELECT DISTINCT apk, name FROM shown WHERE action IN ({c._ACTIONS}) UNION SELECT apk, 'p' || CAST(apk AS VARCHAR) || '.Main' FROM shown WHERE apk % 2 = 0", "v_component", also=c._SHOWN))
def _(spark, sf):
    components = view(spark, sf, "v_component")
    mains = components.where("apk % 2 = 0").select("apk", F.concat(F.lit("p"), F.col("apk").cast("string"), F.lit(".Main")).alias("name"))
    return triage.entry_points(components).union(mains).distinct()


# ---- streams in batch form ----
@_query("str7_job_transitions", "SELECT user_id AS job, arg_max(CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'PROCESSING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END, (ts, event_id)) AS state, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    kind = F.col("event_type")
    events = _read(spark, sf, "events").select(F.col("user_id").alias("job"), "ts", "event_id", F.when(kind == "click", "QUEUED").when(kind == "view", "PROCESSING").when(kind == "error", "FAILED").otherwise("COMPLETED").alias("state"))
    return feeds.job_states(events)


@_query("str8_envelopes", """SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'metadata' ELSE 'result' END AS type, CASE WHEN event_id % 3 = 0 THEN 'm' || CAST(event_id AS VARCHAR) END AS message FROM events WHERE event_id % 5 <> 4""")
def _(spark, sf):
    kinds = "CASE event_id % 3 WHEN 0 THEN concat('{\"type\":\"log\",\"message\":\"m', event_id, '\"}') WHEN 1 THEN '{\"type\":\"metadata\",\"apk_details\":{\"name\":\"a\"}}' ELSE '{\"type\":\"result\",\"telemetry\":{}}' END"
    raw = _read(spark, sf, "events").select("user_id", "event_id", F.expr(f"CASE WHEN event_id % 5 = 4 THEN ': ping\n\ndata: no json\n\n' ELSE concat('data: ', {kinds}, '\n\n') END").alias("raw"))
    return feeds.decode_envelopes(raw, ["user_id", "event_id"], "raw").select("user_id", "event_id", "type", "message")


@_query("str6_ingest", oracle("SELECT apk_hash, min(source_path) AS job, min(apk_size_bytes) % 3 <> 0 AS is_new FROM v_apk GROUP BY 1", "v_apk"))
def _(spark, sf):
    uploads = view(spark, sf, "v_apk").select("apk_hash", F.col("source_path").alias("job"), "apk_size_bytes")
    known = uploads.groupBy("apk_hash").agg(F.min("job").alias("job"), F.min("apk_size_bytes").alias("size")).where("size % 3 = 0").select("apk_hash", "job")
    return checks.admit(uploads.select("apk_hash", "job"), known, "apk_hash", "job")


@_query("str9_monthly_feed", oracle("SELECT start, kind, count(*) AS n FROM (SELECT kind, unnest(generate_series(time_bucket(INTERVAL '1 day', ts) - INTERVAL '29 days', time_bucket(INTERVAL '1 day', ts), INTERVAL '1 day')) AS start FROM ev) GROUP BY 1, 2", "v_log", also=c._EVENTS))
def _(spark, sf):
    return feeds.sliding_feed(c._events(spark, sf), "30 days", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- learned ----
def _labelled(spark, sf):
    """(example_id, label, words), written once, as learning and scoring read it several times."""
    texts = _read(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), "text")
    return cut(learn.words(view(spark, sf, "v_token").join(texts, "example_id").select("example_id", "label", "text")))


@_query("ml1_slice_scores", None)
def _(spark, sf):
    slices = _labelled(spark, sf)
    model = learn.fit(slices.where("example_id % 5 <> 0"), cut=cut)
    return learn.score(model, slices).select("example_id", F.round("probability", 9).alias("probability"))


@_query("ml2_attributions", None)
def _(spark, sf):
    slices = _labelled(spark, sf)
    return learn.attribute(learn.fit(slices.where("example_id % 5 <> 0"), cut=cut), slices, 5)


@_query("sim1_similar_slices", None)
def _(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    items = _read(spark, sf, "benchmark").select("item_id", "text")
    return learn.similar(docs, items, "doc_id", "item_id", 0.5, cut=cut)




# ---- with the system calls, and with what each side saw ----
_SYS = f"{c._TELEMETRY.replace('tele AS', 'bare AS')}, tele AS (SELECT *, list_concat(CASE WHEN session % 2 = 0 THEN ['sys_clone'] ELSE [] END, CASE WHEN session % 3 = 0 THEN ['sys_execve'] ELSE [] END) AS syscalls FROM bare)"


def _with_syscalls(spark, sf):
    made = F.expr("concat(CASE WHEN session % 2 = 0 THEN array('sys_clone') ELSE array() END, CASE WHEN session % 3 = 0 THEN array('sys_execve') ELSE array() END)")
    return c._telemetry(spark, sf).withColumn("syscalls", made)


def _over(name: str, extra: str = "") -> str:
    """The SQL of a query over telemetry, with system calls."""
    return c.ORACLES[name].replace(c._TELEMETRY, _SYS) + extra


@_query("sco14_with_syscalls", _over("sco14_contributions", " UNION ALL SELECT session, 'sys_clone syscall', -0.12::DOUBLE FROM tele WHERE list_contains(syscalls, 'sys_clone')"))
def _(spark, sf):
    return evidence.contributions(_with_syscalls(spark, sf))


@_query("sco20_with_syscalls", _over("sco20_scorecard").replace("THEN 0 ELSE 3 END)), 0) AS penalty", "THEN 0 ELSE 3 END)), 0) + CASE WHEN root AND list_contains(syscalls, 'sys_execve') THEN 10 ELSE 0 END AS penalty"))
def _(spark, sf):
    return telemetry.scorecard(_with_syscalls(spark, sf)).select("session", "security", "privacy", "grade", "privacy_level")


@_query("sco23_with_syscalls", _over("sco23_findings").replace("),\nfindings AS (FROM found", " UNION ALL SELECT session, 'KAV-MED-20', 'Medium', 'System Integrity', false, 'Dynamic Process Spawning Syscall (sys_execve)' FROM tele WHERE list_contains(syscalls, 'sys_execve')),\nfindings AS (FROM found"))
def _(spark, sf):
    return evidence.findings(_with_syscalls(spark, sf))


@_query("str4_observe", oracle("SELECT event_id, e.session, kind FROM ev e JOIN (SELECT session, min(ts) AS start FROM ev GROUP BY 1) s ON e.session = s.session WHERE ts < start + INTERVAL 200000 SECOND", "v_log", also=c._EVENTS))
def _(spark, sf):
    return telemetry.observe(c._events(spark, sf), 200_000).select("event_id", "session", "kind")


@_query("agg15_static_evidence", oracle("SELECT p.apk, p.probability, coalesce(n, 0) AS slice_count, coalesce(most, p.probability) AS max_slice_probability FROM (SELECT apk, min(probability) AS probability FROM v_slice_score GROUP BY 1) p LEFT JOIN (SELECT apk, count(*) AS n, max(probability) AS most FROM v_slice_score WHERE slice_id % 3 = 0 GROUP BY 1) s ON s.apk = p.apk", "v_slice_score"))
def _(spark, sf):
    slices = view(spark, sf, "v_slice_score")
    return telemetry.static_evidence(slices.groupBy("apk").agg(F.min("probability").alias("probability")), slices.where("slice_id % 3 = 0"))


@_query("fus1_with_evidence", None)
def _(spark, sf):
    slices = view(spark, sf, "v_slice_score")
    static = telemetry.static_evidence(slices.groupBy("apk").agg(F.min("probability").alias("probability")), slices)
    return telemetry.fuse_with_evidence(static, telemetry.dynamic_score(telemetry.behaviour_flags(c._telemetry(spark, sf))), slices.select("apk"))


_MERGED = c.ORACLES["fus1_fuse"].replace("max(probability) AS p", "min(probability) AS p")


@_query("fus1_evidence_columns", f"""SELECT f.*, s.probability, s.slice_count, s.most AS max_slice_probability, b.sms, b.banking, b.root, b.loading, coalesce(s.slice_count, 0) AS attributions FROM ({_MERGED}) f
  LEFT JOIN ({oracle("SELECT apk, min(probability) AS probability, count(*) AS slice_count, max(probability) AS most FROM v_slice_score GROUP BY 1", "v_slice_score")}) s ON s.apk = f.apk LEFT JOIN ({c.ORACLES["sco7_behaviour_flags"]}) b ON b.session = f.apk""")
def _(spark, sf):
    """fus1_with_evidence, its structs as columns."""
    made = c.QUERIES["fus1_with_evidence"](spark, sf)
    shown = [F.col(f"{s}.{x}").alias(x) for s, names in (("static_evidence", ("probability", "slice_count", "max_slice_probability")), ("fingerprint", ("sms", "banking", "root", "loading"))) for x in names]
    return made.select("apk", "base_score", "dynamic_score", "c2", "evasion", "label", "score", *shown, "attributions")


@_query("fus1_attributions", f"WITH {_WEIGHED}, best AS (SELECT slice_id, slice_id % 10 AS apk, token, arg_max(weight, (abs(weight), weight)) AS weight FROM attr GROUP BY 1, 2, 3) SELECT apk, slice_id, CAST(row_number() OVER (PARTITION BY slice_id ORDER BY abs(weight) DESC, token) AS INT) AS place, token, weight FROM best WHERE apk IN (SELECT apk FROM ({_MERGED}))")
def _(spark, sf):
    """The attributions of all slices of the packages that were fused, one row each."""
    slices = _read(spark, sf, "documents").select(F.col("doc_id").alias("slice_id"), (F.col("doc_id") % 10).alias("apk"))
    return telemetry.flattened(c.QUERIES["fus1_with_evidence"](spark, sf), outcomes.slice_attributions(slices, _attributions(spark, sf)))


@_query("agg3_finished_statistics", c.ORACLES["agg3_grouped_statistics"].replace("FROM v_token", "FROM (SELECT * FROM v_token WHERE status IN ('completed', 'completed_with_truncation', 'capped', 'zero_sink'))"))
def _(spark, sf):
    return dataset.grouped_statistics(dataset.finished(view(spark, sf, "v_token")))


@_query("ded1_first_of_each", oracle("SELECT apk_hash, arg_min(label, source_path) AS label, min(source_path) AS source_path, count(*) - 1 AS copies, count(DISTINCT label) > 1 AS conflicting FROM v_apk GROUP BY 1", "v_apk"))
def _(spark, sf):
    return dataset.first_of_each(view(spark, sf, "v_apk"))


@_query("dq5_compare_content", "SELECT doc_id, doc_id % 4 <> 0 AS size_holds, doc_id % 5 <> 0 AS content_holds FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    k = F.col("doc_id")
    recorded = _read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("content"), (F.octet_length("text") + F.when(k % 4 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return checks.verify_content(recorded, "content").select("doc_id", "size_holds", "content_holds")


@_query("fn8_incoming_words", oracle(r"""SELECT apk, method, 2 + CASE WHEN flags LIKE '%static%' THEN 0 ELSE 1 END AS words FROM v_decl""", "v_decl"))
def _(spark, sf):
    types = scalars.param_types(F.regexp_extract("full_signature", r"(\(.*)$", 1))
    return view(spark, sf, "v_decl").select("apk", "method", scalars.incoming_words(types, F.array_contains(F.split("flags", ","), "static")).alias("words"))


@_query("fn17_host_port", oracle(r"""SELECT event_id, nullif(regexp_extract(line, 'connection: (.*):([0-9]+)$', 1), '') AS host, CAST(nullif(regexp_extract(line, 'connection: (.*):([0-9]+)$', 2), '') AS INT) AS port FROM v_log WHERE line LIKE '%connection: %'""", "v_log"))
def _(spark, sf):
    rest = F.substring_index("line", "connection: ", -1)
    return view(spark, sf, "v_log").where("line LIKE '%connection: %'").select("event_id", code.host_port(rest).alias("r")).select("event_id", "r.*")


@_query("fn18_socket_lists", oracle("SELECT session, array_to_string(list_transform(sockets, lambda s: s.ip || ':' || CAST(s.port AS VARCHAR)), ',') AS sockets, array_to_string(list_transform(sockets, lambda s: s.ip), ',') AS ips FROM tele", "v_log", also=c._TELEMETRY))
def _(spark, sf):
    return c._telemetry(spark, sf).select("session", F.array_join(scalars.socket_text(F.col("sockets")), ",").alias("sockets"), F.array_join(scalars.ip_list(F.col("sockets")), ",").alias("ips"))


@_query("sco18_permissions", oracle("SELECT apk AS session, permission, 'exercised at runtime' AS status FROM v_perm", "v_perm"))
def _(spark, sf):
    used = view(spark, sf, "v_perm").groupBy(F.col("apk").alias("session")).agg(F.collect_set("permission").alias("permissions_exercised"))  # ten at most
    return outcomes.exercised_permissions(used)


@_query("sco25_all_iocs", oracle("SELECT DISTINCT 'ip' AS kind, ip AS indicator FROM ev WHERE ip IS NOT NULL UNION SELECT 'sha256', apk_hash FROM v_apk WHERE label = 'Malicious'", "v_log", "v_apk", also=c._EVENTS))
def _(spark, sf):
    return outcomes.iocs(c._events(spark, sf), view(spark, sf, "v_apk"))


@_query("udf4_length_struct", oracle(f"SELECT label, {c._DISTRIBUTION}, round(100.0::DOUBLE * count(*) FILTER (token_count > 512) / count(token_count), 6) AS over_512 FROM v_token GROUP BY 1", "v_token"))
def _(spark, sf):
    return view(spark, sf, "v_token").groupBy("label").agg(dataset.token_length_struct("token_count", (512,)).alias("s")).select("label", "s.*")


class ApiReferences:
    """Table function: each method reference of a text, with its place."""

    def eval(self, text: str):
        import re

        for i, m in enumerate(re.finditer(files.API_REF, text)):
            yield i, m[1]


@_query("udf5_scan", oracle(r"""SELECT method, idx, 0 AS place, regexp_extract(operands, '(L[a-zA-Z0-9_/$]+;->[a-zA-Z0-9_]+)', 1) AS reference FROM v_code WHERE opcode LIKE 'invoke-%' AND regexp_matches(operands, 'L[a-zA-Z0-9_/$]+;->[a-zA-Z0-9_]+')""", "v_code"))
def _(spark, sf):
    scan.register(spark, "api_references", ApiReferences, "place int, reference string")
    rows = view(spark, sf, "v_code").where("opcode LIKE 'invoke-%'").select(F.struct("method", "idx").alias("k"), "operands")
    return scan.scan(rows, "k", "operands", "api_references").select("k.method", "k.idx", "place", "reference")
