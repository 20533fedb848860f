"""Queries of frames, feeds, stored tables, digests and sketches, with their SQL; `catalog` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from tracequarry import catalog as c
from tracequarry.functions import canonical
from tracequarry.operators import bytecode, dataset, learn, matching, sketches, slice_stats
from tracequarry.plans.views import oracle, view
from tracequarry.sources import files, smali
from tracequarry.sources.shared import cut, shared_dir
from tracequarry.sources.stored import StoredTable
from tracequarry.streaming import feeds, stateful

_query = c._query


# ---- frames and feeds ----
_SENT = """sent AS (SELECT user_id, event_id, 'data: {"type":"' || CASE event_id % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'error' ELSE 'ping' END || '","message":"m' || CAST(event_id AS @S) || '"}' || chr(10) || chr(10) AS f FROM @E),
cut AS (SELECT user_id, event_id, coalesce(substring(lag(f) OVER (PARTITION BY user_id ORDER BY event_id), CAST(2 + lag(event_id % length(f)) OVER (PARTITION BY user_id ORDER BY event_id) AS INT)), '') || substring(f, 1, CAST(1 + event_id % length(f) AS INT)) AS chunk FROM sent)"""


@_query("str8_frames", f"""WITH {_SENT.replace("@S", "VARCHAR").replace("@E", "events")}, parts AS (SELECT user_id, string_split(string_agg(chunk, '' ORDER BY event_id), chr(10) || chr(10)) AS p FROM cut GROUP BY 1),
f AS (SELECT user_id, generate_subscripts(p, 1) - 1 AS frame, unnest(p) AS text, len(p) AS n FROM parts)
SELECT user_id, CAST(frame AS BIGINT) AS frame, json_extract_string(substring(text, 7), '$.type') AS type, json_extract_string(substring(text, 7), '$.message') AS message FROM f
WHERE frame < n - 1 AND starts_with(text, 'data: ') AND json_extract_string(substring(text, 7), '$.type') IN ('log', 'error')""")
def _(spark, sf):
    """Frames whose chunks are cut anywhere, between newlines too."""
    spelled = _SENT.replace("{", "{{").replace("}", "}}").replace("@S", "STRING").replace("@E", "{events}")
    chunks = spark.sql(f"WITH {spelled} SELECT * FROM cut", events=spark.read.parquet(f"{sf}/events.parquet"))
    framed = stateful.frames(chunks, "user_id", "event_id", "chunk")
    return stateful.envelopes(framed, "user_id", "frame").select("user_id", "frame", "type", "message")


@_query("str9_hourly_feed", oracle("""SELECT start, kind, CAST(sum(m) AS BIGINT) AS n FROM (SELECT h - INTERVAL 1 HOUR * k AS start, kind, m FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS h, kind, count(*) AS m FROM ev GROUP BY 1, 2), range(720) r(k)) GROUP BY 1, 2""", "v_log", also=c._EVENTS))
def _(spark, sf):
    return stateful.sliding_counts(c._events(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- stored tables ----
@_query("src15_stored_upsert", oracle("SELECT event_id, session, ts, line FROM v_log QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) = 1", "v_log"))
def _(spark, sf):
    """The last line of each session, from a stored table that takes in one kind of line after the other."""
    lines = view(spark, sf, "v_log").select("event_id", "session", F.struct("ts", "event_id").alias("at"), "line", F.col("line").contains("File").alias("first"))
    table = StoredTable(spark, f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", "session", "at", 16)
    for part in ("first", "NOT first"):
        table.upsert(cut(lines.where(part).drop("first")))
    return table.read().select("event_id", "session", F.col("at.ts").alias("ts"), "line")


# ---- digests ----
_ESCAPED = r"""list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) > 65535 THEN printf('\u%04x\u%04x', 55296 + ((unicode(c) - 65536) // 1024), 56320 + ((unicode(c) - 65536) % 1024)) ELSE printf('\u%04x', unicode(c)) END)"""


@_query("fn16_canonical_id", rf"""SELECT doc_id, source || ':' || sha256('{{"apk_hash":"' || source || '","instruction_index":' || CAST(doc_id AS VARCHAR) || ',"invoked_signature":' || CASE WHEN text IS NULL THEN 'null' ELSE '"' || array_to_string({_ESCAPED.format(x="text")}, '') || '"' END || ',"rule_id":"r"}}') AS example_id FROM documents""")
def _(spark, sf):
    """Ids over names in any script: whole texts stand for the signatures."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = canonical.with_example_id(docs, F.col("source"), rule_id=F.lit("r"), instruction_index=F.col("doc_id"), invoked_signature=F.col("text"))
    return made.select("doc_id", "example_id")


@_query("set5_canonical_digest", oracle("""SELECT count(*) AS n, sha256('{' || string_agg('"' || apk_hash || '":"' || label || '"', ',' ORDER BY apk_hash) || '}') AS digest FROM (SELECT apk_hash, min(label) AS label FROM v_apk GROUP BY 1)""", "v_apk"))
def _(spark, sf):
    mapping = view(spark, sf, "v_apk").groupBy("apk_hash").agg(F.min("label").alias("label"))
    return canonical.mapping_sha256(mapping, "apk_hash", "label")


# ---- sketches ----
_GROUPS = {"all": "''", "label": "label", "is_truncated": "CAST(is_truncated AS VARCHAR)", "status": "status", "sink_category": "sink_category", "apk_hash": "apk_hash"}


@_query("agg1_sketches", oracle("SELECT grouping, member, n, most, mean, true AS p5, true AS p9, true AS p95, true AS p99 FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS grouping, {m} AS member, count(token_count) AS n, max(token_count) AS most, round(avg(token_count), 6) AS mean FROM v_token GROUP BY 1, 2" for g, m in _GROUPS.items()) + ")", "v_token"))
def _(spark, sf):
    """The six groupings from one stored table of sketches, and whether each quantile's rank is right to 1 %."""
    rows = view(spark, sf, "v_token")
    names = [g for g in _GROUPS if g != "all"]
    stored = cut(sketches.sketched(rows, "token_count", *names))
    found = sketches.distribution(sketches.grouping_sets(stored, *names))
    return sketches.checked(rows, "token_count", found, names).withColumn("mean", F.round("mean", 6))


# ---- texts like known ones ----
_SETS = """d AS (SELECT text, min(doc_id) AS key, count(*) AS n, bool_or(toxic = 1) AS bad, count(*) FILTER (toxic = 1) AS n_bad, min(doc_id) FILTER (toxic = 1) AS bad_key FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY 1),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
s AS (SELECT key, n, bad, n_bad, bad_key, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
p AS (SELECT a.key, b.bad_key AS known, a.n, b.n_bad AS n_known, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS x, len(b.s) AS y FROM s a JOIN s b ON b.bad AND len(b.s) >= 0.8 * len(a.s) - 0.000001 AND len(a.s) >= 0.8 * len(b.s) - 0.000001)"""


@_query("sim1_known_threats", f"WITH {_SETS} SELECT key, known, n, n_known, round(c / (x + y - c), 6) AS similarity FROM p WHERE c >= 0.8 * (x + y - c) - 0.000001")
def _(spark, sf):
    """Documents like those that are labelled toxic, which stand for known threats."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    bad = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    new, known = cut(matching.text_sets(docs, "doc_id", "text")), cut(matching.text_sets(docs.join(bad, "doc_id", "left_semi"), "doc_id", "text"))
    return matching.near_matches(new, known)


# ---- smali ----
def _texts(rows, body):
    text = F.concat(F.lit(".class public Lp/C;\n.super Ljava/lang/Object;\n"), F.array_join(F.array_sort(F.collect_list(body)), "\n"))
    return rows.groupBy("apk").agg(text.alias("text"))


@_query("src3_smali_parameters", oracle(r"""SELECT d.apk, d.full_signature, k AS place, 'p' || CAST(k + CASE WHEN list_contains(string_split(d.flags, ','), 'static') THEN 0 ELSE 1 END AS VARCHAR) AS register, 'I' AS type, CASE WHEN k = 1 THEN 'n' || regexp_extract(d.full_signature, '->m([0-9]+)', 1) END AS name FROM v_decl d, range(2) r(k)""", "v_decl"))
def _(spark, sf):
    """Each package's declarations printed as one class, and their parameters read again."""
    decl = view(spark, sf, "v_decl").where("apk IS NOT NULL")
    number = F.regexp_extract("full_signature", r"->m(\d+)", 1)
    second = F.when(F.array_contains(F.split("flags", ","), "static"), "p1").otherwise("p2")
    body = F.concat(F.lit(".method "), F.array_join(F.split("flags", ","), " "), F.lit(" m"), number, F.lit("(II)I\n    .param "), second, F.lit(', "n'), number, F.lit('"\n.end method'))
    parts = cut(smali.read_classes(_texts(decl, body), "apk", "text"))
    named = smali.methods(parts).select("apk", "method_no", F.regexp_extract("full_signature", r"->(m\d+)", 1).alias("m"))
    signed = decl.select("apk", "full_signature", F.regexp_extract("full_signature", r"->(m\d+)", 1).alias("m"))
    return smali.parameters(parts).join(named, ["apk", "method_no"]).join(signed, ["apk", "m"]).select("apk", "full_signature", "place", "register", "type", "name")


@_query("src3_smali_payloads", oracle("SELECT apk, label || '_' || CAST(method AS VARCHAR) AS label, 'packed-switch' AS kind, CAST(row_number() OVER w - 1 AS INT) AS pos, row_number() OVER w + 6 AS key_value, target FROM v_payload WHERE target IS NOT NULL WINDOW w AS (PARTITION BY apk, method, label ORDER BY pos, target)", "v_payload"))
def _(spark, sf):
    rows = view(spark, sf, "v_payload").where("apk IS NOT NULL AND target IS NOT NULL")
    tables = rows.groupBy("apk", "method", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("entries"))
    body = F.concat(F.lit(".method m()V\n    "), F.col("label"), F.lit("_"), F.col("method").cast("string"), F.lit("\n    .packed-switch 0x7\n        "), F.array_join(F.col("entries.target"), "\n        "), F.lit("\n    .end packed-switch\n.end method"))
    return smali.payload_entries(smali.read_classes(_texts(tables, body), "apk", "text")).select("apk", "label", "kind", "pos", "key_value", "target")


# ---- SQL functions and unknown keys ----
@_query("udf4_sql_function", oracle("SELECT label, count(token_count) AS n, round(avg(token_count), 6) AS mean, max(token_count) AS most FROM v_token GROUP BY 1", "v_token"))
def _(spark, sf):
    sketches.register(spark)
    rows = view(spark, sf, "v_token")
    return spark.sql("SELECT label, d.n, round(d.mean, 6) AS mean, d.most FROM (SELECT label, length_distribution(kll_sketch_agg_bigint(token_count), sum(token_count), max(token_count)) AS d FROM {rows} GROUP BY label)", rows=rows)


@_query("src7_unknown_keys", "SELECT event_id, 'extra' AS name, 'v' || CAST(event_id AS VARCHAR) AS told, CAST(event_id % 7 AS INT) AS number FROM events")
def _(spark, sf):
    """Keys that no schema names come back with their values."""
    text = F.format_string('{"objection_root_bypass":true,"extra":{"told":"v%d","list":[0,%d]}}', F.col("event_id"), F.col("event_id") % 7)
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.alias("document"))
    found = files.unknown_telemetry(rows, "event_id", "document")
    return found.select("event_id", "name", F.variant_get("value", "$.told", "string").alias("told"), F.variant_get("value", "$.list[1]", "int").alias("number"))


# ---- summaries of slices ----
_MAP = lambda rows, name: f"(SELECT apk, string_agg(category || '=' || CAST(n AS VARCHAR), ',' ORDER BY category) AS {name} FROM (SELECT apk, category, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY 1)"


@_query("agg12_package_summary", oracle(f"""SELECT apk, coalesce(u, 0) AS usable_method_count, coalesce(m, 0) AS sink_method_count, coalesce(t, 0) AS total_sink_count, coalesce(ca, 0) AS candidate_selected_sink_count, coalesce(pu, 0) AS selected_sink_count, coalesce(t, 0) - coalesce(pu, 0) AS omitted_sink_count,
  CAST(coalesce(ins, 0) AS BIGINT) AS retained_instruction_count, coalesce(co, 0) AS complete_slice_count, coalesce(tr, 0) AS truncated_slice_count, coalesce(kept, '') AS retained, coalesce(lost, '') AS omitted, coalesce(why, '') AS truncation_reasons,
  CASE WHEN coalesce(pu, 0) < coalesce(ca, 0) THEN 'max_total_slice_instructions' WHEN coalesce(ca, 0) < coalesce(t, 0) THEN 'max_slices_per_apk' END AS cap_reason, rej AS rejected
  FROM (SELECT apk, count(*) AS u FROM v_method WHERE flags NOT ILIKE '%native%' AND flags NOT ILIKE '%abstract%' GROUP BY 1) FULL JOIN (SELECT apk, count(DISTINCT method) AS m, count(*) AS t FROM sinks GROUP BY 1) USING (apk)
  LEFT JOIN (SELECT apk, count(*) AS ca, count(*) FILTER (total <= 12) AS pu, min(CAST(method AS VARCHAR) || '/' || CAST(idx AS VARCHAR) || '/' || rule_id) FILTER (total > 12 AND total - n <= 12) AS rej FROM cand GROUP BY 1) USING (apk)
  LEFT JOIN (SELECT apk, sum(n) AS ins, count(*) FILTER (idx < 3) AS co, count(*) FILTER (idx >= 3) AS tr, CASE WHEN count(*) FILTER (idx >= 3) > 0 THEN CASE WHEN count(*) FILTER (idx >= 4) > 0 THEN 'instruction_limit,recursion' ELSE 'instruction_limit' END END AS why FROM pub GROUP BY 1) USING (apk)
  LEFT JOIN {_MAP("pub", "kept")} USING (apk) LEFT JOIN {_MAP("(SELECT * FROM sinks WHERE (apk, method, idx, rule_id) NOT IN (SELECT (apk, method, idx, rule_id) FROM pub))", "lost")} USING (apk)""", "v_instr", "v_method", also=f"""{c._FOUND},
cand AS (SELECT *, idx + 1 AS n, sum(idx + 1) OVER (PARTITION BY apk ORDER BY place) AS total FROM (SELECT *, row_number() OVER (PARTITION BY apk ORDER BY turn, category) AS place FROM (SELECT *, row_number() OVER (PARTITION BY apk, category ORDER BY method, idx, rule_id) AS turn FROM sinks)) WHERE place <= 5),
pub AS (SELECT * FROM cand WHERE total <= 12)"""))
def _(spark, sf):
    """All measures of a package's slices; a sink's slice stands for the instructions up to it."""
    sinks = cut(c._sinks(spark, sf))
    late = lambda n, reason: F.when(F.col("idx") >= n, F.lit(reason))
    records = sinks.select("apk", "method", "idx", "rule_id", (F.col("idx") + 1).alias("n"), (F.col("idx") >= 3).alias("truncated"), F.array_compact(F.array(late(3, "instruction_limit"), late(4, "recursion"))).alias("reasons"))
    made = slice_stats.package_summary(bytecode.usable_methods(view(spark, sf, "v_method")), sinks, cut(dataset.select_by_category(sinks, 5)), records, 12)
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    rejected = F.when(F.col("rejected_sink").isNotNull(), F.concat_ws("/", "rejected_sink.method", "rejected_sink.idx", "rejected_sink.rule_id"))
    return made.select(
        "apk", *[x for x in made.columns if x.endswith("_count")], told("retained_sink_categories").alias("retained"), told("omitted_sink_categories").alias("omitted"), F.array_join("truncation_reasons", ",").alias("truncation_reasons"), "cap_reason", rejected.alias("rejected"),
    )


# ---- files written and read again, tokenizers, late results ----
def _aside(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query("src11_records", "SELECT doc_id, text, lang FROM documents")
def _(spark, sf):
    """Whole documents written as gzip records and read again (SRC-5)."""
    path = _aside(spark, "records")
    files.write_records(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), path)
    return files.read_records(spark, path, "doc_id long, text string, lang string")


@_query("src10_csv", oracle("SELECT apk_hash, label, apk_size_bytes, source_path, (SELECT count(*) FROM v_apk) AS n_written FROM v_apk", "v_apk"))
def _(spark, sf):
    path = _aside(spark, "rows")
    rows = view(spark, sf, "v_apk")
    n = files.write_csv_checked(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, escape='"', multiLine=True).withColumn("n_written", F.lit(n).cast("long"))


@_query("src13_compact", oracle("SELECT apk_hash, label, apk_size_bytes, 'lib' || label || '.so' AS filename, 'arm64' AS abi, source_path AS archive_path, apk_hash AS sha256 FROM v_apk", "v_apk"))
def _(spark, sf):
    library = F.struct(F.concat(F.lit("lib"), "label", F.lit(".so")).alias("filename"), F.lit("arm64").alias("abi"), F.col("source_path").alias("archive_path"), F.col("apk_hash").alias("sha256"), F.lit("/tmp/x").alias("extracted_path"))
    made = files.compact_ir(view(spark, sf, "v_apk").withColumns({"library": library, "address": F.lit("0x1")}))
    return made.select("apk_hash", "label", "apk_size_bytes", "library.*")


@_query("udf2_tokenizer", "SELECT doc_id, CAST(len(string_split(coalesce(text, ''), ' ')) AS BIGINT) AS token_count, CAST(list_sum(list_transform(string_split(coalesce(text, ''), ' '), lambda w: len(w))) AS BIGINT) AS letters FROM documents")
def _(spark, sf):
    """A tokenizer of the user's own: words by their lengths."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = learn.tokenize(docs, lambda: lambda text: [len(w) for w in text.split(" ")])
    return made.select("doc_id", "token_count", F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("letters"))


@_query("str10_late_fusion", """SELECT s.user_id AS apk, s.event_id / 1000::DOUBLE AS probability, s.ts, CAST(d.event_id % 30 AS INT) AS dynamic_score FROM (SELECT * FROM events WHERE event_type = 'click') s
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') d ON d.user_id = s.user_id AND d.ts >= s.ts AND d.ts <= s.ts + INTERVAL 1 HOUR""")
def _(spark, sf):
    """Batch form: static results with the dynamic ones that come within the hour."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("user_id", "apk")
    static = events.where("event_type = 'click'").select("apk", (F.col("event_id") / 1000.0).cast("double").alias("probability"), "ts")
    return feeds.late_fusion(static, events.where("event_type = 'error'").select("apk", (F.col("event_id") % 30).cast("int").alias("dynamic_score"), "ts"))
