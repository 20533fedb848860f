"""Queries of reports, native code, rules and scalars, with their SQL; `catalog` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry import catalog as c
from tracequarry.functions import scalars
from tracequarry.operators import bytecode, dataset, evidence, native, rules, telemetry
from tracequarry.plans.views import oracle, view
from tracequarry.sources.shared import cut
from tracequarry.streaming import feeds

_query, _T = c._query, c._TELEMETRY
_LIKE = lambda *parts: "(" + " OR ".join(f"contains(file, '{p}')" for p in parts) + ")"
_PARTS = f"{_T}, fl AS (SELECT session, unnest(files) AS file, generate_subscripts(files, 1) - 1 AS i FROM tele), so AS (SELECT session, s.ip AS ip, s.port AS port, i FROM (SELECT session, unnest(sockets) AS s, generate_subscripts(sockets, 1) - 1 AS i FROM tele))"


def _tele(sql: str) -> str:
    return oracle(sql, "v_log", also=_PARTS)


# ---- reports ----
@_query("sco14_contributions", _tele(f"""SELECT session, 'Frida Root Bypass' AS name, 0.35::DOUBLE AS value FROM tele WHERE root UNION ALL SELECT session, 'Frida SSL Bypass', 0.3::DOUBLE FROM tele WHERE ssl
  UNION ALL SELECT session, CASE WHEN {_LIKE('app_process', 'system')} THEN 'Sys Binary Read' WHEN {_LIKE('Bot')} THEN 'Bot Config I/O' ELSE 'Config Write' END, CASE WHEN {_LIKE('app_process', 'system')} THEN 0.25::DOUBLE WHEN {_LIKE('Bot')} THEN 0.18::DOUBLE ELSE 0.15::DOUBLE END FROM fl WHERE {_LIKE('app_process', 'system', 'Bot', 'shared_prefs', 'config')}
  UNION ALL SELECT session, CASE WHEN port = 4444 THEN 'Rev Shell :4444' ELSE 'Conn :' || CAST(port AS VARCHAR) END, CASE WHEN port = 4444 THEN 0.45::DOUBLE ELSE 0.1::DOUBLE END FROM so
  UNION ALL SELECT DISTINCT session, 'DNS Port 53 query', -0.08::DOUBLE FROM so WHERE port = 53"""))
def _(spark, sf):
    return evidence.contributions(c._telemetry(spark, sf))


_COUNTED = f"""{_PARTS}, counted AS (SELECT session, root::INT AS r, ssl::INT AS s, coalesce(cf, 0) AS cf, coalesce(sy, 0) AS sy, coalesce(bo, 0) AS bo, coalesce(sh, 0) AS sh, coalesce(ot, 0) AS ot FROM tele
  LEFT JOIN (SELECT session, count(*) FILTER {_LIKE('shared_prefs', 'config').replace('(', '(WHERE ', 1)} AS cf, count(*) FILTER {_LIKE('app_process', 'system').replace('(', '(WHERE ', 1)} AS sy, count(*) FILTER {_LIKE('Bot', 'contacts').replace('(', '(WHERE ', 1)} AS bo FROM fl GROUP BY 1) USING (session)
  LEFT JOIN (SELECT session, count(*) FILTER (WHERE port = 4444) AS sh, count(*) FILTER (WHERE port <> 4444) AS ot FROM so GROUP BY 1) USING (session))"""
_AXIS = " UNION ALL ".join(f"SELECT session, '{a}' AS axis, CAST(least(98, 5 + {' + '.join(f'{w} * {n}' for w, n in zip(ws, ('r', 's', 'cf', 'sy', 'bo', 'sh', 'ot'), strict=True))}) AS INT) AS value FROM counted" for a, ws in evidence.AXES.items())


@_query("sco15_risk_matrix", oracle(_AXIS, "v_log", also=_COUNTED))
def _(spark, sf):
    return evidence.risk_matrix(c._telemetry(spark, sf))


_NAME = "regexp_extract(file, '[^/]*$')"
_CHAIN = lambda *r: f"CASE WHEN {_NAME} LIKE 'Bot%' OR {_NAME} IN ('contacts', 'app_stat') THEN '{r[0]}' WHEN {_NAME} IN ('zlock', 'HG', 'i', 'c') THEN '{r[1]}' WHEN {_LIKE('app_process', 'system', 'su')} THEN '{r[2]}' WHEN {_LIKE('shared_prefs', 'config')} THEN '{r[3]}' ELSE '{r[4]}' END"


@_query("sco16_classify_files", _tele(f"SELECT session, file, {_CHAIN('Write', 'Read/Write', 'Read', 'Read/Write', 'Access')} AS operation, {_CHAIN('Bot Exfiltration', 'Trojan State', 'System Binary', 'App Config', 'General')} AS context FROM fl"))
def _(spark, sf):
    return evidence.classify_files(c._events(spark, sf).where("file IS NOT NULL").select("session", "file").distinct())


@_query("sco17_classify_sockets", _tele("SELECT session, ip, port, 'ESTABLISHED' AS status, CASE WHEN port = 4444 THEN 'reverse shell' ELSE 'c2 beacon' END AS assessment FROM so"))
def _(spark, sf):
    return evidence.classify_sockets(c._events(spark, sf).where("ip IS NOT NULL").select("session", "ip", "port").distinct())


@_query("sco19_techniques", _tele(f"""SELECT session, 'T1112' AS technique, 'Frida SSL Pinning Bypass' AS trigger FROM tele WHERE ssl UNION ALL SELECT session, 'T1055', 'Frida Root Guard Bypass' FROM tele WHERE root
  UNION ALL SELECT session, CASE WHEN port = 4444 THEN 'T1020' ELSE 'T1071' END, CASE WHEN port = 4444 THEN 'Reverse Shell Port :4444 binding' ELSE 'Outbound C2 to ' || ip || ':' || CAST(port AS VARCHAR) END FROM so
  UNION ALL SELECT session, 'T1005', 'Bot config I/O: ' || {_NAME} FROM fl WHERE {_LIKE('Bot', 'contacts')}"""))
def _(spark, sf):
    return evidence.techniques(c._telemetry(spark, sf))


_FINDINGS = f"""{_PARTS}, found AS (SELECT session, 'KAV-CRIT-01' AS id, 'Critical' AS severity, 'Runtime Security' AS category, false AS privacy, 'Frida Dynamic Root Bypass Hook Executed' AS title FROM tele WHERE root
  UNION ALL SELECT session, 'KAV-CRIT-02', 'Critical', 'Network Privacy', true, 'SSL/TLS Certificate Pinning Defeated' FROM tele WHERE ssl
  UNION ALL SELECT session, CASE WHEN port = 4444 THEN 'KAV-CRIT-0' || CAST(i + 3 AS VARCHAR) ELSE 'KAV-MED-0' || CAST(i + 2 AS VARCHAR) END, CASE WHEN port = 4444 THEN 'Critical' ELSE 'Medium' END, 'Network Privacy', true,
    CASE WHEN port = 4444 THEN 'Active Reverse Shell / Non-Standard C2 Port Connection (' ELSE 'Outbound Network Socket Connection (' END || ip || ':' || CAST(port AS VARCHAR) || ')' FROM so
  UNION ALL SELECT session, 'KAV-HIGH-0' || CAST(i + 1 AS VARCHAR), 'High', 'Data Storage', true, 'Unencrypted Application Preference Read: ' || file FROM fl WHERE {_LIKE('shared_prefs', 'config')}
  UNION ALL SELECT session, 'KAV-HIGH-1' || CAST(i + 1 AS VARCHAR), 'High', 'System Integrity', false, 'System Binary Execution Marker: ' || file FROM fl WHERE {_LIKE('app_process', 'system')} AND NOT {_LIKE('shared_prefs', 'config')}
  UNION ALL SELECT session, 'KAV-MED-1' || CAST(i + 1 AS VARCHAR), 'Medium', 'Runtime Security', false, 'Process Memory & Map Inspection: ' || file FROM fl WHERE {_LIKE('/proc/')} AND NOT {_LIKE('shared_prefs', 'config', 'app_process', 'system')}),
findings AS (FROM found UNION ALL SELECT session, 'KAV-INFO-01', 'Info', 'Runtime Security', false, 'Dynamic Instrumentation Execution Clean' FROM tele ANTI JOIN found USING (session))"""


@_query("sco23_findings", oracle("SELECT * FROM findings", "v_log", also=_FINDINGS))
def _(spark, sf):
    return evidence.findings(c._telemetry(spark, sf))


@_query("flt9_search_findings", oracle("SELECT * FROM findings WHERE privacy AND (lower(title) LIKE '%socket%' OR lower(id) LIKE '%socket%' OR lower(category) LIKE '%socket%')", "v_log", also=_FINDINGS))
def _(spark, sf):
    return evidence.search_findings(evidence.findings(c._telemetry(spark, sf)), "Privacy", "Socket")


@_query("agg14_severity_counts", oracle("SELECT session, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("Critical", "High", "Medium", "Low", "Info")) + " FROM findings GROUP BY 1", "v_log", also=_FINDINGS))
def _(spark, sf):
    return evidence.severity_counts(evidence.findings(c._telemetry(spark, sf)))


@_query("agg19_evidence_counts", _tele("SELECT session, len(files)::INT AS n_files, len(sockets)::INT AS n_sockets, (len(files) + len(sockets))::INT AS n_evidence FROM tele"))
def _(spark, sf):
    return evidence.evidence_counts(c._telemetry(spark, sf))


_SHOWS = lambda parts: " OR ".join(f"contains(lower(line), '{p}')" for p in parts)


@_query("str5_checkpoints", oracle(" UNION ALL ".join(f"SELECT session, '{s}' AS step, count(*) FILTER (WHERE {_SHOWS(p)}) > 0 AS active, min(ts) FILTER (WHERE {_SHOWS(p)}) AS first_ts FROM v_log GROUP BY 1" for s, p in evidence.STEPS.items()), "v_log"))
def _(spark, sf):
    return evidence.checkpoints(view(spark, sf, "v_log"))


@_query("str9_sliding_feed", oracle("SELECT start, kind, CAST(sum(m) AS BIGINT) AS n FROM (SELECT h - INTERVAL 1 HOUR * k AS start, kind, m FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS h, kind, count(*) AS m FROM ev GROUP BY 1, 2), range(24) r(k)) GROUP BY 1, 2", "v_log", also=c._EVENTS))
def _(spark, sf):
    return feeds.sliding_feed(c._events(spark, sf), "24 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("str11_log_level", oracle("SELECT event_id, CASE WHEN contains(lower(line), '[error]') THEN 'error' WHEN contains(lower(line), '[warn]') THEN 'warn' WHEN contains(lower(line), '[sim]') OR contains(lower(line), '[info]') THEN 'info' WHEN contains(lower(line), 'success') THEN 'success' ELSE 'plain' END AS level FROM v_log", "v_log"))
def _(spark, sf):
    return view(spark, sf, "v_log").select("event_id", evidence.log_level(F.col("line")).alias("level"))


@_query("sco27_report_deadline", oracle("SELECT event_id, ts + INTERVAL 6 HOUR AS deadline, ts + INTERVAL 6 HOUR < (SELECT max(ts) FROM v_log) AS overdue FROM v_log", "v_log"))
def _(spark, sf):
    lines = view(spark, sf, "v_log")
    deadline = F.col("ts") + F.expr("INTERVAL 6 HOURS")
    now = F.broadcast(lines.agg(F.max("ts").alias("now")))  # one row
    return lines.join(now).select("event_id", deadline.alias("deadline"), (deadline < F.col("now")).alias("overdue"))


# ---- native code ----
_SPELL = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda k: CASE WHEN k = '_' THEN '_1' WHEN k = ';' THEN '_2' WHEN k = '[' THEN '_3' WHEN k = '/' THEN '_' WHEN regexp_matches(k, '^[A-Za-z0-9]$') THEN k ELSE '_0' || printf('%04x', unicode(k)) END), '')"
_DECL = "SELECT p_partkey AS decl, 'Lp/' || p_brand || '/N_' || CAST(p_partkey % 50 AS STRING) || ';' AS class_name, p_name AS method_name, CASE p_partkey % 3 WHEN 0 THEN '[I' WHEN 1 THEN 'Ljava/lang/String;' ELSE 'J' END AS params FROM {part}"
_NAMED = f"decl AS ({_DECL.format(part='part').replace('STRING', 'VARCHAR')}), named0 AS (SELECT *, 'Java_' || {_SPELL(chr(39) + chr(39) + ' || substr(class_name, 2, len(class_name) - 2)')} || '_' || {_SPELL('method_name')} AS short_name FROM decl), named AS (SELECT *, short_name || '__' || {_SPELL('params')} AS long_name FROM named0)"
_LINES = f"{_NAMED}, lines AS (SELECT 'lib' || CAST(decl % 10 AS VARCHAR) || '.so' AS library, CASE decl % 4 WHEN 0 THEN long_name WHEN 1 THEN short_name WHEN 2 THEN 'other' || CAST(decl AS VARCHAR) ELSE short_name END || CASE decl % 5 WHEN 4 THEN ' U' ELSE ' T 1f' || CAST(decl AS VARCHAR) || ' 20' END AS line FROM named)"
_SYMBOLS = f"{_LINES}, symbols AS (SELECT DISTINCT library, part[1] AS symbol, part[2] AS kind, CAST('0x' || part[3] AS BIGINT) AS address FROM (SELECT library, string_split(line, ' ') AS part FROM lines) WHERE len(part) >= 3 AND part[2] <> 'U')"
_MAPPED = f"{_SYMBOLS}, mapped AS (SELECT decl, CASE WHEN l.symbol IS NOT NULL THEN 'exact_long' WHEN s.symbol IS NOT NULL AND sharing = 1 THEN 'exact_short' WHEN s.symbol IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS kind FROM (SELECT *, count(*) OVER (PARTITION BY short_name) AS sharing FROM named) LEFT JOIN (SELECT DISTINCT symbol FROM symbols) l ON l.symbol = long_name LEFT JOIN (SELECT DISTINCT symbol FROM symbols) s ON s.symbol = short_name)"


def _named(spark, sf):
    return native.jni_names(spark.sql(_DECL, part=spark.read.parquet(f"{sf}/part.parquet")))


def _symbols(spark, sf):
    d, text = F.col("decl"), F.col("decl").cast("string")
    name = F.when(d % 4 == 0, F.col("long_name")).when(d % 4 == 2, F.concat(F.lit("other"), text)).otherwise(F.col("short_name"))
    tail = F.when(d % 5 == 4, " U").otherwise(F.concat(F.lit(" T 1f"), text, F.lit(" 20")))
    lines = _named(spark, sf).select(F.concat(F.lit("lib"), (d % 10).cast("string"), F.lit(".so")).alias("library"), F.concat(name, tail).alias("line"))
    return native.parse_nm(lines)


@_query("fn12_jni_names", f"WITH {_NAMED} SELECT decl, class_name, method_name, params, short_name, long_name FROM named")
def _(spark, sf):
    return _named(spark, sf)


@_query("src8_parse_nm", f"WITH {_SYMBOLS} SELECT * FROM symbols")
def _(spark, sf):
    return _symbols(spark, sf)


@_query("jn8_jni_mappings", f"WITH {_MAPPED} SELECT decl, kind, CASE kind WHEN 'exact_long' THEN 1.0::DOUBLE WHEN 'exact_short' THEN 0.9::DOUBLE WHEN 'ambiguous' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM mapped")
def _(spark, sf):
    return native.jni_mappings(_named(spark, sf), _symbols(spark, sf))


@_query("agg11_jni_metrics", f"WITH {_MAPPED} SELECT " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("exact_long", "exact_short", "ambiguous", "unresolved")) + ", count(*) AS n FROM mapped")
def _(spark, sf):
    return native.jni_metrics(native.jni_mappings(_named(spark, sf), _symbols(spark, sf)))


@_query("jn9_library_loads", """WITH libs AS (SELECT DISTINCT 'lib' || CAST(s_suppkey % 10 AS VARCHAR) || '.so' AS filename, CASE s_nationkey % 2 WHEN 0 THEN 'arm64-v8a' ELSE 'x86_64' END AS abi FROM supplier),
  loads AS (SELECT p_partkey AS load_id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey % 14 AS VARCHAR) WHEN 1 THEN 'lib' || CAST(p_partkey % 14 AS VARCHAR) || '.so' ELSE '/data/x/lib' || CAST(p_partkey % 14 AS VARCHAR) || '.so' END AS requested FROM part)
  SELECT load_id, requested, filename, abi FROM loads LEFT JOIN libs ON filename = regexp_extract(requested, '[^/]*$') OR filename = 'lib' || requested || '.so'""")
def _(spark, sf):
    libs = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("lib"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".so")).alias("filename"), F.when(F.col("s_nationkey") % 2 == 0, "arm64-v8a").otherwise("x86_64").alias("abi"))
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 14).cast("string")
    requested = F.when(k % 3 == 0, n).when(k % 3 == 1, F.concat(F.lit("lib"), n, F.lit(".so"))).otherwise(F.concat(F.lit("/data/x/lib"), n, F.lit(".so")))
    return native.library_loads(spark.read.parquet(f"{sf}/part.parquet").select(k.alias("load_id"), requested.alias("requested")), libs)


# ---- bytecode and scalars ----
@_query("fn14_call_kind", oracle("SELECT apk, regexp_extract(opcode, '^invoke-(static|direct|super|virtual|interface)', 1) AS kind, count(*) AS n FROM calls GROUP BY 1, 2", "v_instr", also=c._CALLS))
def _(spark, sf):
    return bytecode.invokes(view(spark, sf, "v_instr")).groupBy("apk", scalars.call_kind(F.col("opcode")).alias("kind")).agg(F.count("*").alias("n"))


_PARAMS = r"regexp_extract_all(regexp_extract(descriptor, '^\(([^)]*)\)', 1), '\[*(?:[ZBSCIJFD]|L[^;]+;)')"


@_query("fn10_param_types", oracle(f"SELECT apk, method, idx, array_to_string({_PARAMS}, ',') AS types, CAST(len({_PARAMS}) + len(list_filter({_PARAMS}, lambda t: t IN ('J', 'D'))) AS INT) AS words FROM calls", "v_instr", also=c._CALLS))
def _(spark, sf):
    types = scalars.param_types(F.col("descriptor"))
    return bytecode.invokes(view(spark, sf, "v_instr")).select("apk", "method", "idx", F.concat_ws(",", types).alias("types"), scalars.register_words(types).alias("words"))


@_query("cfg3_reachable", "WITH RECURSIVE" + oracle("SELECT DISTINCT apk, method, start, node FROM far", "v_instr", also=f"""{c._EDGES},
  far AS (SELECT DISTINCT apk, method, src AS start, dst AS node FROM edges WHERE (apk, method, src) IN (SELECT (apk, method, src) FROM edges WHERE kind = 'branch') UNION SELECT f.apk, f.method, f.start, e.dst FROM far f JOIN edges e ON e.apk = f.apk AND e.method = f.method AND e.src = f.node)""").removeprefix("WITH"))
def _(spark, sf):
    return bytecode.reachable(bytecode.cfg_edges(view(spark, sf, "v_instr")), cut)


@_query("win3_merge_methods", oracle("""SELECT apk, method, full_signature, flags, backend, priority FROM (SELECT *, row_number() OVER (PARTITION BY apk, full_signature ORDER BY priority, method) AS rn FROM (SELECT *, CASE WHEN flags ILIKE '%native%' OR flags ILIKE '%abstract%' THEN 2 ELSE 0 END + CASE backend WHEN 'smali' THEN 0 ELSE 1 END AS priority FROM
  (SELECT * FROM v_method UNION ALL SELECT apk, method, full_signature, CASE WHEN method % 3 = 0 THEN 'public' ELSE flags END, CASE backend WHEN 'smali' THEN 'raw' ELSE 'smali' END FROM v_method WHERE method % 5 = 0))) WHERE rn = 1""", "v_method"))
def _(spark, sf):
    a = view(spark, sf, "v_method")
    b = a.where("method % 5 = 0").withColumn("flags", F.when(F.col("method") % 3 == 0, "public").otherwise(F.col("flags"))).withColumn("backend", F.when(F.col("backend") == "smali", "raw").otherwise("smali"))
    return rules.merge_methods(a, b)


@_query("agg9_short_identifiers", oracle("SELECT *, segments >= 4 AND share >= 0.6 AS obfuscated FROM (SELECT apk, count(*) AS segments, round(CAST(count(*) FILTER (WHERE len(segment) <= 2) AS DOUBLE) / count(*), 6) AS share FROM (SELECT apk, unnest(string_split(name, '.')) AS segment FROM shown) GROUP BY 1)", "v_component", also=c._SHOWN))
def _(spark, sf):
    return rules.short_identifiers(c.triage.exported_components(view(spark, sf, "v_component")))


@_query("fn3_parse_bool", oracle("SELECT apk, no, coalesce(lower(trim(raw_exported)) = 'true', false) AS exported FROM v_component", "v_component"))
def _(spark, sf):
    return view(spark, sf, "v_component").select("apk", "no", scalars.parse_bool(F.col("raw_exported"), False).alias("exported"))


@_query("fn17_basename", oracle("SELECT event_id, regexp_extract(file, '[^/]*$') AS name FROM ev WHERE file IS NOT NULL", "v_log", also=c._EVENTS))
def _(spark, sf):
    return c._events(spark, sf).where("file IS NOT NULL").select("event_id", evidence.basename(F.col("file")).alias("name"))


@_query("fn19_size_mb", "SELECT doc_id, printf('%.2f MB', n_chars * 1000 / 1048576.0::DOUBLE) AS size FROM documents")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", scalars.size_mb(F.col("n_chars") * 1000).alias("size"))


# ---- rules and training joins ----
@_query("dq2_duplicates", oracle("SELECT apk_hash, count(*) AS n, min(source_path) AS first, max(source_path) AS last FROM v_apk GROUP BY 1 HAVING count(*) > 1", "v_apk"))
def _(spark, sf):
    return rules.duplicates(view(spark, sf, "v_apk"), "apk_hash", "source_path")


@_query("dq2_conflicting_rows", oracle("SELECT *, count(*) OVER (PARTITION BY apk_hash) AS n_rows FROM v_apk QUALIFY n_rows > 1", "v_apk"))
def _(spark, sf):
    return rules.conflicting_rows(view(spark, sf, "v_apk"), "apk_hash")


@_query("dq4_violations", oracle("SELECT 'probability in 0 to 1' AS rule, count(*) FILTER (WHERE NOT probability BETWEEN 0 AND 1) AS n FROM v_slice_score UNION ALL SELECT 'probability below 0.9', count(*) FILTER (WHERE NOT probability < 0.9) FROM v_slice_score", "v_slice_score"))
def _(spark, sf):
    p = F.col("probability")
    return rules.violations(view(spark, sf, "v_slice_score"), {"probability in 0 to 1": p.between(0, 1), "probability below 0.9": p < 0.9})


@_query("dq5_verify_content", "SELECT doc_id, length(text) = n_chars AS size_holds, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.length("text") == F.col("n_chars")).alias("size_holds"), F.sha2("text", 256).alias("sha256"))


_U = c._UNIQUE
_SPLIT = c.ORACLES["win7_stratified_split"].removeprefix("WITH ")


@_query("jn13_key_coverage", oracle("SELECT coalesce(a.k, b.k) AS apk_hash, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS state FROM (SELECT apk_hash AS k FROM uniq WHERE apk_size_bytes % 3 <> 0) a FULL JOIN (SELECT apk_hash AS k FROM uniq WHERE apk_size_bytes % 5 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL", "v_apk", also=_U))
def _(spark, sf):
    u = c._unique(spark, sf)
    return rules.key_coverage(u.where("apk_size_bytes % 3 <> 0"), u.where("apk_size_bytes % 5 <> 0"), "apk_hash")


@_query("jn14_omitted_sinks", oracle("SELECT apk, method, idx, rule_id, category FROM (SELECT *, row_number() OVER (PARTITION BY apk ORDER BY turn, category) AS place FROM (SELECT *, row_number() OVER (PARTITION BY apk, category ORDER BY method, idx, rule_id) AS turn FROM sinks)) WHERE place > 8", "v_instr", also=c._FOUND))
def _(spark, sf):
    every = c._sinks(spark, sf)
    return rules.omitted(every, dataset.select_by_category(every, 8), ["apk", "method", "idx", "rule_id", "category"]).select("apk", "method", "idx", "rule_id", "category")


@_query("set5_mapping_digest", oracle("SELECT count(*) AS n, CAST(CAST(sum(CAST('0x' || substr(sha256(apk_hash || ':' || label), 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS digest FROM uniq", "v_apk", also=_U))
def _(spark, sf):
    return rules.mapping_digest(c._unique(spark, sf), "apk_hash", "label")


@_query("jn11_training_examples", oracle("SELECT example_id, t.apk_hash, CASE s.label WHEN 'Malicious' THEN 1 ELSE 0 END AS label_id, token_count FROM (SELECT example_id, sha256(text) AS apk_hash, token_count FROM v_token JOIN documents ON doc_id = example_id) t JOIN split s ON s.apk_hash = t.apk_hash WHERE split = 'train'", "v_token", also=f"split AS (WITH {_SPLIT})"))
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("example_id"), F.sha2("text", 256).alias("apk_hash"))
    tokens = view(spark, sf, "v_token").select("example_id", "token_count").join(docs, "example_id")
    return rules.training_examples(dataset.stratified_split(c._unique(spark, sf)), tokens, "train")


@_query("ded3_admit", oracle("SELECT a.apk_hash, coalesce(b.job, a.job) AS job, b.job IS NULL AS is_new FROM (SELECT apk_hash, min(source_path) AS job FROM v_apk WHERE apk_size_bytes % 2 = 0 GROUP BY 1) a LEFT JOIN (SELECT apk_hash, min(source_path) AS job FROM v_apk WHERE label = 'Benign' GROUP BY 1) b USING (apk_hash)", "v_apk"))
def _(spark, sf):
    files = view(spark, sf, "v_apk").withColumnRenamed("source_path", "job")
    return rules.admit(files.where("apk_size_bytes % 2 = 0"), files.where("label = 'Benign'"), "apk_hash", "job")


@_query("win11_occurrences", oracle("SELECT apk_hash, source_path, row_number() OVER (PARTITION BY apk_hash ORDER BY source_path) AS occurrence FROM v_apk", "v_apk"))
def _(spark, sf):
    return rules.occurrences(view(spark, sf, "v_apk"), "apk_hash", "source_path").select("apk_hash", "source_path", "occurrence")


@_query("win10_cap_per_class", oracle("SELECT label, source_path, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY source_path) AS rank FROM v_apk) WHERE rank <= 250", "v_apk"))
def _(spark, sf):
    return rules.top(view(spark, sf, "v_apk"), "label", 250, F.col("source_path")).select("label", "source_path", "rank")


@_query("srt4_top_blocks", oracle("SELECT apk, slice_id, probability, rank FROM (SELECT *, row_number() OVER (PARTITION BY apk ORDER BY probability DESC, slice_id) AS rank FROM v_slice_score) WHERE rank <= 3", "v_slice_score"))
def _(spark, sf):
    return rules.top(view(spark, sf, "v_slice_score"), "apk", 3, F.desc("probability"), F.col("slice_id"))


@_query("agg13_inventory_counts", oracle("SELECT count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'zero_sink') AS zero_sink, count(*) FILTER (WHERE is_truncated) AS truncated, count(DISTINCT apk_hash) AS packages FROM v_token", "v_token"))
def _(spark, sf):
    status = F.col("status")
    return view(spark, sf, "v_token").agg(F.count("*").alias("n"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "zero_sink").alias("zero_sink"), F.count_if("is_truncated").alias("truncated"), F.countDistinct("apk_hash").alias("packages"))


@_query("agg4_status_counts", oracle("SELECT label, status, count(*) AS n FROM v_token GROUP BY 1, 2", "v_token"))
def _(spark, sf):
    return view(spark, sf, "v_token").groupBy("label", "status").agg(F.count("*").alias("n"))
