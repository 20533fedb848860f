"""All queries of the engine's own operators and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import bytecode, dataset, rules as checks, telemetry, triage
from tracequarry.plans import rules
from tracequarry.plans.views import oracle, view
from tracequarry.sources.shared import cut

_COMBOS = rules.sql_values([(k, f"android.permission.{p}", len(v)) for k, v in rules.COMBINATIONS.items() for p in v], "combination, permission, needed")
_SINKS = rules.sql_values(rules.SINKS, "rule_id, category, class_name, method_name, descriptor")
_INDICATORS = rules.sql_values([("reflection", *x) for x in rules.REFLECTION] + [("dynamic_loading", *x) for x in rules.LOADING], "indicator, class_name, method_name")
_ACTIONS = ", ".join(f"'{a}'" for a in rules.ENTRY_ACTIONS)

# ---- pieces of SQL that several statements share ----
_HELD = f"combos AS (SELECT p.apk, r.combination FROM v_perm p JOIN {_COMBOS} r ON p.permission = r.permission GROUP BY p.apk, r.combination, r.needed HAVING count(*) = r.needed)"
_SHOWN = """shown AS (SELECT apk, no, kind, CASE WHEN raw_name LIKE '.%' THEN 'p' || CAST(apk AS VARCHAR) || raw_name WHEN raw_name NOT LIKE '%.%' THEN 'p' || CAST(apk AS VARCHAR) || '.' || raw_name ELSE raw_name END AS name, action,
  CASE WHEN raw_exported IS NOT NULL THEN raw_exported = 'true' WHEN kind = 'provider' THEN coalesce(target_sdk <= 16, false) ELSE has_filter AND coalesce(target_sdk < 31, true) END AS exported FROM v_component)"""
_TRIAGED = f"""{_HELD}, {_SHOWN}, triaged AS (SELECT apk, coalesce(c, 0) AS combos, coalesce(e, 0) AS exported, round(least(least(20.0 * coalesce(c, 0), 50) + least(1.5 * coalesce(e, 0), 12), 100), 2)::DOUBLE AS score
  FROM (SELECT apk, count(*) AS c FROM combos GROUP BY 1) FULL JOIN (SELECT apk, count(*) FILTER (exported) AS e FROM shown GROUP BY 1) USING (apk))"""
_CALLS = r"calls AS (SELECT apk, method, idx, opcode, regexp_extract(call, '(L[^,\s]+;)->([^\s(]+)(\([^)]*\).+)$', 1) AS class_name, regexp_extract(call, '(L[^,\s]+;)->([^\s(]+)(\([^)]*\).+)$', 2) AS method_name, regexp_extract(call, '(L[^,\s]+;)->([^\s(]+)(\([^)]*\).+)$', 3) AS descriptor FROM v_instr WHERE opcode LIKE 'invoke-%' AND call IS NOT NULL)"
_FOUND = f"{_CALLS}, sinks AS (SELECT DISTINCT c.apk, c.method, c.idx, r.rule_id, r.category FROM calls c JOIN {_SINKS} r ON c.class_name = r.class_name AND c.method_name = r.method_name AND (r.descriptor IS NULL OR r.descriptor = c.descriptor))"
_FULL = f"""{_HELD}, {_SHOWN}, {_CALLS},
markers AS (SELECT apk, count(DISTINCT marker) FILTER (indicator = 'reflection') AS reflection, count(DISTINCT marker) FILTER (indicator = 'dynamic_loading') AS loading FROM
  (SELECT apk, indicator, CASE WHEN class_name LIKE 'Ldalvik/system/%' THEN class_name ELSE class_name || '->' || method_name END AS marker FROM calls JOIN {_INDICATORS} r USING (class_name, method_name)) GROUP BY 1),
short AS (SELECT apk, (count(*) >= 4 AND round(CAST(count(*) FILTER (len(segment) <= 2) AS DOUBLE) / count(*), 6) >= 0.6)::BIGINT AS short FROM (SELECT apk, unnest(string_split(name, '.')) AS segment FROM shown) GROUP BY 1),
packages AS (SELECT apk FROM v_perm UNION SELECT apk FROM v_component UNION SELECT apk FROM v_instr),
counted AS (SELECT apk, coalesce(c, 0) AS combos, coalesce(e, 0) AS exported, coalesce(reflection, 0) AS reflection, coalesce(loading, 0) AS loading, coalesce(short, 0) + (coalesce(reflection, 0) > 0)::BIGINT + (coalesce(loading, 0) > 0)::BIGINT AS obfuscation, apk NOT IN (SELECT apk FROM v_instr) AS warned
  FROM packages LEFT JOIN (SELECT apk, count(*) AS c FROM combos GROUP BY 1) USING (apk) LEFT JOIN (SELECT apk, count(*) FILTER (exported) AS e FROM shown GROUP BY 1) USING (apk) LEFT JOIN markers USING (apk) LEFT JOIN short USING (apk)),
full_score AS (SELECT *, round(least(least(20.0 * combos, 50) + least(1.5 * exported, 12) + least(6.0 * reflection, 12) + least(8.0 * loading, 16) + least(5.0 * obfuscation, 10), 100), 2)::DOUBLE AS score FROM counted),
full_triage AS (SELECT apk, combos, exported, reflection, loading, obfuscation, score, score >= 60 OR combos > 0 OR loading > 0 OR obfuscation > 0 OR warned AS needs_dynamic FROM full_score)"""
_EDGES = """code AS (SELECT *, max(idx) OVER (PARTITION BY apk, method) AS last FROM v_instr),
edges AS (SELECT apk, method, idx AS src, idx + 1 AS dst, 'fallthrough' AS kind FROM code WHERE opcode NOT LIKE 'return%' AND opcode <> 'goto' AND idx < last
  UNION SELECT apk, method, idx, target, CASE WHEN opcode = 'goto' THEN 'goto' ELSE 'branch' END FROM code WHERE (opcode LIKE 'if-%' OR opcode = 'goto') AND target <= last)"""
_EVENTS = r"""ev0 AS (SELECT event_id, session, ts, nullif(regexp_extract(line, '^\[Sandbox\] File (read|write|access): (.*)$', 2), '') AS file, nullif(regexp_extract(line, '^\[Sandbox\] Network connection: (.*):(\d+)$', 1), '') AS ip,
  CAST(nullif(regexp_extract(line, '^\[Sandbox\] Network connection: (.*):(\d+)$', 2), '') AS INT) AS port, '/lib/arm64/lib' || nullif(regexp_extract(line, '^\[Sandbox\] Native library loaded: (.*)$', 1), '') || '.so' AS library,
  line LIKE '%Root check blocked%' AS root, line LIKE '%CertificatePinner check bypassed%' AS ssl FROM v_log),
ev AS (SELECT *, CASE WHEN root OR ssl THEN 'bypass' WHEN file IS NOT NULL THEN 'file' WHEN ip IS NOT NULL THEN 'socket' WHEN library IS NOT NULL THEN 'library' ELSE 'other' END AS kind FROM ev0)"""
_TELEMETRY = f"""{_EVENTS}, tele AS (SELECT session, bool_or(root) AS root, bool_or(ssl) AS ssl, coalesce(list_sort(list(DISTINCT file) FILTER (file IS NOT NULL)), []) AS files,
  coalesce(list_sort(list(DISTINCT {{'ip': ip, 'port': port}}) FILTER (ip IS NOT NULL)), []) AS sockets, coalesce(list_sort(list(DISTINCT library) FILTER (library IS NOT NULL)), []) AS libraries FROM ev GROUP BY 1)"""
_HAS = lambda *parts: " OR ".join(f"contains(f, '{p}')" for p in parts)
_FLAGGED = f"""{_TELEMETRY}, flagged AS (SELECT session, root, ssl, root OR ssl AS evasion, len(sockets) > 0 AS c2, len(files) > 0 AS writes, len(list_filter(files, lambda f: contains(lower(f), 'sms') OR contains(lower(f), 'telephony'))) > 0 AS sms,
  len(list_filter(files, lambda f: {_HAS('shared_prefs', 'data/user')})) > 0 AS banking, len(list_filter(files, lambda f: {_HAS('.dex', 'app_process')})) > 0 AS loading FROM tele),
dynamic AS (SELECT *, CASE WHEN c2 THEN 10 ELSE 0 END + CASE WHEN sms THEN 15 ELSE 0 END + CASE WHEN banking THEN 10 ELSE 0 END + CASE WHEN root THEN 12 ELSE 0 END + CASE WHEN loading THEN 8 ELSE 0 END + CASE WHEN writes THEN 5 ELSE 0 END AS dynamic_score FROM flagged)"""
_DISTRIBUTION = "count(token_count) AS n, round(avg(token_count), 6) AS mean, round(quantile_cont(token_count, 0.5), 6) AS median, round(quantile_cont(token_count, 0.9), 6) AS p90, round(quantile_cont(token_count, 0.95), 6) AS p95, round(quantile_cont(token_count, 0.99), 6) AS p99, max(token_count) AS most"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _triaged(spark: SparkSession, sf: str) -> DataFrame:
    return triage.triage(view(spark, sf, "v_perm"), view(spark, sf, "v_component"), rules.combinations(spark))


def _full_triage(spark: SparkSession, sf: str) -> DataFrame:
    """With the terms of the code; a package without instructions is one without code, which is a warning."""
    perms, components, instr = (view(spark, sf, v) for v in ("v_perm", "v_component", "v_instr"))
    packages = perms.select("apk").union(components.select("apk")).union(instr.select("apk")).distinct()
    names = checks.short_identifiers(triage.exported_components(components)).unionByName(instr.select("apk").distinct(), allowMissingColumns=True).groupBy("apk").agg(F.bool_or("obfuscated").alias("obfuscated"))
    return triage.full_triage(perms, components, rules.combinations(spark), bytecode.code_markers(instr, rules.indicators(spark)), names, packages.join(instr.select("apk").distinct(), "apk", "left_anti"))


def _sinks(spark: SparkSession, sf: str) -> DataFrame:
    return bytecode.find_sinks(view(spark, sf, "v_instr"), rules.sinks(spark))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.parse_log(view(spark, sf, "v_log"))


def _telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.accumulate_sessions(_events(spark, sf))


# ---- triage ----
@_query("jn3_permission_combos", oracle("SELECT * FROM combos", "v_perm", also=_HELD))
def _(spark, sf):
    return triage.permission_combos(view(spark, sf, "v_perm"), rules.combinations(spark))


@_query("flt7_exported_components", oracle("SELECT apk, no, kind, name, exported FROM shown", "v_component", also=_SHOWN))
def _(spark, sf):
    return triage.exported_components(view(spark, sf, "v_component")).drop("action")


@_query("jn4_entry_points", oracle(f"SELECT DISTINCT apk, name FROM shown WHERE action IN ({_ACTIONS})", "v_component", also=_SHOWN))
def _(spark, sf):
    return triage.entry_points(view(spark, sf, "v_component"))


@_query("sco1_triage_score", oracle("SELECT *, score >= 60 OR combos > 0 AS needs_dynamic FROM triaged", "v_perm", "v_component", also=_TRIAGED))
def _(spark, sf):
    return _triaged(spark, sf)


@_query("srt1_priority_queue", oracle("SELECT *, score >= 60 OR combos > 0 AS needs_dynamic FROM triaged ORDER BY score DESC, apk LIMIT 100", "v_perm", "v_component", also=_TRIAGED))
def _(spark, sf):
    return triage.priority_queue(_triaged(spark, sf), 100)


@_query("sco2_full_triage", oracle("SELECT * FROM full_triage", "v_perm", "v_component", "v_instr", also=_FULL))
def _(spark, sf):
    return _full_triage(spark, sf)


@_query("srt1_full_queue", oracle("SELECT * FROM full_triage ORDER BY score DESC, apk LIMIT 100", "v_perm", "v_component", "v_instr", also=_FULL))
def _(spark, sf):
    return triage.priority_queue(_full_triage(spark, sf), 100)


# ---- bytecode ----
@_query("fn6_method_ref", oracle("SELECT apk, method, idx, opcode, class_name, method_name, descriptor FROM calls", "v_instr", also=_CALLS))
def _(spark, sf):
    return bytecode.invokes(view(spark, sf, "v_instr"))


@_query("jn1_find_sinks", oracle("SELECT * FROM sinks", "v_instr", also=_FOUND))
def _(spark, sf):
    return _sinks(spark, sf)


@_query("jn2_call_indicators", oracle(f"SELECT apk, indicator, count(DISTINCT (class_name, method_name, descriptor)) AS n FROM calls JOIN {_INDICATORS} r USING (class_name, method_name) GROUP BY 1, 2", "v_instr", also=_CALLS))
def _(spark, sf):
    return bytecode.call_indicators(view(spark, sf, "v_instr"), rules.indicators(spark))


@_query("win1_neighbours", oracle("SELECT apk, method, idx, opcode, lag(opcode) OVER w AS before, lead(opcode) OVER w AS after FROM v_instr WINDOW w AS (PARTITION BY apk, method ORDER BY idx)", "v_instr"))
def _(spark, sf):
    return bytecode.with_neighbours(view(spark, sf, "v_instr"))


@_query("cfg1_edges", oracle("SELECT * FROM edges", "v_instr", also=_EDGES))
def _(spark, sf):
    return bytecode.cfg_edges(view(spark, sf, "v_instr"))


@_query("cfg2_adjacency", oracle("SELECT apk, method, dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS predecessors FROM (SELECT DISTINCT apk, method, src, dst FROM edges) GROUP BY 1, 2, 3", "v_instr", also=_EDGES))
def _(spark, sf):
    edges = bytecode.cfg_edges(view(spark, sf, "v_instr"))
    return edges.groupBy("apk", "method", "dst").agg(F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda x: x.cast("string")), ",").alias("predecessors"))


_USES = """du AS (SELECT apk, method, idx, CASE WHEN opcode LIKE 'const%' OR opcode LIKE 'move%' OR opcode LIKE 'iget%' OR opcode LIKE 'sget%' OR opcode LIKE 'add%' THEN reg END AS def,
  CASE WHEN opcode LIKE 'move%' OR opcode LIKE 'iget%' THEN [reg2] WHEN opcode LIKE 'add%' THEN list_distinct([reg, reg2]) WHEN opcode LIKE 'if-%' THEN [reg] WHEN opcode LIKE 'invoke-%' OR opcode = 'aput' THEN list_distinct([reg, reg2]) ELSE [] END AS uses FROM v_instr)"""


@_query("slc1_backward_slices", "WITH RECURSIVE" + oracle(
    """SELECT DISTINCT apk, method, sink, idx FROM (SELECT apk, method, sink, sink AS idx FROM seed UNION ALL SELECT l.apk, l.method, l.sink, e.src FROM live l JOIN edges e ON e.apk = l.apk AND e.method = l.method AND e.dst = l.pos
       JOIN du ON du.apk = l.apk AND du.method = l.method AND du.idx = e.src AND du.def = l.sym)""", "v_instr",
    also=f"""{_FOUND}, {_EDGES}, {_USES}, seed AS (SELECT DISTINCT apk, method, idx AS sink FROM sinks),
live AS (SELECT s.apk, s.method, s.sink, s.sink AS pos, unnest(uses) AS sym FROM seed s JOIN du ON du.apk = s.apk AND du.method = s.method AND du.idx = s.sink
  UNION SELECT apk, method, sink, pos, unnest(CASE WHEN def = sym THEN uses ELSE [sym] END) FROM (SELECT l.apk, l.method, l.sink, e.src AS pos, l.sym, du.def, du.uses FROM live l JOIN edges e ON e.apk = l.apk AND e.method = l.method AND e.dst = l.pos
    JOIN du ON du.apk = l.apk AND du.method = l.method AND du.idx = e.src))""").removeprefix("WITH"))  # fmt: skip
def _(spark, sf):
    instr = view(spark, sf, "v_instr")
    return bytecode.backward_slices(instr, bytecode.find_sinks(instr, rules.sinks(spark)), cut)


@_query("flt1_usable_methods", oracle("SELECT apk, method, full_signature, backend, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(flags, ','), lambda x: lower(trim(x))), lambda x: x <> ''))), ',') AS flags FROM v_method WHERE flags NOT ILIKE '%native%' AND flags NOT ILIKE '%abstract%'", "v_method"))
def _(spark, sf):
    return bytecode.usable_methods(view(spark, sf, "v_method"))


@_query("agg6_category_counts", oracle("SELECT apk, category, count(*) AS n FROM sinks GROUP BY 1, 2", "v_instr", also=_FOUND))
def _(spark, sf):
    return _sinks(spark, sf).groupBy("apk", "category").agg(F.count("*").alias("n"))


@_query("win2_select_by_category", oracle("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY apk ORDER BY turn, category) AS place FROM (SELECT *, row_number() OVER (PARTITION BY apk, category ORDER BY method, idx, rule_id) AS turn FROM sinks)) WHERE place <= 8", "v_instr", also=_FOUND).replace("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY apk ORDER", "SELECT apk, method, idx, rule_id, category, place FROM (SELECT *, row_number() OVER (PARTITION BY apk ORDER"))
def _(spark, sf):
    return dataset.select_by_category(_sinks(spark, sf), 8)


@_query("slc7_bounded_slices", oracle("SELECT * FROM (SELECT apk, sink_order, n, CAST(sum(n) OVER (PARTITION BY apk ORDER BY sink_order ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM (SELECT apk, method AS sink_order, count(*) AS n FROM v_instr GROUP BY 1, 2)) WHERE total <= 40", "v_instr"))
def _(spark, sf):
    sizes = view(spark, sf, "v_instr").groupBy("apk", F.col("method").alias("sink_order")).agg(F.count("*").alias("n"))
    return dataset.bounded_slices(sizes, 40)


@_query("agg18_reflection_density", oracle("SELECT apk, round(CAST(count(*) FILTER (class_name LIKE 'Ljava/lang/reflect/%' OR class_name = 'Ljava/lang/Class;') AS DOUBLE) / count(*), 6) AS density FROM calls GROUP BY 1", "v_instr", also=_CALLS))
def _(spark, sf):
    reflecting = F.col("class_name").startswith("Ljava/lang/reflect/") | (F.col("class_name") == "Ljava/lang/Class;")
    return bytecode.invokes(view(spark, sf, "v_instr")).groupBy("apk").agg(F.round(F.count_if(reflecting) / F.count("*"), 6).alias("density"))


# ---- dataset ----
_UNIQUE = "uniq AS (SELECT apk_hash, min(label) AS label, min(apk_size_bytes) AS apk_size_bytes FROM v_apk GROUP BY 1)"


def _unique(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.dedup_by_content(view(spark, sf, "v_apk")).select("apk_hash", "label", "apk_size_bytes")


@_query("ded1_dedup_by_content", oracle("SELECT apk_hash, min(label) AS label, min(apk_size_bytes) AS apk_size_bytes, min(source_path) AS source_path, array_to_string(list_sort(list(source_path))[2:], ',') AS duplicate_source_paths FROM v_apk GROUP BY 1", "v_apk"))
def _(spark, sf):
    return dataset.dedup_by_content(view(spark, sf, "v_apk"))


@_query("ded2_label_conflicts", oracle("SELECT apk_hash, count(DISTINCT label) AS labels, count(*) AS n FROM v_apk GROUP BY 1 HAVING count(DISTINCT label) > 1", "v_apk"))
def _(spark, sf):
    return dataset.label_conflicts(view(spark, sf, "v_apk"))


@_query("win7_stratified_split", oracle("""SELECT apk_hash, label, CASE WHEN rn <= q0 THEN 'train' WHEN rn <= q0 + q1 THEN 'validation' ELSE 'test' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || label || ':' || apk_hash)) AS rn FROM uniq) JOIN
  (SELECT label, f0 + (CASE WHEN (r1 > r0)::INT + (r2 > r0)::INT < spare THEN 1 ELSE 0 END) AS q0, f1 + (CASE WHEN (r0 >= r1)::INT + (r2 > r1)::INT < spare THEN 1 ELSE 0 END) AS q1 FROM
    (SELECT *, n - f0 - f1 - f2 AS spare, round(n * 0.7::DOUBLE - f0, 9) AS r0, round(n * 0.15::DOUBLE - f1, 9) AS r1, round(n * 0.15::DOUBLE - f2, 9) AS r2 FROM
      (SELECT label, n, floor(n * 0.7::DOUBLE)::BIGINT AS f0, floor(n * 0.15::DOUBLE)::BIGINT AS f1, floor(n * 0.15::DOUBLE)::BIGINT AS f2 FROM (SELECT label, count(*) AS n FROM uniq GROUP BY 1)))) USING (label)""", "v_apk", also=_UNIQUE))
def _(spark, sf):
    return dataset.stratified_split(_unique(spark, sf), cut=cut)


@_query("win8_limit_per_class", oracle("SELECT apk_hash, label, apk_size_bytes FROM uniq QUALIFY row_number() OVER (PARTITION BY label ORDER BY apk_size_bytes, apk_hash) <= 50", "v_apk", also=_UNIQUE))
def _(spark, sf):
    return dataset.limit_per_class(_unique(spark, sf), 50)


@_query("win9_size_quantiles", oracle("SELECT apk_hash, label, apk_size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY apk_size_bytes, apk_hash) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM uniq) WHERE list_contains(list_transform(range(5), lambda i: round_even(i * (n - 1) / 4.0::DOUBLE, 0)::BIGINT), rank)", "v_apk", also=_UNIQUE))
def _(spark, sf):
    return dataset.size_quantiles(_unique(spark, sf), 5, cut)


@_query("agg2_token_length", oracle(f"SELECT {_DISTRIBUTION}, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (token_count > {t}) / count(token_count), 6) AS over_{t}" for t in (512, 1024, 2048, 4096, 8192)) + " FROM v_token", "v_token"))
def _(spark, sf):
    return view(spark, sf, "v_token").agg(*dataset.token_length_distribution("token_count"))


@_query("agg3_grouped_statistics", oracle(" UNION ALL ".join(f"SELECT '{c}' AS grouping, {'CAST(' + c + ' AS VARCHAR)' if c != 'all' else chr(39) + 'all' + chr(39)} AS value, {_DISTRIBUTION} FROM v_token" + (f" GROUP BY {c}" if c != "all" else "") for c in ("all", *dataset.GROUPINGS)), "v_token"))
def _(spark, sf):
    return dataset.grouped_statistics(view(spark, sf, "v_token"))


@_query("agg5_apk_tokens", oracle("SELECT apk_hash, count(*) AS slices, count(*) FILTER (NOT is_truncated) AS complete, count(*) FILTER (is_truncated) AS truncated, CAST(sum(token_count) AS BIGINT) AS total, round(avg(token_count), 6) AS mean, max(token_count) AS most FROM v_token GROUP BY 1", "v_token"))
def _(spark, sf):
    return dataset.apk_token_statistics(view(spark, sf, "v_token"))


@_query("ml3_class_weights", oracle("SELECT label, count(*) AS n, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight FROM v_token GROUP BY 1", "v_token"))
def _(spark, sf):
    return dataset.class_weights(view(spark, sf, "v_token"))


@_query("flt8_terminal_status", oracle("SELECT status, count(*) AS n FROM v_token WHERE status IN ('completed', 'completed_with_truncation', 'capped', 'zero_sink') GROUP BY 1", "v_token"))
def _(spark, sf):
    return view(spark, sf, "v_token").where(F.col("status").isin("completed", "completed_with_truncation", "capped", "zero_sink")).groupBy("status").agg(F.count("*").alias("n"))


@_query("set6_pending", oracle("SELECT DISTINCT apk_hash FROM v_token ANTI JOIN (SELECT apk_hash FROM v_token WHERE status = 'failed' GROUP BY 1 HAVING count(*) > 7) d USING (apk_hash)", "v_token"))
def _(spark, sf):
    tokens = view(spark, sf, "v_token")
    done = tokens.where("status = 'failed'").groupBy("apk_hash").count().where("count > 7")
    return tokens.select("apk_hash").distinct().join(done, "apk_hash", "left_anti")


_RECORDED = "recorded AS (SELECT example_id, status, 'policy' || CAST(example_id % 3 AS VARCHAR) AS policy, 'tokens' || CAST(example_id % 5 AS VARCHAR) AS tokenizer FROM v_token)"


@_query("set6_unfinished", oracle("SELECT DISTINCT example_id FROM v_token WHERE example_id NOT IN (SELECT example_id FROM recorded WHERE status IN ('completed', 'completed_with_truncation', 'capped', 'zero_sink') AND policy = 'policy1' AND tokenizer = 'tokens2')", "v_token", also=_RECORDED))
def _(spark, sf):
    tokens = view(spark, sf, "v_token")
    of = lambda word, n: F.concat(F.lit(word), (F.col("example_id") % n).cast("string"))
    recorded = tokens.select("example_id", "status", of("policy", 3).alias("policy"), of("tokens", 5).alias("tokenizer"))
    return dataset.pending(tokens, recorded, "example_id", {"policy": "policy1", "tokenizer": "tokens2"})


@_query("agg16_decide", oracle("SELECT apk, max(probability) AS most, count(*) FILTER (probability >= 0.6) AS raised, bool_or(probability >= 0.85) OR count(*) FILTER (probability >= 0.6) >= 2 AS malicious FROM v_slice_score GROUP BY 1", "v_slice_score"))
def _(spark, sf):
    return dataset.decide(view(spark, sf, "v_slice_score"))


# ---- telemetry ----
@_query("str1_parse_log", oracle("SELECT * FROM ev", "v_log", also=_EVENTS))
def _(spark, sf):
    return _events(spark, sf)


@_query("str2_first_seen", oracle("SELECT session, kind, coalesce(file, ip || ':' || CAST(port AS VARCHAR), library) AS item, min(ts) AS first_ts, count(*) AS n FROM ev WHERE kind IN ('file', 'socket', 'library') GROUP BY 1, 2, 3", "v_log", also=_EVENTS))
def _(spark, sf):
    return telemetry.first_seen(_events(spark, sf))


@_query("str3_accumulate_sessions", oracle("SELECT session, root, ssl, array_to_string(files, ',') AS files, array_to_string(list_transform(sockets, lambda s: s.ip || ':' || CAST(s.port AS VARCHAR)), ',') AS sockets, array_to_string(libraries, ',') AS libraries FROM tele", "v_log", also=_TELEMETRY))
def _(spark, sf):
    return telemetry.flat(_telemetry(spark, sf))


@_query("str4_observation_windows", oracle("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, kind, count(*) AS n FROM ev GROUP BY 1, 2", "v_log", also=_EVENTS))
def _(spark, sf):
    return telemetry.windowed_counts(_events(spark, sf), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("str7_job_state", oracle("SELECT session, arg_max(line, (ts, event_id)) AS last_line, max(ts) AS ts FROM v_log GROUP BY 1", "v_log"))
def _(spark, sf):
    return view(spark, sf, "v_log").groupBy("session").agg(F.max_by("line", F.struct("ts", "event_id")).alias("last_line"), F.max("ts").alias("ts"))


@_query("sco7_behaviour_flags", oracle("SELECT session, sms, c2, banking, root, loading, evasion, dynamic_score FROM dynamic", "v_log", also=_FLAGGED))
def _(spark, sf):
    return telemetry.dynamic_score(telemetry.behaviour_flags(_telemetry(spark, sf))).select("session", "sms", "c2", "banking", "root", "loading", "evasion", "dynamic_score")


@_query("fus1_fuse", oracle("""SELECT *, CASE WHEN label = 'PACKED_DROPPER' THEN greatest(total, 85) WHEN label = 'DORMANT_MALWARE' THEN greatest(total, base_score) WHEN label = 'SANDBOX_EVASION_DETECTED' THEN greatest(total, 75) WHEN label = 'LIKELY_BENIGN' AND base_score <= 50 THEN least(total, 30) ELSE total END AS score FROM
  (SELECT *, least(base_score + dynamic_score, 100) AS total, CASE WHEN evasion AND base_score < 60 THEN 'SANDBOX_EVASION_DETECTED' WHEN base_score >= 60 AND (dynamic_score >= 15 OR c2) THEN 'CONFIRMED_MALWARE' WHEN base_score < 40 AND (dynamic_score >= 15 OR c2) THEN 'PACKED_DROPPER'
     WHEN base_score >= 60 THEN 'DORMANT_MALWARE' WHEN evasion THEN 'SANDBOX_EVASION_DETECTED' ELSE 'LIKELY_BENIGN' END AS label FROM
    (SELECT coalesce(s.apk, d.session) AS apk, CAST(round_even(100 * coalesce(p, 0), 0) AS INT) AS base_score, coalesce(dynamic_score, 0) AS dynamic_score, coalesce(c2, false) AS c2, coalesce(evasion, false) AS evasion
     FROM (SELECT apk, max(probability) AS p FROM v_slice_score GROUP BY 1) s FULL JOIN dynamic d ON s.apk = d.session))""".replace("SELECT *, CASE WHEN label", "SELECT apk, base_score, dynamic_score, c2, evasion, label, CASE WHEN label"), "v_log", "v_slice_score", also=_FLAGGED))
def _(spark, sf):
    static = view(spark, sf, "v_slice_score").groupBy("apk").agg(F.max("probability").alias("probability"))
    return telemetry.fuse(static, telemetry.dynamic_score(telemetry.behaviour_flags(_telemetry(spark, sf))))


_POINTS = f"""points AS (SELECT session, root, ssl, len(files) + len(sockets) > 0 OR root OR ssl AS observed, round(least(0.99, greatest(0.02, (5 + CASE WHEN root THEN 35 ELSE 0 END + CASE WHEN ssl THEN 30 ELSE 0 END
  + coalesce(list_sum(list_transform(files, lambda f: CASE WHEN {_HAS('app_process', 'system', 'su')} THEN 20 WHEN {_HAS('Bot', 'zlock', 'contacts')} THEN 10 WHEN {_HAS('shared_prefs', 'config')} THEN 2 ELSE 0 END)), 0)
  + coalesce(list_sum(list_transform(sockets, lambda s: CASE WHEN s.port = 4444 THEN 45 ELSE 5 END)), 0)) / 100.0::DOUBLE)), 6)::DOUBLE AS probability FROM tele)"""


@_query("sco12_threat_probability", oracle("SELECT session, probability, CASE WHEN probability > 0.65 THEN 'MALICIOUS' WHEN probability > 0.30 THEN 'SUSPICIOUS' WHEN observed THEN 'LOW RISK' ELSE 'No malicious behavior observed in this run' END AS verdict FROM points", "v_log", also=f"{_TELEMETRY}, {_POINTS}"))
def _(spark, sf):
    return telemetry.threat_probability(_telemetry(spark, sf)).select("session", "probability", "verdict")


@_query("sco20_scorecard", oracle(f"""SELECT session, security, privacy, CASE WHEN security < 40 THEN 'F' WHEN security < 60 THEN 'D' WHEN security < 75 THEN 'C' WHEN security < 90 THEN 'B' ELSE 'A' END AS grade,
  CASE WHEN privacy > 65 THEN 'HIGH' WHEN privacy > 35 THEN 'MEDIUM' ELSE 'LOW' END AS privacy_level FROM (SELECT session, CAST(CASE WHEN penalty = 0 THEN 100 ELSE greatest(12, least(98, 100 - penalty)) END AS INT) AS security, CAST(least(95, private) AS INT) AS privacy FROM
  (SELECT session, CASE WHEN root THEN 30 ELSE 0 END + CASE WHEN ssl THEN 25 ELSE 0 END + coalesce(list_sum(list_transform(files, lambda f: CASE WHEN {_HAS('app_process', 'system', 'su')} THEN 15 WHEN {_HAS('shared_prefs', 'config')} THEN 1 WHEN contains(f, '/proc/') THEN 2 ELSE 0 END)), 0)
    + coalesce(list_sum(list_transform(sockets, lambda s: CASE WHEN s.port = 4444 THEN 35 WHEN s.port IN (80, 443, 8080, 53) THEN 0 ELSE 3 END)), 0) AS penalty,
   coalesce(list_sum(list_transform(files, lambda f: CASE WHEN {_HAS('shared_prefs', 'config', 'user')} THEN 25 ELSE 0 END)), 0) + CASE WHEN len(sockets) > 0 THEN 20 ELSE 0 END + CASE WHEN ssl THEN 20 ELSE 0 END AS private FROM tele))""", "v_log", also=_TELEMETRY))
def _(spark, sf):
    return telemetry.scorecard(_telemetry(spark, sf)).select("session", "security", "privacy", "grade", "privacy_level")


@_query("sco25_iocs", oracle("SELECT DISTINCT ip AS indicator FROM ev WHERE ip IS NOT NULL", "v_log", also=_EVENTS))
def _(spark, sf):
    return _events(spark, sf).where("ip IS NOT NULL").select(F.col("ip").alias("indicator")).distinct()


@_query("ups1_latest", oracle("SELECT event_id, session, ts, line FROM v_log QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) = 1", "v_log"))
def _(spark, sf):
    return dataset.latest(view(spark, sf, "v_log"), "session", F.desc("ts"), F.desc("event_id"))


from tracequarry import catalog_reports  # noqa: E402, F401  registers its queries here
from tracequarry import catalog_code  # noqa: E402, F401
from tracequarry import catalog_build  # noqa: E402, F401
from tracequarry import catalog_graph  # noqa: E402, F401
from tracequarry import catalog_state  # noqa: E402, F401
