"""Queries of the bytecode text, control flow and slice text operators, with their SQL; `catalog` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry import catalog as c
from tracequarry.functions import code
from tracequarry.operators import flow, slice_text, slices
from tracequarry.plans import rules
from tracequarry.plans.views import oracle, view
from tracequarry.sources.shared import cut

_query = c._query
_OPERANDS = r"""list_filter(list_transform(regexp_extract_all(operands, '(?:\{[^}]*\}|"(?:\\.|[^"\\])*"|[^,{"])+'), lambda x: trim(x)), lambda x: x <> '')"""
_ORDERED = lambda x: f"list_transform(list_sort(list_transform(list_distinct({x}), lambda r: {{'at': list_position({x}, r), 'r': r}})), lambda s: s.r)"
_REGS = _ORDERED(r"CASE WHEN contains(operands, ' .. ') THEN ['v0', 'v1', 'v2'] ELSE regexp_extract_all(operands, '\b[vp][0-9]+\b') END")


def _text(*cols: str):
    return [F.array_join(x, "|").alias(x) for x in cols]


@_query("fn1_clean_text", r"SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", code.clean_text(F.col("text")).alias("cleaned"))


@_query("fn7_split_operands", oracle(f"SELECT apk, method, idx, array_to_string({_OPERANDS}, '|') AS parts FROM v_code", "v_code"))
def _(spark, sf):
    return view(spark, sf, "v_code").select("apk", "method", "idx", F.array_join(code.split_operands(F.col("operands")), "|").alias("parts"))


@_query("ud2_registers", oracle(f"SELECT apk, method, idx, array_to_string({_REGS}, '|') AS regs FROM v_code", "v_code"))
def _(spark, sf):
    return view(spark, sf, "v_code").select("apk", "method", "idx", F.array_join(code.registers(F.col("operands")), "|").alias("regs"))


@_query("fn13_raw_register", oracle(r"SELECT apk, method, idx, array_to_string(list_transform(regexp_extract_all(operands, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda t: CASE WHEN regexp_full_match(t, 'v[0-9]+') AND CAST(regexp_extract(t, '[0-9]+') AS INT) >= 2 THEN 'p' || CAST(CAST(regexp_extract(t, '[0-9]+') AS INT) - 2 AS VARCHAR) ELSE t END), '') AS renamed FROM v_code", "v_code"))
def _(spark, sf):
    return view(spark, sf, "v_code").select("apk", "method", "idx", code.raw_register(F.col("operands"), F.lit(2)).alias("renamed"))


_LITERAL = "CASE l_partkey % 6 WHEN 0 THEN '0x' || CAST(l_suppkey % 10 AS {s}) || 'ft' WHEN 1 THEN '-' || CAST(l_partkey AS {s}) || 'L' WHEN 2 THEN CAST(l_partkey AS {s}) WHEN 3 THEN '-0X1' || CAST(l_suppkey % 10 AS {s}) WHEN 4 THEN 'v' || CAST(l_suppkey AS {s}) ELSE ' +7s ' END"


@_query("fn11_smali_int", f"""SELECT lit, count(*) AS n, CASE WHEN regexp_full_match(b, '[+-]?0[xX][0-9a-fA-F]+') THEN (CASE WHEN b LIKE '-%' THEN -1 ELSE 1 END) * CAST('0x' || regexp_extract(b, '[xX](.*)$', 1) AS BIGINT)
  ELSE TRY_CAST(b AS BIGINT) END AS value FROM (SELECT lit, regexp_replace(trim(lit), '[tTsSlL]$', '') AS b FROM (SELECT {_LITERAL.format(s='VARCHAR')} AS lit FROM lineitem)) GROUP BY 1, 3""")
def _(spark, sf):
    literals = spark.sql(f"SELECT {_LITERAL.format(s='STRING')} AS lit FROM {{lineitem}}", lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return literals.groupBy("lit").agg(F.count("*").alias("n")).withColumn("value", code.parse_smali_int(F.col("lit")))


_TYPES = "CASE o_orderkey % 4 WHEN 0 THEN ['I', 'J', '[J', 'D', 'La/b;'] WHEN 1 THEN ['D', 'D', 'I'] WHEN 2 THEN ['I'] ELSE [] END"


@_query("fn9_parameter_registers", f"SELECT o_orderkey, array_to_string(list_transform(range(len(t)), lambda i: t[i + 1] || '=p' || CAST(i + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END + len(list_filter(t[1:i], lambda x: x IN ('J', 'D'))) AS VARCHAR)), ',') AS parameters FROM (SELECT o_orderkey, {_TYPES} AS t FROM orders)")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    types = F.array_except(F.expr("CASE o_orderkey % 4 WHEN 0 THEN array('I', 'J', '[J', 'D', 'La/b;') WHEN 1 THEN array('D', 'D', 'I') WHEN 2 THEN array('I') ELSE array('none') END"), F.array(F.lit("none")))
    types = F.when(F.col("o_orderkey") % 4 == 1, F.expr("array('D', 'D', 'I')")).otherwise(types)
    made = code.parameter_registers(types, F.col("o_orderkey") % 3 == 0)
    return orders.select("o_orderkey", F.array_join(F.transform(made, lambda x: F.concat(x["type"], F.lit("="), x["register"])), ",").alias("parameters"))


@_query("fn15_json_string", oracle("""SELECT apk, method, idx, CASE WHEN opcode = 'const-string' THEN json_extract_string('[' || trim(regexp_extract(operands, ',(.*)$', 1)) || ']', '$[0]') END AS decoded FROM v_code""", "v_code"))
def _(spark, sf):
    return view(spark, sf, "v_code").select("apk", "method", "idx", code.json_string(F.try_element_at(code.split_operands(F.col("operands")), F.lit(2))).alias("decoded"))


_PATHS = "CASE l_partkey % 5 WHEN 0 THEN 'lib/arm64-v8a/lib' || CAST(l_suppkey AS {s}) || '.so' WHEN 1 THEN 'lib/../lib' || CAST(l_suppkey AS {s}) || '.so' WHEN 2 THEN '/lib/x86/a.so' WHEN 3 THEN 'lib/x86/sub/b.so' ELSE 'lib//c.so' END"
_FILES = "CASE l_suppkey % 4 WHEN 0 THEN 'classes.dex' WHEN 1 THEN 'classes' || CAST(l_partkey % 12 AS {s}) || '.dex' WHEN 2 THEN 'classesX.dex' ELSE 'assets/classes2.dex' END"


@_query("flt5_library_paths", f"SELECT path, count(*) AS n, path LIKE 'lib/%' AND path LIKE '%.so' AND len(string_split(path, '/')) >= 3 AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS valid FROM (SELECT {_PATHS.format(s='VARCHAR')} AS path FROM lineitem) GROUP BY 1")
def _(spark, sf):
    paths = spark.sql(f"SELECT {_PATHS.format(s='STRING')} AS path FROM {{lineitem}}", lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return paths.groupBy("path").agg(F.count("*").alias("n")).withColumn("valid", code.valid_library_path(F.col("path")))


@_query("flt6_code_file_order", rf"SELECT name, count(*) AS n, CASE WHEN name = 'classes.dex' THEN 1 ELSE coalesce(TRY_CAST(nullif(regexp_extract(name, '^classes([0-9]+)\.dex$', 1), '') AS BIGINT), 2147483647) END AS place FROM (SELECT {_FILES.format(s='VARCHAR')} AS name FROM lineitem) GROUP BY 1")
def _(spark, sf):
    names = spark.sql(f"SELECT {_FILES.format(s='STRING')} AS name FROM {{lineitem}}", lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return names.groupBy("name").agg(F.count("*").alias("n")).withColumn("place", code.code_file_order(F.col("name")))


_DESCRIPTORS = "CASE l_partkey % 7 WHEN 0 THEN '(I[[JLa/b;)V' WHEN 1 THEN '(V)V' WHEN 2 THEN '()La.b;' WHEN 3 THEN '([)I' WHEN 4 THEN '(I)' WHEN 5 THEN '()[[D' ELSE '(L;)V' END"


@_query("flt4_descriptors", f"SELECT descriptor, count(*) AS n, descriptor IN ('(I[[JLa/b;)V', '()[[D') AS valid FROM (SELECT {_DESCRIPTORS} AS descriptor FROM lineitem) GROUP BY 1")
def _(spark, sf):
    made = spark.sql(f"SELECT {_DESCRIPTORS} AS descriptor FROM {{lineitem}}", lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return made.groupBy("descriptor").agg(F.count("*").alias("n")).withColumn("valid", code.valid_descriptor(F.col("descriptor")))


_USABLE = "usable AS (SELECT d.* FROM v_decl d WHERE flags <> 'native' AND EXISTS (SELECT 1 FROM v_code c WHERE c.apk = d.apk AND c.method = d.method))"


@_query("flt1_with_code", oracle("SELECT apk, method, full_signature FROM usable", "v_decl", "v_code", also=_USABLE))
def _(spark, sf):
    return flow.usable(view(spark, sf, "v_decl"), view(spark, sf, "v_code")).select("apk", "method", "full_signature")


# ---- control flow ----
_FLOW = r"""pl AS (SELECT *, regexp_extract(operands, '.*(:[A-Za-z0-9_$.-]+)', 1) AS label, lead(idx) OVER (PARTITION BY apk, method ORDER BY idx) AS following, count(*) OVER (PARTITION BY apk, method) AS n FROM v_code),
lab AS (SELECT l.* FROM v_label l JOIN v_code c USING (apk, method, idx)),
want AS (SELECT apk, method, idx AS src, label, CASE WHEN opcode LIKE 'goto%' THEN 'goto' ELSE 'branch' END AS kind FROM pl WHERE opcode LIKE 'goto%' OR opcode LIKE 'if-%'
  UNION ALL SELECT apk, method, p.idx, y.target, 'switch' FROM pl p JOIN v_payload y USING (apk, method, label) WHERE opcode LIKE '%switch%'),
span AS (SELECT h.apk, h.method, s.idx AS low, e.idx AS high, t.idx AS dst FROM v_handler h JOIN lab s ON s.apk = h.apk AND s.method = h.method AND s.label = h.try_start JOIN lab t ON t.apk = h.apk AND t.method = h.method AND t.label = h.handler
  LEFT JOIN lab e ON e.apk = h.apk AND e.method = h.method AND e.label = h.try_end),
flow AS (SELECT w.apk, w.method, w.src, l.idx AS dst, w.kind FROM want w JOIN lab l ON l.apk = w.apk AND l.method = w.method AND l.label = w.label
  UNION SELECT apk, method, idx, following, 'fallthrough' FROM pl WHERE following IS NOT NULL AND opcode NOT LIKE 'goto%' AND opcode NOT LIKE 'return%' AND opcode NOT LIKE 'throw%'
  UNION SELECT p.apk, p.method, p.idx, s.dst, 'exception' FROM pl p JOIN span s ON s.apk = p.apk AND s.method = p.method AND p.idx >= s.low AND p.idx < coalesce(s.high, p.n))"""
_VIEWS = ("v_code", "v_label", "v_payload", "v_handler")


def _placed(spark, sf, instr=None):
    """(places of the code, its control flow); the places are written once."""
    places = cut(flow.places(view(spark, sf, "v_code") if instr is None else instr))
    return places, flow.placed_flow(places, *(view(spark, sf, v) for v in _VIEWS[1:]))


def _graph(spark, sf):
    return _placed(spark, sf)[1]


@_query("cfg1_control_flow", oracle("SELECT * FROM flow", *_VIEWS, also=_FLOW))
def _(spark, sf):
    return _graph(spark, sf)


@_query("jn6_unresolved_targets", oracle("SELECT w.apk, w.method, w.src AS idx, 'CFG_UNRESOLVED_TARGET' AS issue, w.label AS detail FROM want w LEFT JOIN lab l ON l.apk = w.apk AND l.method = w.method AND l.label = w.label WHERE l.idx IS NULL UNION ALL SELECT apk, method, idx, 'CFG_UNRESOLVED_PAYLOAD', label FROM pl p WHERE opcode LIKE '%switch%' AND NOT EXISTS (SELECT 1 FROM v_payload y WHERE y.apk = p.apk AND y.method = p.method AND y.label = p.label) UNION ALL SELECT apk, method, CAST(NULL AS INT), 'CFG_UNRESOLVED_EXCEPTION', handler FROM v_handler h WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.apk = h.apk AND s.method = h.method)", *_VIEWS, also=_FLOW))
def _(spark, sf):
    return flow.flow_issues(*(view(spark, sf, v) for v in _VIEWS))


@_query("jn7_exception_ranges", oracle("SELECT apk, method, src, dst FROM flow WHERE kind = 'exception'", *_VIEWS, also=_FLOW))
def _(spark, sf):
    return _graph(spark, sf).where("kind = 'exception'").select("apk", "method", "src", "dst")


_REF = r"regexp_extract(operands, '(L[^;\s]+;->[^\s(]+\([^)]*\)(?:V|[ZBSCIJFD]|L[^;]+;|\[+(?:[ZBSCIJFD]|L[^;]+;)))', 1)"
_UD = f"""u0 AS (SELECT *, {_REGS} AS regs, nullif({_REF}, '') AS ref, regexp_extract_all(operands, 'L[^;\\s]+;->[^\\s:,]+:[^\\s,}}]+') AS fields FROM v_code),
u1 AS (SELECT *, lag(ref) OVER w AS last_ref, lag(idx) OVER w AS last_idx FROM u0 WINDOW w AS (PARTITION BY apk, method ORDER BY idx)),
ud AS (SELECT apk, method, idx, opcode, ref, regs, CASE
  WHEN opcode LIKE 'move-result%' THEN CASE WHEN last_ref IS NOT NULL AND NOT ends_with(last_ref, ')V') THEN ['result:' || last_ref] ELSE [] END
  WHEN opcode LIKE 'const%' THEN [] WHEN opcode LIKE 'goto%' THEN [] WHEN opcode LIKE 'iget%' THEN list_concat(regs[2:], list_transform(fields, lambda f: 'field:' || f))
  WHEN opcode LIKE 'add-%' THEN list_distinct(list_concat(regs[2:], regs[:1])) WHEN opcode LIKE 'move%' THEN regs[2:] ELSE regs END AS uses, CASE
  WHEN opcode LIKE 'invoke-%' THEN CASE WHEN ref IS NOT NULL AND NOT ends_with(ref, ')V') THEN ['result:' || ref] ELSE [] END
  WHEN opcode LIKE 'sput%' THEN list_transform(fields, lambda f: 'field:' || f) WHEN opcode LIKE 'aput%' THEN CASE WHEN len(regs) >= 2 THEN ['array:' || regs[2]] ELSE [] END
  WHEN opcode LIKE 'move%' OR opcode LIKE 'const%' OR opcode LIKE 'iget%' OR opcode LIKE 'add-%' THEN regs[:1] ELSE [] END AS defs, opcode = 'custom-op' AS is_unknown FROM u1)"""


@_query("ud1_use_def", oracle("SELECT apk, method, idx, array_to_string(list_sort(uses), '|') AS uses, array_to_string(list_sort(defs), '|') AS defs, is_unknown FROM ud", "v_code", also=_UD))
def _(spark, sf):
    made = flow.use_def(view(spark, sf, "v_code"))
    return made.select("apk", "method", "idx", F.array_join(F.array_sort("uses"), "|").alias("uses"), F.array_join(F.array_sort("defs"), "|").alias("defs"), "is_unknown")


@_query("agg8_unknown_opcodes", oracle("SELECT opcode, count(*) AS n FROM ud WHERE is_unknown GROUP BY 1", "v_code", also=_UD))
def _(spark, sf):
    return flow.use_def(view(spark, sf, "v_code")).where("is_unknown").groupBy("opcode").agg(F.count("*").alias("n"))


_CALLED = f"called AS (SELECT apk, method, idx, opcode, ref AS target, regexp_extract(opcode, '^invoke-(static|direct|super|virtual|interface)', 1) AS kind FROM (SELECT *, nullif({_REF}, '') AS ref FROM v_code) WHERE opcode LIKE 'invoke-%' AND ref IS NOT NULL)"


@_query("jn5_call_edges", oracle("SELECT c.apk, c.method, c.idx, c.kind, c.target, d.method AS callee, d.flags = 'native' AS callee_native FROM called c LEFT JOIN v_decl d ON d.apk = c.apk AND d.full_signature = c.target", "v_code", "v_decl", also=_CALLED))
def _(spark, sf):
    return flow.call_edges(view(spark, sf, "v_code"), view(spark, sf, "v_decl"))


@_query("slc5_boundaries", oracle("""SELECT c.apk, c.method, c.idx, c.target, CASE WHEN regexp_matches(c.target, '^(Ljava/lang/Class;|Ljava/lang/reflect/Method;)->(forName|getMethod|invoke)\\(') THEN 'reflection' WHEN c.kind IN ('virtual', 'interface') THEN 'virtual_dispatch'
  WHEN n IS NULL THEN 'external_call' WHEN usable > 0 THEN NULL WHEN native > 0 THEN 'native_method' ELSE 'unresolved_local_call' END AS boundary FROM called c LEFT JOIN (SELECT apk, full_signature AS target, count(*) AS n, count(*) FILTER (flags = 'native') AS native,
  count(*) FILTER (flags <> 'native' AND EXISTS (SELECT 1 FROM v_code x WHERE x.apk = d.apk AND x.method = d.method)) AS usable FROM v_decl d GROUP BY 1, 2) USING (apk, target)""".replace("\\\\", "\\"), "v_code", "v_decl", also=_CALLED))
def _(spark, sf):
    return flow.boundaries(view(spark, sf, "v_code"), view(spark, sf, "v_decl"))


@_query("ud3_parameter_map", oracle(f"""SELECT e.apk, e.method, e.idx, e.callee, 'p' || CAST(i + base AS VARCHAR) AS parameter, regs[i + base + 1] AS register FROM (SELECT c.apk, c.method, c.idx, d.method AS callee, CASE WHEN d.flags LIKE '%static%' THEN 0 ELSE 1 END AS base, {_REGS} AS regs
  FROM (SELECT *, nullif({_REF}, '') AS ref FROM v_code WHERE opcode LIKE 'invoke-%') c JOIN v_decl d ON d.apk = c.apk AND d.full_signature = c.ref) e, (SELECT unnest(range(-1, 2)) AS i) WHERE i + base >= 0 AND len(regs) = 2 + base""", "v_code", "v_decl"))
def _(spark, sf):
    return flow.parameter_map(view(spark, sf, "v_code"), view(spark, sf, "v_decl"))[0]


# ---- slice text ----
_TOKENS = r"""tok AS (SELECT apk, method, token, min(seat) AS seat FROM (SELECT apk, method, token, seat FROM (SELECT apk, method, unnest(tokens) AS token, [0, idx, generate_subscripts(tokens, 1)] AS seat FROM (SELECT apk, method, idx, list_filter(regexp_extract_all(regexp_replace(raw_text, '"[^"]*"', '', 'g'), '[A-Za-z0-9_$]+:?|:[A-Za-z0-9_$.-]+|[^A-Za-z0-9_$:]|:'), lambda t: regexp_full_match(t, 'v[0-9]+|:[A-Za-z0-9_$.-]+')) AS tokens FROM v_code))
  UNION ALL SELECT apk, method, label, [1, idx, 0] FROM v_label UNION ALL SELECT apk, method, label, [2, 0, 0] FROM v_payload UNION ALL SELECT apk, method, target, [2, pos, 0] FROM v_payload) GROUP BY 1, 2, 3),
names AS (SELECT apk, method, token, CASE WHEN token LIKE ':%' THEN ':label_' ELSE 'v' END || CAST(row_number() OVER (PARTITION BY apk, method, token LIKE ':%' ORDER BY seat) - 1 AS VARCHAR) AS name FROM tok)"""
_NAMED = ("v_code", "v_label", "v_payload")


@_query("win4_names", oracle("SELECT apk, method, token, name FROM names", *_NAMED, also=_TOKENS))
def _(spark, sf):
    return slice_text.names(*(view(spark, sf, v) for v in _NAMED))


_NORMAL = r"""numbered AS (SELECT apk, method, map_from_entries(list({'k': token, 'v': name})) AS m FROM names GROUP BY 1, 2),
normal AS (SELECT apk, method, idx, opcode, raw_text, trim(array_to_string(list_transform(regexp_extract_all(trim(raw_text), '"[^"]*"|[^"]+'), lambda p: CASE WHEN p LIKE '"%' THEN p ELSE regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(p, '[A-Za-z0-9_$]+:?|:[A-Za-z0-9_$.-]+|[^A-Za-z0-9_$:]|:'),
  lambda t: coalesce(m[t], t)), ''), '\s+', ' ', 'g'), ',\s*', ', ', 'g') END), '')) AS line FROM v_code JOIN numbered USING (apk, method))"""


@_query("nrm1_instructions", oracle("SELECT apk, method, idx, line FROM normal", *_NAMED, also=f"{_TOKENS}, {_NORMAL}"))
def _(spark, sf):
    instr, *others = (view(spark, sf, v) for v in _NAMED)
    return slice_text.normalized(cut(instr), *others).select("apk", "method", "idx", "line")


@_query("win5_method_markers", oracle("SELECT apk, method, idx FROM (SELECT apk, method, idx, lag(method) OVER (PARTITION BY apk ORDER BY method, idx) AS before FROM v_code WHERE idx % 3 <> 1) WHERE before IS NULL OR before <> method", "v_code"))
def _(spark, sf):
    return slice_text.method_starts(view(spark, sf, "v_code").where("idx % 3 <> 1"), "apk").select("apk", "method", "idx")


@_query("nrm2_slice_text", oracle("""SELECT apk, string_agg(line, chr(10) ORDER BY part, method, idx, ord, kind, target) AS normalized, (SELECT string_agg(raw_text, chr(10) ORDER BY method, idx) FROM v_code r WHERE r.apk = x.apk AND idx % 3 <> 1) AS raw FROM
  (SELECT apk, 0 AS part, n.method, idx, 0 AS ord, '' AS kind, '' AS target, '[METHOD] ' || full_signature AS line FROM (SELECT *, lag(method) OVER (PARTITION BY apk ORDER BY method, idx) AS before FROM normal WHERE idx % 3 <> 1) n JOIN v_decl d USING (apk, method) WHERE before IS NULL OR before <> n.method
   UNION ALL SELECT apk, 0, method, idx, 1, '', '', line FROM normal WHERE idx % 3 <> 1
   UNION ALL SELECT apk, CASE WHEN idx % 3 = 1 THEN 1 ELSE 0 END, method, idx, 2, kind, target, '[BOUNDARY] kind=' || kind || ' target=' || target FROM called) x GROUP BY 1""", *_NAMED, "v_decl", also=f"{_TOKENS}, {_NORMAL}, {_CALLED}"))
def _(spark, sf):
    instr, labels, payloads, decl = (view(spark, sf, v) for v in (*_NAMED, "v_decl"))
    instr = cut(instr)  # read for names, lines and calls
    items = slice_text.normalized(instr, labels, payloads).where("idx % 3 <> 1").join(decl.select("apk", "method", "full_signature"), ["apk", "method"])
    bounds = flow.calls(instr).select("apk", "method", "idx", "kind", "target")
    return slice_text.slice_text(items, bounds, "apk")


@_query("fn16_example_id", oracle("""SELECT apk, method, idx, 'h' || CAST(apk AS VARCHAR) || ':' || sha256('{"apk_hash":"h' || CAST(apk AS VARCHAR) || '","dex_name":"classes.dex","instruction_index":' || CAST(idx AS VARCHAR) || ',"invoked_signature":"' || target || '","rule_id":"r","source_method":"' || CAST(method AS VARCHAR) || '"}') AS example_id FROM called""", "v_code", also=_CALLED))
def _(spark, sf):
    apk = F.concat(F.lit("h"), F.col("apk").cast("string"))
    identity = F.struct(apk.alias("apk_hash"), F.lit("classes.dex").alias("dex_name"), F.col("idx").alias("instruction_index"), F.col("target").alias("invoked_signature"), F.lit("r").alias("rule_id"), F.col("method").cast("string").alias("source_method"))
    return flow.calls(view(spark, sf, "v_code")).select("apk", "method", "idx", code.example_id(apk, identity).alias("example_id"))


@_query("fn21_pad_batch", "SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(most - len(ids)), lambda i: 0)), ',') AS ids, len(ids) AS n FROM (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY doc_id // 8) / 4.0) * 4 AS BIGINT) AS most FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents WHERE text IS NOT NULL))")
def _(spark, sf):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", ids.alias("input_ids"), F.floor(F.col("doc_id") / 8).alias("batch"))
    return slice_text.pad_batch(rows, "batch", 4).select("doc_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@_query("fn22_token_count", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]')) AS n FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", code.token_count(F.col("text")).cast("long").alias("n"))


@_query("fn23_config_digest", oracle("""SELECT DISTINCT sink_category, sha256('{"category":"' || sink_category || '","limit":' || CAST(len(sink_category) AS VARCHAR) || '}') AS digest FROM v_token WHERE sink_category IS NOT NULL""", "v_token"))
def _(spark, sf):
    named = view(spark, sf, "v_token").select("sink_category").where("sink_category IS NOT NULL").distinct()
    return named.select("sink_category", code.config_digest(F.struct(F.col("sink_category").alias("category"), F.length("sink_category").alias("limit"))).alias("digest"))


@_query("fn4_sdk_levels", oracle("SELECT raw_name, count(*) AS n, CASE WHEN TRY_CAST(trim(raw_name) AS INT) >= 0 THEN TRY_CAST(trim(raw_name) AS INT) END AS level FROM (SELECT CASE no % 4 WHEN 0 THEN ' ' || CAST(target_sdk AS VARCHAR) WHEN 1 THEN '-' || CAST(target_sdk AS VARCHAR) WHEN 2 THEN 'x' ELSE CAST(target_sdk AS VARCHAR) END AS raw_name FROM v_component) GROUP BY 1", "v_component"))
def _(spark, sf):
    from tracequarry.functions.scalars import parse_sdk

    sdk = F.col("target_sdk").cast("string")
    raw = F.when(F.col("no") % 4 == 0, F.concat(F.lit(" "), sdk)).when(F.col("no") % 4 == 1, F.concat(F.lit("-"), sdk)).when(F.col("no") % 4 == 2, F.lit("x")).otherwise(sdk)
    return view(spark, sf, "v_component").select(raw.alias("raw_name")).groupBy("raw_name").agg(F.count("*").alias("n")).withColumn("level", parse_sdk(F.col("raw_name")))




# ---- slices of whole packages; rounds over calls are no SQL, tests hold them against known slices ----
def _sliced(spark, sf):
    instr, decl = view(spark, sf, "v_code"), view(spark, sf, "v_decl")
    lines = cut(flow.use_def(flow.places(instr, "operands").withColumn("falls", flow.falls()), "label", "falls", "n"))  # all that is read of lines, in one pass
    edges = flow.jumps_and_raised(lines, *(view(spark, sf, v) for v in _VIEWS[1:]), cut)
    called = lines.where(F.col("opcode").startswith("invoke-") & F.col("ref").isNotNull())
    sinks = called.join(rules.sinks(spark).select(F.concat("class_name", F.lit("->"), "method_name").alias("name")).distinct(), F.substring_index("ref", "(", 1) == F.col("name"), "left_semi")
    return slices.program_slices(instr, decl, edges, sinks.select("apk", "method", "idx"), cut, ud=lines)


@_query("slc2_program_slices", None)
def _(spark, sf):
    return _sliced(spark, sf)[0].select("apk", "s_method", "s_idx", "method", "idx", "reason")


@_query("slc6_limited_slices", None)
def _(spark, sf):
    kept, ends, _ = _sliced(spark, sf)
    return slices.apply_limits(kept, ends, slices.Limits(methods=3, instructions=12))[0].select("apk", "s_method", "s_idx", "method", "idx", "reason")


@_query("slc8_slice_summary", None)
def _(spark, sf):
    kept, ends, _ = _sliced(spark, sf)
    return slices.slice_summary(*slices.apply_limits(kept, ends))
