"""The engine's input tables, derived from a star schema; one SQL text for either engine.

SHA(x) stands for the hex SHA-256 of a string and K(x) for the member k of a JSON text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tracequarry.plans.rules import SINKS

#: Lines in a part at most, about; some 100 MB of a task's memory in all that is done to them.
PART_ROWS = 250_000
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def _case(of: str, values) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PERMISSIONS = [f"android.permission.{p}" for p in ("INTERNET", "READ_SMS", "RECEIVE_SMS", "READ_CONTACTS", "BIND_ACCESSIBILITY_SERVICE", "SYSTEM_ALERT_WINDOW", "RECEIVE_BOOT_COMPLETED", "REQUEST_INSTALL_PACKAGES", "CAMERA", "VIBRATE")]
_ACTIONS = ["android.intent.action.MAIN", "android.intent.action.BOOT_COMPLETED", "android.provider.Telephony.SMS_RECEIVED", "android.accessibilityservice.AccessibilityService", "android.intent.action.VIEW", "android.intent.action.SEND"]
_OPCODES = ["const/4", "const-string", "move-object", "iget-object", "if-eqz", "goto", "add-int", "aput", "invoke-virtual", "invoke-static", "return-void", "sget-object"]
_CALLS = [f"{c}->{n}{d or '(' + 'I' + ')V'}" for _, _, c, n, d in SINKS]
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"

def _reg(x: str) -> str:
    return f"'v' || CAST({x} AS STRING)"


_CODE_OPCODES = ["const/4", "const-string", "move-object", "iget-object", "if-eqz", "goto", "add-int/2addr", "aput-object", "invoke-virtual", "invoke-static", "return-object", "sput-object", "move-result-object", "packed-switch", "throw", "custom-op"]
_LABEL = "':cond_' || CAST(ln % 4 AS STRING)"
_CODE_OPERANDS = [
    f"{_reg('sk % 4')} || ', 0x' || CAST(pk % 10 AS STRING)", f"{_reg('sk % 4')} || ',  \"v' || CAST(pk % 3 AS STRING) || '   :cond_7\"'", f"{_reg('sk % 4')} || ', ' || {_reg('pk % 5')}",
    f"{_reg('sk % 4')} || ', p' || CAST(pk % 2 AS STRING) || ', Lq/F' || CAST(sk % 3 AS STRING) || ';->f:I'", f"{_reg('sk % 4')} || ', ' || {_LABEL}", _LABEL, f"{_reg('sk % 4')} || ',' || {_reg('pk % 5')}",
    f"{_reg('sk % 4')} || ', ' || {_reg('pk % 5')} || ', ' || {_reg('sk % 3')}", f"'{{{{' || {_reg('sk % 4')} || ', ' || {_reg('pk % 5')} || '}}}}, ' || sink",
    f"CASE WHEN pk % 7 = 0 THEN '{{{{v0 .. v2}}}}, ' ELSE '{{{{' || {_reg('sk % 4')} || ', p' || CAST(pk % 2 AS STRING) || '}}}}, ' END || CASE WHEN callee IS NOT NULL AND pk % 3 <> 0 THEN callee ELSE sink END",
    _reg("sk % 4"), f"{_reg('sk % 4')} || ', Lq/F' || CAST(sk % 3 AS STRING) || ';->f:I'", _reg("pk % 5"), f"{_reg('sk % 4')} || ', :pswitch_data_' || CAST(ln % 2 AS STRING)", _reg("sk % 4"), _reg("sk % 4"),
]
_SIGNATURE = "'Lp' || CAST(o_custkey AS STRING) || '/C' || CAST(o_orderkey % 7 AS STRING) || ';->m' || CAST(o_orderkey AS STRING) || '(II)I'"

VIEWS = {
    "v_decl": f"SELECT o_custkey AS apk, o_orderkey AS method, {_SIGNATURE} AS full_signature, CASE WHEN o_orderkey % 11 = 0 THEN 'native' WHEN o_orderkey % 2 = 0 THEN 'public,static' ELSE 'public' END AS flags FROM {{orders}}",
    "v_code": f"""SELECT apk, method, idx, opcode, operands, opcode || '  ' || operands AS raw_text FROM (SELECT apk, method, idx, {_case('pk % 16', _CODE_OPCODES)} AS opcode,
        CASE pk % 16 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_CODE_OPERANDS))} END AS operands FROM (SELECT o_custkey AS apk, l_orderkey AS method, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, callee,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS INT) AS idx, {_case('l_partkey % 14', _CALLS)} AS sink
        FROM {{lineitem}} JOIN (SELECT o_orderkey, o_custkey, lead({_SIGNATURE}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS callee FROM {{orders}}) ON l_orderkey = o_orderkey))""",
    "v_label": " UNION ALL ".join(f"SELECT o_custkey AS apk, o_orderkey AS method, ':cond_{i}' AS label, {i} AS idx FROM {{orders}}" for i in range(3)),
    "v_payload": " UNION ALL ".join(f"SELECT o_custkey AS apk, o_orderkey AS method, ':pswitch_data_0' AS label, {i} AS pos, ':cond_{i}' AS target FROM {{orders}}" for i in (1, 2, 3)),
    "v_handler": "SELECT o_custkey AS apk, o_orderkey AS method, ':cond_0' AS try_start, CASE WHEN o_orderkey % 2 = 0 THEN ':cond_2' ELSE ':cond_9' END AS try_end, ':cond_1' AS handler FROM {orders} WHERE o_orderkey % 3 = 0",
    "v_apk": "SELECT SHA(d.text) AS apk_hash, CASE WHEN l.toxic = 1 THEN 'Malicious' ELSE 'Benign' END AS label, d.n_chars AS apk_size_bytes, d.source || '/' || CAST(d.doc_id AS STRING) AS source_path FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "v_perm": f"SELECT DISTINCT l_orderkey AS apk, {_case('l_partkey % 10', _PERMISSIONS)} AS permission FROM {{lineitem}}",
    "v_component": f"""SELECT l_orderkey AS apk, l_linenumber AS no, {_case('l_suppkey % 4', ['activity', 'service', 'receiver', 'provider'])} AS kind,
        CASE l_partkey % 3 WHEN 0 THEN '.C' || CAST(l_partkey AS STRING) WHEN 1 THEN 'C' || CAST(l_partkey AS STRING) ELSE 'a.b.C' || CAST(l_partkey AS STRING) END AS raw_name,
        CASE l_suppkey % 3 WHEN 1 THEN 'true' WHEN 2 THEN 'false' END AS raw_exported, l_partkey % 2 = 0 AS has_filter, {_case('l_partkey % 6', _ACTIONS)} AS action,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(10 + o_orderkey % 26 AS INT) END AS target_sdk FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "v_instr": f"""SELECT o_custkey AS apk, l_orderkey AS method, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS INT) AS idx, {_case('l_partkey % 12', _OPCODES)} AS opcode,
        'v' || CAST(l_suppkey % 6 AS STRING) AS reg, 'v' || CAST(l_partkey % 5 AS STRING) AS reg2, CAST(l_linenumber % 4 AS INT) AS target,
        CASE WHEN l_partkey % 12 IN (8, 9) THEN {_case('l_partkey % 14', _CALLS)} END AS call FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "v_method": """SELECT o_custkey AS apk, o_orderkey AS method, 'Lp' || CAST(o_custkey AS STRING) || '/C' || CAST(o_orderkey % 7 AS STRING) || ';->m' || CAST(o_orderkey AS STRING) || '(I)V' AS full_signature,
        CASE WHEN o_orderkey % 11 = 0 THEN ' Native ,public' WHEN o_orderkey % 13 = 0 THEN 'abstract,public' ELSE 'public,,STATIC,public' END AS flags,
        CASE o_orderkey % 2 WHEN 0 THEN 'smali' ELSE 'raw' END AS backend FROM {orders}""",
    "v_log": """SELECT event_id, user_id AS session, CAST(ts AS TIMESTAMP) AS ts, CASE event_type
        WHEN 'click' THEN '[Sandbox] File read: ' || CASE K(props) % 8 WHEN 0 THEN '/system/bin/app_process' WHEN 1 THEN '/data/user/0/app/shared_prefs/a.xml' WHEN 2 THEN '/data/telephony/mmssms.db' WHEN 3 THEN '/sdcard/payload.dex' WHEN 4 THEN '/proc/self/maps' WHEN 5 THEN '/data/contacts2.db' WHEN 6 THEN '/sdcard/config.json' ELSE '/sdcard/photo.jpg' END
        WHEN 'view' THEN '[Sandbox] File write: /sdcard/out' || CAST(K(props) % 5 AS STRING) || '.bin'
        WHEN 'error' THEN CASE K(props) % 3 WHEN 0 THEN 'Root check blocked' WHEN 1 THEN 'CertificatePinner check bypassed' ELSE 'Unrelated error' END
        WHEN 'purchase' THEN '[Sandbox] Network connection: 10.0.0.' || CAST(K(props) % 20 AS STRING) || ':' || CASE WHEN K(props) % 10 = 0 THEN '4444' WHEN K(props) % 3 = 0 THEN '8080' ELSE '443' END
        ELSE '[Sandbox] Native library loaded: lib' || CAST(K(props) % 6 AS STRING) END AS line FROM {events}""",
    "v_token": """SELECT d.doc_id AS example_id, d.source AS apk_hash, CASE WHEN l.toxic = 1 THEN 'Malicious' ELSE 'Benign' END AS label, CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS BIGINT) AS token_count,
        d.n_chars > 4000 AS is_truncated, d.lang AS sink_category, CASE d.doc_id % 7 WHEN 0 THEN 'completed_with_truncation' WHEN 1 THEN 'capped' WHEN 2 THEN 'zero_sink' WHEN 3 THEN 'failed' ELSE 'completed' END AS status
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v_slice_score": "SELECT o_custkey AS apk, o_orderkey AS slice_id, (o_orderkey % 101) / CAST(100 AS DOUBLE) AS probability FROM {orders}",
}


def spell(sql: str, dialect: str) -> str:
    if dialect == "spark":
        return re.sub(r"\bK\((\w+)\)", r"CAST(get_json_object(\1, '$.k') AS BIGINT)", re.sub(r"\bSHA\(([^()]+)\)", r"sha2(\1, 256)", sql))
    return re.sub(r"\bK\((\w+)\)", r"CAST(json_extract_string(\1, '$.k') AS BIGINT)", re.sub(r"\bSHA\(([^()]+)\)", r"sha256(\1)", sql))


def _dealt(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, where lines stand with their orders dealt out by order: as many parts as keep a part's rows bounded, however few
    shuffle partitions there are. The files' footers give the number of rows."""
    if not {"lineitem", "orders"} <= set(tables):
        return tables
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tables["lineitem"].count() // PART_ROWS))
    return tables | {"lineitem": tables["lineitem"].repartition(parts, "l_orderkey")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = spell(VIEWS[name], "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **_dealt(spark, tables))


def oracle(body: str, *names: str, also: str = "") -> str:
    """SQL for DuckDB: the views named, then the body."""
    views = [f"{n} AS ({spell(VIEWS[n].format(**{t: t for t in TABLES}), 'duckdb')})" for n in names]
    return "WITH " + ", ".join([*views, *([also] if also else [])]) + "\n" + spell(body, "duckdb")
