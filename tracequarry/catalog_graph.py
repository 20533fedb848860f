"""Queries of reachability and graph issues, with their SQL; `catalog` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry import catalog as c
from tracequarry.catalog_code import _FLOW, _VIEWS, _placed
from tracequarry.operators import flow, reach
from tracequarry.plans.views import oracle, view

_query = c._query
#: Pairs that a part answers, about.
PART_PAIRS = 1_000_000
#: Every pair that control flow connects; the engine itself never lists them.
_FAR = f"""{_FLOW}, hop AS (SELECT DISTINCT apk, method, src, dst FROM flow),
far AS (SELECT apk, method, src, dst FROM hop UNION SELECT f.apk, f.method, f.src, e.dst FROM far f JOIN hop e ON e.apk = f.apk AND e.method = f.method AND e.src = f.dst)"""


def _recursive(body: str, *names: str, also: str) -> str:
    return "WITH RECURSIVE" + oracle(body, *names, also=also).removeprefix("WITH")


@_query("cfg3_components", _recursive("""SELECT c.apk, c.method, c.idx, coalesce(least(c.idx, min(f.dst)), c.idx) AS component, coalesce(bool_or(f.dst = c.idx), false) AS cyclic
  FROM v_code c LEFT JOIN (SELECT f.* FROM far f JOIN far b ON b.apk = f.apk AND b.method = f.method AND b.src = f.dst AND b.dst = f.src) f ON f.apk = c.apk AND f.method = c.method AND f.src = c.idx GROUP BY 1, 2, 3""", *_VIEWS, also=_FAR))
def _(spark, sf):
    return reach.components(*_placed(spark, sf)).select("apk", "method", "idx", "component", "cyclic")


@_query("cfg3_asked", _recursive("""SELECT a.apk, a.method, a.idx AS start, b.idx AS node, f.src IS NOT NULL AS reached FROM pl a JOIN pl b ON b.apk = a.apk AND b.method = a.method
  LEFT JOIN (SELECT DISTINCT apk, method, src, dst FROM far) f ON f.apk = a.apk AND f.method = a.method AND f.src = a.idx AND f.dst = b.idx""", *_VIEWS, also=_FAR))
def _(spark, sf):
    """Does control get from each instruction to each of its method; they are numbered from 0."""
    places, edges = _placed(spark, sf)
    asked = places.select("apk", "method", F.col("idx").alias("start"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("node"))
    pairs = places.agg(F.sum("n")).first()[0] or 0
    return reach.answers(edges, asked, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PART_PAIRS)))


@_query("slc4_deciders", _recursive("""SELECT DISTINCT c.apk, c.method, c.idx FROM v_code c JOIN far f ON f.apk = c.apk AND f.method = c.method AND f.src = c.idx JOIN v_code s ON s.apk = f.apk AND s.method = f.method AND s.idx = f.dst
  WHERE (c.opcode LIKE 'if-%' OR c.opcode LIKE '%switch%') AND s.opcode LIKE 'invoke-%'""", *_VIEWS, also=_FAR))
def _(spark, sf):
    instr, edges = _placed(spark, sf)
    branches = instr.where(F.col("opcode").startswith("if-") | F.col("opcode").contains("switch")).select("apk", "method", "idx")
    return reach.reaching(edges, instr.where(F.col("opcode").startswith("invoke-"))).join(branches, ["apk", "method", "idx"], "left_semi")


@_query("cfg1_no_graph", oracle("""SELECT d.apk, d.method, CAST(NULL AS INT) AS idx, 'CFG_NO_USABLE_GRAPH' AS issue, d.full_signature AS detail FROM v_decl d
  WHERE list_has_any(list_transform(string_split(d.flags, ','), lambda x: lower(trim(x))), ['native', 'abstract']) OR NOT EXISTS (SELECT 1 FROM v_code k WHERE k.apk = d.apk AND k.method = d.method)""", "v_decl", "v_code"))
def _(spark, sf):
    return flow.no_graph(view(spark, sf, "v_decl"), view(spark, sf, "v_code"))
