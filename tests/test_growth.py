"""Steps whose cost has to follow the input: parts by rows, methods in batches, words that stay with their text."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from test_reach import every_pair, random_graphs
from tracequarry import catalog
from tracequarry.operators import outcomes, reach
from tracequarry.plans import views

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


def test_methods_of_a_batch_are_numbered_each_for_itself(spark):
    graphs = [*random_graphs(300)]
    instr = spark.createDataFrame([(m % 7, m, i) for m, (n, _) in enumerate(graphs) for i in range(n)], "apk int, method int, idx int")
    edges = spark.createDataFrame([(m % 7, m, a, b) for m, (_, e) in enumerate(graphs) for a, b in e], "apk int, method int, src int, dst int")
    got = {(r["method"], r["idx"]): r for r in reach.components(instr.repartition(2), edges).collect()}
    for m, (n, e) in enumerate(graphs):
        c = reach.Condensed(np.arange(n), np.array([a for a, _ in e], np.int64), np.array([b for _, b in e], np.int64))
        for i in range(n):
            k = c.of[i]
            assert tuple(got[m, i])[3:] == (int(np.flatnonzero(c.of == k)[0]), k, c.first[k], c.last[k], c.least[k], bool(c.cyclic[k]))
    asked = spark.createDataFrame([(m % 7, m, a, b) for m, (n, _) in enumerate(graphs) for a in range(n) for b in range(n)] + [(9, 1, 0, 0)], "apk int, method int, start int, node int")
    far = [every_pair(n, e) for n, e in graphs]
    told = reach.answers(edges, asked).collect()
    assert len(told) == asked.count() and all(r["reached"] == (r["apk"] < 9 and r["node"] in far[r["method"]][r["start"]]) for r in told)


def test_a_method_over_several_batches_comes_whole():
    rows = [("a", 1)] * 5 + [("a", 2)] + [("b", 2)] * 7
    table = pa.table({"apk": [a for a, _ in rows], "method": [m for _, m in rows], "src": list(range(len(rows)))})
    for size in (1, 2, 3, 20):
        parts = [[*t.column("src").to_pylist()] for t, at in reach._whole(iter(table.to_batches(max_chunksize=size))) for _ in [0] if at[0] == 0]
        assert sum(parts, []) == table.column("src").to_pylist()
        assert all(end in (4, 5, 12) for end in (p[-1] for p in parts))
    assert [*reach._whole(iter([]))] == []


@given
def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "PART_ROWS", 200)
    for name in ("v_code", "v_instr"):
        assert views.view(spark, DATA, name).rdd.getNumPartitions() >= 30


@given
def test_words_are_not_shuffled(spark):
    for name in ("jn17_slice_attributions", "srt2_top_attributions"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        before_words = plan.index("Generate")
        assert "Exchange" not in plan[:before_words].replace("BroadcastExchange", "") and "SortAggregate" not in plan


def test_the_greatest_by_size(spark):
    rows = [("a", 0.5), ("a", -0.5), ("b", -0.7), ("b", 0.6), ("c", None), ("d", -0.1), ("d", -0.2), ("e", None), ("e", -0.3)]
    got = outcomes.strongest(spark.createDataFrame(rows, "token string, weight double"), "token").collect()
    assert {r["token"]: r["weight"] for r in got} == {"a": 0.5, "b": -0.7, "c": None, "d": -0.2, "e": -0.3}


def test_every_similar_text_is_found(spark):
    from tracequarry.operators import learn

    common = " ".join(f"c{i}" for i in range(40))
    texts = [f"{common} own{k % 30} w{k % 7}" for k in range(90)] + ["a b", None, "Far, from all those"]
    known = [f"{common} own{k} other" for k in range(12)] + ["far from all those words", "a b"]
    df = lambda rows, k: spark.createDataFrame([*enumerate(rows)], f"{k} long, text string")
    grams = lambda t: {tuple(w[i : i + 3]) for w in [(t or "").lower().replace(",", "").split()] if len(w) >= 3 for i in range(len(w) - 2)}
    want = {(i, j): round(len(a & b) / len(a | b), 6) for i, a in enumerate(map(grams, texts)) for j, b in enumerate(map(grams, known)) if a and b and len(a & b) >= 0.4 * len(a | b)}
    got = learn.similar(df(texts, "doc_id"), df(known, "item_id"), "doc_id", "item_id", 0.4).collect()
    assert len(want) > 1000 and (92, 12) in want and {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == want and len(got) == len(want)


def test_rows_of_many_classes_go_out_together(spark):
    from tracequarry.sources import smali

    texts = spark.range(500, numPartitions=1).selectExpr("id", "CASE WHEN id % 50 < 49 THEN concat('.class La/C', id, ';\\n.method m(IJ)V\\n    nop\\n.end method') END AS text")
    parts = smali.read_classes(texts, "id", "text")
    sizes = parts.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches if b.num_rows), parts.schema)  # a row for each batch
    assert sizes.count() < 10 and smali.parameters(parts).count() == 980
    assert {(r["id"], r["issue"]) for r in smali.issues(parts).collect()} == {(i, smali.NO_CLASS) for i in range(49, 500, 50)}


def test_requests_of_a_method_come_together(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracequarry.operators import flow, slices

    n, keep = 300, lambda df: df
    rows = [(1, m, i, op, regs, f"{op} {regs}") for m in range(n) for i, (op, regs) in enumerate([("const/4", "v0, 0x1"), ("move-object", "v1, v0"), ("invoke-static", "{v1}, La;->s(I)V")])]
    instr = spark.createDataFrame(rows, "apk int, method int, idx int, opcode string, operands string, raw_text string")
    decl = spark.createDataFrame([(1, m, f"Lp/C;->m{m}(I)I", "public") for m in range(n)], "apk int, method int, full_signature string, flags string")
    edges = spark.createDataFrame([(1, m, i, i + 1) for m in range(n) for i in (0, 1)], "apk int, method int, src int, dst int")
    methods = slices.bodies(instr, decl, edges, flow.use_def(instr), flow.boundaries(instr, decl), keep).coalesce(1)
    ask = '{"mode":"start","idx":2,"syms":["v1"],"depth":0,"ctx":[],"path":["0"],"reason":"data_dependency"}'
    asked = spark.range(n).select(F.lit(1).alias("apk"), F.col("id").cast("string").alias("s_method"), F.explode(F.array(F.lit(2), F.lit(7))).alias("s_idx"), F.col("id").cast("string").alias("method"), F.lit(ask).alias("request"), F.lit(1).alias("place"), F.lit(4096).alias("left"))
    first = lambda out: out.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches if b.num_rows), out.schema).count()
    out = slices._round(asked, methods, slices.Limits())
    assert first(out) < 30 and out.where("kind = 'retain' AND idx = 0").count() == 2 * n
    monkeypatch.setattr(slices, "TOGETHER", 1)  # dealt into parts: the same rows
    assert sorted(map(str, slices._round(asked, methods, slices.Limits()).collect())) == sorted(map(str, out.collect()))


@given
def test_sinks_of_a_summary_are_found_once(spark):
    plan = catalog.QUERIES["agg12_package_summary"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan  # they were written; the lines aren't gone through again


@given
def test_lines_are_dealt_out_once_and_their_code_is_compiled(spark, capsys):
    import re

    from tracequarry.operators import flow

    lines = lambda: flow.use_def(flow.places(views.view(spark, DATA, "v_code"), "operands").withColumn("falls", flow.falls()), "label", "falls", "n")
    plan = lines()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(apk" not in plan and plan.count("REPARTITION_BY_NUM") == 1
    capsys.readouterr()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whose plans have no code before they run
    try:
        lines().explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM leaves longer methods to its interpreter
