"""Reachability and limits of slices against brute force and known rows."""

import random
import resource
import time

import numpy as np
import pytest

from test_slices import CALL, END, MAIN, SINK, sliced
from tracequarry.operators import reach, slices


def every_pair(n, edges):
    far = [set() for _ in range(n)]
    for s in range(n):
        left = [s]
        while left:
            x = left.pop()
            for a, b in edges:
                if a == x and b not in far[s]:
                    far[s].add(b)
                    left.append(b)
    return far


def random_graphs(count):
    rng = random.Random(2)
    for _ in range(count):
        n = rng.randint(1, 12)
        yield n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]


def test_components_and_intervals():
    for n, edges in random_graphs(400):
        c = reach.Condensed(np.arange(n), np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        far = every_pair(n, edges)
        pairs = [(a, b) for a in range(n) for b in range(n)]
        assert c.reaches(pairs) == [b in far[a] for a, b in pairs]
        for a, b in pairs:
            u, v = c.of[a], c.of[b]
            assert (u == v) == (a == b or (b in far[a] and a in far[b]))
            if u != v and b in far[a]:
                assert u < v and c.last[v] < c.last[u] and c.least[v] >= c.least[u]
            if u != v and c.first[u] <= c.last[v] < c.last[u]:
                assert b in far[a]


def test_asked_pairs_of_tables(spark):
    graphs = [*random_graphs(60)]
    instr = spark.createDataFrame([(1, m, i) for m, (n, _) in enumerate(graphs) for i in range(n)], "apk int, method int, idx int")
    edges = spark.createDataFrame([(1, m, a, b) for m, (_, e) in enumerate(graphs) for a, b in e], "apk int, method int, src int, dst int")
    asked = [(1, m, a, b) for m, (n, _) in enumerate(graphs) for a in range(n) for b in range(n)] + [(1, 0, 0, 99), (2, 0, 0, 0)]
    got = reach.reached(reach.components(instr, edges), edges, spark.createDataFrame(asked, "apk int, method int, start int, node int")).collect()
    far = [every_pair(n, e) for n, e in graphs]
    assert len(got) == len(asked) and all(r["reached"] == (r["apk"] == 1 and r["node"] in far[r["method"]][r["start"]]) for r in got)
    targets = spark.createDataFrame([(1, m, n // 2) for m, (n, _) in enumerate(graphs)], "apk int, method int, idx int")
    leads = {(r["method"], r["idx"]) for r in reach.reaching(edges, targets).collect()}
    assert leads == {(m, i) for m, (n, _) in enumerate(graphs) for i in range(n) if n // 2 in far[m][i]}
    assert reach.components(instr.limit(0), edges.limit(0)).count() == 0


def test_a_long_method_is_sliced_in_linear_memory():
    n, rng = 65536, random.Random(5)
    code = [{"idx": i, "opcode": "if-eqz" if i % 3 == 0 else "add-int", "uses": [f"v{i % 16}"], "defs": [] if i % 3 == 0 else [f"v{(i + 1) % 16}"], "regs": [], "target": None, "stop": None, "callees": None, "more": False} for i in range(n)]
    edges = [{"src": i, "dst": i + 1} for i in range(n - 1)] + [{"src": i, "dst": min(n - 1, max(0, i + rng.randint(-30, 90)))} for i in range(0, n, 3)]
    row = {"apk": 1, "method": "0", "types": [], "is_static": True, "code": code, "edges": edges, "sites": None, "n_sites": 0}
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    request = {"mode": "start", "idx": n - 1, "syms": ["v3"], "ctx": [], "depth": 0, "path": ["0"], "reason": "data_dependency"}
    out = [*slices._Walker(row, slices.Limits()).walk(request, 1 << 30)]
    assert sum(r[0] == "retain" for r in out) > n // 2
    assert time.perf_counter() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB
    index = reach.Condensed(np.arange(n), np.array([e["src"] for e in edges]), np.array([e["dst"] for e in edges]))
    assert len(index.reaches([(i, n - 1) for i in range(0, n, 9)])) == len(range(0, n, 9))


HELPER = "La/H;->pick(I)Ljava/lang/String;"


def several(spark, declared, limits=slices.Limits(), flags="static"):
    """The slice of a call with so many declarations of one signature."""
    from tracequarry.operators import flow
    from tracequarry.sources.shared import cut

    bodies = {0: (MAIN, "", [("const/4", "v3, 0x1"), ("invoke-static", f"{{v3}}, {HELPER}"), ("move-result-object", "v1"), CALL, END])}
    bodies |= {k + 1: (HELPER, flags, [("const-string", f'v0, "{k}"'), ("return-object", "v0")]) for k in range(declared)}
    instr = spark.createDataFrame([(1, m, i, op, x, "") for m, (_, _, body) in bodies.items() for i, (op, x) in enumerate(body)], "apk int, method int, idx int, opcode string, operands string, raw_text string")
    decl = spark.createDataFrame([(1, m, s, f) for m, (s, f, _) in bodies.items()], "apk int, method int, full_signature string, flags string")
    none = lambda kind: spark.createDataFrame([], f"apk int, method int, {kind}")
    graph = flow.control_flow(instr, none("label string, idx int"), none("label string, pos int, target string"), none("try_start string, try_end string, handler string"))
    kept, ends, issues = slices.program_slices(instr, decl, graph, instr.where(f"operands LIKE '%{SINK}'").select("apk", "method", "idx"), cut, limits)
    return {(r["method"], r["idx"]) for r in kept.collect()}, {(r["boundary"], r["method"], r["idx"]) for r in ends.collect()}, slices.slice_summary(kept, ends).first(), issues.count()


def test_callees_beyond_the_limit_are_a_boundary(spark):
    kept, ends, summary, _ = several(spark, 5)
    assert {m for m, _ in kept} == {"0", "1", "2", "3", "4"} and ("candidate_limit", "0", 1) in ends and summary["truncated"]
    kept, ends, summary, _ = several(spark, 4)
    assert {m for m, _ in kept} == {"0", "1", "2", "3", "4"} and not summary["truncated"] and not any(b == "candidate_limit" for b, _, _ in ends)


def test_flags_are_trimmed_and_lowered(spark):
    send = "La/H;->send(Ljava/lang/String;)V"
    methods = {send: ("public, Static", [("invoke-virtual", f"{{v0, p0}}, {SINK}"), END]), MAIN: ("", [("const-string", 'v3, "value"'), ("invoke-static", f"{{v3}}, {send}"), END])}
    kept, _, issues = sliced(spark, methods)
    assert issues == [] and (MAIN, 0) in kept


@pytest.mark.parametrize("states, cut_off", [(3, True), (40, False)])
def test_states_are_counted_over_rounds(spark, states, cut_off):
    kept, ends, summary, _ = several(spark, 3, slices.Limits(states=states))
    assert ("0", 3) in kept and summary["truncated"] == cut_off == any(b == "traversal_state_limit" for b, _, _ in ends)
    assert len({m for m, _ in kept}) == (1 if cut_off else 4)


def test_each_pair_of_a_method_is_asked(spark):
    """No asked place lies beyond its method's end, and none within is left out."""
    from pathlib import Path

    from tracequarry import catalog
    from tracequarry.plans.views import view

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("needs the given tables")
    got = catalog.QUERIES["cfg3_asked"](spark, sf).groupBy("apk", "method").agg({"*": "count", "start": "max", "node": "max"}).collect()
    lines = {(r["apk"], r["method"]): r["count"] for r in view(spark, sf, "v_code").groupBy("apk", "method").count().collect()}
    assert {(r["apk"], r["method"]): r["count(1)"] for r in got} == {k: n * n for k, n in lines.items()}
    assert all(r["max(start)"] == r["max(node)"] == lines[r["apk"], r["method"]] - 1 for r in got)


def test_a_method_of_many_pairs_passes_in_batches(spark):
    n = 150  # 22,500 pairs in batches of 1,000, between two small methods
    edges = [(m, i, i + 1) for m, k in ((1, 3), (2, n), (3, 3)) for i in range(k - 1) if i % 50 != 49]
    asked = [(m, i, j) for m, k in ((1, 3), (2, n), (3, 3)) for i in range(k) for j in range(k)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        df = lambda rows, names: spark.createDataFrame([(1, *r) for r in rows], f"apk int, method int, {names}").coalesce(1)
        told = reach.answers(df(edges, "src int, dst int"), df(asked + asked[:50], "start int, node int"), 1)
        sizes = told.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches if b.num_rows), told.schema)
        assert sizes.count() > 10
        got = told.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["method"], r["start"], r["node"]) for r in got) == sorted(asked)
    assert all(r["reached"] == (r["start"] < r["node"] and r["start"] // 50 == r["node"] // 50) for r in got)
