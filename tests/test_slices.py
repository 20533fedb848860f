"""Slices of small packages, with known results."""

import pytest

from tracequarry.operators import flow, slices
from tracequarry.sources.shared import cut

SINK = "Ljava/lang/Runtime;->exec(Ljava/lang/String;)V"


def sliced(spark, methods, limits=slices.Limits(), labels=()):
    """methods: {signature: (flags, [(opcode, operands)])}; retained (signature, idx) and reasons, boundaries, of the sink's slice."""
    numbers = {s: i for i, s in enumerate(methods)}
    code = [(1, numbers[s], i, op, x, f"{op} {x}") for s, (_, body) in methods.items() for i, (op, x) in enumerate(body)]
    instr = spark.createDataFrame(code, "apk int, method int, idx int, opcode string, operands string, raw_text string")
    decl = spark.createDataFrame([(1, n, s, methods[s][0]) for s, n in numbers.items()], "apk int, method int, full_signature string, flags string")
    marks = spark.createDataFrame([(1, numbers[s], name, i) for s, name, i in labels], "apk int, method int, label string, idx int")
    none = spark.createDataFrame([], "apk int, method int, label string, pos int, target string")
    handlers = spark.createDataFrame([], "apk int, method int, try_start string, try_end string, handler string")
    sinks = instr.where(f"operands LIKE '%{SINK}'").select("apk", "method", "idx")
    kept, ends, issues = slices.program_slices(instr, decl, flow.control_flow(instr, marks, none, handlers), sinks, cut, limits)
    kept, ends = slices.apply_limits(kept, ends, limits)
    name = {str(n): s for s, n in numbers.items()}
    reasons: dict = {}
    for r in kept.collect():
        reasons.setdefault((name[r["method"]], r["idx"]), set()).add(r["reason"])
    return reasons, {(r["boundary"], name[r["method"]], r["idx"]) for r in ends.collect()}, [r["issue"] for r in issues.collect()]


MAIN = "La/Main;->run()V"
CALL = ("invoke-virtual", f"{{v0, v1}}, {SINK}")
END = ("return-void", "")


def test_definitions_stay_and_other_code_goes(spark):
    kept, ends, _ = sliced(spark, {MAIN: ("", [("const-string", 'v1, "command"'), ("const-string", 'v7, "other"'), CALL, END])})
    assert kept == {(MAIN, 0): {"data_dependency"}, (MAIN, 2): {"data_dependency", "sink"}}
    assert ends == {("virtual_dispatch", MAIN, 2)}


def test_branches_that_decide_stay(spark):
    body = [("const/4", "v2, 0x1"), ("if-eqz", "v2, :sink"), END, ("const-string", 'v1, "cmd"'), CALL, END]
    kept, _, _ = sliced(spark, {MAIN: ("", body)}, labels=[(MAIN, ":sink", 3)])
    assert {i for _, i in kept} == {0, 1, 3, 4} and "control_dependency" in kept[MAIN, 1]
    dead = [("const/4", "v5, 0x1"), ("if-eqz", "v5, :dead"), END, END, ("const-string", 'v1, "cmd"'), CALL, END]
    kept, _, _ = sliced(spark, {MAIN: ("", dead)}, labels=[(MAIN, ":dead", 3)])
    assert {i for _, i in kept} == {4, 5}


def test_loops_end(spark):
    body = [("const/4", "v2, 0x2"), ("add-int/lit8", "v2, v2, -0x1"), ("if-nez", "v2, :loop"), ("const-string", 'v1, "cmd"'), CALL, END]
    kept, _, _ = sliced(spark, {MAIN: ("", body)}, labels=[(MAIN, ":loop", 1)])
    assert {i for _, i in kept} == {1, 2, 3, 4}  # a register that is read and written in one place counts as written


@pytest.mark.parametrize("opcode", ["invoke-static", "invoke-direct"])
def test_returns_of_callees_are_followed(spark, opcode):
    helper = "La/H;->command()Ljava/lang/String;"
    methods = {MAIN: ("", [(opcode, f"{{}}, {helper}"), ("move-result-object", "v1"), CALL, END]), helper: ("static", [("const-string", 'v0, "id"'), ("return-object", "v0")])}
    kept, _, _ = sliced(spark, methods)
    assert kept[helper, 0] == {"callee_return"} and (helper, 1) in kept and (MAIN, 0) in kept


def test_callers_without_context_are_searched(spark):
    send = "La/H;->send(Ljava/lang/String;)V"
    methods = {send: ("public,static", [("invoke-virtual", f"{{v0, p0}}, {SINK}"), END]), MAIN: ("", [("const-string", 'v3, "value"'), ("invoke-static", f"{{v3}}, {send}"), END])}
    kept, _, _ = sliced(spark, methods)
    assert (MAIN, 0) in kept and kept[MAIN, 1] == {"caller_argument"}


def test_a_known_context_excludes_other_callers(spark):
    same = "La/H;->identity(Ljava/lang/String;)Ljava/lang/String;"
    run = lambda secret, end: ("", [("const-string", f'v1, "{secret}"'), ("invoke-static", f"{{v1}}, {same}"), ("move-result-object", "v2"), end, END])
    methods = {"La/B;->run()V": run("b", ("nop", "")), same: ("static", [("return-object", "p0")]), "La/A;->run()V": run("a", ("invoke-virtual", f"{{v0, v2}}, {SINK}"))}
    kept, _, _ = sliced(spark, methods)
    assert ("La/A;->run()V", 0) in kept and not any(s == "La/B;->run()V" for s, _ in kept)


def test_registers_that_do_not_fit_are_an_issue(spark):
    send = "La/H;->send(J)V"
    methods = {send: ("public,static", [("invoke-virtual", f"{{v0, p0}}, {SINK}"), END]), MAIN: ("", [("const-wide", "v2, 0x1"), ("invoke-static", f"{{v2}}, {send}"), END])}
    kept, _, issues = sliced(spark, methods)
    assert issues == ["MALFORMED_PARAMETER_MAPPING"] and not any(s == MAIN for s, _ in kept)


def test_a_budget_keeps_the_sink_and_names_what_it_turned_away(spark):
    body = [("const-string", 'v2, "a"'), ("move-object", "v1, v2"), CALL, END]
    kept, ends, _ = sliced(spark, {MAIN: ("", body)}, slices.Limits(instructions=1))
    assert set(kept) == {(MAIN, 2)} and ("instruction_limit", MAIN, 1) in ends


def test_recursion_is_a_boundary(spark):
    loop = "La/H;->f()Ljava/lang/String;"
    methods = {MAIN: ("", [("invoke-static", f"{{}}, {loop}"), ("move-result-object", "v1"), CALL, END]), loop: ("static", [("invoke-static", f"{{}}, {loop}"), ("move-result-object", "v0"), ("return-object", "v0")])}
    _, ends, _ = sliced(spark, methods)
    assert ("recursion", loop, 0) in ends


def packages(n):
    """Random packages: calls of all kinds, some to one of several bodies of a signature, branches, and declarations without bodies."""
    import random

    rng = random.Random(7)
    code, decl, marks = [], [], []
    for apk in range(n):
        names = [f"La/C{m};->f{m % 3}(I)I" if apk % 3 else f"La/C;->f{m % 2}(I)I" for m in range(rng.randint(1, 13))]
        for m, name in enumerate(names):
            decl.append((apk, m, name, rng.choice(["", "static", "static", "public", "native", "abstract"])))
            for i in range(0 if rng.random() < 0.1 else rng.randint(1, 9)):
                r = lambda: f"v{rng.randint(0, 3)}" if rng.random() < 0.8 else f"p{rng.randint(0, 1)}"
                call = lambda: f"{{{', '.join(r() for _ in range(rng.randint(0, 3)))}}}, {rng.choice([*names, *[SINK] * 8, 'La/X;->g()I', 'Ljava/lang/Class;->forName(I)I'])}"
                kind = rng.choice(["const/4", "move", "if-eqz", "goto", "return", "move-result", "move-result", "invoke-static", "invoke-direct", "invoke-super", "invoke-virtual", "invoke-virtual", "custom"])
                code.append((apk, m, i, kind, call() if kind.startswith("invoke") else f"{r()}, :l{rng.randint(0, 3)}" if kind in ("if-eqz", "goto") else f"{r()}, {r()}"))
            marks += [(apk, m, f":l{k}", k) for k in range(3)]
    return code, [*decl, decl[3]], marks


@pytest.mark.parametrize("limits", [slices.Limits(), slices.Limits(depth=2, candidates=2, states=9)])
def test_packages_in_one_pass_give_what_rounds_over_tables_give(spark, monkeypatch, limits):
    code, decl, marks = packages(150)
    instr = spark.createDataFrame([(*c, f"{c[3]} {c[4]}") for c in code] + [(None, 1, 0, "invoke-static", f"{{v1}}, {SINK}", "")], "apk int, method int, idx int, opcode string, operands string, raw_text string")
    decl = spark.createDataFrame(decl, "apk int, method int, full_signature string, flags string")
    none, handlers = spark.createDataFrame([], "apk int, method int, label string, pos int, target string"), spark.createDataFrame([], "apk int, method int, try_start string, try_end string, handler string")
    instr, sinks = cut(instr), cut(instr.where(f"operands LIKE '%{SINK}'").select("apk", "method", "idx"))
    edges = cut(flow.control_flow(instr, spark.createDataFrame(marks, "apk int, method int, label string, idx int"), none, handlers))
    tables = []
    counted = lambda df: tables.append(1) or cut(df)
    rows = lambda dfs: [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in dfs]
    one = rows(slices.program_slices(instr, decl, edges, sinks, counted, limits))
    assert len(tables) <= 3 and len(one[0]) > 1500 and all(one)  # no table for a round
    each = slices.tabled(instr, decl, edges, sinks, cut, limits)
    assert one == rows(each)
    monkeypatch.setattr(slices, "WHOLE", 30)  # some packages by rounds
    assert one == rows(slices.program_slices(instr, decl, edges, sinks, cut, limits))
