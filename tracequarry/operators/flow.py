"""Control flow, uses and definitions, calls and parameters of bytecode with textual operands.

Instruction tables have apk, method, idx, opcode, operands, raw_text; declarations have apk, method, full_signature, flags."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracequarry.functions import code
from tracequarry.functions.scalars import call_kind, param_types

_PLACE = ["apk", "method", "idx"]
_METHOD = ["apk", "method"]
# References to methods and fields, labels; opcode families that write their first register.
METHOD_REF = r"(L[^;\s]+;->[^\s(]+\([^)]*\)(?:V|[ZBSCIJFD]|L[^;]+;|\[+(?:[ZBSCIJFD]|L[^;]+;)))"
FIELD_REF = r"(L[^;\s]+;->[^\s:,]+:[^\s,}]+)"
LABEL = r":[A-Za-z0-9_$.-]+"
_KINDS = "byte|char|short|int|long|float|double"
_ARITHMETIC = ("add-", "sub-", "mul-", "div-", "rem-", "and-", "or-", "xor-", "shl-", "shr-", "ushr-", "neg-", "not-", "cmp", "instance-of", "rsub-")
_READERS = ("if-", "return", "throw", "monitor-", "packed-switch", "sparse-switch", "fill-array-data")
REFLECTIVE = r"^(Ljava/lang/Class;|Ljava/lang/reflect/Method;)->(forName|getMethod|invoke)\("


def _starts(col: Column, *words: str) -> Column:
    return reduce(or_, [col.startswith(w) for w in words])


def flag_list(flags: str = "flags") -> Column:
    """A declaration's flags, trimmed and in lower case."""
    return F.transform(F.split(F.coalesce(flags, F.lit("")), ","), lambda x: F.lower(F.trim(x)))


def flagged(flag: str) -> Column:
    return F.array_contains(flag_list(), flag)


def sound() -> Column:
    """A declaration that may have a body: neither native nor abstract, with a valid signature."""
    part = lambda i: F.regexp_extract("full_signature", r"^(L[^;\s]+;)->([^(]+)(\(.*)$", i)
    valid = code.valid_identity(part(1), part(2), part(3), F.col("full_signature"))
    return ~F.arrays_overlap(flag_list(), F.array(F.lit("native"), F.lit("abstract"))) & valid


def usable(decl: DataFrame, instr: DataFrame) -> DataFrame:
    """Declarations with a body: sound ones with an instruction at least."""
    body = instr.where(F.col("opcode").isNotNull()).select(*_METHOD).distinct()
    return decl.where(sound()).join(body, _METHOD, "left_semi")


# ---- control flow ----


def places(instr: DataFrame, *also: str) -> DataFrame:
    """Each instruction with its last label, the one that follows it, how many its method has, and the columns named."""
    w = W.partitionBy(*_METHOD)
    label = F.when(F.col("operands").contains(":"), F.regexp_extract("operands", f"^.*({LABEL})", 1)).when(F.col("operands").isNotNull(), "")
    return instr.select(*_PLACE, "opcode", label.alias("label"), F.lead("idx").over(w.orderBy("idx")).alias("following"), F.count("*").over(w).alias("n"), *also)


def _labels(labels: DataFrame, instr: DataFrame) -> DataFrame:
    """Labels that stand at an instruction."""
    return labels.join(instr.select(*_PLACE), _PLACE, "left_semi").select(*_METHOD, "label", F.col("idx").alias("dst"))


def _wanted(places: DataFrame, payloads: DataFrame) -> DataFrame:
    """Jumps by label: goto, branch, and each entry of a switch's payload."""
    op = F.col("opcode")
    jumps = places.where(_starts(op, "goto", "if-")).select(*_METHOD, F.col("idx").alias("src"), "label", F.when(op.startswith("goto"), "goto").otherwise("branch").alias("kind"))
    cases = places.where(op.contains("switch")).join(payloads.where("target IS NOT NULL"), [*_METHOD, "label"])
    return jumps.unionByName(cases.select(*_METHOD, F.col("idx").alias("src"), F.col("target").alias("label"), F.lit("switch").alias("kind")))


def _spans(handlers: DataFrame, at: DataFrame) -> DataFrame:
    """Exception ranges with a known start and handler: low, high (null: the method's end), dst."""
    named = lambda label, place: at.select(*_METHOD, F.col("label").alias(label), F.col("dst").alias(place))
    found = handlers.join(named("try_start", "low"), [*_METHOD, "try_start"]).join(named("handler", "dst"), [*_METHOD, "handler"])
    return found.join(named("try_end", "high"), [*_METHOD, "try_end"], "left")


def control_flow(instr: DataFrame, labels: DataFrame, payloads: DataFrame, handlers: DataFrame) -> DataFrame:
    """(apk, method, src, dst, kind): fallthrough, branch, goto, switch and exception edges; nothing follows a return or throw.

    A switch falls through too; an exception edge leaves every instruction of its range. All joins are within a method."""
    return placed_flow(places(instr), labels, payloads, handlers)


def placed_flow(places: DataFrame, labels: DataFrame, payloads: DataFrame, handlers: DataFrame) -> DataFrame:
    """control_flow() of places(), which are read several times: write them in between, or each time makes them anew."""
    next_ = places.select(*_METHOD, F.col("idx").alias("src"), falls().alias("dst"), F.lit("fallthrough").alias("kind")).where("dst IS NOT NULL")
    return next_.unionByName(_led(places, _labels(labels, places), payloads, handlers)).distinct()


def falls() -> Column:
    """The instruction that one of places() falls through to; nothing follows a goto, return or throw."""
    return F.when(~_starts(F.col("opcode"), "goto", "return", "throw"), F.col("following"))


def jumps_and_raised(places: DataFrame, labels: DataFrame, payloads: DataFrame, handlers: DataFrame, cut) -> DataFrame:
    """placed_flow() without falls(), with an edge as often as it is led by; cut writes the labels that stand at an instruction."""
    return _led(places, cut(_labels(labels, places)), payloads, handlers)


def _led(places: DataFrame, at: DataFrame, payloads: DataFrame, handlers: DataFrame) -> DataFrame:
    jumps = _wanted(places, payloads).join(at, [*_METHOD, "label"]).select(*_METHOD, "src", "dst", "kind")
    p, s = places.alias("p"), _spans(handlers, at).alias("s")
    within = (F.col("p.apk") == F.col("s.apk")) & (F.col("p.method") == F.col("s.method")) & (F.col("p.idx") >= F.col("s.low")) & (F.col("p.idx") < F.coalesce("s.high", "p.n"))
    raised = p.join(s, within).select("p.apk", "p.method", F.col("p.idx").alias("src"), "s.dst", F.lit("exception").alias("kind"))
    return jumps.unionByName(raised)


def flow_issues(instr: DataFrame, labels: DataFrame, payloads: DataFrame, handlers: DataFrame) -> DataFrame:
    """(apk, method, idx, issue, detail): jumps, payloads and handlers that lead nowhere."""
    placed, at = places(instr), _labels(labels, instr)
    row = lambda df, idx, issue, detail: df.select(*_METHOD, idx.cast("int").alias("idx"), issue.alias("issue"), detail.alias("detail"))
    lost = _wanted(placed, payloads).join(at, [*_METHOD, "label"], "left_anti")
    jumps = row(lost, F.col("src"), F.when(F.col("label") == "", "CFG_MISSING_TARGET").otherwise("CFG_UNRESOLVED_TARGET"), F.col("label"))
    tables = row(placed.where(F.col("opcode").contains("switch")).join(payloads.select(*_METHOD, "label").distinct(), [*_METHOD, "label"], "left_anti"), F.col("idx"), F.lit("CFG_UNRESOLVED_PAYLOAD"), F.col("label"))
    ranges = row(handlers.join(_spans(handlers, at), [*_METHOD, "try_start", "try_end", "handler"], "left_anti"), F.lit(None), F.lit("CFG_UNRESOLVED_EXCEPTION"), F.col("handler"))
    return jumps.unionByName(tables).unionByName(ranges)


def no_graph(decl: DataFrame, instr: DataFrame) -> DataFrame:
    """(apk, method, idx, issue, detail) of the declarations that can't have a graph: without a body, or without a valid identity."""
    lost = decl.join(usable(decl, instr).select(*_METHOD), _METHOD, "left_anti")
    return lost.select(*_METHOD, F.lit(None).cast("int").alias("idx"), F.lit("CFG_NO_USABLE_GRAPH").alias("issue"), F.col("full_signature").alias("detail"))


# ---- uses and definitions ----


def use_def(instr: DataFrame, *also: str) -> DataFrame:
    """Each instruction's symbols read (uses) and written (defs): registers, field:, array: and result: symbols; and the columns named.

    A move-result reads the result of the call just before it. Opcodes of no known family read all their registers."""
    op, regs, operands = F.lower("opcode"), F.col("regs"), F.col("operands")
    none = F.array().cast("array<string>")
    first, rest = F.slice(regs, 1, 1), F.when(F.size(regs) > 1, F.slice(regs, F.lit(2), F.size(regs))).otherwise(none)
    gives = lambda r: r.isNotNull() & ~r.endswith(")V")
    result = lambda r: F.array(F.concat(F.lit("result:"), r))
    array_of = lambda i: F.when(F.size(regs) >= i, F.array(F.concat(F.lit("array:"), F.try_element_at(regs, F.lit(i))))).otherwise(none)
    filled = F.array(F.lit("result:filled-new-array"))
    taken = F.when(gives(F.col("last_ref")), result(F.col("last_ref"))).when(F.col("last_op").startswith("filled-new-array"), filled).otherwise(none)
    widened = op.rlike(f"^(?:{_KINDS})-to-(?:{_KINDS})$")
    doubled = op.contains("/2addr")
    lists = {"none": none, "all": regs, "first": first, "rest": rest, "rest, first": F.concat(rest, first), "rest, fields": F.concat(rest, "fields"), "rest, array": F.concat(rest, array_of(2)), "taken": taken, "fields": F.col("fields"), "array": array_of(2), "own array": array_of(1), "filled": filled, "result": F.when(gives(F.col("ref")), result(F.col("ref"))).otherwise(none)}
    rules = [  # (applies, uses, defs), the first that applies counts
        (_starts(op, "move-result"), "taken", "first"), (_starts(op, "move-exception"), "none", "first"), (_starts(op, "move"), "rest", "first"), (_starts(op, "const"), "none", "first"),
        (_starts(op, "filled-new-array"), "all", "filled"), (_starts(op, "new-array", "array-length"), "rest", "first"), (_starts(op, "new-instance"), "none", "first"),
        (_starts(op, "invoke-"), "all", "result"), (_starts(op, "iget", "sget"), "rest, fields", "first"), (_starts(op, "iput", "sput"), "all", "fields"),
        (_starts(op, "aget"), "rest, array", "first"), (_starts(op, "aput"), "all", "array"), (widened, "rest", "first"),
        (_starts(op, *_ARITHMETIC) & doubled, "rest, first", "first"), (_starts(op, *_ARITHMETIC), "rest", "first"), (_starts(op, "check-cast"), "first", "first"),
        (_starts(op, "fill-array-data"), "all", "own array"), (_starts(op, *_READERS), "all", "none"), (_starts(op, "goto", "nop"), "none", "none"),
    ]
    chosen = lambda values, of: reduce(lambda made, x: made.when(x[0], x[1]), values[1:], F.when(*values[0])).otherwise(of)
    listed = lambda k: [(F.col("rule").isin(*[i for i, r in enumerate(rules) if r[k] == name]), made) for name, made in lists.items() if any(r[k] == name for r in rules)]
    rule, refers = F.col("rule"), operands.contains(";->")  # as both kinds of references do
    ref = F.nullif(F.when(refers, F.regexp_extract(operands, METHOD_REF, 1)), F.lit(""))
    fields = F.transform(F.array_distinct(F.regexp_extract_all(operands, F.lit(FIELD_REF), 1)), lambda f: F.concat(F.lit("field:"), f))
    fields = F.when(refers & _starts(op, "iget", "sget", "iput", "sput"), fields).when(operands.isNotNull(), none)
    seen = instr.select(*_PLACE, "opcode", *also, code.registers(operands).alias("regs"), ref.alias("ref"), fields.alias("fields"), chosen([(applies, F.lit(i)) for i, (applies, _, _) in enumerate(rules)], F.lit(len(rules))).alias("rule"))
    w = W.partitionBy(*_METHOD).orderBy("idx")
    seen = seen.withColumn("last_ref", F.lag("ref").over(w)).withColumn("last_op", F.lag("opcode").over(w))
    uses, defs = chosen(listed(1), regs), chosen(listed(2), none)  # by list, not by rule: a method of over 8,000 bytes of code isn't compiled
    unknown = F.when(F.col("opcode").isNotNull(), rule == len(rules))
    return seen.select(*_PLACE, "opcode", F.array_distinct(uses).alias("uses"), F.array_distinct(defs).alias("defs"), unknown.alias("is_unknown"), "ref", "regs", *also)


# ---- calls ----


def calls(instr: DataFrame) -> DataFrame:
    """Calls with a whole reference: kind and target signature."""
    ref = F.nullif(F.regexp_extract("operands", METHOD_REF, 1), F.lit(""))
    return instr.where(F.col("opcode").startswith("invoke-")).select(*_PLACE, call_kind(F.col("opcode")).alias("kind"), ref.alias("target"), "operands").where("target IS NOT NULL")


def call_edges(instr: DataFrame, decl: DataFrame) -> DataFrame:
    """Each call and the declarations of its signature in the package; callee is null for a call that leaves it."""
    targets = decl.select("apk", F.col("full_signature").alias("target"), F.col("method").alias("callee"), flagged("native").alias("callee_native"))
    return calls(instr).drop("operands").join(targets, ["apk", "target"], "left").select(*_PLACE, "kind", "target", "callee", "callee_native")


def undeclared(kind: Column, target: Column) -> Column:
    """The boundaries that no declaration changes: reflection, and dispatch that only the run decides."""
    return F.when(target.rlike(REFLECTIVE), "reflection").when(kind.isin("virtual", "interface"), "virtual_dispatch")


def boundaries(instr: DataFrame, decl: DataFrame) -> DataFrame:
    """(apk, method, idx, target, boundary): why a slice doesn't go on into each call; null where it may.

    In order: reflection, dispatch that only the run decides, a super call without one declaration, no declaration, and a
    declaration without a body."""
    native = flagged("native")
    bodies = usable(decl, instr).select("apk", "method", F.lit(True).alias("body"))
    known = decl.join(bodies, _METHOD, "left").groupBy("apk", F.col("full_signature").alias("target")).agg(F.count("*").alias("n"), F.count_if("body").alias("bodies"), F.count_if(native).alias("natives"))
    kind, n = F.col("kind"), F.coalesce("n", F.lit(0))
    why = (
        F.coalesce(undeclared(kind, F.col("target")), F.when((kind == "super") & (n > 1), "unresolved_local_call")
        .when(n == 0, "external_call").when(F.col("bodies") > 0, None).when(F.col("natives") > 0, "native_method").otherwise("unresolved_local_call"))
    )
    return calls(instr).join(known, ["apk", "target"], "left").select(*_PLACE, "target", why.alias("boundary"))


def parameter_map(instr: DataFrame, decl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(apk, method, idx, callee, parameter, register): which of a call's registers fills each parameter word of a declared
    callee, both words of a wide one either; and the calls whose registers don't fit the descriptor."""
    callee = decl.select("apk", F.col("full_signature").alias("target"), F.col("method").alias("callee"), flagged("static").alias("is_static"))
    types = param_types(F.regexp_extract("target", r"(\(.*)$", 1))
    base = F.when(F.col("is_static"), 0).otherwise(1)
    called = calls(instr).join(callee, ["apk", "target"]).select(*_PLACE, "callee", "is_static", types.alias("types"), code.registers(F.col("operands")).alias("regs"))
    words = base + F.size("types") + F.size(F.filter("types", lambda t: t.isin("J", "D")))
    start = lambda i: base + i + F.size(F.filter(F.slice("types", F.lit(1), i), lambda t: t.isin("J", "D")))
    width = lambda t: F.when(t.isin("J", "D"), 2).otherwise(1)
    spans = F.transform("types", lambda t, i: F.struct(start(i).alias("start"), width(t).alias("width")))
    spans = F.when(F.col("is_static"), spans).otherwise(F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("width"))), spans))
    fits = called.where(F.size("regs") == words).withColumn("s", F.explode(spans))
    slots = fits.select(*_PLACE, "callee", "s.start", "s.width", "regs", F.explode(F.sequence(F.col("s.start"), F.col("s.start") + F.col("s.width") - 1)).alias("slot"))
    mapped = slots.select(*_PLACE, "callee", F.concat(F.lit("p"), F.col("slot").cast("string")).alias("parameter"), F.explode(F.slice("regs", F.col("start") + 1, F.col("width"))).alias("register"))
    issues = called.where(F.size("regs") != words).select(*_PLACE, "callee", F.lit("MALFORMED_PARAMETER_MAPPING").alias("issue"), F.size("regs").alias("given"), words.alias("required"))
    return mapped, issues
