"""Backward slices of whole packages: data and control dependences within methods, into callees and back to callers.

A slice grows in rounds. A request asks a method to be walked backwards from some place with some live symbols, under the call
context that led there; each round walks all open requests in tasks, one method's instructions at a time, and gives out what
is retained, boundaries, and requests to other methods, which are written and dealt out by method for the next round. A
request that was made before isn't made again, so the rounds end; call depth bounds their number.

A package of few instructions comes whole to a task, where its slices go through the same rounds, with the same walker and the
same budgets (`packaged`); only packages of over WHOLE rows are walked in rounds over tables.

Symbols live apart from one another, which gives what sets of them would: a symbol that an instruction defines is replaced by
those that it reads, others pass. Where a result of a local callee is live, the callee's returns are walked in place of the
call's arguments; parameters that are live at a method's entry go back to the caller of the context, or, without one, to the
first callers by order. Each context closes over its own control dependences.

Budgets hold while a slice grows: of a signature's declarations the first ones by number are gone into, and what a slice may
visit is counted over its rounds, so that requests beyond its budget of states are turned away before they are walked. Budgets of
methods and instructions are applied to what has been kept, in order of round and distance from where a walk began: another order
than that of a depth-first traversal, but the sink always stays, and whatever is cut is a boundary that marks the slice truncated.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tracequarry.functions.scalars import call_kind, param_types
from tracequarry.operators import flow

_SLICE = ["apk", "s_method", "s_idx"]
_OUT = ["s_method", "s_idx", "kind", "method", "idx", "detail", "target", "step", "request"]
_FOUND = ["s_method", "s_idx", "kind", "method", "idx", "detail", "target", "round", "step"]
#: Kinds of a package's rows, what is told of a declaration, and the boundaries of calls that a method may be reached by.
_CODE, _EDGE, _DECLARED, _SINK = range(4)
_SOUND, _STATIC, _NATIVE = 1, 2, 4
_UNSURE = ("virtual_dispatch", "unresolved_local_call")
#: Parts that the requests of one method are dealt into, by slice, so that a much called one isn't one task's work; a method of
#: fewer requests than TOGETHER is read once for all of them.
SALTS, TOGETHER = 64, 256
#: Rows that go out together.
ROWS_OUT = 1 << 15
#: Instructions and declarations of a package that comes whole to a task, at most; and of all packages of a task, about.
WHOLE, PART_ROWS = 1 << 15, 250_000


@dataclass(frozen=True)
class Limits:
    depth: int = 3
    methods: int = 8
    instructions: int = 256
    candidates: int = 4
    #: places with a live symbol that a slice may visit
    states: int = 4096


def bodies(instr: DataFrame, decl: DataFrame, edges: DataFrame, ud: DataFrame, bounds: DataFrame, cut, candidates: int = 4) -> DataFrame:
    """One row for each usable method: signature, its code with uses, definitions and calls, its edges, and who calls it.

    ud: use_def() of instr; bounds: boundaries() of instr and decl."""
    able = cut(flow.usable(decl, instr).select("apk", "method", "full_signature", flow.flagged("static").alias("is_static")))
    ends = able.select("apk", F.col("full_signature").alias("target"), F.col("method").cast("string").alias("callee"))
    place = F.row_number().over(W.partitionBy("apk", "target").orderBy("callee"))
    callees = ends.withColumn("n", place).groupBy("apk", "target").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= candidates, F.col("callee")))).alias("callees"), (F.max("n") > candidates).alias("more"))
    inside = F.col("boundary").isNull()
    stops = bounds.join(callees, ["apk", "target"], "left").select("apk", "method", "idx", "target", F.col("boundary").alias("stop"), F.when(inside, F.col("callees")).alias("callees"), (inside & F.col("more")).alias("more"))
    code = ud.join(stops, ["apk", "method", "idx"], "left")
    code = code.groupBy("apk", "method").agg(F.collect_list(F.struct("idx", "opcode", "uses", "defs", "regs", "target", "stop", "callees", "more")).alias("code"))
    graph = edges.groupBy("apk", "method").agg(F.collect_set(F.struct("src", "dst")).alias("edges"))
    # callers whose dispatch is certain, the first ones by method and place
    sure = flow.call_edges(instr, able.withColumn("flags", F.lit(""))).where(F.col("callee").isNotNull() & F.col("kind").isin("static", "direct", "super")).join(able.select("apk", "method"), ["apk", "method"], "left_semi")
    rank, every = F.row_number().over(W.partitionBy("apk", "callee").orderBy("method", "idx")), F.count("*").over(W.partitionBy("apk", "callee"))
    sites = sure.select("apk", F.col("callee").alias("called"), "method", "idx", rank.alias("rank"), every.alias("all"))
    sites = sites.where(F.col("rank") <= candidates).groupBy("apk", F.col("called").alias("method")).agg(F.array_sort(F.collect_list(F.struct(F.col("method").cast("string").alias("method"), "idx"))).alias("sites"), F.max("all").alias("n_sites"))
    types = param_types(F.regexp_extract("full_signature", r"(\(.*)$", 1))
    made = able.join(code, ["apk", "method"]).join(graph, ["apk", "method"], "left").join(sites, ["apk", "method"], "left")
    return made.select("apk", F.col("method").cast("string").alias("method"), types.alias("types"), "is_static", "code", "edges", "sites", "n_sites")


def _mapped(call: dict, types: list[str], is_static: bool, wanted: list[str]) -> list[str] | None:
    """The call's registers that fill the wanted parameters; None if they don't fit."""
    regs, groups, at = call["regs"], {}, 0
    for width in ([] if is_static else [1]) + [2 if t in ("J", "D") else 1 for t in types]:
        for k in range(width):
            groups[f"p{at + k}"] = regs[at : at + width]
        at += width
    if at != len(regs) or any(w not in groups for w in wanted):
        return None
    return sorted({r for w in wanted for r in groups[w]})


class _Walker:
    """One method; requests are walked one by one."""

    def __init__(self, row: dict, limits: Limits):
        self.row, self.limits, self.method = row, limits, row["method"]
        self.code = {c["idx"]: c for c in row["code"]}
        self.defs = {i: frozenset(c["defs"] or ()) for i, c in self.code.items()}
        self.before = defaultdict(list)
        for src, dst in sorted({(e["src"], e["dst"]) if isinstance(e, dict) else e for e in row["edges"] or ()}):
            self.before[dst].append(src)
        self.branches = {c["idx"] for c in row["code"] if c["opcode"].startswith("if-") or "switch" in c["opcode"]}

    def walk(self, r: dict, states: int) -> Iterator[tuple]:
        """(kind, idx, detail, target, step, method, request) rows; a walk visits so many states at most."""
        out: list[tuple] = []
        retained, seen, entry, queue = set(), set(), set(), deque()
        leads, deciders, visited = set(), [], 0  # what leads to retained instructions, one backward walk for all of them
        say = lambda kind, idx, detail, target=None, step=0, method=self.method, request=None: out.append((kind, idx, detail, target, step, method, request))

        def ask(method: str, **request) -> None:
            say("request", request.get("idx", -1), request["reason"], method=method, request=json.dumps(request, sort_keys=True))

        def read(c: dict, live: set[str]) -> set[str]:
            """What a retained instruction makes live."""
            if c["stop"]:
                say("boundary", c["idx"], c["stop"], c["target"])
            if c["more"]:
                say("boundary", c["idx"], "candidate_limit", c["target"])
            if not c["callees"] or not live & self.defs[c["idx"]]:
                return set(c["uses"])
            if r["depth"] >= self.limits.depth:
                say("boundary", c["idx"], "call_depth_limit", c["target"])
                return set()
            for callee in c["callees"]:
                if callee in r["path"]:
                    say("boundary", c["idx"], "recursion", c["target"])
                else:
                    ask(callee, mode="returns", depth=r["depth"] + 1, reason="callee_return", ctx=[*r["ctx"], [self.method, c["idx"]]], path=[*r["path"], callee])
            return set()

        def retain(idx: int, reason: str, step: int) -> None:
            say("retain", idx, reason, step=step)
            retained.add(idx)
            left = [idx]
            while left:
                for p in self.before[left.pop()]:
                    if p not in leads:
                        leads.add(p)
                        left.append(p)
                        if p in self.branches:
                            deciders.append(p)

        def visit(idx: int, live: set[str], forced: bool, step: int, reason: str) -> None:
            nonlocal visited
            c = self.code.get(idx)
            if c is None or visited > states:
                return
            visited += 1
            if visited > states:
                say("boundary", idx, "traversal_state_limit")
                return
            if forced or live & self.defs[idx]:
                retain(idx, reason, step)
                live = (live - self.defs[idx]) | read(c, live)
            if not self.before[idx]:
                entry.update(s for s in live if s[0] == "p")
            for p in self.before[idx]:
                for s in live:
                    if (p, s) not in seen:
                        seen.add((p, s))
                        queue.append((p, s, step + 1))

        def drain(reason: str) -> None:
            while queue:
                p, s, step = queue.popleft()
                visit(p, {s}, False, step, reason)

        starts: list[tuple[int, list[str]]] = []
        if r["mode"] == "start":
            starts = [(r["idx"], r["syms"])]
        elif r["mode"] == "returns":
            starts = [(c["idx"], c["uses"]) for c in self.row["code"] if c["opcode"].startswith("return") and not c["opcode"].startswith("return-void")]
        else:
            call = self.code.get(r["idx"])
            found = call and _mapped(call, r["types"], r["static"], r["syms"])
            if found is None or call is None:
                say("issue", r["idx"], "MALFORMED_PARAMETER_MAPPING")
                return iter(out)
            if r["reverse"]:
                say("retain", r["idx"], "caller_argument")  # alone it decides nothing
            starts = [(p, found) for p in self.before[r["idx"]]]
        for idx, syms in starts:
            visit(idx, set(syms), True, 1, r["reason"])
        drain(r["reason"])
        while deciders:
            idx = deciders.pop()
            if idx not in retained and visited < states:
                say("retain", idx, "control_dependency", step=1 << 20)
                visit(idx, set(self.code[idx]["uses"]), True, 1 << 20, "data_dependency")
                drain("data_dependency")
        if wanted := sorted(entry):
            back = {"mode": "caller", "syms": wanted, "reason": "caller_argument", "types": self.row["types"], "static": self.row["is_static"]}
            at = starts[0][0] if starts else -1
            if r["ctx"]:
                caller, idx = r["ctx"][-1]
                ask(caller, idx=idx, depth=max(0, r["depth"] - 1), ctx=r["ctx"][:-1], path=r["path"][:-1], reverse=False, **back)
            else:
                say("unsafe", at, "")
                if (self.row["n_sites"] or 0) > self.limits.candidates:
                    say("boundary", at, "candidate_limit")
                if self.row["sites"] and r["depth"] >= self.limits.depth:
                    say("boundary", at, "call_depth_limit")
                else:
                    for site in self.row["sites"] or ():
                        ask(site["method"], idx=site["idx"], depth=r["depth"] + 1, ctx=[], path=[*r["path"], site["method"]], reverse=True, **back)
        say("states", -1, "", step=visited)
        return iter(out)


def _named(rows: Iterator[tuple], place: int) -> Iterator[tuple]:
    """The rows of a walk; the count of its states bears the request's place instead of an index."""
    return ((kind, place if kind == "states" else idx, *rest) for kind, idx, *rest in rows)


def _within_budget(asked: DataFrame, used: DataFrame | None, limits: Limits) -> DataFrame:
    """asked with place, each request's number within its slice, and left, the states that its slice may still visit."""
    rows = asked.withColumn("place", F.row_number().over(W.partitionBy(*_SLICE).orderBy("method", "request")))
    spent = F.lit(0) if used is None else F.coalesce("used", F.lit(0))
    rows = rows if used is None else rows.join(used, _SLICE, "left")
    return rows.select(*_SLICE, "method", "request", "place", (F.lit(limits.states) - spent).cast("int").alias("left"))


def _round(requests: DataFrame, methods: DataFrame, limits: Limits) -> DataFrame:
    much = requests.groupBy("apk", "method").agg(F.count("*").alias("asked")).where(F.col("asked") > TOGETHER).select("apk", "method", F.lit(SALTS).alias("salts"))
    salt = F.pmod(F.xxhash64("s_method", "s_idx"), F.coalesce("salts", F.lit(1)))
    salted = requests.join(much, ["apk", "method"], "left").groupBy("apk", "method", salt.alias("salt")).agg(F.collect_list(F.struct("s_method", "s_idx", "request", "place", "left")).alias("requests"))
    rows = salted.join(methods, ["apk", "method"])
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]

    apk_type = to_arrow_type(requests.schema["apk"].dataType)

    def batch(told: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), [apk_type, *kinds], strict=True)], ["apk", *_OUT])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        for part in parts:
            for row in part.to_pylist():
                walker, apk = _Walker(row, limits), row["apk"]
                for q in row["requests"]:
                    rows = _named(walker.walk(json.loads(q["request"]), q["left"]), q["place"])
                    told += dict.fromkeys((apk, q["s_method"], q["s_idx"], kind, method, idx, detail, target, step, request) for kind, idx, detail, target, step, method, request in rows)
                    if len(told) >= ROWS_OUT:
                        yield batch(told)
                        told = []
        if told:
            yield batch(told)

    named = T.StructType([requests.schema["apk"], *[T.StructField(n, T.IntegerType() if n in ("s_idx", "idx", "step") else T.StringType()) for n in _OUT]])
    return rows.mapInArrow(batches, named)


def _plain(column: pa.Array) -> list:
    """A column's values, taken out together; of lists too. A null number is -1, a null list empty."""
    if not pa.types.is_list(column.type):
        column = column.fill_null(-1) if pa.types.is_integer(column.type) else column
        return column.to_numpy(zero_copy_only=False).tolist()
    values, ends = tuple(_plain(column.flatten())), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [values[i:j] for i, j in zip([0, *ends], ends, strict=False)]


class _Package:
    """All rows of one package, and the slices of its sinks.

    Declarations, callers and callees are looked up as bodies() joins them; rows of a method come together, in order of methods.
    What only a walk reads is made of a method's rows when the first walk comes to it."""

    def __init__(self, apk, rows: list[tuple], limits: Limits):
        self.apk, self.limits = apk, limits
        by_kind: tuple[list[tuple], ...] = ([], [], [], [])
        for row in rows:
            by_kind[row[0]].append(row)
        lines, edges, self.declared, sinks = by_kind
        self.sinks = {(row[1], row[2]) for row in sinks}
        self.code: dict[str, list[tuple]] = defaultdict(list)
        self.edges: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for row in lines if sinks else ():
            self.code[row[1]].append(row)
        for _, method, src, dst, *_ in edges if sinks else ():
            self.edges[method].append((src, dst))
        self.walkers: dict[str, list[_Walker]] = {}

    def _linked(self) -> None:
        """Boundaries and callees of calls, callers of methods."""
        able = [d for d in self.declared if d[2] & _SOUND and any(row[4] is not None for row in self.code.get(d[1], ()))]
        known: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        self.signed: dict[str, set[str]] = defaultdict(set)
        for _, method, bits, _, target, *_ in self.declared:
            known[target][0] += 1
            known[target][1] += bool(bits & _NATIVE)
            self.signed[method].add(target)
        bodies: dict[str, list[str]] = defaultdict(list)
        self.able: dict[str, list[tuple]] = defaultdict(list)
        for row in able:
            bodies[row[4]].append(row[1])
            self.able[row[1]].append(row)
        first = {target: sorted(found)[: self.limits.candidates] for target, found in bodies.items()}
        self.called, self.sites, self.calls = defaultdict(list), defaultdict(list), {}
        for method, lines in self.code.items():
            for _, _, idx, _, _, target, kind, stop, *_ in lines:
                if target is None:
                    continue
                n, natives = known.get(target, (0, 0))
                found, callees, more = bodies.get(target, ()), None, None
                if stop is None:
                    if not n:
                        stop = "external_call"
                    elif kind == "super" and n > 1:
                        stop = "unresolved_local_call"
                    elif not found:
                        stop = "native_method" if natives else "unresolved_local_call"
                    else:
                        callees, more = first[target], len(found) > self.limits.candidates
                if stop in _UNSURE and n:
                    self.called[target].append((stop, method, idx, target))
                if kind in ("static", "direct", "super") and found and method in self.able:
                    for callee in found:
                        self.sites[callee].append((method, idx))
                self.calls[method, idx] = (target, stop, callees, more)

    def _walkers(self, method: str) -> list[_Walker]:
        if method not in self.walkers:
            code = []
            for _, _, idx, falls, op, _, _, _, uses, defs, regs in self.code.get(method, ()):
                target, stop, callees, more = self.calls.get((method, idx), (None, None, None, None))
                code.append({"idx": idx, "opcode": op or "", "uses": uses, "defs": defs, "regs": regs, "target": target, "stop": stop, "callees": callees, "more": more})
                if falls >= 0:
                    self.edges[method].append((idx, falls))
            calls = self.sites.get(method)
            sites = calls and [{"method": m, "idx": i} for m, i in sorted(calls[: self.limits.candidates])]
            self.walkers[method] = [
                _Walker({"method": method, "types": row[8], "is_static": bool(row[2] & _STATIC), "code": code, "edges": self.edges.get(method), "sites": sites, "n_sites": calls and len(calls)}, self.limits)
                for row in self.able.get(method, ())
            ]
        return self.walkers[method]

    def slices(self) -> Iterator[tuple]:
        """(apk, s_method, s_idx, kind, method, idx, detail, target, round, step) rows, each once."""
        if not self.sinks:
            return
        self._linked()
        apk = self.apk
        for method, idx in sorted(self.sinks):
            kept: dict[tuple, tuple[int, int]] = {(method, idx, "sink"): (0, 0)}
            stops, issues, unsafe = set(), set(), set()
            target, stop, *_ = self.calls.get((method, idx), (None, None))
            if stop is not None:
                stops.add((stop, method, idx, target))
            open_: list[tuple] = [(method, {"mode": "start", "idx": idx, "syms": list(syms), "depth": 0, "ctx": [], "path": [method], "reason": "data_dependency"}) for syms in sorted({tuple(sorted(row[8])) for row in self.code.get(method, ()) if row[2] == idx})]
            done, used, number = set(), 0, 0
            while open_:
                number, left, asked = number + 1, self.limits.states - used, set()
                for name, request in open_:
                    for walker in self._walkers(name):
                        for kind, at, detail, target, step, where, more in walker.walk(json.loads(request) if number > 1 else request, left):
                            if kind == "retain":
                                place, now = (where, at, detail), (number, step)
                                kept[place] = min(kept.get(place, now), now)
                            elif kind == "request":
                                asked.add((where, more))
                            elif kind == "states":
                                used += step
                            elif kind == "boundary":
                                stops.add((detail, where, at, target))
                            elif kind == "unsafe":
                                unsafe.add(where)
                            else:
                                issues.add((where, at, detail))
                asked = sorted(asked - done)
                done.update(asked)
                room = max(0, self.limits.states - used)  # each walk visits a state at least
                stops |= {("traversal_state_limit", name, -1, None) for name, _ in asked[room:]}
                open_ = asked[:room]
            stops.update(stop for name in unsafe for target in self.signed[name] for stop in self.called.get(target, ()))
            for (where, at, reason), (number, step) in kept.items():
                yield apk, method, idx, "retain", where, at, reason, None, number, step
            for boundary, where, at, target in stops:
                yield apk, method, idx, "boundary", where, at, boundary, target, None, None
            for where, at, issue in issues:
                yield apk, method, idx, "issue", where, at, issue, None, None, None


def packaged(ud: DataFrame, decl: DataFrame, edges: DataFrame, sinks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(apk, s_method, s_idx, kind, method, idx, detail, target, round, step): what program_slices() gives, by packages that come whole
    to a task each; kind is retain, boundary or issue."""
    # op is a line's opcode or a declaration's signature, a its uses or the signature's types
    text, none, no = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("int")
    row = lambda df, kind, at, to=no, op=text, target=text, call=text, why=text, a=none, b=none, c=none: df.select("apk", "method", F.lit(kind).alias("kind"), at.cast("int").alias("at"), to.cast("int").alias("to"), op.alias("op"), target.alias("target"), call.alias("call"), why.alias("why"), a.alias("a"), b.alias("b"), c.alias("c"))
    target = F.when(F.col("opcode").startswith("invoke-"), F.col("ref"))
    call = F.when(target.isNotNull(), call_kind(F.col("opcode")))
    bits = F.coalesce(flow.sound().cast("int"), F.lit(0)) * _SOUND + flow.flagged("static").cast("int") * _STATIC + flow.flagged("native").cast("int") * _NATIVE
    rows = (
        row(ud, _CODE, F.col("idx"), F.col("falls") if "falls" in ud.columns else no, op=F.col("opcode"), target=target, call=call, why=F.when(target.isNotNull(), flow.undeclared(call, target)), a=F.col("uses"), b=F.col("defs"), c=F.col("regs"))
        .unionByName(row(edges, _EDGE, F.col("src"), F.col("dst")))
        .unionByName(row(decl, _DECLARED, bits, op=F.col("full_signature"), a=param_types(F.regexp_extract("full_signature", r"(\(.*)$", 1))))
        .unionByName(row(sinks, _SINK, F.col("idx")))
    ).where("apk IS NOT NULL AND method IS NOT NULL AND at IS NOT NULL")
    spark = ud.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ud.count() // PART_ROWS))
    rows = rows.repartition(parts, "apk").sortWithinPartitions("apk", "method", "at")
    rows = rows.select("apk", "kind", F.col("method").cast("string").alias("method"), "at", "to", "op", "target", "call", "why", "a", "b", "c")
    kinds = [to_arrow_type(ud.schema["apk"].dataType), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def batch(told: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), kinds, strict=True)], ["apk", *_FOUND])

    def packages(parts: Iterator[pa.RecordBatch]) -> Iterator[_Package]:
        held, of = [], None
        for part in parts:
            apks, rows = part.column("apk"), [*zip(*map(_plain, part.columns[1:]), strict=True)]
            starts = [0, *(np.flatnonzero(pc.not_equal(apks[1:], apks[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()] if rows else []
            for i, j in zip(starts, [*starts[1:], len(rows)], strict=False):
                if (apk := apks[i].as_py()) != of:
                    yield _Package(of, held, limits)
                    held, of = [], apk
                held += rows[i:j]
        yield _Package(of, held, limits)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        for package in packages(parts):
            told += package.slices()
            if len(told) >= ROWS_OUT:
                yield batch(told)
                told = []
        if told:
            yield batch(told)

    named = T.StructType([ud.schema["apk"], *[T.StructField(n, T.IntegerType() if n in ("s_idx", "idx", "round", "step") else T.StringType()) for n in _FOUND]])
    return rows.mapInArrow(batches, named)


def program_slices(instr: DataFrame, decl: DataFrame, edges: DataFrame, sinks: DataFrame, cut, limits: Limits = Limits(), ud: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retained, boundaries, issues) of each sink (apk, method, idx); cut writes a table in between and reads it back.

    retained: apk, s_method, s_idx, method, idx, reason, round, step; boundaries: ..., boundary, method, idx, target. ud: use_def() of
    instr, if it has been written; edges may then lack those to the next line, which its column falls names. instr is read for
    packages of over WHOLE rows only."""
    ud = cut(flow.use_def(instr)) if ud is None else ud
    sizes = ud.select("apk").unionByName(decl.select("apk")).groupBy("apk").agg(F.count("*").alias("n"))
    large = cut(sizes.where((F.col("n") > WHOLE) & F.col("apk").isNotNull()).select("apk"))
    of = lambda how: [df.join(large, "apk", how) for df in (instr, decl, edges, sinks)]
    some = not large.isEmpty()
    _, decl_, edges_, sinks_ = of("left_anti") if some else (instr, decl, edges, sinks)
    found = cut(packaged(ud.join(large, "apk", "left_anti") if some else ud, decl_, edges_, sinks_, limits))
    at = [*_SLICE, "method", "idx"]
    # sinks without a package or a method have no slice; they stay what they are
    bare = sinks.where("apk IS NULL OR method IS NULL OR idx IS NULL").distinct()
    bare = bare.select("apk", F.col("method").cast("string").alias("s_method"), F.col("idx").alias("s_idx"), F.col("method").cast("string").alias("method"), "idx", F.lit("sink").alias("reason"), F.lit(0).alias("round"), F.lit(0).alias("step"))
    kept = found.where("kind = 'retain'").select(*at, F.col("detail").alias("reason"), "round", "step").unionByName(bare)
    ends = found.where("kind = 'boundary'").select(*_SLICE, F.col("detail").alias("boundary"), "method", "idx", "target")
    issues = found.where("kind = 'issue'").select(*at, F.col("detail").alias("issue"))
    if not some:
        return kept, ends, issues
    instr_, decl_, edges_, sinks_ = of("left_semi")
    if "falls" in ud.columns:
        falls = ud.join(large, "apk", "left_semi").where("falls IS NOT NULL").select("apk", "method", F.col("idx").alias("src"), F.col("falls").alias("dst"))
        edges_ = edges_.select("apk", "method", "src", "dst").unionByName(falls)
    return tuple(a.unionByName(b) for a, b in zip((kept, ends, issues), tabled(cut(instr_), decl_, edges_, sinks_, cut, limits), strict=True))


def tabled(instr: DataFrame, decl: DataFrame, edges: DataFrame, sinks: DataFrame, cut, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What program_slices() gives, in rounds over tables: for packages of any size."""
    written, bounds = cut(flow.use_def(instr)), cut(flow.boundaries(instr, decl))
    methods = cut(bodies(instr, decl, edges, written, bounds, cut, limits.candidates))
    seed = sinks.select("apk", F.col("method").cast("string").alias("s_method"), F.col("idx").alias("s_idx")).distinct()
    ud = written.select("apk", F.col("method").cast("string").alias("s_method"), F.col("idx").alias("s_idx"), "uses")
    start = F.struct(F.array().cast("array<string>").alias("ctx"), F.lit(0).alias("depth"), F.col("s_idx").alias("idx"), F.lit("start").alias("mode"), F.array("s_method").alias("path"), F.lit("data_dependency").alias("reason"), F.array_sort("uses").alias("syms"))
    first = seed.join(ud, _SLICE).select(*_SLICE, F.col("s_method").alias("method"), F.to_json(start).alias("request"))
    open_ = cut(_within_budget(first, None, limits))
    key, turned = [*_SLICE, "method", "request"], []
    done, outs, used, number = open_.select(*key), [], None, 0
    while not open_.isEmpty():
        number += 1
        out = cut(_round(open_, methods, limits).withColumn("round", F.lit(number)))
        outs.append(out)
        spent = out.where("kind = 'states'").groupBy(*_SLICE).agg(F.sum("step").alias("used"))
        used = cut(spent if used is None else used.unionByName(spent).groupBy(*_SLICE).agg(F.sum("used").alias("used")))
        asked = out.where("kind = 'request'").select(*key).distinct().join(done, key, "left_anti")
        asked = cut(_within_budget(asked, used, limits))
        turned.append(asked.where(F.col("place") > F.col("left")))  # each walk visits a state at least
        open_ = asked.where(F.col("place") <= F.col("left"))
        done = done.unionByName(asked.select(*key))
    if not outs:
        outs, turned = [_round(open_, methods, limits).withColumn("round", F.lit(0))], [open_]
    every, refused = reduce(DataFrame.unionByName, outs), reduce(DataFrame.unionByName, turned)
    at = [*_SLICE, "method", "idx"]
    over = refused.groupBy(*_SLICE, "method").agg(F.lit("traversal_state_limit").alias("boundary")).select(*_SLICE, "boundary", "method", F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("target"))
    kept = every.where("kind = 'retain'").groupBy(*at, F.col("detail").alias("reason")).agg(F.min(F.struct("round", "step")).alias("first")).select(*at, "reason", "first.*")
    sink = seed.select(*_SLICE, F.col("s_method").alias("method"), F.col("s_idx").alias("idx"), F.lit("sink").alias("reason"), F.lit(0).alias("round"), F.lit(0).alias("step"))
    stops = bounds.where("boundary IS NOT NULL").select("apk", F.col("method").cast("string").alias("method"), "idx", "target", "boundary")
    own = seed.join(stops.select("apk", F.col("method").alias("s_method"), F.col("idx").alias("s_idx"), "target", "boundary"), _SLICE).select(*_SLICE, "boundary", F.col("s_method").alias("method"), F.col("s_idx").alias("idx"), "target")
    named = decl.select("apk", F.col("method").cast("string").alias("called"), F.col("full_signature").alias("target"))
    unsure = stops.where("boundary IN ('virtual_dispatch', 'unresolved_local_call')").join(named, ["apk", "target"])
    reverse = every.where("kind = 'unsafe'").select(*_SLICE, F.col("method").alias("called")).distinct().join(unsure, ["apk", "called"]).select(*_SLICE, "boundary", "method", "idx", "target")
    told = every.where("kind = 'boundary'").select(*_SLICE, F.col("detail").alias("boundary"), "method", "idx", "target")
    issues = every.where("kind = 'issue'").select(*at, F.col("detail").alias("issue")).distinct()
    return kept.unionByName(sink), told.unionByName(own).unionByName(reverse).unionByName(over).distinct(), issues


def apply_limits(retained: DataFrame, boundaries: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(retained, boundaries) within the budgets of methods and instructions; the first instruction that each budget turns away
    is a boundary."""
    at = [*_SLICE, "method", "idx"]
    first = retained.groupBy(*at).agg(F.min(F.struct(F.when(F.col("reason") == "sink", 0).otherwise(1).alias("late"), "round", "step")).alias("first"))
    order = W.partitionBy(*_SLICE).orderBy("first", "method", "idx")
    ranked = first.withColumn("met", F.min("first").over(W.partitionBy(*_SLICE, "method")))
    ranked = ranked.withColumn("m", F.dense_rank().over(W.partitionBy(*_SLICE).orderBy("met", "method")))
    inside = ranked.where(F.col("m") <= limits.methods).withColumn("n", F.row_number().over(order))
    turned = lambda rows, kind: rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*_SLICE, F.lit(kind).alias("boundary"), "method", "idx", F.lit(None).cast("string").alias("target"))
    lost = turned(ranked.where(F.col("m") > limits.methods), "method_limit").unionByName(turned(inside.where(F.col("n") > limits.instructions), "instruction_limit"))
    kept = retained.join(inside.where(F.col("n") <= limits.instructions).select(*at), at, "left_semi")
    return kept, boundaries.unionByName(lost)


TRUNCATING = ("call_depth_limit", "method_limit", "candidate_limit", "instruction_limit", "traversal_state_limit", "recursion")


def slice_summary(retained: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(apk, s_method, s_idx, methods, instructions, reasons, boundaries, truncated) of each slice."""
    by = retained.groupBy(*_SLICE).agg(F.countDistinct("method").alias("methods"), F.countDistinct("method", "idx").alias("instructions"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    ends = boundaries.groupBy(*_SLICE).agg(F.count("*").alias("boundaries"), F.bool_or(F.col("boundary").isin(*TRUNCATING)).alias("truncated"))
    return by.join(ends, _SLICE, "left").withColumns({"boundaries": F.coalesce("boundaries", F.lit(0)), "truncated": F.coalesce("truncated", F.lit(False))})
