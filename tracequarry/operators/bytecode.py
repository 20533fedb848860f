"""Instruction tables: calls, sinks, control flow, and backward slices as a fixpoint."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

_CALL = r"(L[^,\s]+;)->([^\s(]+)(\([^)]*\).+)$"
_PLACE = ["apk", "method", "idx"]


def method_ref(col: Column) -> Column:
    """Struct of class, name and descriptor of a method reference."""
    part = lambda i: F.nullif(F.regexp_extract(col, _CALL, i), F.lit(""))
    return F.struct(part(1).alias("class_name"), part(2).alias("method_name"), F.regexp_replace(part(3), r"\s+", "").alias("descriptor"))


def invokes(instr: DataFrame) -> DataFrame:
    return instr.where(F.col("opcode").startswith("invoke-")).select(*_PLACE, "opcode", method_ref(F.col("call")).alias("ref")).where("ref.class_name IS NOT NULL").select(*_PLACE, "opcode", "ref.*")


def find_sinks(instr: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls of a rule's class and method; a rule without a descriptor takes any."""
    calls, rule = invokes(instr).alias("c"), F.broadcast(rules.alias("r"))
    on = (F.col("c.class_name") == F.col("r.class_name")) & (F.col("c.method_name") == F.col("r.method_name")) & (F.col("r.descriptor").isNull() | (F.col("r.descriptor") == F.col("c.descriptor")))
    return calls.join(rule, on).select("c.apk", "c.method", "c.idx", "r.rule_id", "r.category").distinct()


def call_indicators(instr: DataFrame, indicators: DataFrame) -> DataFrame:
    """Distinct calls behind each indicator and package."""
    return invokes(instr).join(F.broadcast(indicators), ["class_name", "method_name"]).groupBy("apk", "indicator").agg(F.countDistinct("class_name", "method_name", "descriptor").alias("n"))


def code_markers(instr: DataFrame, indicators: DataFrame) -> DataFrame:
    """(apk, reflection, loading): a package's distinct markers; the loader classes of the platform are one marker each."""
    marker = F.when(F.col("class_name").startswith("Ldalvik/system/"), F.col("class_name")).otherwise(F.concat_ws("->", "class_name", "method_name"))
    called = invokes(instr).join(F.broadcast(indicators), ["class_name", "method_name"])
    count = lambda kind, name: F.countDistinct(F.when(F.col("indicator") == kind, marker)).alias(name)
    return called.groupBy("apk").agg(count("reflection", "reflection"), count("dynamic_loading", "loading"))


def with_neighbours(instr: DataFrame) -> DataFrame:
    w = W.partitionBy("apk", "method").orderBy("idx")
    return instr.select(*_PLACE, "opcode", F.lag("opcode").over(w).alias("before"), F.lead("opcode").over(w).alias("after"))


def cfg_edges(instr: DataFrame) -> DataFrame:
    """Fallthrough, branch and goto edges between instructions; none after a return. Targets outside the method are dropped."""
    op, last = F.col("opcode"), F.max("idx").over(W.partitionBy("apk", "method"))
    code = instr.select(*_PLACE, "opcode", "target", last.alias("last"))
    edge = lambda when, dst, kind: F.when(when, F.struct(dst.cast("int").alias("dst"), kind.alias("kind")))
    falls = edge(~op.startswith("return") & (op != "goto") & (F.col("idx") < F.col("last")), F.col("idx") + 1, F.lit("fallthrough"))
    jumps = edge((op.startswith("if-") | (op == "goto")) & (F.col("target") <= F.col("last")), F.col("target"), F.when(op == "goto", "goto").otherwise("branch"))
    # one pass over the code; rows are one method's already, so that equal edges meet without another shuffle
    made = code.select("apk", "method", F.col("idx").alias("src"), F.explode(F.array_compact(F.array(falls, jumps))).alias("e"))
    return made.select("apk", "method", "src", "e.dst", "e.kind").distinct()


def defines(instr: DataFrame) -> DataFrame:
    """(place, def, uses): what an instruction writes and reads among registers."""
    op = F.col("opcode")
    made = F.when(op.startswith("const") | op.startswith("move") | op.startswith("iget") | op.startswith("sget") | op.startswith("add"), F.col("reg"))
    read = (
        F.when(op.startswith("move") | op.startswith("iget"), F.array("reg2")).when(op.startswith("add"), F.array_distinct(F.array("reg", "reg2")))
        .when(op.startswith("if-"), F.array("reg")).when(op.startswith("invoke-") | (op == "aput"), F.array_distinct(F.array("reg", "reg2"))).otherwise(F.array().cast("array<string>"))
    )
    return instr.select(*_PLACE, made.alias("def"), read.alias("uses"))


def _walked(methods: DataFrame, key: str, found: str, walk) -> DataFrame:
    """(apk, method, key, found): what walk(row) gives as (key, found) pairs for each row, which holds one method whole."""
    names, most = ["apk", "method", key, found], 1 << 16

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kinds = [part.schema.field("apk").type, part.schema.field("method").type, pa.int32(), pa.int32()]
            for row in part.to_pylist():
                pairs = walk(row)
                while some := [*itertools.islice(pairs, most)]:
                    columns = [[row["apk"]] * len(some), [row["method"]] * len(some), *zip(*some, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kept = [methods.schema["apk"], methods.schema["method"]]
    return methods.mapInArrow(batches, T.StructType([*kept, T.StructField(key, T.IntegerType()), T.StructField(found, T.IntegerType())]))


def _by_method(df: DataFrame, name: str, *cols: str) -> DataFrame:
    return df.groupBy("apk", "method").agg(F.collect_list(F.struct(*cols)).alias(name))


def _slices(row: dict) -> Iterator[tuple[int, int]]:
    code, back = defaultdict(list), defaultdict(list)
    for c in row["code"]:
        code[c["idx"]].append((c["def"], [u for u in c["uses"] if u is not None]))
    for e in row["edges"] or ():
        back[e["dst"]].append(e["src"])
    for sink in {s["idx"] for s in row["sinks"]}:
        seen = {(sink, u) for _, uses in code[sink] for u in uses}
        left, kept = [*seen], set()
        while left:
            at, sym = left.pop()
            for p in back[at]:
                for made, uses in code[p]:
                    if made == sym:
                        kept.add(p)
                    fresh = {(p, u) for u in (uses if made == sym else (sym,))} - seen
                    seen |= fresh
                    left += fresh
        yield from ((sink, i) for i in kept)


def backward_slices(instr: DataFrame, sinks: DataFrame, cut) -> DataFrame:
    """(apk, method, sink, idx): instructions that a sink's registers depend on, within its method.

    A symbol is live before an instruction if it is used there by a kept one, or is live after and isn't written there. Facts
    stay within a method, so each method is walked to its fixpoint where its rows have been brought together, however long
    it is; `cut` writes the result."""
    seed = sinks.select("apk", "method", "idx").distinct()
    edges = cfg_edges(instr).select("apk", "method", "src", "dst").distinct()
    methods = _by_method(seed, "sinks", "idx").join(_by_method(defines(instr), "code", "idx", "def", "uses"), ["apk", "method"]).join(_by_method(edges, "edges", "src", "dst"), ["apk", "method"], "left")
    return cut(_walked(methods, "sink", "idx", _slices).union(seed.select("apk", "method", F.col("idx").alias("sink"), "idx")).distinct())


def _reached(row: dict) -> Iterator[tuple[int, int]]:
    after = defaultdict(set)
    for e in row["edges"]:
        after[e["src"]].add(e["dst"])
    for start in {e["src"] for e in row["edges"] if e["kind"] == "branch"}:
        seen, left = set(after[start]), [*after[start]]
        while left:
            fresh = after[left.pop()] - seen
            seen |= fresh
            left += fresh
        yield from ((start, node) for node in seen)


def reachable(edges: DataFrame, cut) -> DataFrame:
    """(apk, method, start, node): what control flow reaches from each instruction that branches; itself only on a cycle.
    Each method is walked whole, as in backward_slices."""
    methods = _by_method(edges, "edges", "src", "dst", "kind").where("apk IS NOT NULL AND method IS NOT NULL")
    return cut(_walked(methods, "start", "node", _reached))


def usable_methods(methods: DataFrame) -> DataFrame:
    flags = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("flags", ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    return methods.withColumn("flags", flags).where(~F.arrays_overlap("flags", F.array(F.lit("native"), F.lit("abstract")))).withColumn("flags", F.concat_ws(",", "flags"))
