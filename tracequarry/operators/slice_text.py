"""From slices to training text: names by first appearance, normalised lines, markers, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracequarry.functions import code

_METHOD = ["apk", "method"]


def names(instr: DataFrame, labels: DataFrame, payloads: DataFrame) -> DataFrame:
    """(apk, method, token, name): registers v0, v1, ... and labels :label_0, ... of each whole method in the order in which
    they first appear: in instructions, then among labels, then in payloads."""
    at, zero = _at, F.lit(0)
    listed = labels.select(*_METHOD, F.col("label").alias("token"), at(1, F.col("idx"), zero).alias("at"))
    tables = payloads.select(*_METHOD, F.col("label").alias("token"), at(2, zero, zero).alias("at"))
    cases = payloads.where("target IS NOT NULL").select(*_METHOD, F.col("target").alias("token"), at(2, F.col("pos"), zero).alias("at"))
    return _numbered(_spoken(instr).union(listed).union(tables).union(cases))


def _at(source: int, place: Column, step: Column) -> Column:
    """Order of source, place (32 bits, null first) and step (24 bits) in one number, whose least one is found by hashing."""
    return F.lit(source << 60) + F.coalesce(place.cast("long"), F.lit(-(1 << 32))) * (1 << 24) + step


def _spoken(instr: DataFrame) -> DataFrame:
    # the outer form, as the plain one would look for tokens twice, first to leave out lines without any
    tokens = instr.select(*_METHOD, "idx", F.posexplode_outer(code.tokens_outside_quotes(F.col("raw_text"))).alias("step", "token")).where("token IS NOT NULL")
    return tokens.select(*_METHOD, "token", _at(0, F.col("idx"), F.col("step")).alias("at"))


def _numbered(tokens: DataFrame) -> DataFrame:
    first = tokens.groupBy(*_METHOD, "token").agg(F.min("at").alias("at"))
    is_label = F.col("token").startswith(":")
    rank = F.row_number().over(W.partitionBy(*_METHOD, is_label).orderBy("at")) - 1
    return first.select(*_METHOD, "token", F.concat(F.when(is_label, ":label_").otherwise("v"), rank.cast("string")).alias("name"))


def normalized(instr: DataFrame, labels: DataFrame | None = None, payloads: DataFrame | None = None) -> DataFrame:
    """instr with the column line: its raw text under the method's names.

    instr is read twice: write it in between. Labels and payloads aren't read: they are numbered after all that instructions speak
    of, so no line shows such a name."""
    maps = _numbered(_spoken(instr)).groupBy(*_METHOD).agg(F.map_from_entries(F.collect_list(F.struct("token", "name"))).alias("names"))
    made = instr.join(maps, _METHOD, "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))
    return made.withColumn("line", code.normalize_instruction(F.col("raw_text"), F.col("names"))).drop("names")


def method_starts(items: DataFrame, slice_key: str) -> DataFrame:
    """Rows of a slice at which the method changes."""
    before = F.lag("method").over(W.partitionBy(slice_key).orderBy("method", "idx"))
    return items.withColumn("before", before).where("before IS NULL OR before <> method").drop("before")


def slice_text(items: DataFrame, bounds: DataFrame, slice_key: str) -> DataFrame:
    """(slice, normalized, raw): the texts of each slice; a slice's length is bounded by the budgets of its making.

    items: slice, method, idx, full_signature, line, raw_text. A [METHOD] line goes before the first instruction of a method,
    [BOUNDARY] lines after their instruction, and those whose instruction isn't kept to the end."""
    row = lambda df, part, order, kind, target, line: df.select(slice_key, part.alias("part"), "method", "idx", F.lit(order).alias("ord"), kind.alias("kind"), target.alias("target"), line.alias("line"))
    none = F.lit("")
    markers = row(method_starts(items, slice_key), F.lit(0), 0, none, none, F.concat(F.lit("[METHOD] "), "full_signature"))
    lines = row(items, F.lit(0), 1, none, none, F.col("line"))
    kept = items.select(slice_key, "method", "idx", F.lit(True).alias("kept"))
    noted = bounds.join(kept, [slice_key, "method", "idx"], "left")
    notes = row(noted, F.when(F.col("kept"), 0).otherwise(1), 2, F.col("kind"), F.coalesce("target", none), F.concat(F.lit("[BOUNDARY] kind="), "kind", F.lit(" target="), F.coalesce("target", F.lit("NONE"))))
    order = F.struct("part", "method", "idx", "ord", "kind", "target", "line")
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n")
    text = markers.union(lines).union(notes).groupBy(slice_key).agg(joined(order).alias("normalized"))
    raw = items.groupBy(slice_key).agg(joined(F.struct("method", "idx", F.col("raw_text").alias("line"))).alias("raw"))
    return text.join(raw, slice_key, "left").select(slice_key, "normalized", "raw")


def pad_batch(rows: DataFrame, batch: str, multiple: int | None = None, pad: int = 0) -> DataFrame:
    """rows (input_ids, batch) padded to the longest of their batch, or up to a multiple; attention_mask is 1 for real ids."""
    most = F.max(F.size("input_ids")).over(W.partitionBy(batch))
    most = most if not multiple else F.ceil(most / multiple) * multiple
    fill = lambda value: F.array_repeat(F.lit(value), (F.col("_most") - F.size("input_ids")).cast("int"))
    return rows.withColumn("_most", most).select(*[c for c in rows.columns if c != "input_ids"], F.concat("input_ids", fill(pad)).alias("input_ids"), F.concat(F.transform("input_ids", lambda _: F.lit(1)), fill(0)).alias("attention_mask"))
