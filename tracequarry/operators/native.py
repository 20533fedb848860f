"""Native code: names of exported functions, symbol listings, and which library a declaration or a load belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jni_encode(text: Column) -> Column:
    """A class, method or parameter text as it is spelled in an exported name."""
    code = lambda c: F.concat(F.lit("_0"), F.lower(F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0")))
    spelled = lambda c: F.when(c == "_", "_1").when(c == ";", "_2").when(c == "[", "_3").when(c == "/", "_").when(c.rlike("^[A-Za-z0-9]$"), c).otherwise(code(c))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.split(text, ""), spelled), ""))


def jni_names(declared: DataFrame) -> DataFrame:
    """declared (class_name as La/b;, method_name, params) with the short and the long exported name."""
    inner = F.regexp_replace("class_name", "^L|;$", "")
    short = F.concat(F.lit("Java_"), jni_encode(inner), F.lit("_"), jni_encode(F.col("method_name")))
    return declared.withColumn("short_name", short).withColumn("long_name", F.concat("short_name", F.lit("__"), jni_encode(F.col("params"))))


def parse_nm(lines: DataFrame) -> DataFrame:
    """(library, symbol, kind, address) of listing lines `name type address [size]`; undefined and malformed ones dropped."""
    part = F.split(F.trim("line"), r"\s+")
    whole = lines.where((F.size(part) >= 3) & F.element_at(part, 2).rlike("^[A-Za-z]$") & F.element_at(part, 3).rlike("^[0-9A-Fa-f]+$") & (F.upper(F.element_at(part, 2)) != "U"))
    return whole.select("library", F.element_at(part, 1).alias("symbol"), F.element_at(part, 2).alias("kind"), F.conv(F.element_at(part, 3), 16, 10).cast("long").alias("address")).distinct()


def jni_mappings(named: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each declaration's best match: its long name, else its short one where only one declaration has it.

    named has (decl, short_name, long_name), symbols has a column symbol; both joins are on the name."""
    exported = symbols.select("symbol").distinct()
    sharing = named.groupBy("short_name").agg(F.count("*").alias("sharing"))
    found = (
        named.join(sharing, "short_name").join(exported.select(F.col("symbol").alias("long_name"), F.lit(True).alias("long_hit")), "long_name", "left")
        .join(exported.select(F.col("symbol").alias("short_name"), F.lit(True).alias("short_hit")), "short_name", "left")
    )
    kind = F.when(F.col("long_hit"), "exact_long").when(F.col("short_hit") & (F.col("sharing") == 1), "exact_short").when(F.col("short_hit"), "ambiguous").otherwise("unresolved")
    sure = F.when(F.col("kind") == "exact_long", 1.0).when(F.col("kind") == "exact_short", 0.9).when(F.col("kind") == "ambiguous", 0.5).otherwise(0.0)
    return found.select("decl", kind.alias("kind")).withColumn("confidence", sure)


def jni_metrics(mapped: DataFrame) -> DataFrame:
    return mapped.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("exact_long", "exact_short", "ambiguous", "unresolved")], F.count("*").alias("n"))


def library_loads(loads: DataFrame, libraries: DataFrame) -> DataFrame:
    """loads (load_id, requested) with each library file (filename, abi) that the name may mean, or null."""
    name = F.col("requested")
    candidates = F.array_distinct(F.array(F.element_at(F.split(name, "/"), -1), F.concat(F.lit("lib"), name, F.lit(".so"))))
    wanted = loads.select("load_id", "requested", F.explode(candidates).alias("filename"))
    hits = wanted.join(libraries.select("filename", "abi").distinct(), "filename")
    return loads.join(hits.select("load_id", "filename", "abi"), "load_id", "left").select("load_id", "requested", "filename", "abi")
