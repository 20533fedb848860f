"""Manifest features to a triage score and the order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.plans.rules import ENTRY_ACTIONS


def permission_combos(perms: DataFrame, rules: DataFrame) -> DataFrame:
    """(apk, combination): the rule's permissions are all among the package's. The rule table is a few rows."""
    held = perms.distinct().join(F.broadcast(rules), "permission")
    return held.groupBy("apk", "combination").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n = needed").select("apk", "combination")


def qualified_name(package: Column, name: Column) -> Column:
    return F.when(name.startswith("."), F.concat(package, name)).when(~name.contains("."), F.concat(package, F.lit("."), name)).otherwise(name)


def resolve_exported(kind: Column, raw: Column, has_filter: Column, sdk: Column) -> Column:
    """The exported flag that holds: the attribute, else the platform's default for the kind and target level."""
    given = F.lower(F.trim(raw)) == "true"
    provider = F.coalesce(sdk <= 16, F.lit(False))
    return F.when(raw.isNotNull(), given).when(kind == "provider", provider).otherwise(has_filter & F.coalesce(sdk < 31, F.lit(True)))


def exported_components(components: DataFrame) -> DataFrame:
    flag = resolve_exported(F.col("kind"), F.col("raw_exported"), F.col("has_filter"), F.col("target_sdk"))
    name = qualified_name(F.concat(F.lit("p"), F.col("apk").cast("string")), F.col("raw_name"))
    return components.select("apk", "no", "kind", name.alias("name"), "action", flag.alias("exported"))


def entry_points(components: DataFrame) -> DataFrame:
    """Components that an entry action reaches."""
    return exported_components(components).where(F.col("action").isin(*ENTRY_ACTIONS)).select("apk", "name").distinct()


def triage_score(combos: Column, exported: Column, reflection: Column, loading: Column, obfuscation: Column) -> Column:
    parts = [(20.0, combos, 50.0), (1.5, exported, 12.0), (6.0, reflection, 12.0), (8.0, loading, 16.0), (5.0, obfuscation, 10.0)]
    total = sum((F.least(F.coalesce(n, F.lit(0)) * w, F.lit(most)) for w, n, most in parts), F.lit(0.0))
    return F.round(F.least(total, F.lit(100.0)), 2)


def triage(perms: DataFrame, components: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each package: counts, score, and whether it needs the dynamic stage."""
    combos = permission_combos(perms, rules).groupBy("apk").agg(F.count("*").alias("combos"))
    shown = exported_components(components).groupBy("apk").agg(F.count_if("exported").alias("exported"))
    both = shown.join(combos, "apk", "full").select("apk", F.coalesce("combos", F.lit(0)).alias("combos"), F.coalesce("exported", F.lit(0)).alias("exported"))
    none = F.lit(0)
    scored = both.withColumn("score", triage_score(F.col("combos"), F.col("exported"), none, none, none))
    return scored.withColumn("needs_dynamic", (F.col("score") >= 60) | (F.col("combos") > 0))


def full_triage(perms: DataFrame, components: DataFrame, rules: DataFrame, markers: DataFrame, names: DataFrame, warned: DataFrame) -> DataFrame:
    """triage() with the terms of the code: markers (apk, reflection, loading), names (apk, obfuscated) by short identifiers,
    and warned (apk), the packages whose code could not be read or isn't there. A package of any table has a row."""
    combos = permission_combos(perms, rules).groupBy("apk").agg(F.count("*").alias("combos"))
    shown = exported_components(components).groupBy("apk").agg(F.count_if("exported").alias("exported"))
    warnings = warned.select("apk").distinct().withColumn("warned", F.lit(True))
    every = perms.select("apk").union(components.select("apk")).union(markers.select("apk")).union(names.select("apk")).union(warnings.select("apk")).distinct()
    for part in (combos, shown, markers.select("apk", "reflection", "loading"), names.select("apk", "obfuscated"), warnings):
        every = every.join(part, "apk", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    known = every.select("apk", *map(number, ("combos", "exported", "reflection", "loading")), F.coalesce("obfuscated", F.lit(False)).cast("long").alias("short"), F.coalesce("warned", F.lit(False)).alias("warned"))
    signs = F.col("short") + (F.col("reflection") > 0).cast("long") + (F.col("loading") > 0).cast("long")
    counted = known.withColumn("obfuscation", signs)
    scored = counted.withColumn("score", triage_score(*map(F.col, ("combos", "exported", "reflection", "loading", "obfuscation"))))
    dynamic = (F.col("score") >= 60) | (F.col("combos") > 0) | (F.col("loading") > 0) | (F.col("obfuscation") > 0) | F.col("warned")
    return scored.select("apk", "combos", "exported", "reflection", "loading", "obfuscation", "score", dynamic.alias("needs_dynamic"))


def priority_queue(triaged: DataFrame, k: int) -> DataFrame:
    return triaged.orderBy(F.desc("score"), "apk").limit(k)
