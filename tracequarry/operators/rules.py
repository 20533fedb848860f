"""Data-quality rules, coverage checks, and joins that assemble a training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LABEL_IDS = {"Benign": 0, "Malicious": 1}


def duplicates(rows: DataFrame, key: str, shown: str) -> DataFrame:
    """Keys that stand in several rows, with the least and the greatest of what they show; no list grows with a key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(shown).alias("first"), F.max(shown).alias("last")).where("n > 1")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule; a null counts as broken. One pass."""
    counted = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)])).alias("r")).select("r.rule", "r.n")


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state): keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full").where("l IS NULL OR r IS NULL").select(key, F.when(F.col("r").isNull(), "missing").otherwise("extra").alias("state"))


def omitted(every: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    return every.join(kept.select(*on), on, "left_anti")


def conflicting_rows(rows: DataFrame, key: str) -> DataFrame:
    """Every row whose key another row has as well, whole, with the number of such rows; keys are counted before rows are joined."""
    repeated = rows.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return rows.join(repeated, key)


def mapping_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row that is the same in any order: pairs, and the sum of 48 bits of each pair's hash."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", key, value), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest"))


def training_examples(splits: DataFrame, tokens: DataFrame, split: str, label_ids: dict[str, int] = LABEL_IDS) -> DataFrame:
    """tokens of the packages of a split, with the number of their label; a label without one raises."""
    ids = F.create_map(*[F.lit(x) for pair in label_ids.items() for x in pair])
    number = F.coalesce(ids[F.col("label")], F.raise_error(F.concat(F.lit("no id for label "), F.col("label"))).cast("int"))
    chosen = splits.where(F.col("split") == split).select("apk_hash", "label")
    return tokens.join(chosen, "apk_hash").select("example_id", "apk_hash", number.alias("label_id"), "token_count")


def admit(new: DataFrame, known: DataFrame, key: str, job: str) -> DataFrame:
    """(key, job, is_new): uploads by content; known content answers with its job, new content with its own least one."""
    fresh = new.groupBy(key).agg(F.min(job).alias("own"))
    there = known.groupBy(key).agg(F.min(job).alias("there"))
    return fresh.join(there, key, "left").select(key, F.coalesce("there", "own").alias(job), F.col("there").isNull().alias("is_new"))


def occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each row's number among the rows of its key."""
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(key).orderBy(order)))


def top(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def merge_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each package and signature: usable before unusable, smali before raw."""
    every = a.unionByName(b, allowMissingColumns=True)
    usable = ~F.lower("flags").rlike("native|abstract")
    rank = F.when(usable, 0).otherwise(2) + F.when(F.col("backend") == "smali", 0).otherwise(1)
    best = F.row_number().over(W.partitionBy("apk", "full_signature").orderBy("priority", "method"))
    return every.withColumn("priority", rank).withColumn("rn", best).where("rn = 1").drop("rn")


def short_identifiers(names: DataFrame, least: int = 4, share: float = 0.6, short: int = 2) -> DataFrame:
    """(apk, segments, share, obfuscated): how many segments of a package's names are short."""
    each = names.select("apk", F.explode(F.split("name", r"\.")).alias("segment"))
    by = each.groupBy("apk").agg(F.count("*").alias("segments"), F.round(F.count_if(F.length("segment") <= short) / F.count("*"), 6).alias("share"))
    return by.withColumn("obfuscated", (F.col("segments") >= least) & (F.col("share") >= share))


def contains_all(rows: DataFrame, key: str, value: str, required: list[str]) -> DataFrame:
    """(key, has_all) for keys that have one of the required values: whether they have all of them."""
    held = rows.where(F.col(value).isin(*required)).select(key, value).distinct()
    return held.groupBy(key).agg((F.count("*") == len(set(required))).alias("has_all"))


def verify_content(rows: DataFrame, content: str) -> DataFrame:
    """rows (content, size_bytes, sha256 as recorded) with size_holds and content_holds; a missing record holds nothing."""
    same = lambda made, name: F.coalesce(made == F.col(name), F.lit(False))
    return rows.withColumn("size_holds", same(F.octet_length(content), "size_bytes")).withColumn("content_holds", same(F.sha2(content, 256), "sha256"))
