"""Inventory, splits, selection and statistics of a training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RATIOS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))


def dedup_by_content(files: DataFrame) -> DataFrame:
    """One row for each content: the first path stays, the others are listed."""
    by = files.groupBy("apk_hash").agg(F.min("source_path").alias("source_path"), F.min("label").alias("label"), F.min("apk_size_bytes").alias("apk_size_bytes"), F.array_sort(F.collect_list("source_path")).alias("paths"))
    return by.select("apk_hash", "label", "apk_size_bytes", "source_path", F.concat_ws(",", F.slice("paths", 2, 1 << 30)).alias("duplicate_source_paths"))


def first_of_each(files: DataFrame) -> DataFrame:
    """(apk_hash, label, source_path, copies, conflicting): the first path of each content with its label; occurrences() lists
    the others as rows, so that no list grows with a content's copies."""
    by = files.groupBy("apk_hash").agg(F.min_by("label", "source_path").alias("label"), F.min("source_path").alias("source_path"), (F.count("*") - 1).alias("copies"), F.min("label").alias("low"), F.max("label").alias("high"))
    return by.select("apk_hash", "label", "source_path", "copies", (F.col("low") != F.col("high")).alias("conflicting"))


def label_conflicts(files: DataFrame) -> DataFrame:
    return files.groupBy("apk_hash").agg(F.countDistinct("label").alias("labels"), F.count("*").alias("n")).where("labels > 1")


def ranked(rows: DataFrame, group: str, *order: str, cut) -> DataFrame:
    """rows with `rank`, 1 for the first of its group, however few groups there are: rows are dealt out by ranges of (group,
    order), numbered within their part, and moved on by the numbers of the parts before. cut writes the dealt rows."""
    dealt = cut(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))  # a row for each part and group
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)))
    moved = own.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return moved.withColumn("rank", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before", "_group", "_p")


def stratified_split(apks: DataFrame, ratios=RATIOS, seed: int = 42, cut=None) -> DataFrame:
    """(apk_hash, label, split): each label's share by largest remainder, in an order that only the seed sets.

    With cut, which writes a table and reads it back, a label's rows are numbered in many tasks; without, in one."""
    n = apks.groupBy("label").agg(F.count("*").alias("n"))
    floors = [F.floor(F.col("n") * r) for _, r in ratios]
    rests = [F.round(F.col("n") * r - F.floor(F.col("n") * r), 9) for _, r in ratios]
    spare = F.col("n") - sum(floors[1:], floors[0])
    rank = lambda i: sum((F.when((rests[j] > rests[i]) | ((rests[j] == rests[i]) & F.lit(j < i)), 1).otherwise(0) for j in range(len(ratios)) if j != i), F.lit(0))
    quota = n.select("label", *[(floors[i] + F.when(rank(i) < spare, 1).otherwise(0)).alias(f"q{i}") for i in range(len(ratios))])
    keyed = apks.select("apk_hash", "label", F.sha2(F.concat_ws(":", F.lit(str(seed)), "label", "apk_hash"), 256).alias("order"))
    placed = ranked(keyed, "label", "order", cut=cut) if cut else keyed.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("order")))
    numbered = placed.select("apk_hash", "label", F.col("rank").alias("rn")).join(quota, "label")
    split, upto = F.when(F.lit(False), ""), F.lit(0)
    for i, (name, _) in enumerate(ratios):
        upto = upto + F.col(f"q{i}")
        split = split.when(F.col("rn") <= upto, name)
    return numbered.select("apk_hash", "label", split.alias("split"))


def limit_per_class(apks: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("label").orderBy("apk_size_bytes", "apk_hash")
    return apks.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def size_quantiles(apks: DataFrame, k: int, cut=None) -> DataFrame:
    """k packages of each class at even ranks of size; cut as in stratified_split."""
    order = ("apk_size_bytes", "apk_hash")
    placed = ranked(apks, "label", *order, cut=cut) if cut else apks.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(*order)))
    sizes = apks.groupBy("label").agg(F.count("*").alias("n"))  # a row for each label
    numbered = placed.withColumn("rank", F.col("rank") - 1).join(F.broadcast(sizes), "label")
    pick = (lambda i: F.floor(F.col("n") / 2)) if k == 1 else (lambda i: F.bround(i * (F.col("n") - 1) / (k - 1)))
    return numbered.where(F.col("rank").isin(*[]) if k < 1 else F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: pick(i) == F.col("rank"))).drop("rank", "n")


def select_by_category(sinks: DataFrame, n: int) -> DataFrame:
    """Round robin over a package's categories, n in all."""
    turn = sinks.withColumn("turn", F.row_number().over(W.partitionBy("apk", "category").orderBy("method", "idx", "rule_id")))
    place = F.row_number().over(W.partitionBy("apk").orderBy("turn", "category"))
    return turn.withColumn("place", place).where(F.col("place") <= n).drop("turn")


def bounded_slices(sizes: DataFrame, cap: int) -> DataFrame:
    """Slices of a package, in order, while their instructions stay within the cap."""
    w = W.partitionBy("apk").orderBy("sink_order").rowsBetween(W.unboundedPreceding, 0)
    return sizes.withColumn("total", F.sum("n").over(w)).where(F.col("total") <= cap)


def numeric_distribution(col: str) -> list[Column]:
    p = F.percentile(col, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    return [F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"), *[F.round(p[i], 6).alias(a) for i, a in enumerate(("median", "p90", "p95", "p99"))], F.max(col).alias("most")]


def weighted_distribution(col: str, times: str) -> list[Column]:
    """numeric_distribution of values that stand `times` times each."""
    p = F.percentile(col, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))), F.col(times))
    there = F.when(F.col(col).isNotNull(), F.col(times))
    mean = F.try_divide(F.sum((F.col(col) * F.col(times)).cast("double")), F.sum(there))
    return [F.coalesce(F.sum(there), F.lit(0)).alias("n"), F.round(mean, 6).alias("mean"), *[F.round(p[i], 6).alias(a) for i, a in enumerate(("median", "p90", "p95", "p99"))], F.max(col).alias("most")]


def finished(tokens: DataFrame) -> DataFrame:
    """Rows of packages of a terminal status: what statistics count."""
    return tokens.where(F.col("status").isin(*TERMINAL))


def token_length_distribution(col: str, thresholds=(512, 1024, 2048, 4096, 8192)) -> list[Column]:
    return [*numeric_distribution(col), *[F.round(F.try_divide(100.0 * F.count_if(F.col(col) > t), F.count(col)), 6).alias(f"over_{t}") for t in thresholds]]


def token_length_struct(col: str, thresholds=(512, 1024, 2048, 4096, 8192)) -> Column:
    """The distribution as one aggregate, a struct."""
    return F.struct(*token_length_distribution(col, thresholds))


GROUPINGS = ("label", "is_truncated", "status", "sink_category", "apk_hash")


def grouped_statistics(tokens: DataFrame) -> DataFrame:
    """The distribution over all rows and within each grouping, in one pass of grouping sets over rows that are counted before
    the sets multiply them."""
    keys = [F.col(c).cast("string").alias(c) for c in GROUPINGS]
    base = tokens.select(*keys, "token_count").groupBy(*GROUPINGS, "token_count").agg(F.count("*").alias("m"))
    sets = base.groupingSets([[], *[[c] for c in GROUPINGS]], *GROUPINGS)
    out = sets.agg(*weighted_distribution("token_count", "m"), *[F.grouping(c).alias(f"g_{c}") for c in GROUPINGS])
    which, value = F.lit("all"), F.lit("all")
    for c in GROUPINGS:
        which, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(which), F.when(F.col(f"g_{c}") == 0, F.col(c)).otherwise(value)
    return out.select(which.alias("grouping"), value.alias("value"), "n", "mean", "median", "p90", "p95", "p99", "most")


def apk_token_statistics(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("apk_hash").agg(
        F.count("*").alias("slices"), F.count_if(~F.col("is_truncated")).alias("complete"), F.count_if("is_truncated").alias("truncated"),
        F.sum("token_count").alias("total"), F.round(F.avg("token_count"), 6).alias("mean"), F.max("token_count").alias("most"),
    )


def class_weights(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    w = W.partitionBy(F.lit(1))  # a row for each class
    return n.select("label", "n", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6).alias("weight"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Upsert rule: the last row of each key stays."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")


TERMINAL = ("completed", "completed_with_truncation", "capped", "zero_sink")


def pending(work: DataFrame, records: DataFrame, key: str, current: dict[str, str], terminal=TERMINAL) -> DataFrame:
    """Keys of work that no record has finished: one of terminal status whose digest columns all equal the current ones."""
    done = records.where(F.col("status").isin(*terminal))
    for name, digest in current.items():
        done = done.where(F.col(name) == digest)
    return work.select(key).distinct().join(done.select(key), key, "left_anti")


def decide(slices: DataFrame, hi: float = 0.85, lo: float = 0.60, k: int = 2) -> DataFrame:
    p = F.col("probability")
    return slices.groupBy("apk").agg(F.max(p).alias("most"), F.count_if(p >= lo).alias("raised"), (F.bool_or(p >= hi) | (F.count_if(p >= lo) >= k)).alias("malicious"))
