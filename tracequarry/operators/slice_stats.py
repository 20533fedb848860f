"""What became of a package's sinks: selected, published within the budget, turned away, cut; one row a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_SINK = ["apk", "method", "idx", "rule_id"]


def published(candidates: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """candidates, in their order place, with n and fate: published while the package's instructions stay within the budget, rejected for
    the first one that would exceed it, unreached after that."""
    both = candidates.join(records.select(*_SINK, "n"), _SINK)
    total = F.sum("n").over(W.partitionBy("apk").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    rows = both.withColumn("total", total)
    fate = F.when(F.col("total") <= budget, "published").when(F.col("total") - F.col("n") <= budget, "rejected").otherwise("unreached")
    return rows.withColumn("fate", fate).drop("total")


def _counts(rows: DataFrame, name: str) -> DataFrame:
    """A map of counts by category, of a rule table's size."""
    by = rows.groupBy("apk", "category").agg(F.count("*").alias("n"))
    return by.groupBy("apk").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias(name))


def _or_none(col: str, kind: str) -> Column:
    return F.coalesce(F.col(col), F.create_map().cast(kind))


def package_summary(usable: DataFrame, sinks: DataFrame, candidates: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """One row for each package with a usable method or a sink: all counts of its sinks and slices, why sinks were left out, which one
    was turned away, and why slices were cut.

    usable: apk, method; sinks: apk, method, idx, rule_id, category; candidates: some of them with place, their order; records: their
    slices, with n instructions, truncated, and reasons, an array of boundary kinds and issue codes."""
    fates = published(candidates, records, budget)
    done = fates.where("fate = 'published'")
    omitted = sinks.join(done.select(*_SINK), _SINK, "left_anti")
    made = done.select(*_SINK).join(records, _SINK)
    every = sinks.groupBy("apk").agg(F.countDistinct("method").alias("sink_method_count"), F.count("*").alias("total_sink_count"))
    chosen = fates.groupBy("apk").agg(
        F.count("*").alias("candidate_selected_sink_count"), F.count_if(F.col("fate") == "published").alias("selected_sink_count"),
        F.min(F.when(F.col("fate") == "rejected", F.struct("method", "idx", "rule_id"))).alias("rejected_sink"),
    )
    slices = made.groupBy("apk").agg(F.sum("n").alias("retained_instruction_count"), F.count_if(~F.col("truncated")).alias("complete_slice_count"), F.count_if("truncated").alias("truncated_slice_count"))
    why = made.where("truncated").select("apk", F.explode("reasons").alias("reason")).groupBy("apk").agg(F.array_sort(F.collect_set("reason")).alias("truncation_reasons"))
    out = usable.groupBy("apk").agg(F.count("*").alias("usable_method_count")).join(every, "apk", "full")
    for part in (chosen, slices, _counts(done, "retained_sink_categories"), _counts(omitted, "omitted_sink_categories"), why):
        out = out.join(part, "apk", "left")
    counts = [c for c in out.columns if c.endswith("_count")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    reason = F.when(F.col("selected_sink_count") < F.col("candidate_selected_sink_count"), "max_total_slice_instructions").when(F.col("candidate_selected_sink_count") < F.col("total_sink_count"), "max_slices_per_apk")
    return out.withColumns({
        "omitted_sink_count": F.col("total_sink_count") - F.col("selected_sink_count"), "cap_reason": reason, "truncation_reasons": F.coalesce("truncation_reasons", F.array().cast("array<string>")),
        "retained_sink_categories": _or_none("retained_sink_categories", "map<string,bigint>"), "omitted_sink_categories": _or_none("omitted_sink_categories", "map<string,bigint>"),
    })
