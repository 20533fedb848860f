"""Sandbox log lines to one telemetry row for each session, its scores, and fusion with the static result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def parse_log(lines: DataFrame, abi: str = "arm64", marker: str = "[Sandbox]") -> DataFrame:
    """Typed events: kind, file path, address and port, library path, bypass flags, of lines that the marker begins. Works on
    streams too."""
    begin = "^" + re.escape(marker) + " "
    file, socket, native = begin + "File (read|write|access|accessed): (.*)$", begin + r"Network connection: (.*):(\d+)$", begin + "Native library loaded: (.*)$"
    line = F.trim("line")
    got = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    root = line.contains("Root check blocked") | line.contains("Blocked runtime execution") | line.contains("ro.build.tags spoofed")
    ssl = line.contains("SSLContext.init") | line.contains("CertificatePinner check bypassed")
    library = got(native, 1)
    out = lines.select("event_id", "session", "ts", got(file, 2).alias("file"), got(socket, 1).alias("ip"), got(socket, 2).cast("int").alias("port"), F.when(library.isNotNull(), F.concat(F.lit(f"/lib/{abi}/lib"), library, F.lit(".so"))).alias("library"), root.alias("root"), ssl.alias("ssl"))
    kind = F.when(F.col("root") | F.col("ssl"), "bypass").when(F.col("file").isNotNull(), "file").when(F.col("ip").isNotNull(), "socket").when(F.col("library").isNotNull(), "library").otherwise("other")
    return out.withColumn("kind", kind)


def first_seen(events: DataFrame) -> DataFrame:
    """First event of each file, socket and library of a session (batch form)."""
    named = events.where(F.col("kind").isin("file", "socket", "library")).withColumn("item", F.coalesce("file", F.concat("ip", F.lit(":"), F.col("port").cast("string")), "library"))
    return named.groupBy("session", "kind", "item").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


def accumulate_sessions(events: DataFrame) -> DataFrame:
    """A telemetry row for each session; a session's distinct items are few, its events need not be."""
    return events.groupBy("session").agg(
        F.bool_or("root").alias("root"), F.bool_or("ssl").alias("ssl"), F.array_sort(F.collect_set("file")).alias("files"),
        F.array_sort(F.collect_set(F.when(F.col("ip").isNotNull(), F.struct("ip", "port")))).alias("sockets"), F.array_sort(F.collect_set("library")).alias("libraries"),
    )


def flat(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("session", "root", "ssl", F.concat_ws(",", "files").alias("files"), F.concat_ws(",", F.transform("sockets", lambda s: F.concat_ws(":", s["ip"], s["port"].cast("string")))).alias("sockets"), F.concat_ws(",", "libraries").alias("libraries"))


def _any(col: str, *parts: str, lower: bool = False) -> Column:
    return F.exists(col, lambda f: _has(F.lower(f) if lower else f, *parts))


def _has(f: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | f.contains(p)
    return found


def called(telemetry: DataFrame, syscall: str) -> Column:
    """Whether a session used a system call; telemetry without such a column shows none."""
    return F.array_contains("syscalls", syscall) if "syscalls" in telemetry.columns else F.lit(False)


def observe(events: DataFrame, seconds: int) -> DataFrame:
    """Events of the first `seconds` of each session."""
    start = events.groupBy("session").agg(F.min("ts").alias("start"))
    return events.join(start, "session").where(F.col("ts") < F.col("start") + F.make_interval(secs=F.lit(seconds))).drop("start")


def behaviour_flags(telemetry: DataFrame) -> DataFrame:
    return telemetry.withColumns({
        "sms": _any("files", "sms", "telephony", lower=True), "c2": F.size("sockets") > 0, "banking": _any("files", "shared_prefs", "data/user"),
        "loading": _any("files", ".dex", "app_process"), "evasion": F.col("root") | F.col("ssl"), "writes": F.size("files") > 0,
    })


def dynamic_score(flagged: DataFrame) -> DataFrame:
    parts = {"c2": 10, "sms": 15, "banking": 10, "root": 12, "loading": 8, "writes": 5}
    return flagged.withColumn("dynamic_score", sum((F.when(F.col(c), n).otherwise(0) for c, n in parts.items()), F.lit(0)))


def contradiction_label(base: Column, dynamic_high: Column, evasion: Column) -> Column:
    evading = "SANDBOX_EVASION_DETECTED"
    return (
        F.when(evasion & (base < 60), evading).when((base >= 60) & dynamic_high, "CONFIRMED_MALWARE").when((base < 40) & dynamic_high, "PACKED_DROPPER")
        .when((base >= 60) & ~dynamic_high, "DORMANT_MALWARE").when(evasion, evading).otherwise("LIKELY_BENIGN")
    )


def apply_override(score: Column, base: Column, label: Column) -> Column:
    return (
        F.when(label == "PACKED_DROPPER", F.greatest(score, F.lit(85))).when(label == "DORMANT_MALWARE", F.greatest(score, base))
        .when(label == "SANDBOX_EVASION_DETECTED", F.greatest(score, F.lit(75))).when((label == "LIKELY_BENIGN") & (base <= 50), F.least(score, F.lit(30))).otherwise(score)
    )


def fuse(static: DataFrame, scored: DataFrame) -> DataFrame:
    """Static (apk, probability) with dynamic rows by package; a side that is absent counts as its default."""
    both = static.join(scored.withColumnRenamed("session", "apk"), "apk", "full")
    base = F.bround(100 * F.coalesce("probability", F.lit(0.0)), 0).cast("int")
    made = both.select("apk", base.alias("base_score"), F.coalesce("dynamic_score", F.lit(0)).alias("dynamic_score"), F.coalesce("c2", F.lit(False)).alias("c2"), F.coalesce("evasion", F.lit(False)).alias("evasion"))
    label = contradiction_label(F.col("base_score"), (F.col("dynamic_score") >= 15) | F.col("c2"), F.col("evasion"))
    total = F.least(F.col("base_score") + F.col("dynamic_score"), F.lit(100))
    return made.withColumn("label", label).withColumn("score", apply_override(total, F.col("base_score"), F.col("label")))


def static_evidence(packages: DataFrame, slices: DataFrame) -> DataFrame:
    """(apk, probability, slice_count, max_slice_probability); a package without slices has its own probability."""
    by = slices.groupBy("apk").agg(F.count("*").alias("n"), F.max("probability").alias("most"))
    return packages.select("apk", "probability").join(by, "apk", "left").select("apk", "probability", F.coalesce("n", F.lit(0)).alias("slice_count"), F.coalesce("most", "probability").alias("max_slice_probability"))


def fuse_with_evidence(static: DataFrame, scored: DataFrame, attributions: DataFrame) -> DataFrame:
    """fuse() with what each side saw: structs static_evidence and fingerprint, and the number of attributions of all slices."""
    seen = scored.select(F.col("session").alias("apk"), F.struct("sms", "c2", "banking", "root", "loading", "evasion", "dynamic_score").alias("fingerprint"))
    told = attributions.groupBy("apk").agg(F.count("*").alias("attributions"))
    made = fuse(static.select("apk", "probability"), scored).join(static.select("apk", F.struct("probability", "slice_count", "max_slice_probability").alias("static_evidence")), "apk", "left")
    return made.join(seen, "apk", "left").join(told, "apk", "left").withColumn("attributions", F.coalesce("attributions", F.lit(0)))


def flattened(fused: DataFrame, attributions: DataFrame) -> DataFrame:
    """(apk, slice_id, place, token, weight): every attribution of every slice of the fused packages, the strongest of a slice first."""
    place = F.row_number().over(W.partitionBy("slice_id").orderBy(F.desc(F.abs("weight")), "token"))
    return attributions.join(fused.select("apk"), "apk", "left_semi").select("apk", "slice_id", place.alias("place"), "token", "weight")


def threat_probability(telemetry: DataFrame) -> DataFrame:
    file = lambda f: F.when(_has(f, "app_process", "system", "su"), 20).when(_has(f, "Bot", "zlock", "contacts"), 10).when(_has(f, "shared_prefs", "config"), 2).otherwise(0)
    total = lambda col, f: F.aggregate(col, F.lit(0), lambda a, x: a + f(x))
    points = 5 + F.when(F.col("root"), 35).otherwise(0) + F.when(F.col("ssl"), 30).otherwise(0) + total("files", file) + total("sockets", lambda s: F.when(s["port"] == 4444, 45).otherwise(5))
    p = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.02), points / 100.0)), 6)
    some = (F.size("files") > 0) | (F.size("sockets") > 0) | F.col("root") | F.col("ssl")
    out = telemetry.withColumn("probability", p)
    return out.withColumn("verdict", F.when(F.col("probability") > 0.65, "MALICIOUS").when(F.col("probability") > 0.30, "SUSPICIOUS").when(some, "LOW RISK").otherwise("No malicious behavior observed in this run"))


def scorecard(telemetry: DataFrame) -> DataFrame:
    """Security score and grade, privacy score and level."""
    file = lambda f: F.when(_has(f, "app_process", "system", "su"), 15).when(_has(f, "shared_prefs", "config"), 1).when(_has(f, "/proc/"), 2).otherwise(0)
    socket = lambda s: F.when(s["port"] == 4444, 35).when(s["port"].isin(80, 443, 8080, 53), 0).otherwise(3)
    total = lambda col, f: F.aggregate(col, F.lit(0), lambda a, x: a + f(x))
    penalty = F.when(F.col("root"), 30).otherwise(0) + F.when(F.col("ssl"), 25).otherwise(0) + total("files", file) + total("sockets", socket)
    penalty = penalty + F.when(called(telemetry, "sys_execve") & F.col("root"), 10).otherwise(0)
    private = total("files", lambda f: F.when(_has(f, "shared_prefs", "config", "user"), 25).otherwise(0)) + F.when(F.size("sockets") > 0, 20).otherwise(0) + F.when(F.col("ssl"), 20).otherwise(0)
    out = telemetry.withColumn("security", F.when(penalty == 0, 100).otherwise(F.greatest(F.lit(12), F.least(F.lit(98), 100 - penalty)))).withColumn("privacy", F.least(F.lit(95), private))
    s = F.col("security")
    return out.withColumns({
        "grade": F.when(s < 40, "F").when(s < 60, "D").when(s < 75, "C").when(s < 90, "B").otherwise("A"),
        "rating": F.when(s < 40, "CRITICAL").when(s < 60, "HIGH").when(s < 75, "MEDIUM").when(s < 90, "LOW").otherwise("SECURE"),
        "privacy_level": F.when(F.col("privacy") > 65, "HIGH").when(F.col("privacy") > 35, "MEDIUM").otherwise("LOW"),
    })


def windowed_counts(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows; a watermark on ts bounds the state of a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
