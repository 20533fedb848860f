"""Outcomes of processing: warnings, statuses, native evidence, data checks, summaries, and rankings of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracequarry.functions import code

# Strings of native code that mean something, by category.
SIGNATURES = {
    "process_execution": ("execl", "execve", "execvp", "fork", "popen", "system"),
    "network": ("SSL_read", "SSL_write", "connect", "getaddrinfo", "inet_addr", "recv", "send", "socket"),
    "filesystem": ("chmod", "open", "openat", "read", "unlink", "write"),
    "dynamic_loading": ("JNI_OnLoad", "RegisterNatives", "System.loadLibrary", "android_dlopen_ext", "dlopen", "dlsym"),
    "anti_analysis": ("/proc/self/maps", "TracerPid", "frida", "gum-js-loop", "ptrace"),
    "privilege_system": ("mount", "setgid", "setuid", "su"),
    "cryptography": ("AES", "EVP_Decrypt", "EVP_Encrypt", "RSA"),
}
# An instruction that writes its first register, for the lookup of constants.
_WRITES = "^(?:move|const|new-|iget|sget|aget|array-length|instance-of|check-cast|add-|sub-|rsub-|mul-|div-|rem-|and-|or-|xor-|shl-|shr-|ushr-|neg-|not-|cmp)|-to-"
TERMINAL = ("completed", "completed_with_truncation", "capped", "zero_sink")
TOLERATED = ("failed", "timed_out", "extraction_partial")


# ---- statuses ----


def triage_warnings(no_sdk: Column, no_entry: Column, no_code: Column) -> Column:
    """Sorted warnings of a package."""
    found = F.array(F.when(no_sdk, "TARGET_SDK_UNAVAILABLE"), F.when(no_entry, "NO_DISCOVERABLE_ENTRY_POINT"), F.when(no_code, "NO_DEX_FILES"))
    return F.array_sort(F.array_compact(found))


def extraction_status(usable: Column, complete: Column, fallback: Column, native_failed: Column, libraries: Column) -> Column:
    return F.when((usable > 0) & (~complete | fallback | native_failed), "PARTIAL").when(usable > 0, "SUCCESS").when(libraries > 0, "PARTIAL").otherwise("FAILED")


def extraction_backend(methods: DataFrame) -> DataFrame:
    """(apk, usable, extracted_by): which extractor the usable methods of a package come from; null without one."""
    usable = ~F.lower("flags").rlike("native|abstract")
    by = methods.groupBy("apk").agg(F.count_if(usable).alias("usable"), F.count_if(usable & (F.col("backend") == "smali")).alias("a"), F.count_if(usable & (F.col("backend") == "raw")).alias("b"))
    name = F.when(F.col("usable") == 0, None).when(F.col("a") == F.col("usable"), "smali").when(F.col("b") == F.col("usable"), "raw").otherwise("mixed")
    return by.select("apk", "usable", name.alias("extracted_by"))


def processing_status(extraction: Column, timed_out: Column, failed: Column, sinks: Column, cap_reason: Column, truncated: Column) -> Column:
    """What became of a package: trouble first, then no sink, a cap, truncated slices, all done."""
    return (
        F.when(extraction == "PARTIAL", "extraction_partial").when((extraction == "FAILED") | failed, "failed").when(timed_out, "timed_out")
        .when(sinks == 0, "zero_sink").when(cap_reason.isNotNull(), "capped").when(truncated > 0, "completed_with_truncation").otherwise("completed")
    )


def sink_summary(sinks: DataFrame, selected: DataFrame, cap: int) -> DataFrame:
    """(apk, total, methods, selected, omitted, retained_categories, cap_reason): a package's sinks and which were kept; the
    categories are a map of counts, of a rule table's size."""
    total = sinks.groupBy("apk").agg(F.count("*").alias("total_sink_count"), F.countDistinct("method").alias("sink_method_count"))
    by = selected.groupBy("apk", "category").agg(F.count("*").alias("n"))
    kept = by.groupBy("apk").agg(F.sum("n").alias("selected_sink_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("retained_sink_categories"))
    both = total.join(kept, "apk", "left").withColumn("selected_sink_count", F.coalesce("selected_sink_count", F.lit(0)))
    reason = F.when(F.col("total_sink_count") > cap, "max_slices_per_apk")
    return both.withColumn("omitted_sink_count", F.col("total_sink_count") - F.col("selected_sink_count")).withColumn("cap_reason", reason)


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row over packages (status, slices) and their truncated slices: failures, empty packages, truncated totals."""
    return outcomes.agg(F.count("*").alias("packages"), F.count_if(F.col("status").isin(*TOLERATED)).alias("failed"), F.count_if(F.col("slices") == 0).alias("zero_slice"), F.sum("truncated").alias("truncated"), (F.sum("slices") - F.sum("truncated")).alias("whole"))


def shard_index(outcomes: DataFrame, shards: DataFrame) -> DataFrame:
    """(apk_hash): packages of a terminal status that have a shard."""
    return outcomes.where(F.col("status").isin(*TERMINAL)).select("apk_hash").join(shards.select("apk_hash"), "apk_hash", "left_semi")


def missing_shards(splits: DataFrame, shards: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(apk_hash, state) of split packages without a shard: tolerated where their outcome explains it, else an error."""
    absent = splits.select("apk_hash").join(shards.select("apk_hash"), "apk_hash", "left_anti").join(outcomes.select("apk_hash", "status"), "apk_hash", "left")
    state = F.when(F.col("status").isNull(), "no_outcome").when(F.col("status").isin(*TOLERATED), "tolerated").otherwise("missing")
    return absent.select("apk_hash", state.alias("state"))


# ---- data checks ----


def incompatible(rows: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Rows whose version columns aren't all as given; a null is not."""
    wrong = F.lit(False)
    for name, wanted in versions.items():
        wrong = wrong | ~F.col(name).eqNullSafe(F.lit(wanted))
    return rows.where(wrong)


def token_violations(tokens: DataFrame, forbidden: tuple[str, ...] = ("attention_mask", "label")) -> DataFrame:
    """Rows whose token_count isn't the length of input_ids; columns that a shard must not hold raise."""
    if held := [c for c in forbidden if c in tokens.columns]:
        raise ValueError(f"token rows hold {', '.join(held)}")
    return tokens.where(~F.col("token_count").eqNullSafe(F.size("input_ids").cast("long")))


def issue_table(issues: DataFrame) -> DataFrame:
    """Distinct issues, in their canonical order, with a severity."""
    severity = F.when(F.col("issue").endswith("NO_USABLE_GRAPH"), "error").otherwise("warning")
    return issues.distinct().withColumn("severity", severity).orderBy(*[F.asc_nulls_first(c) for c in ("issue", "apk", "method", "idx", "detail")])


def mapping_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pairs that only one mapping has; a stored mapping may not change, so any row is an error."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(stored, fresh, "stored").unionByName(only(fresh, stored, "fresh"))


def canonical_order(rows: DataFrame, kind: str) -> DataFrame:
    """rows in the order in which methods, boundaries or slices are published."""
    keys = {
        "methods": (code.code_file_order(F.col("dex_name")) if "dex_name" in rows.columns else F.lit(1), F.regexp_extract("full_signature", "^([^-]*)->", 1), F.col("full_signature"), F.when(F.col("backend") == "smali", 0).otherwise(1) if "backend" in rows.columns else F.lit(0)),
        "boundaries": tuple(F.asc_nulls_first(c) for c in ("boundary", "apk", "method", "idx", "target") if c in rows.columns), "slices": tuple(F.col(c) for c in ("apk", "method", "idx", "rule_id") if c in rows.columns),
    }
    return rows.orderBy(*keys[kind])


# ---- native evidence ----


def byte_signals(texts: DataFrame, key: str, text: str, signatures=SIGNATURES) -> DataFrame:
    """(key, category, signature, n): whole-word occurrences, found in one pass by one alternation of all signatures."""
    named = {s: c for c, several in signatures.items() for s in several}
    quoted = "|".join(rf"\Q{s}\E" for s in sorted(named, key=len, reverse=True))
    category = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9_])(?:{quoted})(?![A-Za-z0-9_])"), 0)).alias("signature"))
    return found.groupBy(key, "signature").agg(F.count("*").alias("n")).select(key, category[F.col("signature")].alias("category"), "signature", "n")


def symbol_signals(symbols: DataFrame, key: str, signatures=SIGNATURES) -> DataFrame:
    """(key, category, signature, n): exported symbols named as a signature, without their @version."""
    named = {s: c for c, several in signatures.items() for s in several}
    category = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    base = F.substring_index("symbol", "@", 1)
    return symbols.select(key, base.alias("signature")).where(F.col("signature").isin(*named)).groupBy(key, "signature").agg(F.count("*").alias("n")).select(key, category[F.col("signature")].alias("category"), "signature", "n")


def merged_signals(by_bytes: DataFrame, by_symbols: DataFrame, key: str) -> DataFrame:
    """Both kinds of evidence; a symbol's replaces that of bytes for the same signature."""
    on = [key, "category", "signature"]
    both = by_bytes.withColumnRenamed("n", "bytes").join(by_symbols.withColumnRenamed("n", "symbols"), on, "full")
    return both.select(*on, F.coalesce("symbols", "bytes").alias("n"), F.when(F.col("symbols").isNotNull(), "exported_symbol").otherwise("binary_string").alias("source"))


def jni_issues(loads: DataFrame, mappings: DataFrame, signals: DataFrame) -> DataFrame:
    """(key, issue, n) for each package: load names that only the run knows, absent libraries, possible registration at run time.

    loads: key, requested (null: dynamic), resolved; mappings: key, kind; signals: key, signature."""
    issue = F.when(F.col("requested").isNull(), "DYNAMIC_LIBRARY_LOAD_NAME").when(~F.col("resolved"), "LOADED_LIBRARY_NOT_IN_APK")
    missed = loads.select("key", issue.alias("issue")).where("issue IS NOT NULL").groupBy("key", "issue").agg(F.count("*").alias("n"))
    open_ = mappings.where("kind = 'unresolved'").groupBy("key").agg(F.count("*").alias("n"))
    hooks = signals.where(F.col("signature").isin("RegisterNatives", "JNI_OnLoad")).select("key").distinct()
    return missed.unionByName(open_.join(hooks, "key", "left_semi").select("key", F.lit("DYNAMIC_JNI_REGISTRATION_POSSIBLE").alias("issue"), "n"))


def jni_status(complete: Column, useful: Column, cached: bool = False) -> Column:
    """Of a package's native analysis; from cached evidence, nothing to show means it doesn't apply."""
    return F.when(complete, "SUCCESS").when(useful, "PARTIAL").otherwise("NOT_APPLICABLE" if cached else "FAILED")


def resolve_constants(instr: DataFrame, limit: int = 64) -> DataFrame:
    """(apk, method, idx, register, value): the string that a call's last register holds, by its nearest earlier definition
    within `limit` instructions; moves are followed, any other definition leaves it unknown (null)."""
    regs = code.registers(F.col("operands"))
    w = W.partitionBy("apk", "method").orderBy("idx").rowsBetween(-limit, -1)
    literal = code.json_string(F.try_element_at(code.split_operands(F.col("operands")), F.lit(2)))
    step = F.struct("opcode", F.col("regs").alias("regs"), literal.alias("literal"))
    seen = instr.withColumn("regs", regs).withColumn("before", F.reverse(F.collect_list(step).over(w)))  # at most `limit`
    calls = seen.where(F.col("opcode").startswith("invoke-") & (F.size("regs") > 0))
    start = F.struct(F.element_at("regs", -1).alias("register"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("value"))

    def back(state: Column, x: Column) -> Column:
        op, first = x["opcode"], F.try_element_at(x["regs"], F.lit(1))
        mine, made = first == state["register"], lambda r, done, value: F.struct(r.alias("register"), done.alias("done"), value.alias("value"))
        none, yes = F.lit(None).cast("string"), F.lit(True)
        text = op.startswith("const-string") & (F.size(x["regs"]) > 0)
        moved = op.startswith("move") & ~op.rlike("^move-(?:result|exception)")
        return (
            F.when(state["done"] | ~F.coalesce(mine, F.lit(False)), state).when(text, made(state["register"], yes, x["literal"]))
            .when(moved, F.when(F.size(x["regs"]) >= 2, made(F.element_at(x["regs"], 2), F.lit(False), none)).otherwise(state)).when(op.rlike(_WRITES), made(state["register"], yes, none)).otherwise(state)
        )

    return calls.select("apk", "method", "idx", F.element_at("regs", -1).alias("register"), F.aggregate("before", start, back)["value"].alias("value"))


def native_opacity(mappings: DataFrame, entropy: DataFrame) -> DataFrame:
    """(key, opacity): half the share of unresolved declarations, half the entropy of the libraries over 8 bits."""
    share = mappings.groupBy("key").agg((F.count_if(F.col("kind") == "unresolved") / F.count("*")).alias("share"))
    return share.join(entropy, "key", "left").select("key", F.round(0.5 * F.col("share") + 0.5 * F.coalesce("entropy", F.lit(0.0)) / 8, 6).alias("opacity"))


def text_entropy(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy) in bits, by the counts of a text's characters."""
    each = texts.select(key, F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(key, "c").agg(F.count("*").alias("n"))
    total = each.groupBy(key).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(key, F.round(F.log2("all") - F.col("s") / F.col("all"), 6).alias("entropy"))


# ---- what a report shows ----


def static_proxy(telemetry: DataFrame) -> DataFrame:
    """(session, probability, triage_score, obfuscated): a stand-in for the static stage where only a run was seen."""
    seen = (F.size("sockets") > 0) | (F.size("files") > 0) | F.col("root") | F.col("ssl")
    return telemetry.select("session", F.when(seen, 0.82).otherwise(0.05).alias("probability"), F.when(seen, 85.0).otherwise(10.0).alias("triage_score"), F.col("root").alias("obfuscated"))


COMPLIANCE = (("Sec 12.2", "root", "FAIL"), ("Sec 14.5", "ssl", "FAIL"), ("Sec 8.1", "encrypted", "PASS"))


def compliance(telemetry: DataFrame) -> DataFrame:
    """(session, section, result): rules that a session's evidence decides."""
    seen = telemetry.withColumn("encrypted", F.exists("files", lambda f: f.endswith(".db")))
    rows = F.array(*[F.when(F.col(flag), F.struct(F.lit(section).alias("section"), F.lit(result).alias("result"))) for section, flag, result in COMPLIANCE])
    return seen.select("session", F.explode(F.array_compact(rows)).alias("r")).select("session", "r.*")


def classify_dns(answers: DataFrame) -> DataFrame:
    """answers (session, domain, resolved_ip, status) as shown: the status in capitals, a dash for no address."""
    return answers.select("session", "domain", F.coalesce(F.nullif("resolved_ip", F.lit("")), F.lit("—")).alias("resolved_ip"), F.upper("status").alias("status"))


def case_report(jobs: DataFrame, packages: DataFrame, reports: DataFrame) -> DataFrame:
    """(job, apk_hash, status, compliance_status): two joins by key; a report that isn't there yet is null."""
    return jobs.join(packages, "job").join(reports, "apk_hash", "left").select("job", "apk_hash", "status", "compliance_status")


def strongest(attributions: DataFrame, *keys: str) -> DataFrame:
    """(keys, weight): the greatest weight by size, of two of one size the positive one.

    It is the greatest or the least one, which hashing finds without a sort."""
    ends = attributions.groupBy(*keys).agg(F.max("weight").alias("high"), F.min("weight").alias("low"))
    return ends.select(*keys, F.when(F.abs("high") >= F.abs("low"), F.col("high")).otherwise(F.col("low")).alias("weight"))


def slice_attributions(slices: DataFrame, attributions: DataFrame) -> DataFrame:
    """(slice_id, apk, token, weight): each slice's tokens once, with the greatest weight by size."""
    best = strongest(attributions, "slice_id", "token")
    return slices.select("slice_id", "apk").join(best, "slice_id")


def top_attributions(attributions: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Tokens by absolute weight within each key; the first k of them."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("weight")), "token"))
    ranked = attributions.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def time_stratified_split(rows: DataFrame, key: str, label: str, ts: str, boundary: int, old, new, seed: int = 42, cut=None) -> DataFrame:
    """(key, split): the split of WIN-7 within each label and age, newer rows with ratios of their own; cut as in stratified_split."""
    from tracequarry.operators.dataset import stratified_split

    aged = rows.select(F.col(key).alias("apk_hash"), F.concat_ws("/", F.col(label).cast("string"), F.when(F.year(ts) > boundary, "new").otherwise("old")).alias("label"))
    aged = cut(aged) if cut else aged
    parts = [stratified_split(aged.where(F.col("label").endswith(f"/{name}")), ratios, seed, cut) for name, ratios in (("old", old), ("new", new))]
    return parts[0].unionByName(parts[1]).select(F.col("apk_hash").alias(key), F.col("label").alias("stratum"), "split")


def exercised_permissions(telemetry: DataFrame) -> DataFrame:
    """(session, permission, status) for each permission that a run used."""
    return telemetry.select("session", F.explode(F.array_sort(F.array_distinct("permissions_exercised"))).alias("permission")).withColumn("status", F.lit("exercised at runtime"))


def iocs(events: DataFrame, packages: DataFrame) -> DataFrame:
    """(kind, indicator): addresses that sessions reached and hashes of malicious packages, each once."""
    ips = events.where("ip IS NOT NULL").select(F.lit("ip").alias("kind"), F.col("ip").alias("indicator"))
    return ips.unionByName(packages.where("label = 'Malicious'").select(F.lit("sha256").alias("kind"), F.col("apk_hash").alias("indicator"))).distinct()
