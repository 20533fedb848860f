"""Sources and sinks: package files, manifests, smali text, listings, records, checked tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tracequarry.sources.shared import written

# Fixed value: a reference to a method as printable bytes show it.
API_REF = r"(L[a-zA-Z0-9_/$]+;->[a-zA-Z0-9_]+)"
MANIFEST = "_package string, `uses-sdk` struct<`_android:targetSdkVersion`: string, `_android:minSdkVersion`: string>, `uses-permission` array<struct<`_android:name`: string>>, application struct<{kinds}>"
_COMPONENT = "array<struct<`_android:name`: string, `_android:exported`: string, `intent-filter`: array<struct<action: array<struct<`_android:name`: string>>>>>>"
COMPONENTS = ("activity", "service", "receiver", "provider")
TELEMETRY = "objection_root_bypass boolean, objection_ssl_pinning_bypass boolean, ebpf_telemetry struct<syscalls: array<string>, files_accessed: array<string>, network_connections: array<struct<ip: string, port: int, protocol: string>>>"


# ---- sources ----


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row for each content below <root>/<label>/*.apk: hash, label, size, first path, number of further paths.

    Contents are hashed in tasks and go no further; one content under two labels raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.apk").load(root)
    label = F.element_at(F.split("path", "/"), -2)
    hashed = files.select(F.sha2("content", 256).alias("apk_hash"), label.alias("label"), F.col("length").alias("apk_size_bytes"), F.col("path").alias("source_path"))
    by = hashed.groupBy("apk_hash").agg(F.min_by("label", "source_path").alias("label"), F.min("apk_size_bytes").alias("apk_size_bytes"), F.min("source_path").alias("source_path"), (F.count("*") - 1).alias("copies"), F.min("label").alias("low"), F.max("label").alias("high"))
    sure = F.when(F.col("low") == F.col("high"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("conflicting labels for "), "apk_hash")).cast("string"))
    return by.select("apk_hash", sure.alias("label"), "apk_size_bytes", "source_path", "copies")


def parse_manifests(texts: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, package, target_sdk, permissions, components) of decoded manifests; malformed XML gives nulls."""
    schema = MANIFEST.format(kinds=", ".join(f"{k}: {_COMPONENT}" for k in COMPONENTS))
    root = F.from_xml(xml, schema, {"mode": "PERMISSIVE"})
    name = lambda items: F.transform(items, lambda x: x["_android:name"])
    actions = lambda c: F.flatten(F.transform(F.coalesce(c["intent-filter"], F.array()), lambda f: F.coalesce(name(f["action"]), F.array())))
    shown = lambda kind: F.transform(F.coalesce(F.col(f"m.application.{kind}"), F.array()), lambda c: F.struct(F.lit(kind).alias("kind"), c["_android:name"].alias("name"), c["_android:exported"].alias("exported"), c["intent-filter"].isNotNull().alias("has_filter"), actions(c).alias("actions")))
    out = texts.select(key, root.alias("m"))
    return out.select(key, F.col("m._package").alias("package"), F.col("m.uses-sdk._android:targetSdkVersion").try_cast("int").alias("target_sdk"), name(F.coalesce(F.col("m.uses-permission"), F.array())).alias("permissions"), F.concat(*map(shown, COMPONENTS)).alias("components"))


def parse_smali(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(methods, instructions, labels, handlers) of smali texts, one class a row.

    A line belongs to the method that its number of .method lines so far gives; payload and annotation blocks are no
    instructions. Lines are numbered by windows over their class, which shuffle; smali.read_classes takes one pass without."""
    line = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), r"\s+#[^\"]*$", ""))
    lines = texts.select(key, F.regexp_extract(text, r"(?m)^\.class\s+(?:.*\s)?(L[^;]+;)\s*$", 1).alias("class_name"), F.posexplode(line).alias("no", "line")).where("line <> '' AND NOT startswith(line, '#')")
    w = W.partitionBy(key, "class_name").orderBy("no")
    opens = lambda words: F.count_if(F.col("line").rlike(rf"^\.(?:{words})\b")).over(w.rowsBetween(W.unboundedPreceding, 0))
    blocks = "annotation|subannotation|array-data|packed-switch|sparse-switch"
    ended = F.count_if(F.col("line").rlike(rf"^\.end (?:{blocks})\b")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = lines.withColumns({"method_no": opens("method"), "closed": F.count_if(F.col("line") == ".end method").over(w.rowsBetween(W.unboundedPreceding, -1)), "depth": opens(blocks) - ended}).withColumn("inside", F.col("method_no") > F.col("closed"))
    mine = [key, "class_name", "method_no"]
    head = r"^\.method\s+(.*?)([^\s(]+)(\([^)]*\).+)$"
    named = marked.where(F.col("line").startswith(".method "))
    methods = named.select(*mine, F.split(F.trim(F.regexp_extract("line", head, 1)), r"\s+").alias("flags"), F.regexp_extract("line", head, 2).alias("method_name"), F.regexp_extract("line", head, 3).alias("descriptor"))
    methods = methods.withColumn("full_signature", F.concat("class_name", F.lit("->"), "method_name", "descriptor"))
    sizes = marked.where(F.col("inside") & F.col("line").rlike(r"^\.(?:locals|registers)\s")).groupBy(*mine).agg(
        F.max(F.regexp_extract("line", r"^\.locals\s+(\d+)", 1).try_cast("int")).alias("local_count"), F.max(F.regexp_extract("line", r"^\.registers\s+(\d+)", 1).try_cast("int")).alias("register_count"))
    unclosed = marked.groupBy(*mine).agg(F.bool_or(F.col("line") == ".end method").alias("terminated"))
    methods = methods.join(sizes, mine, "left").join(unclosed, mine, "left")
    body = marked.where(F.col("inside") & (F.col("depth") == 0) & ~F.col("line").startswith("."))
    place = W.partitionBy(*mine).orderBy("no")
    is_label = F.col("line").startswith(":")
    counted = body.withColumn("idx", F.count_if(~is_label).over(place.rowsBetween(W.unboundedPreceding, 0)))
    opcode = F.substring_index("line", " ", 1)
    instructions = counted.where(~is_label).select(*mine, (F.col("idx") - 1).cast("int").alias("idx"), opcode.alias("opcode"), F.trim(F.substring(F.col("line"), F.length(opcode) + 1, F.length("line"))).alias("operands"), F.col("line").alias("raw_text"))
    labels = counted.where(is_label).select(*mine, F.col("line").alias("label"), F.col("idx").cast("int").alias("idx"))
    caught = r"^\.(?:catch|catchall)(?:\s+(L[^;]+;))?\s+\{(:[^\s.]+)\s+\.\.\s+(:[^\s}]+)\}\s+(:\S+)$"
    part = lambda i: F.nullif(F.regexp_extract("line", caught, i), F.lit(""))
    handlers = marked.where(F.col("inside") & F.col("line").rlike(caught)).select(*mine, part(1).alias("exception"), part(2).alias("try_start"), part(3).alias("try_end"), part(4).alias("handler"))
    return methods, instructions, labels, handlers


def api_references(rows: DataFrame, key: str, text: Column, chunk: int = 15) -> DataFrame:
    """(key, chunk_no, slice_text): printable method references in groups of `chunk` lines; one stand-in line if there is none."""
    found = F.filter(F.regexp_extract_all(text, F.lit(API_REF), 1), lambda x: F.length(x) > 10)
    n = F.size(found)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / chunk).cast("int"))), lambda i: F.array_join(F.slice(found, i * chunk + 1, F.lit(chunk)), "\n"))
    spare = F.array(F.concat(F.lit("invoke-virtual {v0}, Landroid/content/Context;->getPackageName; //"), F.col(key).cast("string")))
    return rows.select(key, F.posexplode(F.when(n > 0, groups).otherwise(spare)).alias("chunk_no", "slice_text"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are no records, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def training_rows(records: DataFrame) -> DataFrame:
    """(text, label) of records under any of the names in use; empty texts go."""
    pick = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in records.columns], F.lit(None))
    label = F.coalesce(pick(("label", "is_malware", "malicious")).try_cast("int"), F.lit(0))
    return records.select(pick(("slice_text", "code", "text", "slice")).alias("text"), label.alias("label")).where(F.length("text") > 0)


def parse_telemetry(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, root, ssl, syscalls, files, sockets) of telemetry documents; what a document lacks has its default."""
    d = rows.select(key, F.from_json(document, TELEMETRY).alias("d"))
    some = lambda c: F.coalesce(F.col(f"d.{c}"), F.array())
    flag = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit(False))
    sockets = F.transform(F.col("d.ebpf_telemetry.network_connections"), lambda x: F.struct(x["ip"].alias("ip"), x["port"].alias("port")))
    return d.select(key, flag("objection_root_bypass").alias("root"), flag("objection_ssl_pinning_bypass").alias("ssl"), some("ebpf_telemetry.syscalls").alias("syscalls"), some("ebpf_telemetry.files_accessed").alias("files"), F.coalesce(sockets, F.array()).alias("sockets"))


def unknown_telemetry(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, name, value): what a document has beside the keys that parse_telemetry reads, as VARIANT; broken documents have none."""
    known = T.StructType.fromDDL(TELEMETRY).fieldNames()
    other = F.map_filter(F.from_json(document, "map<string,variant>"), lambda k, v: ~k.isin(*known))
    return rows.select(key, F.explode(other).alias("name", "value"))


def parse_nm_lines(lines: DataFrame) -> DataFrame:
    """(library, symbol, kind, address, malformed) of listing lines `name type [address [size]]`; undefined symbols go, lines
    without a type letter are marked."""
    part = F.split(F.trim("line"), r"\s+")
    at = lambda i: F.try_element_at(part, F.lit(i))
    malformed = ~F.coalesce(at(2).rlike("^[A-Za-z?]$"), F.lit(False))
    address = F.when(F.coalesce(at(3).rlike("^(?:0[xX])?[0-9A-Fa-f]+$"), F.lit(False)), at(3))
    rows = lines.where(F.trim("line") != "").select("library", F.when(~malformed, at(1)).alias("symbol"), F.when(~malformed, at(2)).alias("kind"), F.when(~malformed, address).alias("address"), malformed.alias("malformed"))
    return rows.where("malformed OR upper(kind) <> 'U'").distinct()


def parse_readelf(lines: DataFrame) -> DataFrame:
    """(library, symbol, kind, address, malformed) of dynamic symbol lines: global or weak, defined, visible; no @version."""
    part = F.split(F.trim("line"), r"\s+", 8)
    short = F.size(part) < 8
    at = lambda i: F.try_element_at(part, F.lit(i))
    shown = at(5).isin("GLOBAL", "WEAK") & (at(7) != "UND") & at(6).isin("DEFAULT", "PROTECTED") & (at(8) != "")
    rows = lines.where(F.trim("line").rlike(r"^\d+:")).where(short | shown)
    unless = lambda c: F.when(~short, c)
    return rows.select("library", unless(F.substring_index(at(8), "@", 1)).alias("symbol"), unless(at(4)).alias("kind"), unless(F.when(at(2).rlike("^(?:0[xX])?[0-9A-Fa-f]+$"), at(2))).alias("address"), short.alias("malformed")).distinct()


# ---- sinks ----


def write_csv_checked(df: DataFrame, path: str) -> int:
    """Writes CSV with a header, reads it back and raises unless all rows are there; df is computed once, by way of a table in
    the shared folder."""
    rows = written(df, "csv")
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    wanted, found = rows.count(), df.sparkSession.read.csv(path, header=True, escape='"', multiLine=True).count()
    if found != wanted:
        raise RuntimeError(f"{path} contains {found} rows, but {wanted} were measured")
    return found


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, gzip, fields in order of name; the commit of the job makes them visible at once."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path, compression="gzip")


def write_shards(tokens: DataFrame, path: str, buckets: int = 256) -> None:
    """Token rows, one folder for each bucket of packages."""
    tokens.withColumn("apk_bucket", F.pmod(F.xxhash64("apk_hash"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("apk_bucket").parquet(path)


def compact_ir(rows: DataFrame) -> DataFrame:
    """Rows without what a cache doesn't need: paths of sources, symbols' addresses, all but four columns of a library."""
    kept = [c for c in rows.columns if c not in ("source_path", "declared_source_file", "address")]
    out = rows.select(*kept)
    if "library" in kept and isinstance(rows.schema["library"].dataType, T.StructType):
        out = out.withColumn("library", F.struct(*[F.col(f"library.{c}").alias(c) for c in ("filename", "abi", "archive_path", "sha256")]))
    return out


def dataset_manifest(outcomes: DataFrame, splits: DataFrame, versions: dict[str, str]) -> DataFrame:
    """One row: versions, numbers of packages by status as a map, and the digest of the split mapping."""
    from tracequarry.operators.rules import mapping_digest

    by = outcomes.groupBy("status").agg(F.count("*").alias("n"))
    counts = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("processed"))  # a row for each status
    digest = mapping_digest(splits, "apk_hash", "split").select(F.col("n").alias("unique_apks"), F.col("digest").alias("split_digest"))
    both = counts.withColumn("one", F.lit(1)).join(digest.withColumn("one", F.lit(1)), "one").drop("one")
    return reduce(lambda df, kv: df.withColumn(kv[0], F.lit(kv[1])), versions.items(), both).withColumn("unprocessed", F.col("unique_apks") - F.col("processed"))


def write_case_tables(tables: dict[str, tuple[DataFrame, str]], path: str, updated: str = "updated_at") -> None:
    """Result tables by name: (rows, key), written as Parquet below path; of several rows of a key the latest stays."""
    for name, (rows, key) in tables.items():
        last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(updated)))
        rows.withColumn("_n", last).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/{name}")
