"""From a session's telemetry to what a reader of a report sees: contributions, risks, techniques, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.telemetry import _has, called

# Six axes, each with what root, ssl, a config file, a system file, a bot file, port 4444 and other ports add.
AXES = {
    "Data Theft": (0, 0, 30, 0, 20, 0, 0),
    "Financial Fraud": (0, 0, 0, 0, 15, 55, 0),
    "Persistence": (0, 0, 35, 0, 0, 0, 0),
    "Privilege Escalation": (30, 0, 0, 45, 0, 0, 0),
    "Evasion": (40, 45, 0, 20, 0, 0, 0),
    "Command & Control": (0, 25, 0, 0, 0, 60, 25),
}
# Steps of a run and the texts that show them.
STEPS = {
    "APK Parse & Load": ("receiving", "extracting", "package"),
    "Emulator Installation": ("installing", "device", "emulator-"),
    "Frida Server Spawn": ("frida", "hooks"),
    "Objection Safeguards Bypass": ("objection", "root", "ssl"),
    "Receivers Detonation": ("trojan", "intents", "boot_completed"),
    "Telemetry Logs Synced": ("complete", "syncing", "telemetry"),
}
REVERSE_SHELL = 4444


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _rows(telemetry: DataFrame, *arrays: Column, names: tuple[str, ...]) -> DataFrame:
    """One row for each struct of the arrays (null structs dropped)."""
    kept = [F.filter(a, lambda x: x.isNotNull()) for a in arrays]
    return telemetry.select("session", F.explode(F.concat(*kept)).alias("r")).select("session", *[F.col(f"r.{n}").alias(n) for n in names])


def _when(flag: Column, row: Column) -> Column:
    return F.array(F.when(flag, row))


def contributions(telemetry: DataFrame) -> DataFrame:
    """(session, name, value): what speaks for and against each session."""
    row = lambda name, value: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), F.lit(value).alias("value"))
    file = lambda f: F.when(_has(f, "app_process", "system"), row("Sys Binary Read", 0.25)).when(_has(f, "Bot"), row("Bot Config I/O", 0.18)).when(_has(f, "shared_prefs", "config"), row("Config Write", 0.15))
    socket = lambda s: F.when(s["port"] == REVERSE_SHELL, row("Rev Shell :4444", 0.45)).otherwise(row(F.concat(F.lit("Conn :"), s["port"].cast("string")), 0.10))
    dns = F.exists("sockets", lambda s: s["port"] == 53)
    return _rows(
        telemetry, _when(F.col("root"), row("Frida Root Bypass", 0.35)), _when(F.col("ssl"), row("Frida SSL Bypass", 0.30)),
        F.transform("files", file), F.transform("sockets", socket), _when(called(telemetry, "sys_clone"), row("sys_clone syscall", -0.12)), _when(dns, row("DNS Port 53 query", -0.08)), names=("name", "value"),
    )


def risk_matrix(telemetry: DataFrame, base: int = 5, most: int = 98) -> DataFrame:
    """(session, axis, value): six axes, each from base to most."""
    count = lambda col, test: F.size(F.filter(col, test))
    shells = count("sockets", lambda s: s["port"] == REVERSE_SHELL)
    parts = [
        F.col("root").cast("int"), F.col("ssl").cast("int"), count("files", lambda f: _has(f, "shared_prefs", "config")), count("files", lambda f: _has(f, "app_process", "system")),
        count("files", lambda f: _has(f, "Bot", "contacts")), shells, F.size("sockets") - shells,
    ]
    value = lambda weights: F.least(F.lit(most), base + sum((p * w for p, w in zip(parts, weights, strict=True) if w), F.lit(0)))
    return _rows(telemetry, F.array(*[F.struct(F.lit(a).alias("axis"), value(w).alias("value")) for a, w in AXES.items()]), names=("axis", "value"))


def classify_files(files: DataFrame) -> DataFrame:
    """files (session, file) with operation and context; the first rule that fits decides."""
    name, path = basename(F.col("file")), F.col("file")
    bot, state = name.startswith("Bot") | name.isin("contacts", "app_stat"), name.isin("zlock", "HG", "i", "c")
    system, config = _has(path, "app_process", "system", "su"), _has(path, "shared_prefs", "config")
    chain = lambda a, b, c, d, e: F.when(bot, a).when(state, b).when(system, c).when(config, d).otherwise(e)
    return files.select(
        "session", "file", chain("Write", "Read/Write", "Read", "Read/Write", "Access").alias("operation"),
        chain("Bot Exfiltration", "Trojan State", "System Binary", "App Config", "General").alias("context"),
    )


def classify_sockets(sockets: DataFrame, status: Column | None = None) -> DataFrame:
    """sockets (session, ip, port) with a label of their status (connected where unknown) and what they look like."""
    state = F.lit("connected") if status is None else F.coalesce(status, F.lit("connected"))
    label = F.when(state == "connected", "ESTABLISHED").when(state == "attempted", "ATTEMPTED").otherwise("REFUSED")
    return sockets.select("session", "ip", "port", label.alias("status"), F.when(F.col("port") == REVERSE_SHELL, "reverse shell").otherwise("c2 beacon").alias("assessment"))


def techniques(telemetry: DataFrame) -> DataFrame:
    """(session, technique, trigger) from the evidence."""
    row = lambda technique, trigger: F.struct(F.lit(technique).alias("technique"), (trigger if isinstance(trigger, Column) else F.lit(trigger)).alias("trigger"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    port = lambda s: s["port"].cast("string")
    socket = lambda s: F.when(s["port"] == REVERSE_SHELL, row("T1020", text("Reverse Shell Port :", port(s), " binding"))).otherwise(row("T1071", text("Outbound C2 to ", s["ip"], ":", port(s))))
    file = lambda f: F.when(_has(f, "Bot", "contacts"), row("T1005", text("Bot config I/O: ", basename(f))))
    return _rows(
        telemetry, _when(F.col("ssl"), row("T1112", "Frida SSL Pinning Bypass")), _when(F.col("root"), row("T1055", "Frida Root Guard Bypass")),
        F.transform("sockets", socket), F.transform("files", file), names=("technique", "trigger"),
    )


def findings(telemetry: DataFrame) -> DataFrame:
    """(session, id, severity, category, privacy, title); a session without any has one row that says so."""
    names = ("id", "severity", "category", "privacy", "title")

    def row(ident, severity: str, category: str, privacy: bool, title) -> Column:
        cells = (ident, severity, category, privacy, title)
        return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in zip(names, cells, strict=True)])

    at = lambda prefix, i, plus: F.concat(F.lit(prefix), (i + plus).cast("string"))
    place = lambda s: F.concat(F.lit(" ("), s["ip"], F.lit(":"), s["port"].cast("string"), F.lit(")"))
    title = lambda text, of: F.concat(F.lit(text), of)
    socket = lambda s, i: F.when(s["port"] == REVERSE_SHELL, row(at("KAV-CRIT-0", i, 3), "Critical", "Network Privacy", True, title("Active Reverse Shell / Non-Standard C2 Port Connection", place(s)))).otherwise(
        row(at("KAV-MED-0", i, 2), "Medium", "Network Privacy", True, title("Outbound Network Socket Connection", place(s))))
    file = lambda f, i: (
        F.when(_has(f, "shared_prefs", "config"), row(at("KAV-HIGH-0", i, 1), "High", "Data Storage", True, title("Unencrypted Application Preference Read: ", f)))
        .when(_has(f, "app_process", "system"), row(at("KAV-HIGH-1", i, 1), "High", "System Integrity", False, title("System Binary Execution Marker: ", f)))
        .when(_has(f, "/proc/"), row(at("KAV-MED-1", i, 1), "Medium", "Runtime Security", False, title("Process Memory & Map Inspection: ", f)))
    )
    found = F.filter(F.concat(
        _when(F.col("root"), row("KAV-CRIT-01", "Critical", "Runtime Security", False, "Frida Dynamic Root Bypass Hook Executed")),
        _when(F.col("ssl"), row("KAV-CRIT-02", "Critical", "Network Privacy", True, "SSL/TLS Certificate Pinning Defeated")),
        F.transform("sockets", socket), F.transform("files", file),
        _when(called(telemetry, "sys_execve"), row("KAV-MED-20", "Medium", "System Integrity", False, "Dynamic Process Spawning Syscall (sys_execve)"))), lambda x: x.isNotNull())
    clean = F.array(row("KAV-INFO-01", "Info", "Runtime Security", False, "Dynamic Instrumentation Execution Clean"))
    listed = telemetry.select("session", F.explode(F.when(F.size(found) > 0, found).otherwise(clean)).alias("r"))
    return listed.select("session", *[F.col(f"r.{n}").alias(n) for n in names])


def search_findings(rows: DataFrame, severity: str = "All", query: str = "") -> DataFrame:
    """Findings of a severity (or `Privacy`) whose title, id or category holds the query, in any case."""
    kept = rows if severity == "All" else rows.where(F.col("privacy") if severity == "Privacy" else F.col("severity") == severity)
    held = [F.lower(c).contains(query.lower()) for c in ("title", "id", "category")]
    return kept.where(held[0] | held[1] | held[2])


def severity_counts(rows: DataFrame) -> DataFrame:
    """A column for each severity, 0 where a session has none."""
    return rows.groupBy("session").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low", "Info")])


def evidence_counts(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("session", F.size("files").alias("n_files"), F.size("sockets").alias("n_sockets"), (F.size("files") + F.size("sockets")).alias("n_evidence"))


def steps_shown() -> dict[str, Column]:
    """Whether a line shows each step."""
    return {s: _has(F.lower("line"), *parts) for s, parts in STEPS.items()}


def checkpoints(lines: DataFrame) -> DataFrame:
    """(session, step, active, first_ts): whether any line of a session shows a step, and when first; one pass over the lines."""
    shown = steps_shown()
    first = lines.groupBy("session").agg(*[F.min(F.when(shows, F.col("ts"))).alias(f"s{i}") for i, shows in enumerate(shown.values())])
    row = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"s{i}").alias("ts")) for i, s in enumerate(STEPS)])
    return first.select("session", F.explode(row).alias("r")).select("session", F.col("r.step").alias("step"), F.col("r.ts").isNotNull().alias("active"), F.col("r.ts").alias("first_ts"))


def log_level(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.contains("[error]"), "error").when(low.contains("[warn]"), "warn").when(_has(low, "[sim]", "[info]"), "info").when(low.contains("success"), "success").otherwise("plain")
