"""Rule tables: plain values that a user can replace by their own DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Which permissions together are dangerous, entry actions, sink calls, loading and reflection calls.
COMBINATIONS = {
    "ACCESSIBILITY_SMS_OVERLAY": ("BIND_ACCESSIBILITY_SERVICE", "RECEIVE_SMS", "SYSTEM_ALERT_WINDOW"),
    "SMS_INTERCEPTION": ("RECEIVE_SMS", "READ_SMS"),
    "SMS_EXFILTRATION": ("READ_SMS", "INTERNET"),
    "BOOT_PERSISTENT_INSTALLER": ("RECEIVE_BOOT_COMPLETED", "REQUEST_INSTALL_PACKAGES"),
    "CONTACT_EXFILTRATION": ("READ_CONTACTS", "INTERNET"),
}
ENTRY_ACTIONS = (
    "android.intent.action.MAIN", "android.intent.action.BOOT_COMPLETED", "android.provider.Telephony.SMS_RECEIVED", "android.accessibilityservice.AccessibilityService",
)
_TEXT = "Ljava/lang/String;"
SINKS = (
    ("sms.send_text", "sms", "Landroid/telephony/SmsManager;", "sendTextMessage", f"({_TEXT * 3}Landroid/app/PendingIntent;Landroid/app/PendingIntent;)V"),
    ("runtime.exec", "execution", "Ljava/lang/Runtime;", "exec", None),
    ("process_builder.start", "execution", "Ljava/lang/ProcessBuilder;", "start", "()Ljava/lang/Process;"),
    ("dex_class_loader.init", "class_loader", "Ldalvik/system/DexClassLoader;", "<init>", f"({_TEXT * 3}Ljava/lang/ClassLoader;)V"),
    ("dex_class_loader.load", "class_loader", "Ldalvik/system/DexClassLoader;", "loadClass", None),
    ("class_loader.load", "class_loader", "Ljava/lang/ClassLoader;", "loadClass", None),
    ("accessibility.global_action", "accessibility", "Landroid/accessibilityservice/AccessibilityService;", "performGlobalAction", "(I)Z"),
    ("accessibility.dispatch_gesture", "accessibility", "Landroid/accessibilityservice/AccessibilityService;", "dispatchGesture", None),
    ("accessibility.node_action", "accessibility", "Landroid/view/accessibility/AccessibilityNodeInfo;", "performAction", None),
    ("reflection.class_for_name", "reflection", "Ljava/lang/Class;", "forName", None),
    ("reflection.get_method", "reflection", "Ljava/lang/Class;", "getMethod", None),
    ("reflection.invoke", "reflection", "Ljava/lang/reflect/Method;", "invoke", None),
    ("native.system_load", "native_loading", "Ljava/lang/System;", "load", f"({_TEXT})V"),
    ("native.system_load_library", "native_loading", "Ljava/lang/System;", "loadLibrary", f"({_TEXT})V"),
)
REFLECTION = (("Ljava/lang/Class;", "forName"), ("Ljava/lang/Class;", "getMethod"), ("Ljava/lang/reflect/Method;", "invoke"), ("Ljava/lang/reflect/Constructor;", "newInstance"))
LOADING = (
    ("Ljava/lang/System;", "loadLibrary"), ("Ljava/lang/System;", "load"), ("Ldalvik/system/DexClassLoader;", "<init>"), ("Ldalvik/system/DexClassLoader;", "loadClass"), ("Ldalvik/system/PathClassLoader;", "<init>"),
    ("Ldalvik/system/PathClassLoader;", "loadClass"), ("Ldalvik/system/InMemoryDexClassLoader;", "<init>"), ("Ldalvik/system/InMemoryDexClassLoader;", "loadClass"), ("Ljava/lang/ClassLoader;", "loadClass"),
)


def combinations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f"android.permission.{p}", len(v)) for k, v in COMBINATIONS.items() for p in v], "combination string, permission string, needed int")


def sinks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SINKS, "rule_id string, category string, class_name string, method_name string, descriptor string")


def indicators(spark: SparkSession) -> DataFrame:
    rows = [("reflection", *x) for x in REFLECTION] + [("dynamic_loading", *x) for x in LOADING]
    return spark.createDataFrame(rows, "indicator string, class_name string, method_name string")


def sql_values(rows, names: str) -> str:
    """Rows as SQL that either engine reads."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS r({names}))"
