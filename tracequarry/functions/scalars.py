"""Scalar rules over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = r"\[*(?:[ZBSCIJFD]|L[^;]+;)"


def parse_bool(col: Column, default: bool) -> Column:
    return F.coalesce(F.lower(F.trim(col)) == "true", F.lit(default))


def parse_sdk(col: Column) -> Column:
    """A level that is a whole number from 0, else null."""
    level = F.trim(col).try_cast("int")
    return F.when(level >= 0, level)


def call_kind(opcode: Column) -> Column:
    kind = F.regexp_extract(opcode, "^invoke-(static|direct|super|virtual|interface)", 1)
    return F.nullif(kind, F.lit(""))


def param_types(descriptor: Column) -> Column:
    """The types between a descriptor's brackets."""
    return F.regexp_extract_all(F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1), F.lit(_TYPE), 0)


def register_words(types: Column) -> Column:
    """Registers that parameters of these types fill: long and double take two."""
    return F.aggregate(types, F.lit(0), lambda n, t: n + F.when(t.isin("J", "D"), 2).otherwise(1))


def size_mb(n: Column) -> Column:
    return F.format_string("%.2f MB", n / 1048576.0)


def incoming_words(types: Column, is_static: Column) -> Column:
    """Registers that a call fills: the receiver, if there is one, and the parameters."""
    return register_words(types) + F.when(is_static, 0).otherwise(1)


def socket_text(sockets: Column) -> Column:
    return F.transform(sockets, lambda s: F.concat_ws(":", s["ip"], s["port"].cast("string")))


def ip_list(sockets: Column) -> Column:
    """The addresses of sockets, as often as they stand."""
    return F.filter(F.transform(sockets, lambda s: s["ip"]), lambda x: x.isNotNull())
