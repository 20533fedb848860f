"""Scalar rules over bytecode text: operands, registers, literals, descriptors, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a type, an operand, a token and a quoted piece look like.
TYPE = r"\[*(?:[ZBSCIJFD]|L[^\s.;\[]+;)"
DESCRIPTOR = rf"^\((?:{TYPE})*\)(?:V|{TYPE})$"
METHOD_NAME = r"^(?:<init>|<clinit>|[^\s.;\[/<>(]+)$"
CLASS_NAME = r"^L[^;\s]+;$"
OPERAND = r'(?:\{[^}]*\}|"(?:\\.|[^"\\])*"|[^,{"])+'
REGISTER = r"\b[vp][0-9]+\b"
RANGE = r"\b([vp])([0-9]+)\s*\.\.\s*([vp])([0-9]+)\b"
_QUOTED = r'"(?:\\.|[^"\\])*"?'
#: In one pass over a line: a register or label that isn't part of a longer name is the first group, names and quoted text are passed over.
_NAMED = rf"(v[0-9]++(?![A-Za-z0-9_$:])|:[A-Za-z0-9_$.-]+)|[A-Za-z0-9_$]+:?|{_QUOTED}"
#: What a line is made of; signs, single blanks and names that are no register together.
_PIECE = rf"{_QUOTED}|,\s*|(?:[^\s\",:A-Za-z0-9_$]| (?!\s)|(?!v[0-9])[A-Za-z0-9_$]++:?)+|\s+|[A-Za-z0-9_$]+:?|:[A-Za-z0-9_$.-]+|:"


def clean_text(text: Column) -> Column:
    """Null as empty; without white space at either end."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def split_operands(text: Column) -> Column:
    """Operands between commas; a comma in braces or quotes parts nothing; empty operands go."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(OPERAND), 0), lambda x: F.trim(x)), lambda x: x != "")


def registers(operands: Column) -> Column:
    """Distinct registers of an operand text; {v1 .. v4} stands for all four, before the others."""
    part = lambda i: F.regexp_extract(operands, RANGE, i)
    low, high = part(2).try_cast("int"), part(4).try_cast("int")
    whole = operands.contains("..") & (part(1) != "") & (part(1) == part(3))  # most operands have no range to look for
    spread = F.when(whole & (low <= high), F.transform(F.sequence(F.least(low, high), F.greatest(low, high)), lambda i: F.concat(part(1), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    rest = F.when(whole, F.regexp_replace(operands, RANGE, " ")).otherwise(operands)
    return F.array_distinct(F.concat(spread, F.regexp_extract_all(rest, F.lit(REGISTER), 0)))


def raw_register(text: Column, local_count: Column) -> Column:
    """Registers vN of a text by their place: those from local_count on are parameters."""
    number = lambda t: F.substring(t, 2, 10).cast("int")
    named = lambda t: F.when(t.rlike(r"^v[0-9]{1,9}$"), F.when(number(t) >= local_count, F.concat(F.lit("p"), (number(t) - local_count).cast("string"))).otherwise(F.concat(F.lit("v"), number(t).cast("string")))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\w+|\W+"), 0), named), "")


def parse_smali_int(text: Column) -> Column:
    """A literal's value: decimal, 0x, 0o or 0b, a sign, one suffix of t, s, l; else null."""
    bare = F.regexp_replace(F.trim(text), "[tTsSlL]$", "")
    sign = F.when(bare.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.lower(F.regexp_replace(bare, "^[+-]", ""))
    based = lambda pattern, base: F.when(digits.rlike(pattern), sign * F.conv(F.substring(digits, 3, 64), base, 10).cast("decimal(20,0)"))
    plain = F.when(digits.rlike("^(0+|[1-9][0-9]*)$"), sign * digits.try_cast("decimal(20,0)"))
    return F.coalesce(based("^0x[0-9a-f]{1,16}$", 16), based("^0o[0-7]{1,21}$", 8), based("^0b[01]{1,63}$", 2), plain).try_cast("bigint")


def parameter_registers(types: Column, is_static: Column) -> Column:
    """Each type's first register: p0 is the receiver where there is one; long and double take two."""
    first = F.when(is_static, 0).otherwise(1)
    wide = lambda seen: F.size(F.filter(seen, lambda t: t.isin("J", "D")))
    return F.transform(types, lambda t, i: F.struct(i.alias("position"), t.alias("type"), F.concat(F.lit("p"), (first + i + wide(F.slice(types, F.lit(1), i))).cast("string")).alias("register")))


def json_string(text: Column) -> Column:
    """What a quoted JSON string says; null for anything else."""
    return F.when(F.trim(text).startswith('"'), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0])


def valid_descriptor(text: Column) -> Column:
    return text.rlike(DESCRIPTOR)


def valid_identity(class_name: Column, method_name: Column, descriptor: Column, full_signature: Column) -> Column:
    """Class, name and descriptor are well formed, and make up the signature."""
    return class_name.rlike(CLASS_NAME) & method_name.rlike(METHOD_NAME) & valid_descriptor(descriptor) & (full_signature == F.concat(class_name, F.lit("->"), method_name, descriptor))


def valid_library_path(path: Column) -> Column:
    """lib/<abi>/.../name.so without empty, '.' or '..' parts and backslashes."""
    parts = F.split(path, "/")
    return (F.size(parts) >= 3) & (parts[0] == "lib") & path.endswith(".so") & ~path.contains("\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def code_file_order(name: Column) -> Column:
    """classes.dex is 1, classesN.dex is N, any other file comes last."""
    number = F.regexp_extract(name, r"^classes([0-9]*)\.dex$", 1)
    return F.when(~name.rlike(r"^classes[0-9]*\.dex$"), F.lit(2147483647).cast("long")).when(number == "", F.lit(1).cast("long")).otherwise(number.cast("long"))


def normalize_instruction(text: Column, names: Column) -> Column:
    """Outside quotes: registers and labels renamed by a map, blanks squeezed, one blank after a comma."""
    squeezed = lambda p: F.when(p.startswith('"'), p).when(p.startswith(","), ", ").when(p.rlike(r"^\s+$"), " ").otherwise(F.coalesce(F.try_element_at(names, p), p))
    return F.trim(F.array_join(F.transform(F.regexp_extract_all(F.trim(text), F.lit(_PIECE), 0), squeezed), ""))


def tokens_outside_quotes(text: Column) -> Column:
    """Registers vN and labels of an instruction, in order."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(_NAMED), 1), "")


def example_id(apk_hash: Column, identity: Column) -> Column:
    """The package's hash and the SHA-256 of the identity struct as JSON, its fields in order of name."""
    return F.concat(apk_hash, F.lit(":"), F.sha2(F.to_json(identity), 256))


def config_digest(config: Column) -> Column:
    """SHA-256 of a struct as JSON; name its fields in order."""
    return F.sha2(F.to_json(config), 256)


def token_count(text: Column) -> Column:
    """Words and single signs; a user's tokenizer takes its place through learn.tokenize."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]"), 0))


def dns_status(status: Column) -> Column:
    return F.upper(status)


def host_port(text: Column) -> Column:
    """host:port split at the last colon; a port that is no number makes both null."""
    return F.struct(F.nullif(F.regexp_extract(text, r"^(.*):([0-9]+)$", 1), F.lit("")).alias("host"), F.regexp_extract(text, r"^(.*):([0-9]+)$", 2).try_cast("int").alias("port"))
