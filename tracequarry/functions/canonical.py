"""Canonical JSON as column expressions, and digests over it: keys in order, no blanks, everything beyond ASCII as \\u escapes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a mapping that are joined to one piece before the digest runs over the pieces.
PIECE = 4096
# Short escapes of JSON.
_SHORT = {'"': r"\"", "\\": r"\\", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}


def json_string(text: Column) -> Column:
    """text as a JSON string of ASCII letters; characters beyond the first plane are two escapes."""

    def escaped(c: Column) -> Column:
        out = F.when(c.rlike(r"^[ -~]$"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1"))
        return reduce(lambda rest, kv: F.when(c == kv[0], kv[1]).otherwise(rest), _SHORT.items(), out)

    slow = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'^[ !#-\[\]-~]*$'), text).otherwise(slow), F.lit('"'))


def canonical_json(col: Column, kind: T.DataType) -> Column:
    """col, of type kind, as canonical JSON text; null is null's text. Struct fields and map keys are put in order of code points.

    Numbers are whole ones: others have no spelling that all writers share, so that they raise TypeError here."""
    if isinstance(kind, T.StringType):
        out = json_string(col)
    elif isinstance(kind, T.BooleanType) or isinstance(kind, T.IntegralType):
        out = col.cast("string")
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(_key(f.name)), canonical_json(col[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_entries(col), lambda e: F.struct(e["key"].alias("k"), canonical_json(e["value"], kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(col.isNull(), F.lit("null")).otherwise(out)


def _key(name: str) -> str:
    import json

    return json.dumps(name) + ":"


def with_digest(df: DataFrame, name: str, **parts: Column) -> DataFrame:
    """df with one more column: SHA-256 of the canonical JSON of an object with these members."""
    made = df.select(F.struct(*[c.alias(k) for k, c in parts.items()]).alias("o")).schema["o"].dataType
    return df.withColumn(name, F.sha2(canonical_json(F.struct(*[c.alias(k) for k, c in parts.items()]), made), 256))


def with_example_id(df: DataFrame, apk_hash: Column, **identity: Column) -> DataFrame:
    """df with example_id: the package's hash and the digest of the identity, which holds the hash as well."""
    made = with_digest(df, "example_id", apk_hash=apk_hash, **identity)
    return made.withColumn("example_id", F.concat(apk_hash, F.lit(":"), "example_id"))


def mapping_sha256(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row (n, digest): the SHA-256 of the canonical JSON of the whole mapping, in whatever order and parts the rows come.

    Entries are put in order by ranges and joined to pieces there; one task reads the pieces in order and keeps a digest's state
    only. A key that stands twice raises, as a mapping has it once; null keys and values are none."""
    entry = F.concat(json_string(F.col(key)), F.lit(":"), json_string(F.col(value)))
    entries = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), entry.alias("entry"))
    pieces = entries.repartitionByRange("k").sortWithinPartitions("k").mapInPandas(_pieces, "k string, last string, n long, text string")
    none = rows.sparkSession.range(1).selectExpr("'' AS k", "'' AS last", "0L AS n", "'' AS text")  # an empty mapping has a digest too
    return pieces.unionByName(none).repartition(1).sortWithinPartitions("k", "n").mapInPandas(_digested, "n long, digest string")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for batch in batches:
        keys, texts = batch["k"].tolist(), batch["entry"].tolist()
        for a, b in zip([last, *keys], keys, strict=False):
            if a == b:
                raise ValueError(f"the mapping has {b!r} twice")
        last = keys[-1] if keys else last
        rows = [(keys[i], keys[min(i + PIECE, len(keys)) - 1], len(keys[i : i + PIECE]), ",".join(texts[i : i + PIECE])) for i in range(0, len(keys), PIECE)]
        yield pd.DataFrame(rows, columns=["k", "last", "n", "text"], dtype=object)


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, state = 0, hashlib.sha256(b"{")
    for batch in batches:
        for count, text in zip(batch["n"], batch["text"], strict=True):
            if not count:
                continue
            state.update(("," if n else "").encode() + text.encode())
            n += int(count)
    state.update(b"}")
    yield pd.DataFrame([(n, state.hexdigest())], columns=["n", "digest"], dtype=object)
