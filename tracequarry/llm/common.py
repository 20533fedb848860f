"""What the operators share: reading tables, cutting lineage in the shared folder, bounded blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.sources.shared import written

#: Characters that a task turns into arrays at a time; a longer text is a block of its own.
BLOCK_CHARS = 1 << 19
#: Rows up to which a list of 32-byte text keys is broadcast (about 80 MB); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


#: Rows that Spark hands to Python at a time, unless the session sets its own number: whole texts are long rows.
ROWS_AT_A_TIME = 1000


def short_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(ROWS_AT_A_TIME))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: the plan behind it runs once and a lost executor costs no redo.
    The JVM deletes the files as it ends."""
    short_batches(df.sparkSession)
    return written(df)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def digest(text: str = "text") -> F.Column:
    """32-byte key of a text, its SHA-256; null for null."""
    return F.unhex(F.sha2(F.col(text), 256))


def keep_keys(df: DataFrame, keys: DataFrame, on: str, bound: int = BROADCAST_KEYS) -> DataFrame:
    """df's rows whose key is in keys (distinct, already written): broadcast below the bound, else a shuffled semi join."""
    return df.join(F.broadcast(keys) if keys.count() <= bound else keys, on, "left_semi")


def blocks(texts, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of texts whose characters stay under limit, null as empty."""
    start, chars, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if run and chars + len(text) > limit:
            yield start, run
            start, chars, run = i, 0, []
        run.append(text)
        chars += len(text)
    if run:
        yield start, run


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def fields(text: str) -> T.StructType:
    """"a long, b array<int>" as a type, without a session."""

    def kind(name: str) -> T.DataType:
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else _KINDS[name]

    return T.StructType([T.StructField(n, kind(k)) for n, k in (part.split() for part in text.split(","))])
