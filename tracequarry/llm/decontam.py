"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the benchmark's windows of 13 words, and whole items that have fewer. For each pattern length a shift table
over hashed blocks of words says how far the search may jump; where it says 0, the hash of the block that ends there selects
the patterns to compare word by word. Benchmarks are searched for in parts of bounded size, so that what a task holds does
not grow with them.

Cases: null texts have no words, as have texts of separators only; items without words are never found; items whose words
repeat those of others all count; items without an id hit words like others, count together as one item and have no place
in the list of ids; an empty benchmark or document table gives n_hit 0, or no rows; repeated and null doc_ids
stay as they are; no other column is read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.arrays import word_values, words
from tracequarry.llm.common import blocks, fields, free_name, table

WINDOW = 13
#: Characters of benchmark items that are searched for at a time.
PART_CHARS = 1 << 24
#: Entries of a shift table; blocks that fall together keep the lesser shift.
_ENTRIES = 1 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


class WuManber:
    """Patterns of one length, as rows of word values with the words themselves."""

    def __init__(self, rows: np.ndarray, owners: list[set], texts: list[bytes]):
        self.length = rows.shape[1]
        self.block = min(2, self.length)
        self.owners, self.texts = owners, texts
        self.far = self.length - self.block + 1
        self.shift = np.full(_ENTRIES, self.far, np.uint8 if self.far < 256 else np.uint16)
        for at in range(self.far):  # the last word block of the window shifts by 0
            np.minimum.at(self.shift, self._slots(rows[:, at : at + self.block]), self.far - 1 - at)
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for i, key in enumerate(self._keys(rows[:, -self.block :]).tolist()):
            self.buckets[key].append(i)

    def _keys(self, blocks_: np.ndarray) -> np.ndarray:
        return blocks_[:, 0] if self.block == 1 else blocks_[:, 0] * np.uint64(0x9E3779B97F4A7C15) + blocks_[:, 1]

    def _slots(self, blocks_: np.ndarray) -> np.ndarray:
        return (self._keys(blocks_) >> np.uint64(44)).astype(np.int64)

    def shifts(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place where a block of words starts: how far to go on, and its key."""
        pairs = np.stack([values[: len(values) - self.block + 1], values[self.block - 1 :]], 1)[:, : self.block]
        keys = self._keys(pairs)
        return self.shift[(keys >> np.uint64(44)).astype(np.int64)], keys

    def search(self, shift: bytes | list[int], keys: np.ndarray, start: int, end: int, words_at) -> Iterator[tuple[int, int]]:
        """(place, pattern) of occurrences within words start to end."""
        at, last = start + self.length - self.block, end - self.block
        while at <= last:
            step = shift[at]
            if step:
                at += step
                continue
            bucket = self.buckets.get(int(keys[at]))
            if bucket:
                first = at - self.length + self.block
                here = words_at(first, first + self.length)
                for pattern in bucket:
                    if self.texts[pattern] == here:
                        yield first, pattern
            at += 1


def matchers(items: list[tuple[object, str]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each pattern length among the items' windows."""
    found: dict[int, dict[bytes, tuple[np.ndarray, set]]] = defaultdict(dict)
    for _, texts in blocks([t for _, t in items]):
        ids = items[_ : _ + len(texts)]
        data, starts, ends, first = words(texts, _INSIDE, _FOLD)
        values = word_values(data, starts, ends)
        spelled = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        for (item, _text), a, b in zip(ids, first, first[1:], strict=False):
            n = min(window, b - a)
            for i in range(a, b - n + 1) if n else ():
                found[n].setdefault(b" ".join(spelled[i : i + n]), (values[i : i + n], set()))[1].add(item)
    return [WuManber(np.stack([v for v, _ in p.values()]), [o for _, o in p.values()], [*p]) for _, p in sorted(found.items())]


def scan(texts: pd.Series, searchers: list[WuManber]) -> Iterator[tuple[int, np.ndarray, list]]:
    """For each text: number of its words, flat (start, end) ranges of hit words, the items found."""
    for _, part in blocks(texts):
        data, starts, ends, first = words(part, _INSIDE, _FOLD)
        values = word_values(data, starts, ends)

        def words_at(a: int, b: int) -> bytes:
            return b" ".join(data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True))  # noqa: B023

        ready = []
        for m in searchers:
            if len(values) >= m.block:
                shift, keys = m.shifts(values)
                ready.append((m, shift.tobytes() if shift.dtype == np.uint8 else shift.tolist(), keys))
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            hits, items = [], set()
            for m, shift, keys in ready:
                for at, pattern in m.search(shift, keys, a, b, words_at):
                    hits += (at - a, at - a + m.length)
                    items |= m.owners[pattern]
            yield b - a, hits, [*items]


def _joined(hits) -> int:
    """Words covered by flat (start, end) ranges."""
    pairs = sorted(zip(hits[::2], hits[1::2], strict=True))
    total, upto = 0, 0
    for s, e in pairs:
        total += max(0, e - max(s, upto))
        upto = max(upto, e)
    return total


def _finder(spark: SparkSession, items: list[tuple[object, str]], window: int):
    tables = spark.sparkContext.broadcast(matchers(items, window))  # PART_CHARS bounds it

    @F.pandas_udf(fields("n_words long, hits array<long>, items array<string>"))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([*scan(texts, tables.value)], columns=["n_words", "hits", "items"])

    return find


@F.pandas_udf(fields("n_hit long, n_items long, items_sha256 string"))
def _summed(hits: pd.Series, items: pd.Series) -> pd.DataFrame:
    rows = []
    for h, found in zip(hits, items, strict=True):
        items_found = set(found)
        ids = sorted(x for x in items_found if x is not None)
        rows.append((_joined([int(x) for x in h]), len(items_found), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256"])


def parts(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, as strings, in lists of limited size; the driver holds one list at a time."""
    part, chars = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), text).where(F.col(text).isNotNull()).toLocalIterator():
        if part and chars + len(row[1]) > limit:
            yield part
            part, chars = [], 0
        part.append((row[0], row[1]))
        chars += len(row[1])
    yield part


def hit_columns(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_chars: int = PART_CHARS) -> Column:
    """Struct column of a document's text: n_words, n_hit, n_items, items_sha256, contaminated, hits (flat ranges of words), items."""
    found = [_finder(docs.sparkSession, part, window)(F.col(text)) for part in parts(benchmark, item_id, item_text, part_chars)]
    hits = F.flatten(F.array(*[f["hits"] for f in found])) if len(found) > 1 else found[0]["hits"]
    items = F.flatten(F.array(*[f["items"] for f in found])) if len(found) > 1 else found[0]["items"]
    n, s = found[0]["n_words"], _summed(hits, items)
    return F.struct(
        n.alias("n_words"), s["n_hit"].alias("n_hit"), s["n_items"].alias("n_items"), s["items_sha256"].alias("items_sha256"),
        ((s["n_hit"] > 0) & (20 * s["n_hit"] >= n)).alias("contaminated"), hits.alias("hits"), items.alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule doesn't call contaminated, with their columns."""
    hit = free_name(docs, "benchmark_hits")
    return docs.withColumn(hit, hit_columns(docs, benchmark)).where(~F.col(f"{hit}.contaminated")).drop(hit)


def op6_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", hit_columns(docs, table(spark, sf_dir, "benchmark")).alias("r"))
    return found.select("doc_id", *[f"r.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
o AS (SELECT row_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT o.row_id, o.i, o.n, p.item_id FROM o JOIN p USING (n, k)),
h AS (SELECT row_id, count(DISTINCT j) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT row_id, i, n FROM m)) GROUP BY 1),
t AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN t USING (row_id)
"""
