"""Windows that stand in several places: what the byte and the word deduplication share.

Each text's windows are named by anchors (see arrays.anchors). Windows can only be equal where their anchors are, so only
runs of windows whose anchor stands in several places are looked at; each is cut out as a segment. Segments are brought
together by anchor, in blocks that a task compares by their contents; equal ones, by a 128-bit digest, fall together first.

An anchor with more different segments than one block takes has them pruned before: its windows are dealt out by their place
before the anchor, and those whose 64-bit hash stands there once go, as they equal no other. What is left is cut out again,
equal pieces fall together, and each pair of the anchor's blocks is compared like any other block. So the size of a block
changes costs, never what is compared in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.arrays import grams
from tracequarry.llm.common import BROADCAST_KEYS, blocks, cut, fields

#: Different segments of one anchor that one task compares at once.
TOGETHER = 1024
#: Bytes of segments that a task compares at once.
BLOCK_BYTES = 1 << 20
#: Hashes of one anchor's windows that a task compares at once, where there are more segments than that.
AT_ONCE = 1 << 22
#: Segment starts and window counts are packed in one long.
PACK = 1 << 10

#: From a list of texts to their places: token values and the first token of each text (one more at the end).
Tokens = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def anchor_column(tokens: Tokens, find, text: str = "text") -> Column:
    """array<long> of a text: the anchors' hashes, then their packed runs."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def anchored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[np.ndarray] = []
            for _, part in blocks(texts):
                values, first = tokens(part)
                owner, start, count, hashes = find(values, first)
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                packed = start * PACK + count
                out += [np.concatenate([hashes[a:b].view(np.int64), packed[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pd.Series(out, dtype=object)

    return anchored(F.col(text))


def runs(anchored: DataFrame, *keep: str) -> DataFrame:
    """One row for each anchor: kept columns, its hash h, its packed run."""
    half = F.floor(F.size("anchors") / 2).cast("int")
    pairs = F.arrays_zip(F.slice("anchors", F.lit(1), half).alias("h"), F.slice("anchors", half + 1, half).alias("run"))
    return anchored.where(F.size("anchors") > 0).select(*keep, F.explode(pairs).alias("r")).select(*keep, "r.h", "r.run")


def content_key(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def segments(texts: DataFrame, keep: T.StructType, contents: Callable[[str, np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """texts (kept columns, text, found array<struct<h, run>>) as rows: kept columns, h, c, lo, n, content.

    contents gives the segments' bytes; c is their digest."""
    names = keep.fieldNames()

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                h = np.array([r["h"] for r in row.found], np.int64)
                run = np.array([r["run"] for r in row.found], np.int64)
                lo, n = run // PACK, run % PACK
                pieces = contents(row.text, lo, n)
                yield pd.DataFrame({**{k: [getattr(row, k)] * len(h) for k in names}, "h": h, "c": [*map(content_key, pieces)], "lo": lo, "n": n, "content": pieces})

    return texts.mapInPandas(gathered(cut_out), T.StructType([*keep, *fields("h long, c binary, lo long, n long, content binary")]))


def with_shared(member: DataFrame) -> DataFrame:
    """member's rows (h, ...) whose h stands several times."""
    return with_keys(member, cut(member.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")))


def with_keys(member: DataFrame, keys: DataFrame) -> DataFrame:
    """member's rows whose h is among keys (h, n: how many rows have it). The at most 1,000 values that a thousandth of those
    rows have each are taken by a broadcast list, so that no task gets such a value's rows together; the others are merged, for
    short lists as for long ones, so that what is moved stays in proportion to the input."""
    most = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keys.where(F.col("n") * 1000 > most).select("h"))
    return member.join(hot, "h", "left_semi").unionByName(member.join(hot, "h", "left_anti").join(keys.select("h").hint("merge"), "h", "left_semi"))


def gathered(rows, size: int = 4096):
    """rows' small frames put together to frames of about `size` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in rows(batches):
            held.append(frame)
            n += len(frame)
            if n >= size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return run


def by_key(rows: DataFrame, keys: list[str], heavy: str, compare: Callable[[pd.DataFrame], pd.DataFrame], kind: T.StructType) -> DataFrame:
    """compare, on blocks of all rows of some keys; a block has BLOCK_BYTES or one key. heavy: the bytes or longs that count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            marks = batch[keys].to_numpy()
            # a block may end where the key changes, from the batch before on
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1)] if last is None or (marks[0] != last).any() else [*(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1)]
            weights = np.concatenate([[0], np.cumsum(batch[heavy].str.len().to_numpy())])
            at = 0
            for e in edges:
                if size + weights[e] - weights[at] >= BLOCK_BYTES:
                    if e > at:
                        held.append(batch.iloc[at:e])
                    yield compare(pd.concat(held, ignore_index=True))
                    held, size, at = [], 0, e
            held.append(batch.iloc[at:])
            size += weights[-1] - weights[at]
            last = marks[-1]
        if held:
            yield compare(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, kind)


def compared(unique: DataFrame, hashes: Callable[[bytes], tuple[np.ndarray, np.ndarray]], part: Callable[[bytes, int, int], bytes], k: int, values: dict[str, str], compare: Callable[[pd.DataFrame], pd.DataFrame], kind: T.StructType, together: int = TOGETHER) -> DataFrame:
    """compare, on blocks of whole anchors' segments or on pairs of an anchor's blocks: its rows (h, c, ...) with `off`, which
    window of the segment they begin at; an anchor of several blocks gives some windows several times.

    unique: h, c, n, content, m (how often the segment stands) and the columns of values, each with the aggregate that equal
    pieces' values take. hashes: token values and window hashes of a segment; part: the segment of some of its windows; k: an
    anchor's tokens; kind: compare's columns, h and c first."""
    sizes = cut(unique.groupBy("h").agg(F.count("*").alias("d")).where(F.col("d") > together))
    one = F.lit(0)
    known = [c for c in unique.columns if c not in ("h", "c")]
    if sizes.isEmpty():
        return by_key(unique.select("h", "c", one.alias("low"), one.alias("high"), *known), ["h", "low", "high"], "content", compare, kind).withColumn("off", F.lit(0).cast("long"))
    # with a broadcast list, the segments needn't be written again
    marked = unique.join(F.broadcast(sizes), "h", "left") if sizes.count() <= BROADCAST_KEYS else cut(unique.join(sizes, "h", "left"))
    few = by_key(marked.where("d IS NULL").select("h", "c", one.alias("low"), one.alias("high"), *known), ["h", "low", "high"], "content", compare, kind)
    pieces = cut(pruned(marked.where("d IS NOT NULL"), hashes, part, k, [*values]))
    again = pieces.groupBy("h", "p").agg(F.first("content").alias("content"), F.first("n").alias("n"), F.sum("m").alias("m"), *[F.expr(f"{f}({v})").alias(v) for v, f in values.items()])
    again = cut(again)
    dealt = again.groupBy("h").agg(F.ceil(F.count("*") / together).cast("int").alias("blocks"))
    dealt = again.join(dealt, "h").withColumn("block", F.pmod(F.xxhash64("p"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.col("p").alias("c"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *known)
    many = by_key(dealt, ["h", "low", "high"], "content", compare, kind).withColumnRenamed("c", "p")
    many = pieces.select("h", "p", "c", "off").join(many, ["h", "p"]).drop("p")
    return few.withColumn("off", F.lit(0).cast("long")).unionByName(many)


def pruned(unique: DataFrame, hashes: Callable[[bytes], tuple[np.ndarray, np.ndarray]], part: Callable[[bytes, int, int], bytes], k: int, values: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """h, c, off, n, p, content, m, values: the runs of windows of segments (h, c, n, d, content, m, values) that may stand
    several times, cut out, with the digest p of their contents.

    Windows are equal only at the same place before their anchor, so an anchor's windows are dealt out by that place, and
    beyond at_once segments by their hash too; a task then holds at_once hashes of a key."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                tokens, w = hashes(row.content)
                wide, salts = max(1, at_once // row.d), max(1, row.d // at_once)
                anchor = row.n - 1 + int(np.flatnonzero(grams(tokens[row.n - 1 :], k).view(np.int64) == row.h)[0])
                i = np.arange(row.n)
                place = (anchor - i) // wide * salts + (w % np.uint64(salts)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                yield pd.DataFrame({"h": row.h, "part": place[edges], "c": row.c, "i": edges, "w": np.split(w.view(np.int64), edges[1:]), "m": row.m})

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        sizes = block["w"].str.len().to_numpy()
        w = np.concatenate([*block["w"]])
        owner = np.repeat(np.arange(len(block)), sizes)
        h, part_ = block["h"].to_numpy()[owner], block["part"].to_numpy()[owner]
        order = np.lexsort((w, part_, h))
        new = np.concatenate([[False], (w[order][1:] != w[order][:-1]) | (part_[order][1:] != part_[order][:-1]) | (h[order][1:] != h[order][:-1])])
        group = np.empty(len(w), np.int64)
        group[order] = np.cumsum(new)
        twice = np.bincount(group, block["m"].to_numpy()[owner])[group] > 1
        return pd.DataFrame({"h": block["h"], "c": block["c"], "i": block["i"], "out": np.split(twice, np.cumsum(sizes)[:-1])})

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                flags = np.concatenate([x["out"] for x in sorted(row.found, key=lambda x: x["i"])])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
                off, n = edges[::2], edges[1::2] - edges[::2]
                contents = [part(row.content, a, b) for a, b in zip(off.tolist(), n.tolist(), strict=True)]
                yield pd.DataFrame({"h": row.h, "c": row.c, "off": off, "n": n, "p": [*map(content_key, contents)], "content": contents, "m": row.m, **{v: getattr(row, v) for v in values}})

    rows = unique.select("h", "c", "n", "d", "content", "m").mapInPandas(gathered(dealt), fields("h long, part long, c binary, i long, w array<long>, m long"))
    done = by_key(rows, ["h", "part"], "w", compare, fields("h long, c binary, i long, out array<boolean>"))
    found = done.groupBy("h", "c").agg(F.collect_list(F.struct("i", "out")).alias("found"))  # the parts of one segment
    return unique.join(found, ["h", "c"]).mapInPandas(gathered(cut_out), T.StructType([*fields("h long, c binary, off long, n long, p binary, content binary, m long"), *[unique.schema[v] for v in values]]))
