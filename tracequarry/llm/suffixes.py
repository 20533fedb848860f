"""Suffix-array deduplication: bytes covered by long strings that stand elsewhere too.

Suffixes are sorted in two stages: only those smaller than their successors are compared; scanning the buckets of first
bytes upwards then places each other suffix when its successor is met. Neighbours' common prefixes show repeated strings.
What is sorted are the segments of windows.py, in blocks of whole anchors or pairs of an anchor's blocks, so that all copies
of a string meet in suffix arrays of bounded size. Texts, and segments, that are equal by a digest of their bytes (SHA-256,
BLAKE2b) are one string with a count: it is sorted once, and what stands twice is removed in all its places.

Cases: null texts have no bytes; texts shorter than the string are kept whole; a text that stands twice is removed whole if
it is long enough; one that repeats itself loses all copies; repeated rows and ids count as documents of their own; empty
tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.arrays import BYTE_VALUES, anchors, covered, prefix, spans, window_hashes
from tracequarry.llm.common import cut, digest, fields, keep_keys, table
from tracequarry.llm.windows import TOGETHER, anchor_column, compared, runs, segments, with_shared

LENGTH, ANCHOR = 400, 32


def _rank_columns(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(out)].astype(np.uint64)
    return out


def _compared(data: np.ndarray, eight: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """chosen places in order of their suffixes, equal to `depth` in any order.

    Places that tie are numbered by group; a group's number and as many further bytes as fit beside it make one key."""
    n = len(data)
    if not len(chosen):
        return chosen
    pre = prefix(BYTE_VALUES[data])
    whole = spans(pre, chosen, np.minimum(chosen + depth, n)) + np.minimum(n - chosen, depth).astype(np.uint64)
    _, lead, member = np.unique(whole, return_index=True, return_inverse=True)
    place = chosen[lead]  # one of those that are equal to the depth
    key = eight[place]
    order = np.argsort(key)
    key, at, d = key[order], np.arange(len(order)), 8
    while True:
        same = key[1:] == key[:-1]
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at, own = at[tied], np.cumsum(np.concatenate([[True], ~same]))[tied]
        if not len(at) or d >= depth:
            break
        own = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]])).astype(np.uint64)
        size = min(8, (64 - int(own[-1]).bit_length()) // 8)
        key = eight[np.minimum(place[order[at]] + d, n)] >> np.uint64(64 - 8 * size)
        if own[-1]:
            key |= own << np.uint64(8 * size)
        sub = np.argsort(key)
        order[at], key = order[at][sub], key[sub]
        d += size
    rank = np.empty(len(place), np.int64)
    rank[order] = np.arange(len(place))
    return chosen[np.argsort(rank[member], kind="stable")]


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places in order of their suffixes, compared to `depth` bytes at least.

    With a mask of wanted places, those and what their order follows from: the successors of one that isn't sorted directly,
    up to the first that is."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(data.astype(np.int16)))
    # a suffix is smaller than its successor where the next different byte is greater; the last one never is
    different = np.append(np.where(step != 0, np.arange(n - 1), n - 1), n - 1)
    following = np.minimum.accumulate(different[::-1])[::-1]
    smaller = np.append(step, -1)[following] > 0
    need = np.ones(n, bool)
    if wanted is not None:
        at = np.arange(1, n + 1)
        need = wanted.copy()
        need[1:] |= (np.maximum.accumulate(at * wanted) > np.maximum.accumulate(at * smaller))[:-1]
    direct = _compared(data, _rank_columns(data), np.flatnonzero(smaller & need), depth)
    bucket_of = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[n - 1]:
        waiting[data[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the least
    out: list[np.ndarray] = []
    for byte in range(256):
        here = []
        found = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(found):  # predecessors with the same byte follow in this bucket
            here.append(found)
            before = found[found > 0] - 1
            found = before[(data[before] == byte) & need[before]]
        here.append(direct[bucket_of[byte] : bucket_of[byte + 1]])
        placed = np.concatenate(here)
        before = placed[placed > 0] - 1
        before = before[(data[before] > byte) & need[before]]
        order = np.argsort(data[before], kind="stable")
        first = data[before][order]
        for part in np.split(before[order], np.flatnonzero(np.diff(first)) + 1) if len(before) else ():
            waiting[data[part[0]]].append(part)
        out.append(placed)
    return np.concatenate(out)


def repeats(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether each place's string of `length` bytes is that of another of the places; places as a mask over data."""
    order = suffix_array(data, length, places)
    order = order[places[order]]
    left, right, alive = order[:-1], order[1:], np.arange(max(0, len(order) - 1))
    eight = _rank_columns(data)
    for d in [*range(0, length - 7, 8), length - 8]:  # common prefixes of neighbours, as far as asked for
        alive = alive[eight[left[alive] + d] == eight[right[alive] + d]]
    found = np.zeros(len(data), bool)
    found[left[alive]] = found[right[alive]] = True
    return found


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return BYTE_VALUES[np.frombuffer(b"".join(raw), np.uint8)], np.concatenate([[0], np.cumsum([*map(len, raw)])]).astype(np.int64)


def _ranges(mask: np.ndarray) -> np.ndarray:
    """Flat (start, count) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], 1).ravel()


_FOUND = fields("h long, c binary, ranges array<long>")
_NONE = np.zeros(0, np.int64)


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, together: int = TOGETHER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (key, text): keys with how often they stand; texts (key, text) with repeated windows; key and flat ranges of those."""
    keep = fields("key binary")
    find = lambda values, first: anchors(values, first, length, anchor)
    held = cut(docs.select("key", anchor_column(_tokens, find).alias("anchors")).groupBy("key").agg(F.first("anchors").alias("anchors"), F.count("*").alias("copies")))
    found = cut(with_shared(runs(held, "key")).groupBy("key").agg(F.collect_list(F.struct("h", "run")).alias("found")))  # of one text
    texts = cut(keep_keys(docs, found.select("key"), "key").groupBy("key").agg(F.first("text").alias("text")))

    def contents(text: str, lo: np.ndarray, n: np.ndarray) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        return [raw[a:b] for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist(), strict=True)]

    cuts = cut(segments(texts.join(found, "key"), keep, contents))
    unique = cut(cuts.groupBy("h", "c").agg(F.first("content").alias("content"), F.first("n").alias("n"), F.count("*").alias("m")))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        n, many = block["n"].to_numpy(), block["m"].to_numpy() > 1  # a segment that stands several times is one string here
        ranges = [np.array([0, k]) if all_ else _NONE for k, all_ in zip(n, many, strict=True)]
        met = np.flatnonzero(block["h"].duplicated(keep=False))  # of several segments under one anchor
        if len(met):
            contents = block["content"].iloc[met]
            data, sizes = np.frombuffer(b"".join(contents), np.uint8), contents.str.len().to_numpy()
            first = np.cumsum(sizes) - sizes
            places = np.zeros(len(data) + 1, np.int64)
            np.add.at(places, first, 1)
            np.add.at(places, first + n[met], -1)
            twice = repeats(data, np.cumsum(places[:-1]) > 0, length)
            for i, a in zip(met.tolist(), first.tolist(), strict=True):
                if not many[i]:
                    ranges[i] = _ranges(twice[a : a + n[i]])
        return pd.DataFrame({"h": block["h"], "c": block["c"], "ranges": ranges})

    out = compared(unique, lambda content: _hashed(content, length), lambda content, a, n: content[a : a + n + length - 1], anchor, {}, compare, _FOUND, together)
    ranges = cuts.select("key", "h", "c", "lo").join(out.where("size(ranges) > 0"), ["h", "c"])
    shifted = F.transform("ranges", lambda x, i: F.when(i % 2 == 0, x + F.col("lo") + F.col("off")).otherwise(x))
    return held.select("key", "copies"), texts, ranges.groupBy("key").agg(F.flatten(F.collect_list(shifted)).alias("ranges"))


def _hashed(content: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    values = BYTE_VALUES[np.frombuffer(content, np.uint8)]
    return values, window_hashes(values, length)


@F.pandas_udf(fields("n_removed long, n_spans long, kept_sha256 string"))
def _without(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = []
    for text, flat in zip(texts, ranges, strict=True):
        kept, gone = remove(text, flat, LENGTH)
        rows.append((int(gone.sum()), len(_ranges(gone)) // 2, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])


def remove(text: str, ranges: np.ndarray, length: int) -> tuple[bytes, np.ndarray]:
    """The bytes that no window of the flat ranges covers; which bytes those cover."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    pairs = np.asarray(ranges, np.int64).reshape(-1, 2)
    gone = covered(pairs[:, 0], pairs[:, 1], length, len(data))
    return data[~gone].tobytes(), gone


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select(digest().alias("key"), "text").where(F.col("key").isNotNull())
    copies, texts, ranges = repeated_windows(keyed)
    cutted = cut(texts.join(ranges, "key").select("key", _without("text", "ranges").alias("r")).select("key", "r.*"))
    fate = copies.where("copies > 1").join(cutted, "key", "full")
    raw = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", digest().alias("key"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    out = base.join(fate, "key", "left")
    all_ = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
