"""Near-duplicate documents by ProbMinHash.

A document's shingles (five words; all words of a shorter one) are weighted by how often they occur. Each shingle is a
Poisson process whose rate is its weight: its arrivals fall into registers at random, and each register keeps its first.
Arrivals later than all registers' first ones can't matter, so processes end early. Two documents agree in a register with
the probability of their probability Jaccard similarity. Bands of registers give buckets.

Within a bucket all documents are compared to its first one only; that gives a star, not all pairs. What then stands in
one bucket but in different groups is looked at again: shingles that a document alone has bound its similarity to any other,
which rules most out; the rest is compared to the document that has the least of its own. What is apart even then is dealt
into blocks; a task has two blocks at a time, and gives out a forest of the links between them, never the pairs. So no link
between documents that share a bucket is lost, and a bucket of many copies costs about its size; m texts of one bucket that
are apart after all that are read m / 1,024 times. Similarities are computed exactly, on the shingles.

Cases: null texts and texts without a word are alone, but equal texts are copies; equal texts share a class before anything
is compared; ties and repeated ids fall together under the least id; empty tables give no rows; null ids are kept and never
represent others if there is one that isn't null; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.arrays import grams, mix, word_values, words
from tracequarry.llm.common import BROADCAST_KEYS, blocks, cut, digest, fields, free_name, keep_keys, table
from tracequarry.llm.windows import gathered

#: Sums of fractions that should be just SIMILAR can fall short of it by rounding.
SHINGLE, SIMILAR, ROUNDING = 5, 0.8, 1e-9
BANDS, ROWS = 20, 4
#: Texts, and their characters, of a block that one task compares with another block at once.
TOGETHER, TOGETHER_CHARS = 1024, 1 << 22
_SEED = np.uint64(0xA0761D6478BD642F)


def shingles(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of each text, ascending, and their counts."""
    data, starts, ends, first = words(texts)
    values = word_values(data, starts, ends)
    for a, b in zip(first, first[1:], strict=False):
        own = values[a:b]
        yield np.unique(grams(own, min(SHINGLE, len(own))), return_counts=True) if b > a else (own, np.zeros(0, np.int64))


def signatures(parts: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """(texts, m) shingle hash that comes first in each register; texts have shingles."""
    n = len(parts)
    element = np.concatenate([e for e, _ in parts])
    rate = np.concatenate([c for _, c in parts]).astype(float)
    owner = np.repeat(np.arange(n), [len(e) for e, _ in parts])
    first, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, active, arrival = np.zeros(len(element)), np.arange(len(element)), 0
    while len(active):
        arrival += 1
        random = mix(element[active] + np.uint64((int(_SEED) * arrival) & 0xFFFFFFFFFFFFFFFF))
        time[active] += -np.log(((random >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate[active]
        register = owner[active] * m + (mix(random ^ _SEED) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, register, time[active])
        won = time[active] == first[register]
        winner[register[won]] = element[active[won]]
        latest = first.reshape(n, m).max(1)
        active = active[time[active] < latest[owner[active]]]
    return winner.reshape(n, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity: sum over common d of 1 / sum over all e of max(a[e]/a[d], b[e]/b[d])."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    # max(x/xd, y/yd) is x/xd where x/y >= xd/yd: sort the common elements by their ratio, and sum from either end
    ratio = x[i] / y[j]
    order = np.argsort(ratio, kind="stable")
    ratio, xc, yc = ratio[order], x[i][order], y[j][order]
    cx, cy = np.concatenate([[0], np.cumsum(xc)]), np.concatenate([[0], np.cumsum(yc)])
    only_x, only_y = x.sum() - cx[-1], y.sum() - cy[-1]
    below = np.searchsorted(ratio, ratio, "left")
    return float((1 / ((cx[-1] - cx[below] + only_x) / xc + (cy[below] + only_y) / yc)).sum())


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A key for each band of a text's signature; null if it has no word."""
    for texts in batches:
        out: list[np.ndarray | None] = []
        for _, part in blocks(texts):
            own = [*shingles(part)]
            some = [p for p in own if len(p[0])]
            keys = grams_of(signatures(some, BANDS * ROWS)) if some else iter(())
            rows = iter(keys)
            out += [next(rows) if len(p[0]) else None for p in own]
        yield pd.Series(out, dtype=object)


def grams_of(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys, different from band to band."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _SEED, rows.shape[:2])
    for r in range(ROWS):
        key = mix(key ^ rows[:, :, r]) + np.uint64(r)
    return key.astype(np.int64)


@F.pandas_udf(T.DoubleType())
def pair_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        out = []
        for at, part in blocks(left, 1 << 18):
            other = [t or "" for t in right.iloc[at : at + len(part)]]
            seen: dict[str, tuple] = {}  # a bucket's first text comes again and again
            for a, b in zip(part, other, strict=True):
                if a not in seen:
                    seen = {a: next(shingles([a]))}
                out.append(similarity(seen[a], next(shingles([b]))))
        yield pd.Series(out, dtype=float)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of the edges (a, b), by large-star and small-star steps."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    step = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # large star: each greater neighbour to the least of the neighbourhood
        near = both(step)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: each lesser neighbour, and the node, to the least of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
        new = cut(small.where("a <> b").distinct())
        if new.count() == step.count() and new.exceptAll(step).isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        step = new


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of text keys, with their similarity."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", pair_similarity("text_a", "text_b").alias("s"))


def text_classes(docs: DataFrame, text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """(key, root): for distinct texts that have near copies, the class they fall in; key is digest(text)."""
    keyed = docs.select(digest(text).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    bands = cut(keyed.select("key", band_keys("text").alias("bands")).groupBy("key").agg(F.first("bands").alias("bands")))
    member = bands.select("key", F.posexplode("bands").alias("band", "bucket"))
    hub = member.groupBy("band", "bucket").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    in_bucket = cut(member.join(hub, ["band", "bucket"]))
    pairs = in_bucket.where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    used = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    # the texts that are compared, each once
    texts = cut(keep_keys(keyed, used, "key").groupBy("key").agg(F.first("text").alias("text")))
    first = cut(_compared(pairs, texts))
    linked = first.where(F.col("s") >= threshold - ROUNDING).select("a", "b")
    group = components(linked)
    # members of a bucket that are still in different groups, and could be linked
    left = _apart(in_bucket.select("band", "bucket", "key"), group)
    own = unshared(keep_keys(texts, cut(left.select("key").distinct()), "key"))
    possible = own.where(F.col("odds") <= 1 / threshold - 1 + ROUNDING)
    left = cut(_apart(left.select("band", "bucket", "key").join(possible, "key"), group))
    if left.isEmpty():
        return _named(group)
    # the member with the least of its own is most like the others: a second star
    hub = left.groupBy("band", "bucket").agg(F.min_by("key", F.struct("odds", "key")).alias("hub"))
    pairs = left.join(hub, ["band", "bucket"]).where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    second = cut(_compared(pairs, texts))
    linked = cut(linked.union(second.where(F.col("s") >= threshold - ROUNDING).select("a", "b")))
    group = components(linked)
    left = cut(_apart(left.select("band", "bucket", "key", "odds"), group))
    if left.isEmpty():
        return _named(group)
    third = linked_in_blocks(left.select("band", "bucket", "key", "root").join(texts, "key").join(bands, "key"), threshold)
    return _named(components(linked.union(third)))


def _named(group: DataFrame) -> DataFrame:
    return group.select(F.col("node").alias("key"), "root")


def _apart(member: DataFrame, group: DataFrame) -> DataFrame:
    """member (band, bucket, key, ...) with the groups' roots, of the buckets that hold several groups."""
    seen = member.join(_named(group), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = seen.groupBy("band", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "bucket")
    return seen.join(several, ["band", "bucket"])


def linked_in_blocks(member: DataFrame, threshold: float, together: int = TOGETHER, chars: int = TOGETHER_CHARS) -> DataFrame:
    """(a, b): links between members of a bucket (band, bucket, key, root, text, bands) in different groups; as many of them
    as connect the groups.

    A bucket is dealt into blocks of about `together` texts or `chars` characters, and each pair of its blocks is one task's
    work at a time. What comes out is a forest over the block pair's texts, however many pairs are alike."""
    keys = ["band", "bucket", "low", "high"]
    size = member.groupBy("band", "bucket").agg(F.greatest(F.ceil(F.count("*") / together), F.ceil(F.sum(F.length("text")) / chars)).cast("int").alias("blocks"))
    dealt = member.join(size, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "root", "bands", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            marks = batch[keys].to_numpy()
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1 if len(batch) else ()
            parts = [batch.iloc[i:j] for i, j in zip([0, *edges], [*edges, len(batch)], strict=True)]
            if held and parts and (held[-1][keys].to_numpy()[-1] != marks[0]).any():
                yield forest(pd.concat(held), threshold)
                held = []
            for part in parts[:-1]:
                yield forest(pd.concat([*held, part]), threshold)
                held = []
            held += parts[-1:]
        if held:
            yield forest(pd.concat(held), threshold)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(gathered(run), fields("a binary, b binary"))


def forest(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links (a, b) that connect the groups (roots) of one block or two, of all links that their texts have in this bucket and
    share with no earlier band."""
    block, keys, roots, band = group["block"].to_numpy(), [*group["key"]], [*group["root"]], int(group["band"].iloc[0])
    x, y = np.flatnonzero(block == group["low"].iloc[0]), np.flatnonzero(block == group["high"].iloc[0])
    bands = np.stack([*group["bands"]])
    _, number = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
    wanted = number[x][:, None] != number[y][None, :]
    if group["low"].iloc[0] == group["high"].iloc[0]:
        wanted &= x[:, None] < y[None, :]
    for earlier in range(band):  # a pair is looked at in the first bucket that it shares
        wanted &= bands[x, earlier][:, None] != bands[y, earlier][None, :]
    parts = [p for _, some in blocks(group["text"]) for p in shingles(some)]
    wanted &= possible(parts, x, y, threshold) if wanted.any() else wanted
    up = {n: n for n in number.tolist()}

    def top(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    out = []
    for i, j in np.argwhere(wanted).tolist():
        i, j = x[i], y[j]
        a, b = top(int(number[i])), top(int(number[j]))
        if a != b and similarity(parts[i], parts[j]) >= threshold - ROUNDING:
            up[a] = b
            out.append((keys[i], keys[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def possible(parts: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, threshold: float, columns: int = 4096) -> np.ndarray:
    """(x, y) mask: pairs whose bound of unshared() with what the other lacks as each one's own doesn't rule a link out."""
    element = np.concatenate([e for e, _ in parts])
    weight = np.concatenate([c / max(1, c.sum()) for _, c in parts])
    owner = np.repeat(np.arange(len(parts)), [len(e) for e, _ in parts])
    _, column, n = np.unique(element, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, weight, column = owner[shared], weight[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    of_x, of_y = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, (at, at + columns))
        dense = np.zeros((len(parts), columns), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = weight[lo:hi]
        has = (dense > 0).astype(np.float32)
        of_x += dense[x] @ has[y].T
        of_y += has[x] @ dense[y].T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((1 - of_x) / of_x + (1 - of_y) / of_y, nan=np.inf) <= 1 / threshold - 1 + 1e-4


def unshared(texts: DataFrame) -> DataFrame:
    """(key, odds): weight of each text's shingles that no other of the texts has, over the weight of the rest.

    With odds p and q, two texts' similarity is 1 / (1 + p + q) at most: for a common shingle d of normalised weights x, y
    the similarity's term is at most 1 / (1 / x + own(y) / y), which is concave in (x, y), so the sum of all is at most its
    value at the whole shared weights."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, part in blocks(batch["text"], 1 << 18):
                for key, (e, c) in zip(batch["key"].iloc[at : at + len(part)], shingles(part), strict=True):
                    yield pd.DataFrame({"key": [key] * len(e), "shingle": e.view(np.int64), "share": c / max(1, c.sum())})

    listed = texts.select("key", "text").mapInPandas(gathered(rows, 1 << 15), fields("key binary, shingle long, share double"))
    alone = listed.groupBy("shingle").agg(F.count("*").alias("n"), F.first("key").alias("key"), F.first("share").alias("share")).where("n = 1")
    own = alone.groupBy("key").agg(F.sum("share").alias("own"))
    odds = F.when(F.coalesce("own", F.lit(0.0)) >= 1, F.lit(1e9)).otherwise(F.coalesce("own", F.lit(0.0)) / (1 - F.coalesce("own", F.lit(0.0))))
    return cut(texts.select("key").join(own, "key", "left").select("key", odds.alias("odds")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_class) for each row: the least id among its near copies, and their number."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("key"))
    roots = text_classes(docs, text)
    classed = rows.join(roots, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root"))
    size = classed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class"))
    return classed.join(size, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the least id. Rows without a text stay; rows that repeat both the id and
    the text of the one that stays go."""
    key, ident = (free_name(docs, n) for n in ("text_key", "row_id"))
    roots = text_classes(docs, text).select(F.col("key").alias(key), "root")
    rows = docs.select(F.col(doc_id).alias(ident), digest(text).alias(key)).where(F.col(key).isNotNull())
    classed = rows.join(roots, key, "left").select(ident, key, F.coalesce("root", key).alias("root"))
    least = classed.groupBy("root").agg(F.min(F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col(key).alias("key"))).alias("m"), F.count("*").alias("n")).where("n > 1")
    goes = cut(classed.join(least, "root").where(~(F.col(key).eqNullSafe(F.col("m.key")) & F.col(ident).eqNullSafe(F.col("m.id")))).select(ident, key).distinct())
    marked = docs.withColumn(key, digest(text))
    few = goes.count() <= BROADCAST_KEYS
    kept = marked.join(F.broadcast(goes) if few else goes, (marked[key] == goes[key]) & marked[doc_id].eqNullSafe(goes[ident]), "left_anti").drop(key)
    again = rows.groupBy(ident, key).count().where("count > 1")
    return kept if again.isEmpty() else _first_of_each(kept, doc_id, text)


def _first_of_each(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs without repeats of an id with the same text; rows without a text stay."""
    some = docs.where(F.col(text).isNotNull()).dropDuplicates([doc_id, text])
    return some.unionByName(docs.where(F.col(text).isNull()))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
