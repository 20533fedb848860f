"""Substring deduplication with a log-structured fingerprint index.

The index is a list of immutable runs, each sorted by fingerprint and written once. A batch of documents becomes a run; it is
merge-joined with the earlier runs and with itself, which shows the fingerprints that stand in several documents. Only their
windows are cut out, here and in the historical texts, and compared by their words, so what is removed is verified. Runs are
compacted to one when there are too many.

A run holds one fingerprint for each anchor of a document (see arrays.anchors): windows that are equal have equal anchors,
so the sparse run finds each of them. Distinct texts are numbered as they come in; runs and segments have the number, not the
32-byte key, and a text is moved twice only: to its anchors that others have too, and to its windows that go.

Cases: null texts have no words; documents under 50 words are kept; equal texts are one document with the least id, and its
further copies go whole; rows without an id neither remove nor lose anything; rows of one id don't affect one another;
empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.arrays import anchors, covered, window_hashes, word_values, words
from tracequarry.llm.common import cut, digest, fields, keep_keys, table
from tracequarry.llm.windows import TOGETHER, anchor_column, compared, runs, segments, with_keys

WINDOW, ANCHOR = 50, 8
#: Runs that are kept before they are compacted to one; batches that the query makes of a table.
RUNS, BATCHES = 4, 2


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, first = words(texts)
    return word_values(data, starts, ends), first.astype(np.int64)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sorted(run: DataFrame) -> DataFrame:
    """Rows in parts sorted by fingerprint; the rows of one go to up to 16 parts by text."""
    return run.repartition("h", F.pmod(F.xxhash64("t"), F.lit(16))).sortWithinPartitions("h")


_LEAST = fields("h long, c binary, least array<long>")
#: Bits of a text's number below its batch's.
NUMBER_BITS = 56


class FingerprintIndex:
    """Documents seen so far, for batches of ascending ids."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR, together: int = TOGETHER, most_runs: int = RUNS):
        self.window, self.anchor, self.together, self.most_runs = window, anchor, together, most_runs
        self.runs: list[DataFrame] = []  # h, t, run; sorted by h
        self.numbers: list[DataFrame] = []  # key, doc, t: each batch's texts that were new, numbered
        self.texts: list[DataFrame] = []  # key, doc, text

    def ingest(self, batch: DataFrame) -> DataFrame:
        """batch (key, doc, text), ids above all earlier ones: key, text and flat (start, count) ranges of its windows that
        start in a document of a lesser id. Texts seen before aren't listed: their copies go whole."""
        window, anchor = self.window, self.anchor  # tasks get these, not the index
        find = lambda values, first: anchors(values, first, window, anchor)
        own = batch.select("key", "doc", anchor_column(_tokens, find).alias("anchors")).groupBy("key").agg(F.min("doc").alias("doc"), F.first("anchors").alias("anchors"))
        for earlier in self.numbers:
            own = own.join(earlier.select("key"), "key", "left_anti")
        least = len(self.numbers) << NUMBER_BITS
        new = F.col("t") >= least
        own = cut(own.withColumn("t", F.monotonically_increasing_id() + F.lit(least)))
        self.numbers.append(own.select("key", "doc", "t"))
        run = cut(_sorted(runs(own, "t")))
        # merge join: fingerprints of this run that other texts have
        here = run.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))
        for i, earlier in enumerate(self.runs):
            before = earlier.groupBy("h").agg(F.count("*").alias(f"run_{i}"))
            here = here.join(before, "h", "left")
        old = sum((F.coalesce(f"run_{i}", F.lit(0)) for i in range(len(self.runs))), F.lit(0))
        shared = cut(here.where((F.col("low") < F.col("high")) | (old > 0)).select("h", (F.col("n") + old).alias("n")))
        places = _together([run, *self.runs])
        found = with_keys(places, shared).groupBy("t").agg(F.collect_list(F.struct("h", "run")).alias("found"))
        found = cut(found.join(_together(self.numbers), "t"))
        self.texts.append(batch)
        known = keep_keys(_together(self.texts).select("key", "text"), found.select("key"), "key")
        texts = cut(known.groupBy("key").agg(F.first("text").alias("text")).join(found, "key"))
        ranges = self._verified(texts.select("t", "doc", "text", "found"), new)
        self.runs.append(run)
        if len(self.runs) > self.most_runs:
            self.compact()
        return texts.where(new).select("t", "key", "text").join(ranges, "t").drop("t")

    def compact(self) -> None:
        """All runs to one."""
        self.runs = [cut(_sorted(_together(self.runs)))]

    def _verified(self, texts: DataFrame, asked: Column) -> DataFrame:
        """texts (t, doc, text, found): t and ranges of the asked texts' windows that a lesser document has too."""
        window = self.window

        def contents(text: str, lo: np.ndarray, n: np.ndarray) -> list[bytes]:
            data, starts, ends, _ = words([text])
            spaced = b" ".join(data[s:e].tobytes() for s, e in zip(starts, ends, strict=True))  # one space between words
            stops = np.cumsum(ends - starts + 1) - 1
            begins = stops - (ends - starts)
            last = lo + n + window - 2
            return [spaced[a:b] for a, b in zip(begins[lo].tolist(), stops[last].tolist(), strict=True)]

        def part(content: bytes, at: int, n: int) -> bytes:
            return b" ".join(content.split(b" ")[at : at + n + window - 1])

        cuts = cut(segments(texts, fields("t long, doc long"), contents))
        unique = cut(cuts.groupBy("h", "c").agg(F.first("content").alias("content"), F.first("n").alias("n"), F.count("*").alias("m"), F.min("doc").alias("doc")))
        out = compared(unique, lambda content: _hashed(content, window), part, self.anchor, {"doc": "min"}, lambda block: least_documents(block, window), _LEAST, self.together)
        flagged = cuts.where(asked).select("t", "doc", "h", "c", "lo").join(out, ["h", "c"])
        ranges = F.filter(F.transform("least", lambda d, i: F.when(d < F.col("doc"), F.col("lo") + F.col("off") + i)), lambda x: x.isNotNull())
        return flagged.select("t", ranges.alias("starts")).where("size(starts) > 0").groupBy("t").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def least_documents(block: pd.DataFrame, window: int) -> pd.DataFrame:
    """For each window of each segment, the least document that has it under the same anchor; words are compared."""
    texts = [*block["content"]]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], data[:-1] == 32]))
    ends = np.concatenate([starts[1:] - 1, [len(data) - 1]])
    counts = np.array([t.count(b" ") + 1 for t in texts])
    n = block["n"].to_numpy()
    first = np.cumsum(counts) - counts
    hashes = window_hashes(word_values(data, starts, ends), window)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    h, own, doc = block["h"].to_numpy()[owner], hashes[at], block["doc"].to_numpy()[owner]
    order = np.lexsort((doc, own, h))
    new = np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (h[order][1:] != h[order][:-1])])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    least = np.empty(len(order), np.int64)
    least[order] = doc[lead]
    # the words themselves, against those of the least document's window
    follower = np.flatnonzero(~new)
    for i, j in zip(order[follower].tolist(), lead[follower].tolist(), strict=True):
        a, b, c, d = starts[at[i]], ends[at[i] + window - 1], starts[at[j]], ends[at[j] + window - 1]
        if b - a != d - c or data[a:b].tobytes() != data[c:d].tobytes():
            return _least_by_words(block, window)
    return pd.DataFrame({"h": block["h"], "c": block["c"], "least": np.split(least, np.cumsum(n)[:-1])})


def _least_by_words(block: pd.DataFrame, window: int) -> pd.DataFrame:
    """The same by the words alone, where two windows' hashes fell together."""
    lists = [[b" ".join(w[i : i + window]) for i in range(n)] for w, n in zip((t.split(b" ") for t in block["content"]), block["n"], strict=True)]
    least: dict[tuple[int, bytes], int] = {}
    for h, doc, own in zip(block["h"], block["doc"], lists, strict=True):
        for w in own:
            least[h, w] = min(doc, least.get((h, w), doc))
    return pd.DataFrame({"h": block["h"], "c": block["c"], "least": [np.array([least[h, w] for w in own]) for h, own in zip(block["h"], lists, strict=True)]})


def _hashed(content: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, _ = words([content.decode("utf-8", "surrogatepass")])
    values = word_values(data, starts, ends)
    return values, window_hashes(values, window)


def remove(text: str, starts: np.ndarray, window: int) -> tuple[bytes, int]:
    """The words that no window covers, joined by one space; how many were covered."""
    data, begin, end, _ = words([text])
    own = np.asarray(starts, np.int64)
    gone = covered(own, np.ones(len(own), np.int64), window, len(begin))
    return b" ".join(data[s:e].tobytes() for s, e in zip(begin[~gone], end[~gone], strict=True)), int(gone.sum())


@F.pandas_udf(fields("n_removed long, kept_sha256 string"))
def _without(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, starts, strict=True):
        kept, gone = remove(text, own, WINDOW)
        rows.append((gone, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["n_removed", "kept_sha256"])


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs (doc, ...) in up to n parts of ascending ids."""
    bounds = sorted({int(b) for b in docs.approxQuantile("doc", [i / n for i in range(1, n)], 0.01)}) if n > 1 else []
    edges = [None, *bounds, None]
    return [docs.where((F.lit(True) if a is None else F.col("doc") > a) & (F.lit(True) if b is None else F.col("doc") <= b)) for a, b in zip(edges, edges[1:], strict=False)]


def op8_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select(F.col("doc_id").alias("doc"), digest().alias("key"), "text").where(F.col("key").isNotNull() & F.col("doc").isNotNull())
    index, cutted = FingerprintIndex(), None
    for batch in batches(keyed, BATCHES):
        part = cut(index.ingest(batch).select("key", _without("text", "starts").alias("r")).select("key", "r.*"))
        cutted = part if cutted is None else cutted.union(part)
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+", " ")
    plain = F.trim(spaced)
    n_words = F.when(F.length("plain") == 0, 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).cast("long")
    base = docs.select("doc_id", digest().alias("key"), plain.alias("plain")).select("doc_id", "key", n_words.alias("n_words"), F.sha2("plain", 256).alias("whole"))
    least = keyed.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("m")).where("m > 1").drop("m")
    fate = least.join(cutted, "key", "full")
    out = base.join(fate, "key", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    mine = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(mine, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(mine, F.coalesce("kept_sha256", "whole")).otherwise(F.col("whole")).alias("kept_sha256"),
    )
