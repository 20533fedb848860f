"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over the embedded bytes
of a chunk; each filter's greatest response in the chunk is kept. Over the chunks, the mean, the greatest and the least of
these are combined into one probability. Training, by Adam on the cross entropy, takes the whole texts of a sample of
labelled rows of expected size SAMPLE, chosen by a hash of the id.

Cases: null and empty texts are one chunk of padding and get its score; any length is read whole; without labelled rows, or
with labels of one kind only, the score is the smoothed share of label 1; null labels teach nothing; repeated rows and other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.common import free_name, table
from tracequarry.llm.langid import remainder

#: Expected number of labelled documents that are learned from.
SAMPLE = 3000
#: Bytes of a chunk and between the starts of chunks; filter width and the step between its places.
CHUNK, HOP, WIDTH, STEP = 512, 384, 8, 2
EMBED, FILTERS, HIDDEN = 6, 48, 24
EPOCHS, BATCH, RATE, DECAY = 12, 32, 3e-3, 1e-4
#: Byte value (beyond 255) that fills the last chunk; chunks computed at a time.
PAD, CHUNKS_AT_A_TIME = 256, 256


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) byte values that cover the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
    n = 1 + max(0, -(-(len(raw) - CHUNK) // HOP))
    full = np.full((n - 1) * HOP + CHUNK, PAD, np.int16)
    full[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::HOP]


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "embed": rng.standard_normal((257, EMBED)).astype(np.float32), "filter": scale(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32),
            "hidden": scale(3 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": scale(HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
        }
        self.share: float | None = None  # the answer where nothing could be learned

    def _windows(self, pieces: np.ndarray) -> np.ndarray:
        """(n, places, WIDTH * EMBED) embedded bytes at each place of a filter."""
        seen = self.w["embed"][pieces].reshape(len(pieces), -1)
        return np.lib.stride_tricks.sliding_window_view(seen, WIDTH * EMBED, axis=1)[:, :: STEP * EMBED]

    def _pool(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each chunk, and where."""
        most, where = np.empty((len(pieces), FILTERS), np.float32), np.empty((len(pieces), FILTERS), np.int64)
        for at in range(0, len(pieces), CHUNKS_AT_A_TIME):
            wide = self._windows(pieces[at : at + CHUNKS_AT_A_TIME])
            n, places, _ = wide.shape
            made = (np.ascontiguousarray(wide).reshape(n * places, -1) @ self.w["filter"]).reshape(n, places, FILTERS)
            most[at : at + n], where[at : at + n] = made.max(1), made.argmax(1)
        return np.maximum(most + self.w["bias"], 0), where

    def _combine(self, pooled: np.ndarray, first: np.ndarray, counts: np.ndarray):
        mean = np.add.reduceat(pooled, first) / counts[:, None]
        most, least = np.maximum.reduceat(pooled, first), np.minimum.reduceat(pooled, first)
        seen = np.concatenate([mean, most, least], 1)
        hidden = np.maximum(seen @ self.w["hidden"] + self.w["hidden_bias"], 0)
        return seen, hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["out_bias"], -30, 30)))[:, 0]

    def fit(self, texts: list[str], labels: list[int], seed: int = 11) -> Network:
        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.share = float((y.sum() + 1) / (len(y) + 2))
            return self
        rng, parts = np.random.default_rng(seed), [chunks(t) for t in texts]
        moment, spread, t = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                t += 1
                grads = self._gradients([parts[i] for i in own], y[own])
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in grads.items():
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    spread[k] = 0.999 * spread[k] + 0.001 * g * g
                    step = moment[k] / (1 - 0.9**t) / (np.sqrt(spread[k] / (1 - 0.999**t)) + 1e-8)
                    self.w[k] -= (rate * (step + DECAY * self.w[k])).astype(np.float32)
        return self

    def _gradients(self, pieces: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        counts = np.array([len(p) for p in pieces])
        first, owner, data = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts), np.concatenate(pieces)
        pooled, where = self._pool(data)
        seen, hidden, p = self._combine(pooled, first, counts)
        d = ((p - y) / len(y))[:, None].astype(np.float32)
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        dh = (d @ self.w["out"].T) * (hidden > 0)
        g |= {"hidden": seen.T @ dh, "hidden_bias": dh.sum(0)}
        ds = dh @ self.w["hidden"].T
        mean, most, least = ds[:, :FILTERS], ds[:, FILTERS : 2 * FILTERS], ds[:, 2 * FILTERS :]
        top, low = seen[owner, FILTERS : 2 * FILTERS], seen[owner, 2 * FILTERS :]
        shared = lambda equal: equal / np.add.reduceat(equal.astype(np.float32), first)[owner]  # noqa: E731  chunks that tie share it
        dp = (mean / counts[:, None])[owner] + most[owner] * shared(pooled == top) + least[owner] * shared(pooled == low)
        dp *= pooled > 0
        g |= {"filter": np.zeros_like(self.w["filter"]), "bias": dp.sum(0), "embed": np.zeros_like(self.w["embed"])}
        for at in range(0, len(data), CHUNKS_AT_A_TIME):
            part = slice(at, at + CHUNKS_AT_A_TIME)
            self._add_filter_gradients(g, data[part], where[part], dp[part])
        return g

    def _add_filter_gradients(self, g: dict[str, np.ndarray], data: np.ndarray, where: np.ndarray, dp: np.ndarray) -> None:
        """Adds what some chunks give: the greatest response of a filter changes with the bytes at its place alone."""
        wide = self._windows(data)
        rows, cols = np.nonzero(dp)
        place, value = where[rows, cols], dp[rows, cols]
        order = np.argsort(cols, kind="stable")
        if len(order):
            starts = np.flatnonzero(np.concatenate([[True], np.diff(cols[order]) > 0]))
            got = (wide[rows, place] * value[:, None])[order]
            g["filter"][:, cols[order][starts]] += np.add.reduceat(got, starts).T
        back = (self.w["filter"].T[cols] * value[:, None]).reshape(-1, EMBED)
        bytes_ = data[rows[:, None], (place * STEP)[:, None] + np.arange(WIDTH)].ravel()
        g["embed"] += np.stack([np.bincount(bytes_, back[:, j], 257) for j in range(EMBED)], 1).astype(np.float32)

    def score(self, texts) -> Iterator[float]:
        """Probability of label 1 for each text."""
        if self.share is not None:
            yield from (self.share for _ in texts)
            return
        held, size = [], 0
        for t in texts:
            held.append(chunks(t))
            size += len(held[-1])
            if size >= CHUNKS_AT_A_TIME:
                yield from self._scores(held)
                held, size = [], 0
        if held:
            yield from self._scores(held)

    def _scores(self, parts: list[np.ndarray]) -> list[float]:
        counts = np.array([len(p) for p in parts])
        data = np.concatenate(parts)
        return self._combine(self._pool(data)[0], np.cumsum(counts) - counts, counts)[2].astype(float).tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network that has learned from an expected `sample` of the labelled documents (doc_id, text; doc_id, quality).

    Labels that are null or neither 0 nor 1, and those without an id, teach nothing; of several labels of an id the greatest
    counts; null texts count as empty; rows that repeat both the id and the text teach once; without labels, or with one kind
    alone, the network gives the smoothed share of label 1; other columns don't matter."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return Network().fit([], [])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000)
    # of a bounded number of rows, so broadcast; rows that repeat both the id and the text teach once
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").distinct().select("text", "quality", F.xxhash64("text", "doc_id").alias("k")).collect()
    rows.sort(key=lambda r: (r["k"], r["quality"]))
    return Network().fit([r["text"] for r in rows], [r["quality"] for r in rows])


def scored(spark: SparkSession, network: Network) -> Column:
    shipped = spark.sparkContext.broadcast(network)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([*shipped.value.score(texts)], dtype=float)

    return score


def learned_from(docs: DataFrame, labels: DataFrame) -> Network:
    """The network of the contract: rows whose crc32(doc_id) mod 3 is 1 teach nothing."""
    open_rows = F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))
    return fit(docs, labels.where(open_rows))


def keep_good(docs: DataFrame, all_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those scored under 0.5."""
    name = free_name(docs, "quality_score")
    score = scored(docs.sparkSession, learned_from(all_docs, labels))
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) >= 0.5).drop(name)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scored(spark, learned_from(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
