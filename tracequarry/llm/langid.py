"""Language identification by multilingual mixture inference.

A document's words are drawn from a mixture of languages; each language gives a word the likelihood of its letter trigrams.
Expectation-maximisation estimates the proportions. Which languages take part is chosen by penalised likelihood: starting
from all, the least is dropped as long as that costs less likelihood than its penalty.

The model is fitted on a sample of labelled rows of expected size PER_LANGUAGE for each language, chosen by a hash of the
row's text, of which copies count once; prediction reads every whole text.

Cases: null texts and texts without a letter are `und` with score 0, as is every text where no labelled row was there to
learn from; ties go to the language that comes first by name; null labels teach nothing; any length is read, in blocks;
repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.common import blocks, fields, table

UNKNOWN = "und"
#: Expected number of labelled documents for each language that the model is fitted on.
PER_LANGUAGE = 1500
#: Trigrams are hashed to so many counts; what is added to each count.
BUCKETS, PRIOR = 1 << 16, 0.05
#: Share of a word's log likelihood that counts, since its trigrams overlap.
TEMPER = 0.5
#: Steps of expectation-maximisation; log likelihood that a further language must add, times the log of the words.
STEPS, PENALTY = 12, 2.0


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of each word with its edges; each word's first one; each text's first word (and ends)."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    kept = np.where(letter, points, 0).astype(np.uint32)
    grams = (kept[:-2] * np.uint32(0x9E3779B1)) ^ (kept[1:-1] * np.uint32(0x85EBCA77)) ^ (kept[2:] * np.uint32(0xC2B2AE3D))
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    middle = letter[1:-1]
    first = np.cumsum(middle) - middle  # trigrams before each place
    at = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
    return grams[middle], first[starts - 1], np.searchsorted(starts, at)


class Model:
    """Languages in order of name, and their log likelihoods by trigram bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + PRIOR
        self.logs = (TEMPER * np.log(smooth / smooth.sum(0))).astype(np.float32)

    @classmethod
    def fit(cls, rows: Iterator[tuple[str, str]]) -> Model:
        found: dict[str, np.ndarray] = {}
        for language, text in rows:
            counts = found.setdefault(language, np.zeros(BUCKETS))
            counts += np.bincount(trigrams([text])[0], minlength=BUCKETS)
        names = sorted(found)
        return cls(names, np.stack([found[n] for n in names], 1) if names else np.zeros((BUCKETS, 0)))

    def proportions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Languages' shares in each text after selection, and whether it has a word."""
        grams, word, text = trigrams(texts)
        n, k = len(texts), len(self.languages)
        sizes = np.diff(text)
        share = np.zeros((n, k))
        full = np.flatnonzero(sizes)
        if not len(full) or not k:
            return share, np.zeros(n, bool) if not k else sizes > 0
        logs = np.add.reduceat(self.logs[grams], word, axis=0)
        top = logs.max(1)
        likely = np.exp(logs - top[:, None])
        share[full] = self._select(likely, text[full], sizes[full])
        return share, sizes > 0

    def _em(self, likely: np.ndarray, first: np.ndarray, sizes: np.ndarray, allowed: np.ndarray):
        """Shares among the allowed languages of each text, and the log likelihood they give."""
        share = allowed / allowed.sum(1, keepdims=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for _ in range(STEPS):
            part = likely * share.astype(np.float32)[owner]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            share = np.add.reduceat(part, first, axis=0) / sizes[:, None]
        given = np.log(np.maximum((likely * share.astype(np.float32)[owner]).sum(1), 1e-30))
        return share, np.add.reduceat(given, first)

    def _select(self, likely: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, k = len(sizes), likely.shape[1]
        allowed = np.ones((n, k))
        best, gain = self._em(likely, first, sizes, allowed)
        open_, price = np.arange(n), PENALTY * np.log(sizes + 1.0)
        # a single language is final where all together gain less than one more would cost
        alone = np.add.reduceat(np.log(np.maximum(likely, 1e-30)), first, axis=0)
        single = alone.argmax(1)
        sure = gain - alone.max(1) < price
        best[sure] = np.eye(k)[single[sure]]
        open_ = np.flatnonzero(~sure)
        while len(open_):
            left = allowed[open_].copy()
            least = np.where(left > 0, best[open_], np.inf).argmin(1)
            left[np.arange(len(open_)), least] = 0
            more = left.sum(1) > 0
            open_, left = open_[more], left[more]
            if not len(open_):
                break
            rows = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in open_])
            own = sizes[open_]
            share, now = self._em(likely[rows], np.cumsum(own) - own, own, left)
            drop = gain[open_] - now < price[open_]
            open_, left = open_[drop], left[drop]
            best[open_], gain[open_], allowed[open_] = share[drop], now[drop], left
        return best

    def predict(self, texts) -> Iterator[tuple[str, float, str]]:
        """Most likely language of each text, its share, and all languages selected."""
        for _, part in blocks(texts, 1 << 18):
            shares, known = self.proportions(part)
            for s, k in zip(shares, known, strict=True):
                if not k or not len(s):
                    yield UNKNOWN, 0.0, ""
                else:
                    i = int(s.argmax())
                    yield self.languages[i], min(1.0, float(s[i])), ",".join(self.languages[j] for j in np.flatnonzero(s > 0.005))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled rows given: of each language an expected per_language rows, by a hash of their texts.

    Rows without a label or a text teach nothing; copies of a text with one label teach once; without any row the model knows
    no language; other columns don't matter."""
    labelled = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model.fit(iter(()))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)
    return Model.fit((r["lang"], r["text"]) for r in chosen.distinct().collect())  # a much repeated text comes once


def predicted(spark: SparkSession, model: Model) -> Column:
    shipped = spark.sparkContext.broadcast(model)  # BUCKETS floats for each language

    @F.pandas_udf(fields("lang_pred string, score double, languages string"))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([*shipped.value.predict(texts)], columns=["lang_pred", "score", "languages"])

    return predict


def remainder(doc_id: str, of: int) -> Column:
    return F.crc32(F.col(doc_id).cast(T.StringType()).cast("binary")) % of


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out).select("text", "lang"))
    return docs.select("doc_id", held_out.alias("held_out"), predicted(spark, model)(F.col("text")).alias("r")).select("doc_id", "held_out", "r.*")
