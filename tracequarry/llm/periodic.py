"""Periodic runs of words, found by minimizers at several scales.

A run is a stretch of words with smallest period q, of max(24, 3q) words at least, that no neighbouring word extends. Periods up
to 8 are read off directly: words that equal the word q further on. Longer ones are taken in bands lo..hi of half an octave each.
In a band every word gets the fingerprint of the hi words that begin there, and the least one of each window of 2 lo - hi + 1
places is a minimizer. Within a run all this repeats q words on, and as hi >= q no fingerprint stands twice within a period, so
two successive minimizers that are equal lie exactly one period apart; three periods are long enough to hold such a pair. Each
pair seeds an extension that compares the words themselves in both directions. So every run is found, and none that isn't one.

Texts are searched in blocks of bounded size, one after another with a mark between them; a longer text is a block by itself.
Time grows with words times bands, memory with the words of a block. There is no shuffle.

Cases: null, empty and blank texts have no words and no runs, and their collapsed text is empty; repeated rows are judged each
for itself; a null doc_id keeps its text as it is in the query; ties of the greatest exponent go to the smaller start, then
period; empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.arrays import _sliding_min, mix
from tracequarry.llm.common import blocks, fields, table

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods found by comparing words at each lag.
DIRECT = LEAST_WORDS // LEAST_PERIODS
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _FIRST + mix(b * _SECOND))


def _until(line: np.ndarray, at: int, lag: int, step: int) -> int:
    """The nearest place from `at` on, in steps of 1 or -1, whose word differs from the one `lag` further on; -1 or the last if none."""
    size, last = 64, len(line) - lag
    while 0 <= at < last:
        low, high = (at, min(at + size, last)) if step > 0 else (max(at + 1 - size, 0), at + 1)
        other = np.flatnonzero(line[low:high] != line[low + lag : high + lag])
        if len(other):
            return low + int(other[0 if step > 0 else -1])
        at, size = high if step > 0 else low - 1, size * 2
    return at


def _short_periods(line: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    for lag in range(1, min(DIRECT, len(line) - 1) + 1):
        apart = np.concatenate([[-1], np.flatnonzero(line[:-lag] != line[lag:]), [len(line) - lag]])
        lengths = np.diff(apart) - 1 + lag
        for i in np.flatnonzero(lengths >= max(LEAST_WORDS, LEAST_PERIODS * lag)).tolist():
            found.setdefault((int(apart[i]) + 1, int(lengths[i])), lag)


def minimizers(prints: np.ndarray, window: int) -> np.ndarray:
    """Places whose fingerprint is the least of some window of so many places, equal ones all."""
    least = _sliding_min(prints, window)
    ends = np.full(window - 1, np.iinfo(np.uint64).max, np.uint64)
    return np.flatnonzero(~_sliding_min(np.concatenate([ends, ~least, ends]), window) == prints)


def _band(line: np.ndarray, prints: np.ndarray, low: int, high: int, found: dict[tuple[int, int], int]) -> None:
    at = minimizers(prints, 2 * low - high + 1)
    at = at[np.argsort(prints[at], kind="stable")]
    lag = np.diff(at)
    good = (prints[at[1:]] == prints[at[:-1]]) & (lag >= low) & (lag <= high)
    starts, lags = at[:-1][good], lag[good]
    upto: dict[int, int] = {}
    for i in np.argsort(starts, kind="stable").tolist():
        a, q = int(starts[i]), int(lags[i])
        if a < upto.get(q, 0):
            continue
        first, end = _until(line, a, q, -1) + 1, _until(line, a, q, 1)
        upto[q] = end
        if end - first + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            key = (first, end - first + q)
            found[key] = min(q, found.get(key, q))


def runs(values: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs by start, then period.

    values: the words of all texts, one text after another, as numbers from 0; sizes: the words of each text."""
    order = np.argsort(-sizes, kind="stable")  # so the texts that are long enough for a band stand first
    begin = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    line = np.empty(begin[-1], np.int64)
    line[begin[1:] - 1] = -1 - np.arange(len(sizes))
    inside = np.ones(len(line), bool)
    inside[begin[1:] - 1] = False
    first = np.cumsum(sizes) - sizes
    line[inside] = values[np.repeat(first[order] - (begin[:-1] - np.arange(len(sizes))), sizes[order]) + np.arange(len(values))]
    found: dict[tuple[int, int], int] = {}
    _short_periods(line, found)
    low, power, powered = DIRECT + 1, 1, mix(line.astype(np.uint64) * _FIRST)
    while (long := int(np.count_nonzero(sizes >= LEAST_PERIODS * low))) > 0:
        high, upto = low * 3 // 2, begin[long]
        while 2 * power <= high:
            powered = _pairs(powered[:-power], powered[power:])
            power *= 2
        n = upto - high + 1
        _band(line, _pairs(powered[:n], powered[high - power : high - power + n]), low, high, found)
        low = high + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for (start, length), period in found.items():
        k = int(np.searchsorted(begin, start, "right")) - 1
        out[order[k]].append((start - int(begin[k]), length, period))
    for some in out:
        some.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def scan(texts) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs and collapsed text of each text."""
    for _, part in blocks(texts):
        words = [t.encode("utf-8", "surrogatepass").split() for t in part]  # bytes split at \x09-\x0D and space only
        flat = [w for some in words for w in some]
        values = pd.factorize(np.array(flat, object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
        for some, found in zip(words, runs(values, np.array([len(w) for w in words], np.int64)), strict=True):
            if found:
                keep = kept_words(len(some), found)
                yield len(some), found, b" ".join([w for w, k in zip(some, keep.tolist(), strict=True) if k]).decode("utf-8", "surrogatepass")
            else:
                yield len(some), found, b" ".join(some).decode("utf-8", "surrogatepass")


@F.pandas_udf(fields("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"))
def _scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [(n, [r[0] for r in found], [r[1] for r in found], [r[2] for r in found], text) for n, found, text in scan(texts)]
        yield pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])


def find_runs(docs: DataFrame, text: str | Column = "text", name: str = "periodic") -> DataFrame:
    """docs with one more column, a struct: n_words, runs (array of start, length, period) and collapsed, the text without repetition."""
    found = docs.withColumn(name, _scanned(F.col(text) if isinstance(text, str) else text))
    parts = F.col(name)
    runs_ = F.arrays_zip(parts["starts"].alias("start"), parts["lengths"].alias("length"), parts["periods"].alias("period"))
    return found.withColumn(name, F.struct(parts["n_words"].alias("n_words"), runs_.cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), parts["collapsed"].alias("collapsed")))


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The query's texts: for a tenth of the ids the words from the a-th on repeat the p words that begin there."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, g = F.size(words), F.floor(h / 10)
    some = F.nullif(n, F.lit(0))
    a = (g % some).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(F.col(text))


def _stronger(a: Column, b: Column) -> Column:
    """a, or b if its length / period is greater, exactly; the first of equals stays, as runs come by start, then period."""
    return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, the query's planted ones among them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    found = find_runs(docs).select("doc_id", "periodic.*")
    best = F.aggregate("runs", F.get("runs", F.lit(0)), _stronger)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
