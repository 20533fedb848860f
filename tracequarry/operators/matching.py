"""Texts like known ones: an exact set-similarity join over word shingles, by prefixes of rare shingles.

Two sets whose Jaccard similarity is t or more share one of the first n - ceil(t n) + 1 of their shingles in any order that is the same
for both. In order of frequency these are the rarest, so candidates are few and none is lost; lengths that differ by more than
1 / t are left out, and what remains is compared whole. Equal texts are one set. All of it is built-in functions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, SIMILAR = 5, 0.8


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the distinct runs of so many words; of a shorter text, of all its words; empty without words."""
    return _runs(_words(text), width)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, width: int) -> Column:
    shifted = [F.when(F.size(words) > i, F.slice(words, F.lit(i + 1), F.greatest(F.size(words), F.lit(1)))).otherwise(F.array().cast("array<string>")).alias(f"w{i}") for i in range(width)]
    runs = F.transform(F.filter(F.arrays_zip(*shifted), lambda z: z[f"w{width - 1}"].isNotNull()), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(width)]))
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= width, F.array_distinct(runs)).otherwise(whole)


def text_sets(rows: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(digest, key, n, set): one row for each distinct text with words: its least key, how many rows have it, its shingles."""
    one = rows.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(key).alias("key"), F.count("*").alias("n"), F.any_value(text).alias("text"))
    cut = one.select("digest", "key", "n", _words(F.col("text")).alias("words")).where(F.size("words") > 0)  # words are read often, but cut once
    return cut.select("digest", "key", "n", _runs(F.col("words"), width).alias("set"))


#: What names a text in tables of shingles: its least key and 64 bits of its digest, a quarter of the digest's bytes.
_ID = ["key", "mark"]


def _prefixes(sets: DataFrame, seen: DataFrame, similar: float) -> DataFrame:
    """(key, mark, size, shingle) of those shingles of each set's prefix that are seen, the rarest first; shingles that aren't seen come
    before them all and find nothing, so that their number is enough."""
    each = sets.select(*_ID, F.size("set").alias("size"), F.explode("set").alias("shingle")).join(seen, "shingle")
    sorted_ = each.groupBy(*_ID, "size").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("known"))
    length = F.col("size") - F.ceil(F.round(F.col("size") * similar, 6)).cast("int") + 1
    prefix = F.slice("known", F.lit(1), F.greatest(F.lit(0), length - (F.col("size") - F.size("known"))))
    return sorted_.select(*_ID, "size", F.explode(prefix).alias("p")).select(*_ID, "size", "p.shingle")


def near_sets(new: DataFrame, known: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(digest, key, n, k_digest, known, n_known, similarity) of texts of new and of known, both from text_sets(), that are similar enough.

    Frequencies are counted over the known ones, which are fewer. Only shingles that some known text has go further than the first join."""
    marked = lambda rows: rows.withColumn("mark", F.xxhash64("digest"))
    new, known = marked(new), marked(known)
    seen = known.select(F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("times"))
    b = _prefixes(known, seen, similar).select(F.col("key").alias("known"), F.col("mark").alias("k_mark"), F.col("size").alias("k_size"), "shingle")
    close = (F.col("k_size") >= F.col("size") * similar - 1e-6) & (F.col("size") >= F.col("k_size") * similar - 1e-6)
    pairs = _prefixes(new, seen, similar).join(b, "shingle").where(close).select(*_ID, "known", "k_mark").distinct()
    right = known.select(F.col("digest").alias("k_digest"), F.col("mark").alias("k_mark"), F.col("key").alias("known"), F.col("n").alias("n_known"), F.col("set").alias("k_set"))
    both = pairs.join(new.select("digest", *_ID, "n", "set"), _ID).join(right, ["known", "k_mark"])
    common = F.size(F.array_intersect("set", "k_set"))
    found = both.withColumn("similarity", common / (F.size("set") + F.size("k_set") - common)).where(F.col("similarity") >= similar - 1e-9)
    return found.select("digest", "key", "n", "k_digest", "known", "n_known", F.round("similarity", 6).alias("similarity"))


def near_matches(new: DataFrame, known: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(key, known, n, n_known, similarity) of near_sets()."""
    return near_sets(new, known, similar).select("key", "known", "n", "n_known", "similarity")
