"""A slice classifier from labelled packages, its attributions, tokenizers of the user's own, and similar texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.operators import matching

#: Words that the classifier knows at most.
VOCABULARY = 1 << 16
#: A word of lower-cased text. Words are looked for: splitting at what is none takes eight times as long.
WORD = "[a-z0-9_/;<>]+"
LABELS = {"Benign": 0.0, "Malicious": 1.0}


def words(slices: DataFrame, text: str = "text") -> DataFrame:
    """slices with words, the classifier's, in place of the text; null for a null text. What is written like this needs no second reading of texts."""
    return slices.withColumn("words", F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)).drop(text)


def fit(slices: DataFrame, text: str = "text", label: str = "label", cut=lambda df: df) -> PipelineModel:
    """P(package malicious | slice), with labels inherited from the package; rarer labels weigh more.

    slices need a text, or its words(), and a label of LABELS; nulls teach nothing. Without a row, or with one label alone, it raises. cut
    may write what is learned from, which is gone through several times."""
    number = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col(label)]
    column = "words" if "words" in slices.columns else text
    rows = slices.where(F.col(column).isNotNull()).select(column, number.alias("y")).where("y IS NOT NULL")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # a row for each label
    if len(n) < 2:
        raise ValueError("slices of both labels are needed")
    weight = F.create_map(*[F.lit(x) for y, k in n.items() for x in (y, sum(n.values()) / (2.0 * k))])
    rows = rows if column == "words" else words(rows, column)
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=VOCABULARY, minDF=2.0, binary=True).fit(rows)
    found = cut(counts.transform(rows).select("features", "y", weight[F.col("y")].alias("w")))
    tokens = RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False)  # words() of texts to come
    return PipelineModel([tokens, counts, LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, maxIter=30).fit(found)])


def score(model: PipelineModel, slices: DataFrame, text: str = "text") -> DataFrame:
    """slices, with texts or their words(), with a probability; null texts count as empty."""
    extra = ["words", "features", "rawPrediction", "prediction"]
    if "words" in slices.columns:
        scored = PipelineModel(model.stages[1:]).transform(slices.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))
    else:
        scored = model.transform(slices.withColumn(text, F.coalesce(text, F.lit(""))))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop(*extra)


def attribute(model: PipelineModel, slices: DataFrame, k: int, key: str = "example_id", text: str = "text") -> DataFrame:
    """(key, token, weight, rank): the k words of a slice whose coefficients weigh most; slices have texts or their words(). The table of
    coefficients has a row for each word of the vocabulary, so it is broadcast."""
    from pyspark.sql import Window as W

    counts, regression = model.stages[1], model.stages[2]
    spark = slices.sparkSession
    table = spark.createDataFrame(pd.DataFrame({"token": counts.vocabulary, "weight": regression.coefficients.toArray()}))
    made = slices if "words" in slices.columns else words(slices.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")))
    found = made.where("words IS NOT NULL").select(key, F.explode(F.array_distinct("words")).alias("token")).join(F.broadcast(table), "token")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("weight")), "token"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "token", F.round("weight", 9).alias("weight"), "rank")


def tokenize(rows: DataFrame, make: Callable[[], Callable[[str], list[int]]], text: str = "text") -> DataFrame:
    """rows with input_ids and token_count by the user's tokenizer, which `make` builds once in each task."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            yield pd.Series([run(t or "") for t in texts], dtype=object)

    return rows.withColumn("input_ids", ids(text)).withColumn("token_count", F.size("input_ids").cast("long"))


def similar(rows: DataFrame, known: DataFrame, key: str, known_key: str, threshold: float, words: int = 3, cut=lambda df: df) -> DataFrame:
    """(key, known_key, similarity): rows whose word shingles have a Jaccard similarity of the threshold or more with a known text.

    All of them: distinct texts are joined by matching.near_sets(), then every row of a text has its links. Texts of fewer words
    have none. cut may write the sets in between."""
    cleaned = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - words + 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(words)), " ")))
    named = lambda df, k, digest, name: df.where("text IS NOT NULL").select(F.sha2("text", 256).alias(digest), F.col(k).alias(name), "text")

    def sets(df: DataFrame, k: str) -> DataFrame:
        one = named(df, k, "digest", "key").groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.any_value("text").alias("text"))
        return cut(one.select("digest", "key", "n", cleaned.alias("w")).where(F.size("w") >= words).select("digest", "key", "n", F.array_distinct(grams(F.col("w"))).alias("set")))

    pairs = matching.near_sets(sets(rows, key), sets(known, known_key), threshold).select("digest", "k_digest", "similarity")
    linked = named(rows, key, "digest", key).drop("text").join(pairs, "digest")
    return linked.join(named(known, known_key, "k_digest", known_key).drop("text"), "k_digest").select(key, known_key, "similarity")
