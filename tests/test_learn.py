"""The slice classifier on held-out rows, and what it attributes to tokens."""

import random

from pyspark.ml.feature import RegexTokenizer

from tracequarry import catalog
from tracequarry.operators import learn


def test_held_out_rows_are_ranked(spark):
    rng = random.Random(5)
    common, bad, good = [f"w{i}" for i in range(40)], ["exec", "loader", "smspdu"], ["layout", "button", "theme"]
    rows = []
    for i in range(400):
        own = bad if i % 4 == 0 else good
        words = rng.choices(common, k=30) + [w for w in own if rng.random() < 0.6] + [w for w in bad + good if rng.random() < 0.08]
        rng.shuffle(words)
        rows.append((i, "Malicious" if i % 4 == 0 else "Benign", " ".join(words)))
    df = spark.createDataFrame(rows, "example_id long, label string, text string")
    model = learn.fit(df.where("example_id < 300"))
    scored = {r["example_id"]: r["probability"] for r in learn.score(model, df.where("example_id >= 300")).collect()}
    ill, well = [p for i, p in scored.items() if i % 4 == 0], [p for i, p in scored.items() if i % 4]
    auc = sum((a > b) + (a == b) / 2 for a in ill for b in well) / (len(ill) * len(well))
    assert len(scored) == 100 and auc > 0.9
    told = learn.attribute(model, df.where("example_id >= 300"), 3).collect()
    assert len(told) == 300 and {r["rank"] for r in told} == {1, 2, 3}
    strong = [r["token"] for r in told if r["rank"] == 1]
    assert sum(t in bad + good for t in strong) > 60


def test_words_are_those_of_the_pipeline(spark):
    odd = ["\u0130stanbul \u212a a\u0130b K1 <X>;/y_ \n\tzZ", "", "  ", "a", "-a-", None, "\u017fS \ufb01 \uff41B \u03a3A\u03a3"]
    df = spark.createDataFrame([(i, "Malicious" if i % 2 else "Benign", t) for i, t in enumerate(odd * 2)], "example_id long, label string, text string")
    made = {r["example_id"]: r["words"] for r in learn.words(df).collect()}
    split = RegexTokenizer(inputCol="text", outputCol="words", pattern="[^A-Za-z0-9_/;<>]+")
    assert made[5] is None and {i: w for i, w in made.items() if w is not None} == {r["example_id"]: r["words"] for r in split.transform(df.where("text IS NOT NULL")).collect()}
    tables = []
    model = learn.fit(learn.words(df), cut=lambda t: tables.append(t.columns) or t)
    assert tables == [["features", "y", "w"]]
    p = [{r["example_id"]: r["probability"] for r in learn.score(m, rows).collect()} for m in (model, learn.fit(df)) for rows in (df, learn.words(df))]
    assert len(p[0]) == 14 and all(x == p[0] for x in p)


def test_labelled_texts_are_cut_into_words_once(spark):
    from pathlib import Path

    import pytest

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("needs the given tables")
    plan = catalog.QUERIES["ml1_slice_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "words#" in plan  # texts aren't gone through again
