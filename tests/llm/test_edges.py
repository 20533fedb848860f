"""Every query over odd and over empty tables."""

import hashlib

import pytest

from tracequarry.llm.queries import QUERIES

ROWS = 11


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, odd, name):
    assert QUERIES[name](spark, f"{odd}/none").count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline", "op7_main_text", "op12_prefix_trie"}))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, f"{odd}/full").collect()
    assert len(rows) == ROWS
    by = {r["doc_id"]: r.asDict() for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    if name.startswith("op1_"):
        assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und"
    if name.startswith("op2_"):
        assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[3]["class_id"] == 3 and by[None]["class_id"] is None
    if name.startswith("op3_"):
        assert by[6]["n_phone"] == 1 and by[3]["base_sha256"] == empty
    if name.startswith("op4_"):
        assert by[1]["n_removed"] == by[1]["n_bytes"] > 400 and by[7]["n_removed"] == 3000 and by[3]["n_bytes"] == 0 and by[3]["kept_sha256"] == empty
    if name.startswith("op6_"):
        assert by[1]["contaminated"] and by[1]["n_hit"] == by[1]["n_words"] and by[6]["n_items"] == 1 and by[3]["n_words"] == 0
    if name.startswith("op8_"):
        assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == by[2]["n_words"] and by[8]["n_removed"] == 0 and by[None]["n_removed"] == 0
    if name.startswith("op9_"):
        assert by[3]["payload_bytes"] == by[4]["payload_bytes"] == 192 and by[1]["payload_bytes"] % 192 == 0
    if name.startswith("op10_"):
        assert by[3]["n_tokens"] == by[5]["n_tokens"] == 0
    if name.startswith("op11_"):
        assert by[3]["n_runs"] == 0 and by[3]["start"] is None and by[8]["n_runs"] == 1 and by[8]["period"] == 3 and by[3]["collapsed_sha256"] == empty
    if name.startswith("op13_"):
        assert by[3]["n_words"] == by[5]["n_words"] == by[3]["n_base"] == 0 and by[3]["labels"] == "" and by[7]["n_words"] == 1


def test_odd_conversations(spark, odd):
    rows = {(r["conv_id"], r["depth"]): r for r in QUERIES["op12_prefix_trie"](spark, f"{odd}/full").collect()}
    assert rows[0, 0]["n_convs"] == 3 and rows[0, 0]["parent_conv_id"] is None


def test_odd_pages(spark, odd):
    text = {r["page_id"]: r["text"] for r in QUERIES["op7_main_text"](spark, f"{odd}/full").collect()}
    assert text[1] == text[2] == "" and text[3] == "One & two words of a text that goes on, and on.\nMore of it, as is usual."


def test_stages_keep_columns(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{odd}/full").columns == docs.columns
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, f"{odd}/full").collect()}
    assert {1, 3, 6, 7, None} <= kept and 2 not in kept
