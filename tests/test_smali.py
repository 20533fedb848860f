"""Smali texts and texts like known ones, with known rows."""

import random

from tracequarry.operators import matching
from tracequarry.sources import smali

TEXT = """.class public final La/Example;
.super Ljava/lang/Object;

.method public constructor <init>(J)V
    .locals 2
    .param p1, "identifier"
    .annotation Lx;
        value = 1
    .end annotation
    invoke-direct {p0}, Ljava/lang/Object;-><init>()V  # up
    return-void
.end method

.method public static choose(IJLjava/lang/String;)V
    .registers 8
    .param p0, "choice"
    .param p3, "name"
    :try_start_0
    packed-switch p0, :pswitch_data_0
    # nothing here
    sparse-switch p0, :sswitch_data_0
    :try_end_0
    .catch Ljava/lang/Exception; {:try_start_0 .. :try_end_0} :case_1
    .catchall {:try_start_0 .. :try_end_0} :case_1
    :case_1
    return-void
    :pswitch_data_0
    .packed-switch -0x1
        :case_1
        :try_end_0
    .end packed-switch
    :sswitch_data_0
    .sparse-switch
        0x5 -> :case_1
        0x9 -> nowhere
    .end sparse-switch
    :array_data_0
    .array-data 0x1
        0x1t
        0x2t
    .end array-data
.end method

.method public native nativeCall()V
.end method

.method broken(Q)V
    .locals many
    :data
    .packed-switch x
        :a
    .end packed-switch
    nop
    :open
    .sparse-switch
        0x1 -> :a
    nop
.end method

.method
.end method

.method public after()V
    return-void
    .annotation Ly;
    nop
.end method

.method public never()V
    nop
"""


def test_parts_of_a_class(spark):
    parts = smali.read_classes(spark.createDataFrame([("k", TEXT), ("none", None), ("no class", "nop")], "key string, text string"), "key", "text").cache()
    rows = lambda df, *cols: [tuple(r[c] for c in cols) for r in df.where("key = 'k'").collect()]
    assert rows(smali.methods(parts), "method_no", "full_signature", "flags", "local_count", "register_count", "n_instructions") == [
        (0, "La/Example;-><init>(J)V", "public,constructor", 2, 5, 2), (1, "La/Example;->choose(IJLjava/lang/String;)V", "public,static", 4, 8, 3), (2, "La/Example;->nativeCall()V", "public,native", None, None, 0),
        (3, "La/Example;->broken(Q)V", "", None, None, 1), (5, "La/Example;->after()V", "public", None, None, 1),
    ]
    assert rows(smali.parameters(parts), "method_no", "place", "register", "type", "name") == [(0, 0, "p1", "J", "identifier"), (1, 0, "p0", "I", "choice"), (1, 1, "p1", "J", None), (1, 2, "p3", "Ljava/lang/String;", "name")]
    assert rows(smali.instructions(parts).where("method_no < 2"), "method_no", "idx", "opcode", "operands") == [
        (0, 0, "invoke-direct", "{p0}, Ljava/lang/Object;-><init>()V"), (0, 1, "return-void", ""), (1, 0, "packed-switch", "p0, :pswitch_data_0"), (1, 1, "sparse-switch", "p0, :sswitch_data_0"), (1, 2, "return-void", ""),
    ]
    assert rows(smali.labels(parts).where("method_no = 1"), "label", "idx") == [(":try_start_0", 0), (":try_end_0", 2), (":case_1", 2), (":pswitch_data_0", None), (":sswitch_data_0", None), (":array_data_0", None)]
    assert rows(smali.handlers(parts), "exception", "try_start", "try_end", "handler") == [("Ljava/lang/Exception;", ":try_start_0", ":try_end_0", ":case_1"), (None, ":try_start_0", ":try_end_0", ":case_1")]
    assert rows(smali.payload_entries(parts).where("method_no = 1"), "label", "pos", "key_value", "target", "value") == [
        (":pswitch_data_0", 0, -1, ":case_1", None), (":pswitch_data_0", 1, 0, ":try_end_0", None), (":sswitch_data_0", 0, 5, ":case_1", None), (":sswitch_data_0", 1, 9, None, None), (":array_data_0", 0, None, None, "0x1t"), (":array_data_0", 1, None, None, "0x2t"),
    ]
    found = [(r["issue"], r["detail"]) for r in smali.issues(parts).where("key = 'k'").collect()]
    want = [(smali.BAD_ENTRY, ":sswitch_data_0"), (smali.BAD_DESCRIPTOR, "(Q)V"), (smali.BAD_LOCALS, None), (smali.BAD_KEY, ":data"), (smali.OPEN_PAYLOAD, ":open"), (smali.BAD_HEADER, None), (smali.OPEN_BLOCK, "annotation"), (smali.OPEN_METHOD, None)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert {(r["key"], r["issue"]) for r in smali.issues(parts).where("key <> 'k'").collect()} == {("none", smali.NO_CLASS), ("no class", smali.NO_CLASS)}
    assert parts.where("class_name IS NOT NULL AND class_name <> 'La/Example;'").count() == 0
    assert not any(word in smali.read_classes(spark.createDataFrame([("k", TEXT)], "key string, text string"), "key", "text")._jdf.queryExecution().toString() for word in ("Exchange", "Window"))


def test_every_similar_pair_is_found(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    known = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    new = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(30)] + [["the"] * 30, []]
    for k in known:
        for changes in (0, 0, 1, 1, 2, 5):
            t = [*k]
            for _ in range(changes):
                t[rng.randrange(len(t))] = rng.choice(words)
            new.append(t)
    row = lambda texts: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(999, None)], "id long, text string")
    got = matching.near_matches(matching.text_sets(row(new), "id", "text"), matching.text_sets(row(known), "id", "text")).collect()

    def one(t):
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else {tuple(t)} - {()}

    first = {}
    for i, t in enumerate(new):
        first.setdefault(tuple(t), i)
    kept = {}
    for i, t in enumerate(known):
        kept.setdefault(tuple(t), i)
    want = {}
    for t, i in first.items():
        for u, j in kept.items():
            a, b = one([*t]), one([*u])
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                want[i, j] = round(len(a & b) / len(a | b), 6)
    assert {(r["key"], r["known"]): r["similarity"] for r in got} == want and len(want) > 40
    assert sum(r["n"] for r in got) > len(got)
