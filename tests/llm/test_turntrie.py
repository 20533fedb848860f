"""The conversation trie against brute force and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tracequarry.llm import turntrie
from tracequarry.llm.common import cut
from tracequarry.llm.queries import QUERIES

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def every_node(sequences):
    """Rows of COLUMNS from {conv_id: [(role, text)]} by listing each prefix's members."""
    members, rows = defaultdict(list), []
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in who if len(sequences[c]) == len(node))))
        rows.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_batches_cut_edges(spark, batches):
    rng, trunk = random.Random(batches), [("user", f"t{i} x y") for i in range(40)]
    sequences = {}
    for c in range(70):
        seq = trunk[: rng.randint(0, 40)] if rng.random() < 0.8 else []
        seq = seq + [("bot", f"{rng.randrange(2)} z") for _ in range(rng.choice([0, 0, 1, 3, 9]))]
        sequences[c] = seq
    sequences |= {100 + c: trunk[:17] for c in range(30)} | {200: []}
    rows = [(c, [hashlib.sha256(repr(t).encode()).digest() for t in s], [len(t[1].split()) for t in s]) for c, s in sequences.items()]
    rng.shuffle(rows)
    trie = turntrie.PrefixTrie(spark)
    for i in range(batches):
        part = spark.createDataFrame(rows[i::batches], "conv_id long, digests array<binary>, words array<long>")
        trie.insert(cut(turntrie.paths(part)))
    assert rows_of(trie.expanded()) == every_node(sequences)
    nodes = trie.nodes.collect()
    assert len({r["handle"] for r in nodes}) == len({r["extent"] for r in nodes}) == len(nodes)
    assert len(nodes) <= 2 * len(sequences)


def test_two_fattest(spark):
    rows = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", turntrie.fattest(*map(turntrie.F.col, "ab")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in got)


def contract(rows):
    """Rebuilt conversations from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for *_, t in sorted(s)] for c, s in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: head[c]] + s[head[c] :] for c, s in own.items()}


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 90), 125, 126, 127, 1000]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "é \t c", "", None, "long " * 500])))
    rows += [(40, None, "user", "first of all"), (40, None, None, None), (41, 2, "user", "again"), (41, 2, "user", "again"), (None, 1, "user", "nobody"), *rows[:5]]
    top = tmp_path_factory.mktemp("talks")
    spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(3).write.parquet(f"{top}/conversations.parquet")
    return str(top), rows


def test_query(spark, talks):
    top, rows = talks
    want = every_node(contract(rows))
    assert rows_of(QUERIES["op12_prefix_trie"](spark, top)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{top}/conversations.parquet/*.parquet'")
    got = con.sql(turntrie.OP12_SQL)
    assert sorted(got.project(", ".join(COLUMNS)).fetchall(), key=repr) == want
