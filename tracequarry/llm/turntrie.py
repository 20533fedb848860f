"""A z-fast trie of conversations, kept as tables and filled in batches.

A conversation is a path of turns. Each of its prefixes is known by a SHA-256 chained over the digests of its turns, so equal
prefixes have equal digests at equal depth. The trie keeps compacted nodes only, those where paths branch or end: a node's edge
covers the depths top+1 .. depth, its extent is the digest at depth, and it is hashed at its handle, the digest at the two-fattest
number in top+1 .. depth (the one divisible by the highest power of two).

A batch finds its exit nodes by fat binary search: each round asks the handles for the two-fattest depth of what is left of the
interval, as one join, and there are as many rounds as the trie's depth has bits. What a path shares with the edge it leaves on
is counted from the edge's digests. Then edges are cut where paths leave or end inside them, and what lies below becomes new
nodes: of the new prefixes, those that branch or end. Conversations that are equal are one path.

Figures of the nodes are sums over what ends below them: each node sends its own to the digests of its prefixes, pre-aggregated
before the shuffle, and those that are extents take them. Edges are expanded to one row a depth as the last step. Lists of
conversations that end at a node are put in order by ranges, joined to pieces there, and digested piece by piece, so that no task
holds a list. Joins look up tables with unique keys; where many rows ask for one key, adaptive execution splits them.

Cases: a null conv_id isn't a conversation; a null turn comes first, null role and text are empty; rows of one turn go by the
digest of role and text, so that repeated rows are repeated turns; an empty table has no root; other columns are not read. One
conversation is one row of 48 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.common import cut, fields, table

#: The extent of the root.
ROOT = b""
#: Conversations of a piece of a list; pieces of one list are digested one after another.
PIECE = 4096
#: Turns of another conversation that the query lets a conversation begin with, at most.
BORROWED = 3
_NODE = "extent binary, parent binary, first binary, handle binary, top int, depth int, above long, rep binary, edge array<struct<digest:binary,upto:bigint>>"


def _int(c: Column) -> Column:
    return c.cast("int")


def fattest(low: Column, high: Column) -> Column:
    """The number in low+1 .. high that is divisible by the highest power of two."""
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits := F.length(F.bin(low.bitwiseXOR(high))) - 1), bits)


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, digests and words of each conversation's turns, in order; the texts stay where they are."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    one = F.struct(
        F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)).alias("digest"),
        F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all")).select("conv_id", F.col("all.digest").alias("digests"), F.col("all.words").alias("words"))


@F.pandas_udf(fields("digests array<binary>, upto array<long>"))
def _chained(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for digests, words in batches:
        rows = []
        for some, counts in zip(digests, words, strict=True):
            chain, last = [], b""
            for one in some:
                last = hashlib.sha256(last + one).digest()
                chain.append(last)
            rows.append((chain, np.cumsum(np.asarray(counts, np.int64))))
        yield pd.DataFrame(rows, columns=["digests", "upto"])


def paths(sequences: DataFrame) -> DataFrame:
    """conv_id, key, digests and upto: for each depth the prefix's digest and its words; key is the last digest."""
    return sequences.select("conv_id", _chained("digests", "words").alias("c")).select("conv_id", F.coalesce(F.try_element_at("c.digests", F.lit(-1)), F.lit(ROOT)).alias("key"), "c.digests", "c.upto")


def _nodes(rows: DataFrame, low: Column, high: Column, parent: Column, above: Column, edge: Column) -> DataFrame:
    """One node a row; edge covers the depths low+1 .. high."""
    digest = lambda depth: F.get(edge, depth - low - 1)["digest"]
    return rows.select(
        digest(high).alias("extent"), parent.alias("parent"), digest(low + 1).alias("first"), digest(_int(fattest(low, high))).alias("handle"),
        low.alias("top"), high.alias("depth"), above.alias("above"), F.col("rep"), edge.alias("edge"),
    )


class PrefixTrie:
    """Compacted nodes, the paths that made them, and the conversations that end at each extent."""

    def __init__(self, spark: SparkSession):
        self.spark, self.deepest = spark, 0
        self.nodes = spark.createDataFrame([], _NODE)
        self.paths: list[DataFrame] = []
        self.ends: list[DataFrame] = []

    def insert(self, batch: DataFrame) -> None:
        """Add conversations, as paths() gives them; batch should be a written table, as it is read twice."""
        self.ends.append(batch.select(F.col("key").alias("extent"), "conv_id"))
        distinct = batch.where(F.size("digests") > 0).dropDuplicates(["key"]).select("key", "digests", "upto")
        located = cut(self.located(distinct))
        self.paths.append(located.where(F.col("shared") < F.size("digests")).select("key", "digests"))
        self.nodes = cut(self._split(located).unionByName(self._fresh(located)))
        self.deepest = self.nodes.agg(F.max("depth")).first()[0] or 0

    def located(self, found: DataFrame) -> DataFrame:
        """key, digests and upto with shared, the depth to which the trie has the path, and the extent of the node whose edge it leaves
        or ends on (null where it leaves at a node)."""
        n = F.size("digests")
        at = lambda depth: F.get("digests", depth - 1)
        found = found.withColumns({"low": F.lit(0), "high": F.least(n, F.lit(self.deepest))})
        handles = self.nodes.select(F.col("handle").alias("ask"), F.col("top").alias("t"), F.col("depth").alias("d"), F.col("extent").alias("x"))
        for _ in range(self.deepest.bit_length()):
            open_ = F.col("low") < F.col("high")
            found = found.withColumn("fat", F.when(open_, _int(fattest(F.col("low"), F.col("high")))))
            found = found.withColumn("ask", F.when(open_, at(F.col("fat"))).otherwise(F.col("key"))).join(handles, "ask", "left")
            whole = (F.col("d") <= n) & (at(F.col("d")) == F.col("x"))
            hit = open_ & F.col("d").isNotNull()
            found = found.select(
                "key", "digests", "upto", F.when(hit, F.when(whole, F.col("d")).otherwise(F.col("t"))).otherwise(F.col("low")).alias("low"),
                F.when(hit, F.when(whole, F.col("high")).otherwise(F.col("t"))).when(open_, F.col("fat") - 1).otherwise(F.col("high")).alias("high"),
            )
        exits = self.nodes.select(F.col("first").alias("ask"), F.col("top").alias("t"), F.col("depth").alias("d"), F.col("extent").alias("x"), F.col("edge.digest").alias("e"))
        found = found.withColumn("ask", F.coalesce(at(F.col("low") + 1), F.col("key"))).join(exits, "ask", "left")
        goes_on = F.col("t") == F.col("low")  # the edge that begins where the path's last whole node ends
        same = F.size(F.array_intersect(F.col("e"), F.slice("digests", F.col("t") + 1, F.col("d") - F.col("t"))))
        return found.select("key", "digests", "upto", F.when(goes_on, F.col("t") + same).otherwise(F.col("low")).alias("shared"), F.when(goes_on, F.col("x")).alias("exit"))

    def _split(self, located: DataFrame) -> DataFrame:
        """The nodes, with the edges cut where paths leave or end inside them."""
        cuts = located.where("exit IS NOT NULL").groupBy(F.col("exit").alias("extent")).agg(F.sort_array(F.collect_set("shared")).alias("cuts"))
        rows = self.nodes.join(cuts, "extent", "left")
        depths = F.array_distinct(F.concat(F.array("top"), F.coalesce(F.col("cuts"), F.array().cast("array<int>")), F.array("depth")))
        rows = rows.withColumn("depths", depths).select("*", F.explode(F.sequence(F.lit(1), F.size("depths") - 1)).alias("i"))
        low, high = F.get("depths", F.col("i") - 1), F.get("depths", F.col("i"))
        rows = rows.withColumns({"low": low, "high": high})
        before = F.get("edge", F.col("low") - F.col("top") - 1)
        whole = F.col("low") == F.col("top")
        return _nodes(
            rows, F.col("low"), F.col("high"), F.when(whole, F.col("parent")).otherwise(before["digest"]), F.when(whole, F.col("above")).otherwise(before["upto"]),
            F.slice("edge", F.col("low") - F.col("top") + 1, F.col("high") - F.col("low")),
        )

    def _fresh(self, located: DataFrame) -> DataFrame:
        """New nodes below what is shared: prefixes where new paths branch or end, each made from the least path through it."""
        new = located.where(F.col("shared") < F.size("digests"))
        steps = new.select("key", F.posexplode(F.slice("digests", F.col("shared") + 1, F.size("digests"))).alias("i", "digest"), "shared", "digests")
        depth = F.col("shared") + F.col("i") + 1
        steps = steps.select("key", "digest", depth.alias("depth"), F.get("digests", depth).alias("next"))
        kept = steps.groupBy("digest").agg(F.min("key").alias("rep"), (F.bool_or(F.col("next").isNull()) | (F.min("next") != F.max("next"))).alias("node")).where("node")
        own = steps.join(kept.select("digest", "rep"), "digest").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("depth", (F.col("rep") == F.col("key")).alias("mine")))).alias("steps"))
        rows = new.join(own, "key").withColumn("depths", F.concat(F.array("shared"), F.col("steps.depth")))
        rows = rows.select("*", F.posexplode("steps").alias("i", "step")).where("step.mine")
        rows = rows.select(F.col("key").alias("rep"), F.get("depths", F.col("i")).alias("low"), F.col("step.depth").alias("high"), "digests", "upto")
        part = lambda c: F.slice(c, F.col("low") + 1, F.col("high") - F.col("low"))
        at = F.col("low") - 1
        top = F.col("low") == 0
        return _nodes(
            rows, F.col("low"), F.col("high"), F.when(top, F.lit(ROOT)).otherwise(F.get("digests", F.when(~top, at))), F.when(top, F.lit(0).cast("long")).otherwise(F.get("upto", F.when(~top, at))),
            F.arrays_zip(part("digests").alias("digest"), part("upto").alias("upto")),
        )

    def ended(self) -> DataFrame:
        """extent, n_ends, least and ends_sha256 of the nodes where conversations end."""
        ends = reduce(DataFrame.unionByName, self.ends)
        pieces = ends.repartitionByRange("extent", "conv_id").sortWithinPartitions("extent", "conv_id").mapInPandas(_pieces, "extent binary, least long, n long, ids string")
        return pieces.repartition("extent").sortWithinPartitions("extent", "least").mapInPandas(_digested, "extent binary, n_ends long, least long, ends_sha256 string")

    def expanded(self) -> DataFrame:
        """One row for each prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
        ended = cut(self.ended())
        children = self.nodes.groupBy(F.col("parent").alias("extent")).agg(F.count("*").alias("n_children"))
        total = F.element_at("edge.upto", -1)
        nodes = self.nodes.join(ended, "extent", "left").join(children, "extent", "left").withColumn("n_ends", F.coalesce("n_ends", F.lit(0)))
        own = nodes.select(
            "rep", "depth", "n_ends", "least", (F.col("n_ends") * total).alias("spoken"), (total - F.col("above")).alias("distinct"), F.col("n_children").isNull().cast("long").alias("leaf"))
        every = reduce(DataFrame.unionByName, self.paths).withColumnRenamed("key", "rep")
        sent = own.join(every, "rep").select(F.explode(F.concat(F.array(F.lit(ROOT)), F.slice("digests", F.lit(1), F.col("depth")))).alias("extent"), "n_ends", "least", "spoken", "distinct", "leaf")
        zero = F.lit(0).cast("long")
        at_root = ended.where(F.col("extent") == F.lit(ROOT)).select("extent", "n_ends", "least", zero.alias("spoken"), zero.alias("distinct"), zero.alias("leaf"))
        sums = [F.sum("n_ends").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("spoken").alias("spoken"), F.sum("distinct").alias("distinct"), F.sum("leaf").alias("n_leaves")]
        figures = sent.unionByName(at_root).groupBy("extent").agg(*sums)
        shape = self.nodes.select("extent", "parent", "top", "above", "edge")
        root = figures.where(F.col("extent") == F.lit(ROOT)).select("extent", F.lit(None).cast("binary").alias("parent"), F.lit(-1).alias("top"), zero.alias("above"), F.array(F.struct(F.lit(ROOT).alias("digest"), zero.alias("upto"))).alias("edge"))
        known = cut(shape.unionByName(root).join(figures, "extent").join(children, "extent", "left").join(ended.select("extent", "ends_sha256"), "extent", "left"))
        parents = known.select(F.col("extent").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        rows = known.join(parents, "parent", "left").select("*", F.posexplode("edge").alias("i", "at"))
        before = F.when(F.col("i") == 0, F.col("above")).otherwise(F.get("edge", F.when(F.col("i") > 0, F.col("i") - 1))["upto"])
        last = F.col("i") == F.size("edge") - 1
        return rows.select(
            "conv_id", (F.col("top") + F.col("i") + 1).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.coalesce("n_children", zero)).otherwise(F.lit(1)).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("spoken") - F.col("n_convs") * before - F.col("distinct") + before - F.col("above")).alias("saved_tokens"),
            F.when(last, F.col("ends_sha256")).otherwise(F.lit(None)).alias("ends_sha256"),
        ).fillna({"ends_sha256": hashlib.sha256(b"").hexdigest()})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one extent, joined."""
    for batch in batches:
        extent = batch["extent"].to_numpy(object)
        new = np.flatnonzero(np.concatenate([[True], extent[1:] != extent[:-1]])) if len(extent) else []
        rows = []
        for a, b in zip(new, [*new[1:], len(extent)], strict=True):
            for at in range(a, b, PIECE):
                ids = batch["conv_id"].to_numpy()[at : min(b, at + PIECE)]
                rows.append((extent[a], ids[0], len(ids), ",".join(map(str, ids.tolist()))))
        yield pd.DataFrame(rows, columns=["extent", "least", "n", "ids"])


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each extent's list, over its pieces in order."""
    extent, least, n, state = None, None, 0, None
    for batch in batches:
        rows = []
        for x, first, count, ids in batch.itertuples(index=False, name=None):
            if x != extent:
                if state:
                    rows.append((extent, n, least, state.hexdigest()))
                extent, least, n, state = x, first, 0, hashlib.sha256()
            state.update(("," if n else "").encode() + ids.encode())
            n += count
        yield pd.DataFrame(rows, columns=["extent", "n_ends", "least", "ends_sha256"])
    if state:
        yield pd.DataFrame([(extent, n, least, state.hexdigest())], columns=["extent", "n_ends", "least", "ends_sha256"])


def rebuilt(sequences: DataFrame) -> DataFrame:
    """The query's conversations: the first turns of conversation c - c % 20, then what c itself has after as many."""
    base = sequences.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("digests", 1, BORROWED).alias("d"), F.slice("words", 1, BORROWED).alias("w"))
    rows = sequences.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (BORROWED + 1)).cast("int")}).join(base, "base", "left")

    def joined(borrowed: str, own: str, kind: str) -> Column:
        none = F.array().cast(kind)
        return F.concat(F.coalesce(F.slice(borrowed, F.lit(1), F.col("h")), none), F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))

    return rows.select("conv_id", joined("d", "digests", "array<binary>").alias("digests"), joined("w", "words", "array<bigint>").alias("words"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations; those that others begin like are inserted first, the rest in a second batch."""
    every = cut(paths(rebuilt(cut(turns(table(spark, sf_dir, "conversations"))))))
    trie = PrefixTrie(spark)
    trie.insert(every.where("conv_id % 20 = 0"))
    trie.insert(every.where("conv_id % 20 <> 0"))
    return trie.expanded()


OP12_SQL = r"""
WITH RECURSIVE c0 AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS crc),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), c0),
s AS (SELECT c.conv_id, t.i AS o, 0 AS k, t.r, t.x FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h UNION ALL SELECT c.conv_id, t.i, 1, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, o) AS d, sha256(CAST(length(r) AS VARCHAR) || ':' || r || x) AS turn, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM s),
p AS (SELECT conv_id, d, words, sha256(string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS path FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(d) AS n FROM p GROUP BY 1),
v AS (SELECT path, any_value(d) AS d, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY 1),
u AS (SELECT v.*, w.conv_id AS parent_conv_id, w.path AS parent FROM v LEFT JOIN p ON p.conv_id = v.conv_id AND p.d = v.d - 1 LEFT JOIN v w ON w.path = p.path),
k AS (SELECT parent AS path, count(*) AS n FROM u WHERE parent IS NOT NULL GROUP BY 1),
g AS (SELECT p.path, sum((u.n - 1) * u.words) AS saved, count_if(u.path NOT IN (SELECT path FROM k)) AS leaves FROM u JOIN p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY 1),
e AS (SELECT p.path, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN l ON l.conv_id = p.conv_id AND l.n = p.d GROUP BY 1)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, u.parent_conv_id, u.n AS n_convs, coalesce(k.n, 0) AS n_children, CAST(g.leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u LEFT JOIN k USING (path) LEFT JOIN g USING (path) LEFT JOIN e USING (path)
"""
