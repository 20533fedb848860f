"""Reachability within methods without listing pairs: components, intervals, asked pairs, and what leads to given places.

A method's control flow is condensed to strongly connected components. One depth-first walk over them numbers each in post-order;
a component's subtree of that walk is an interval of numbers, and so is what it can reach at most. The first shows most pairs that
are reachable, the second most that aren't; only what both leave open is walked. All is linear in a method's instructions and
edges, in time and in rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_METHOD = ["apk", "method"]
_INDEX = ["component", "place", "first", "last", "least"]


def _walked(out_edges: list[list[int]], enter, leave, again) -> None:
    """A depth-first walk without recursion: enter(v, parent), leave(v, parent) and again(v, w) for an edge to a known w."""
    for root in range(len(out_edges)):
        if not enter(root, -1):
            continue
        stack = [(root, -1, iter(out_edges[root]))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if enter(w, v):
                    stack.append((w, v, iter(out_edges[w])))
                    break
                again(v, w)
            else:
                stack.pop()
                leave(v, parent)


def strong_components(out_edges: list[list[int]]) -> list[int]:
    """The component of each node, numbered so that edges between components lead to smaller numbers."""
    n = len(out_edges)
    order, low, component, open_ = [-1] * n, [0] * n, [-1] * n, []
    count = [0, 0]

    def enter(v: int, parent: int) -> bool:
        if order[v] >= 0:
            return False
        order[v] = low[v] = count[0]
        count[0] += 1
        open_.append(v)
        return True

    def again(v: int, w: int) -> None:
        if component[w] < 0:
            low[v] = min(low[v], order[w])

    def leave(v: int, parent: int) -> None:
        if low[v] == order[v]:
            while True:
                w = open_.pop()
                component[w] = count[1]
                if w == v:
                    break
            count[1] += 1
        if parent >= 0:
            low[parent] = min(low[parent], low[v])

    _walked(out_edges, enter, leave, again)
    return component


class Condensed:
    """A method's components and the intervals of their depth-first walk."""

    def __init__(self, nodes: np.ndarray, src: np.ndarray, dst: np.ndarray):
        self.nodes = np.unique(np.concatenate([nodes, src, dst]))
        a, b = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        self.of = np.array(strong_components(_lists(len(self.nodes), a, b)), np.int64)
        n = int(self.of.max(initial=-1)) + 1
        a, b = self.of[a], self.of[b]
        self.cyclic = np.bincount(self.of, minlength=n) > 1
        self.cyclic[a[a == b]] = True
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0).reshape(-1, 2)
        # components are walked from the last number on, as edges lead to smaller ones: sources first
        self.out = _lists(n, n - 1 - pairs[:, 0], n - 1 - pairs[:, 1])
        self.of, self.cyclic = n - 1 - self.of, self.cyclic[::-1]
        self.first, self.last, self.least = [-1] * n, [-1] * n, [0] * n
        self._number()

    def _number(self) -> None:
        count = [0]

        def enter(v: int, parent: int) -> bool:
            if self.first[v] >= 0:
                return False
            self.first[v] = self.least[v] = count[0]
            return True

        def again(v: int, w: int) -> None:
            self.least[v] = min(self.least[v], self.least[w])

        def leave(v: int, parent: int) -> None:
            self.last[v] = count[0]
            count[0] += 1
            if parent >= 0:
                self.least[parent] = min(self.least[parent], self.least[v])

        _walked(self.out, enter, leave, again)

    def reaches(self, asked: list[tuple[int, int]]) -> list[bool]:
        """Whether control gets from the first to the second of each pair by an edge at least."""
        pairs = np.array(asked, np.int64).reshape(-1, 2)
        return self.reached(pairs[:, 0], pairs[:, 1]).tolist()

    def reached(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """reaches() over arrays: intervals decide most pairs at once, the rest is walked."""
        got = np.zeros(len(start), bool)
        if not len(self.nodes):
            return got
        places = [np.minimum(np.searchsorted(self.nodes, x), len(self.nodes) - 1) for x in (start, end)]
        asked = np.flatnonzero((self.nodes[places[0]] == start) & (self.nodes[places[1]] == end))
        a, b = (self.of[p[asked]] for p in places)
        first, last, least = (np.asarray(x, np.int64) for x in (self.first, self.last, self.least))
        inside = np.where(a == b, self.cyclic[a], (first[a] <= last[b]) & (last[b] < last[a]))
        got[asked] = inside
        left = np.flatnonzero(~inside & (a != b) & (least[a] <= least[b]) & (last[b] < last[a]))
        wanted: dict[int, set[int]] = defaultdict(set)
        for u, v in zip(a[left].tolist(), b[left].tolist(), strict=True):
            wanted[u].add(v)
        found = {u: self._found(u, ends) for u, ends in wanted.items()}
        got[asked[left]] = [v in found[u] for u, v in zip(a[left].tolist(), b[left].tolist(), strict=True)]
        return got

    def _found(self, start: int, ends: set[int]) -> set[int]:
        got = {e for e in ends if (self.cyclic[e] if e == start else self.first[start] <= self.last[e] < self.last[start])}
        left = {e for e in ends - got if e != start and self.least[start] <= self.least[e] and self.last[e] < self.last[start]}
        seen, stack = {start}, [start]
        while left and stack:
            for w in self.out[stack.pop()]:
                if w not in seen and any(self.last[e] <= self.last[w] and self.least[w] <= self.least[e] for e in left):
                    seen.add(w)
                    stack.append(w)
                    now = {e for e in left if self.first[w] <= self.last[e] <= self.last[w]}
                    got |= now
                    left -= now
        return got


def _lists(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    order = np.argsort(src, kind="stable")
    cuts, flat = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def leading(back: dict[int, list[int]], targets) -> set[int]:
    """Places from which control gets to a target by an edge at least."""
    found: set[int] = set()
    left = [*targets]
    while left:
        for p in back.get(left.pop(), ()):
            if p not in found:
                found.add(p)
                left.append(p)
    return found


def _differs(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first is of another method than the one before it."""
    return np.any([pc.not_equal(rows.column(k)[1:], rows.column(k)[:-1]).to_numpy(zero_copy_only=False) for k in _METHOD], axis=0)


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a method ends, and which of their methods each row is of; rows come sorted by method."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        joint = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), part]) if held else part
        if not _differs(joint).any():
            held.append(part)
            continue
        rows = pa.concat_batches([*held, part])
        changes = np.concatenate([[False], _differs(rows)])
        last = int(np.flatnonzero(changes)[-1])
        yield pa.table(rows.slice(0, last)), np.cumsum(changes[:last])
        held = [rows.slice(last)]
    if held:
        rows = pa.table(pa.concat_batches(held))
        yield rows, np.zeros(rows.num_rows, np.int64)


def _mapped(rows: DataFrame, cols: list[str], names: str, made) -> DataFrame:
    """apk, method and the columns of names, by made(method numbers, columns of numbers, nulls as -1) of many whole methods at once,
    which gives the method's number of each row and the columns. Rows are dealt out and sorted by method; a method comes whole to a task."""
    wanted = T.StructType([rows.schema["apk"], rows.schema["method"], *T.StructType.fromDDL(names).fields])
    kinds = [{"int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in wanted.fields[2:]]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _whole(parts):
            numbers = {c: table.column(c).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols}
            of, columns = made(at, numbers)
            if len(of):
                first = pa.array(np.flatnonzero(np.diff(at, prepend=-1))[of])
                keys = [table.column(k).combine_chunks().take(first) for k in _METHOD]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], wanted.names)

    known = rows.where("apk IS NOT NULL AND method IS NOT NULL").select(*_METHOD, *cols)
    return known.repartition(*_METHOD).sortWithinPartitions(*_METHOD).mapInArrow(batches, wanted)


class _Places:
    """Places of many methods as one number each; a method's numbers stand together, in order of place."""

    def __init__(self, *places: np.ndarray):
        self.low = min((int(p.min()) for p in places if len(p)), default=0)
        self.span = max((int(p.max()) for p in places if len(p)), default=0) - self.low + 1

    def join(self, method: np.ndarray, place: np.ndarray) -> np.ndarray:
        return method * self.span + (place - self.low)

    def split(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return joined // self.span, joined % self.span + self.low


def components(instr: DataFrame, edges: DataFrame) -> DataFrame:
    """(apk, method, idx, component, place, first, last, least, cyclic): one row an instruction.

    component is its least instruction; place orders components so that edges lead to later ones; last is the component's number
    in post-order, first..last those of its subtree, and what it can reach lies in least..last. cyclic: control can come back.
    The methods of a batch are condensed together, as no edge leads from one to another; methods without instructions have no rows."""
    rows = instr.select(*_METHOD, F.col("idx").alias("src"), F.lit(None).cast("int").alias("dst")).unionByName(edges.select(*_METHOD, "src", "dst"))

    def made(at: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        src, dst = columns["src"], columns["dst"]
        places, led = _Places(src, dst), dst >= 0
        a = places.join(at, src)
        c = Condensed(a, a[led], places.join(at[led], dst[led]))
        of, idx = places.split(c.nodes)
        name = np.full(len(c.out), np.iinfo(np.int64).max)
        np.minimum.at(name, c.of, idx)
        method = np.zeros(len(c.out), np.int64)
        method[c.of] = of

        def own(numbers) -> np.ndarray:
            """Numbers of components, counted from their method's first."""
            numbers, least = np.asarray(numbers, np.int64), np.full(int(at[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, method, numbers)
            return numbers - least[method]

        place, last = own(np.arange(len(c.out))), np.asarray(c.last, np.int64)
        shift = last - own(last)
        return of, [idx, name[c.of], place[c.of], *((np.asarray(x, np.int64) - shift)[c.of] for x in (c.first, last, c.least)), c.cyclic[c.of]]

    return _mapped(rows, ["src", "dst"], "idx int, component int, place int, first int, last int, least int, cyclic boolean", made)


def decided(start: str, node: str) -> Column:
    """Whether a pair's intervals show that it is reachable; null where they leave it open. start and node are structs of components()."""
    a, b = F.col(start), F.col(node)
    same = a["component"] == b["component"]
    outside = (b["last"] > a["last"]) | (b["least"] < a["least"])
    return F.when(same, a["cyclic"]).when((a["first"] <= b["last"]) & (b["last"] < a["last"]), True).when(outside, False)


def reached(index: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (apk, method, start, node) with reached: whether control gets from start to node, by an edge at least.

    index is components() of the same edges. Pairs that the intervals leave open are walked in their methods; an instruction that
    the index doesn't have is reached from nowhere."""
    asked = asked.select(*_METHOD, "start", "node").distinct()
    part = F.struct("component", "first", "last", "least", "cyclic")
    at = lambda name: index.select(*_METHOD, F.col("idx").alias(name), part.alias(f"{name}_at"))
    seen = asked.join(at("start"), [*_METHOD, "start"], "left").join(at("node"), [*_METHOD, "node"], "left")
    answer = F.when(F.col("start_at").isNull() | F.col("node_at").isNull(), False).otherwise(decided("start_at", "node_at"))
    seen = seen.select(*_METHOD, "start", "node", answer.alias("reached"))
    open_ = seen.where("reached IS NULL").select(*_METHOD, "start", "node")
    rows = open_.select(*_METHOD, F.col("start").alias("src"), F.col("node").alias("dst"), F.lit(1).alias("ask"))
    graph = edges.join(open_.select(*_METHOD).distinct(), _METHOD, "left_semi").select(*_METHOD, "src", "dst", F.lit(0).alias("ask"))

    walked = _answered(rows.unionByName(graph))
    return seen.where("reached IS NOT NULL").unionByName(walked)


def _answered(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(apk, method, start, node, reached) of the distinct rows (src, dst, ask) with ask = 1, over the edges that the others are.

    A method's edges come before its pairs, which pass by in batches: a task holds a method's edges and a batch, however many pairs are asked."""
    wanted = T.StructType([rows.schema["apk"], rows.schema["method"], *T.StructType.fromDDL("start int, node int, reached boolean").fields])

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the edges of the last row's method
        known: Condensed | None = None  # and these condensed, while only its pairs come
        for part in batches:
            if not part.num_rows:
                continue
            joint = part if held is None else pa.concat_batches([held, part])
            at = np.cumsum(np.concatenate([[False], _differs(joint)]))
            src, dst, ask = (joint.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "dst", "ask"))
            ask, one = ask == 1, at[-1] == 0
            fresh = held is None or not one or not ask[held.num_rows :].all()
            places = _Places(src, dst)
            a, b = (src, dst) if one else (places.join(at, src), places.join(at, dst))
            if fresh or known is None:
                known = Condensed(a[:0], a[~ask], b[~ask])
            if ask.any():
                keys = [joint.column(k).filter(pa.array(ask)) for k in _METHOD]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(src[ask], pa.int32()), pa.array(dst[ask], pa.int32()), pa.array(known.reached(a[ask], b[ask]))], wanted.names)
            held, known = joint.filter(pa.array(~ask & (at == at[-1]))), known if one else None

    # null places are no places, but a pair with one gets an answer
    rows = rows.where("apk IS NOT NULL AND method IS NOT NULL").select(*_METHOD, F.coalesce("src", F.lit(-1)).alias("src"), F.coalesce("dst", F.lit(-1)).alias("dst"), "ask")
    dealt = rows.repartition(parts, *_METHOD) if parts else rows.repartition(*_METHOD)
    return dealt.distinct().sortWithinPartitions(*_METHOD, "ask").mapInArrow(batches, wanted)


def answers(edges: DataFrame, asked: DataFrame, parts: int | None = None) -> DataFrame:
    """What reached() gives, without an index: methods are condensed where their pairs are answered, in one pass. Pairs with a null lead nowhere."""
    rows = asked.select(*_METHOD, F.col("start").alias("src"), F.col("node").alias("dst"), F.lit(1).alias("ask"))
    return _answered(rows.unionByName(edges.select(*_METHOD, "src", "dst", F.lit(0).alias("ask"))), parts)


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(apk, method, idx) of the instructions from which control gets to one of targets (apk, method, idx) in their method: one
    backward walk a method from all of its targets at once."""
    rows = edges.select(*_METHOD, "src", "dst").unionByName(targets.select(*_METHOD, F.col("idx").alias("src"), F.lit(None).cast("int").alias("dst")))

    def made(at: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        src, dst = columns["src"], columns["dst"]
        places, led = _Places(src, dst), dst >= 0
        a, back = places.join(at, src), defaultdict(list)
        for p, q in zip(a[led].tolist(), places.join(at[led], dst[led]).tolist(), strict=True):
            back[q].append(p)
        of, idx = places.split(np.array(sorted(leading(back, a[~led].tolist())), np.int64))
        return of, [idx]

    return _mapped(rows, ["src", "dst"], "idx int", made)
