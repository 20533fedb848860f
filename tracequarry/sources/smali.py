"""Smali texts in one pass a class: methods, parameters, instructions, labels, handlers, payload entries and issues.

A class text is read line by line in the task that has its row; nothing is shuffled. All of it comes out as one table of parts,
to be written once; methods(), parameters() and so on take theirs from it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directives of the text format, and the codes of issues.
_CLASS = re.compile(r"^\.class\s+(?:.*\s)?(L[^;\s]+;)$")
_PARAM = re.compile(r'^\.param\s+(p\d+)(?:\s*,\s*"((?:[^"\\]|\\.)*)")?')
_LEGACY = re.compile(r'^\.parameter\s+"((?:[^"\\]|\\.)*)"')
_CATCH = re.compile(r"^\.(?:catch|catchall)(?:\s+(L[^;]+;))?\s+\{(:[^\s.]+)\s+\.\.\s+(:[^\s}]+)\}\s+(:\S+)$")
_PAYLOAD = re.compile(r"^\.(packed-switch|sparse-switch|array-data)(?:\s+(\S+))?$")
_BLOCKS = ("annotation", "subannotation", "packed-switch", "sparse-switch", "array-data")
_TYPE = re.compile(r"\[*(?:[ZBSCIJFD]|L[^;]+;)")
_DESCRIPTOR = re.compile(r"^\(((?:\[*(?:[ZBSCIJFD]|L[^;]+;))*)\)(?:V|\[*(?:[ZBSCIJFD]|L[^;]+;))$")
NO_CLASS, OPEN_METHOD, BAD_HEADER, BAD_DESCRIPTOR = "SMALI_CLASS_DECLARATION_MISSING", "SMALI_METHOD_BLOCK_UNTERMINATED", "SMALI_METHOD_HEADER_INVALID", "SMALI_METHOD_DESCRIPTOR_INVALID"
BAD_LOCALS, BAD_REGISTERS, OPEN_BLOCK = "SMALI_LOCALS_DIRECTIVE_INVALID", "SMALI_REGISTERS_DIRECTIVE_INVALID", "SMALI_DIRECTIVE_BLOCK_UNTERMINATED"
OPEN_PAYLOAD, BAD_KEY, BAD_ENTRY = "SMALI_PAYLOAD_UNTERMINATED", "SMALI_PAYLOAD_KEY_INVALID", "SMALI_PAYLOAD_ENTRY_INVALID"

#: Rows that go out of a task at once, at least, where there are so many.
ROWS = 1 << 14
_COMMENT = re.compile(r'\s+#[^"]*$')
_COLUMNS = ["class_name", "part", "method_no", "n", "a", "b", "c", "d", "i", "j"]
_KINDS = "class_name string, part string, method_no int, n int, a string, b string, c string, d string, i int, j long"


def literal(text: str) -> int | None:
    """A whole number as smali spells it: sign, base prefix, a suffix for its width."""
    try:
        return int(text[:-1] if text[-1:] in "tTsSlL" and text[:-1] else text, 0)
    except ValueError:
        return None


class _Class:
    """The rows of one class text."""

    def __init__(self, text: str | None):
        self.lines = [_COMMENT.sub("", x.strip()) for x in (text or "").split("\n")]
        self.rows: list[tuple] = []
        self.name = next((m[1] for m in map(_CLASS.match, self.lines) if m), None)
        self.method = -1

    def say(self, part: str, n: int | None = None, a=None, b=None, c=None, d=None, i=None, j=None) -> None:
        self.rows.append((self.name, part, self.method if self.method >= 0 else None, n, a, b, c, d, i, j))

    def issue(self, code: str, line: int, detail: str | None = None) -> None:
        self.say("issue", None, code, detail, i=line + 1)

    def read(self) -> list[tuple]:
        if self.name is None:
            self.issue(NO_CLASS, 0)
            return self.rows
        start = None
        for k, line in enumerate(self.lines):
            if line == ".method" or line.startswith(".method "):
                if start is not None:
                    self.issue(OPEN_METHOD, start)
                start, self.method = k, self.method + 1
            elif line == ".end method" and start is not None:
                self.body(start, k)
                start = None
        if start is not None:
            self.issue(OPEN_METHOD, start)
        return self.rows

    def body(self, start: int, end: int) -> None:
        parts = self.lines[start].split()[1:]
        at = parts[-1].find("(") if parts else -1
        if at <= 0:
            return self.issue(BAD_HEADER, start)
        name, descriptor, flags = parts[-1][:at], parts[-1][at:], parts[:-1]
        fits = _DESCRIPTOR.match(descriptor)
        if not fits:
            self.issue(BAD_DESCRIPTOR, start, descriptor)
        types = _TYPE.findall(fits[1]) if fits else []
        ends: dict[str, list[int]] = defaultdict(list)
        for k in range(start + 1, end):
            if self.lines[k].startswith(".end "):
                ends[self.lines[k][5:]].append(k)
        self.named, self.legacy, self.sizes, self.count, self.place = {}, [], {}, 0, defaultdict(int)
        k = start + 1
        while k < end:
            k = self.line(k, end, ends) + 1
        place = 0 if any(f.lower() == "static" for f in flags) else 1
        for n, kind in enumerate(types):
            register = f"p{place}"
            self.say("parameter", n, register, kind, self.named.get(register, self.legacy[n] if n < len(self.legacy) else None))
            place += 2 if kind in ("J", "D") else 1
        local, every = self.sizes.get("locals"), self.sizes.get("registers")
        if local is not None:
            every = local + place
        elif every is not None and every >= place:
            local = every - place
        self.say("method", self.count, f"{self.name}->{name}{descriptor}", ",".join(flags), name, descriptor, local, every)

    def line(self, k: int, end: int, ends: dict[str, list[int]]) -> int:
        """Reads what begins at line k; the last line of it."""
        line = self.lines[k]
        if not line or line.startswith("#"):
            return k
        if line.startswith(":"):
            after = next((x for x in range(k + 1, end) if self.lines[x] and not self.lines[x].startswith("#")), None)
            if after is not None and (m := _PAYLOAD.match(self.lines[after])):
                self.say("label", self.next("label"), line)
                return self.payload(line, m, after, end, ends)
            self.say("label", self.next("label"), line, i=self.count)
        elif m := _PARAM.match(line):
            if m[2] is not None:
                self.named[m[1]] = m[2]
        elif m := _LEGACY.match(line):
            self.legacy.append(m[1])
        elif m := _CATCH.match(line):
            self.say("handler", self.next("handler"), *m.groups())
        elif line.startswith((".locals", ".registers")) and line.split()[0] in (".locals", ".registers"):
            word, *value = line[1:].split()
            if len(value) == 1 and value[0].isdecimal() and value[0].isascii():
                self.sizes[word] = int(value[0])
            else:
                self.issue(BAD_LOCALS if word == "locals" else BAD_REGISTERS, k)
        elif line.startswith("."):
            word = line[1:].split()[0] if line[1:].split() else ""
            if word and word != "end":
                last = self.closing(word, k, ends)
                if last is None and word in _BLOCKS:
                    self.issue(OPEN_BLOCK, k, word)
                    last = end - 1
                return k if last is None else last
        else:
            opcode, *operands = line.split(None, 1)
            self.say("instruction", self.count, opcode, operands[0] if operands else "", line)
            self.count += 1
        return k

    def next(self, part: str) -> int:
        self.place[part] += 1
        return self.place[part] - 1

    @staticmethod
    def closing(word: str, k: int, ends: dict[str, list[int]]) -> int | None:
        found = ends.get(word, [])
        at = bisect_right(found, k)
        return found[at] if at < len(found) else None

    def payload(self, label: str, m: re.Match, k: int, end: int, ends: dict[str, list[int]]) -> int:
        kind, argument = m.groups()
        last = self.closing(kind, k, ends)
        if last is None:
            self.issue(OPEN_PAYLOAD, k, label)
            return end - 1
        entries = [(x, self.lines[x]) for x in range(k + 1, last) if self.lines[x] and not self.lines[x].startswith("#")]
        first = literal(argument or "") if kind == "packed-switch" else None
        if kind == "packed-switch" and first is None:
            self.issue(BAD_KEY, k, label)
        for n, (x, entry) in enumerate(entries):
            if kind == "array-data":
                self.say("payload", n, label, kind, None, entry)
            elif kind == "packed-switch":
                self.say("payload", n, label, kind, entry if entry.startswith(":") else None, j=None if first is None else first + n)
            else:
                key, arrow, target = (p.strip() for p in entry.partition("->"))
                number, target = (literal(key) if arrow else None), target if target.startswith(":") else None
                if number is None or target is None:
                    self.issue(BAD_ENTRY, x, label)
                self.say("payload", n, label, kind, target, j=number)
        return last


def read_classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_name, part, method_no and the part's columns, of class texts one a row; null texts lack a class declaration."""
    wanted = T.StructType([texts.schema[key], *T.StructType.fromDDL(_KINDS).fields])

    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in wanted.fields[1:]]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of many classes go out together, as most classes have few."""
        for part in parts:
            types, rows = [part.schema.field(key).type, *kinds], []
            made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], wanted.names)
            for name, body in zip(part.column(key).to_pylist(), part.column(text).to_pylist(), strict=True):
                rows += [(name, *r) for r in _Class(body).read()]
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    return texts.select(key, text).mapInArrow(batches, wanted)


def _part(parts: DataFrame, part: str, **named: str) -> DataFrame:
    kept = [c for c in parts.columns if c not in _COLUMNS]
    return parts.where(F.col("part") == part).select(*kept, "class_name", "method_no", *[F.col(c).alias(name) for name, c in named.items()])


def methods(parts: DataFrame) -> DataFrame:
    return _part(parts, "method", full_signature="a", flags="b", method_name="c", descriptor="d", local_count="i", register_count="j", n_instructions="n")


def parameters(parts: DataFrame) -> DataFrame:
    return _part(parts, "parameter", place="n", register="a", type="b", name="c")


def instructions(parts: DataFrame) -> DataFrame:
    return _part(parts, "instruction", idx="n", opcode="a", operands="b", raw_text="c")


def labels(parts: DataFrame) -> DataFrame:
    """idx is the instruction that follows; null for the label of a payload."""
    return _part(parts, "label", label="a", idx="i")


def handlers(parts: DataFrame) -> DataFrame:
    return _part(parts, "handler", exception="a", try_start="b", try_end="c", handler="d")


def payload_entries(parts: DataFrame) -> DataFrame:
    return _part(parts, "payload", label="a", kind="b", pos="n", key_value="j", target="c", value="d")


def issues(parts: DataFrame) -> DataFrame:
    """line counts from 1; method_no is null for issues of the class."""
    return _part(parts, "issue", issue="a", detail="b", line="i")
