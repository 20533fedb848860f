"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it stands. Then transducers rewrite the text, each keeping for every character
it emits the source span that it came from: look-alike characters to ASCII, spelled digits to digits, disguised at and dot
to @ and a dot. Identifiers in the rewritten text are mapped back to source characters and added unless a span of the same
kind covers them; a longer one stands beside the plain fragment that it holds.

Cases: null counts as empty and has no spans; any length is scanned whole; touching and repeated finds are kept in order of
start, then kind; repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.common import fields, free_name, table

KINDS = ("email", "ip", "card", "phone")

# Possessive where a greedy run could not match otherwise anyway: time stays linear in long runs.
_LOCAL = regex.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = regex.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, index of the kind


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1  # a local part holds no @
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """Plain identifiers, leftmost and non-overlapping within each kind."""
    out: list[Span] = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# ---- transducers ----

# Look-alike letters of other scripts, and the spelled digits of the four languages.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "∙": ".", "·": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = frozenset("­​‌‍⁠﻿")
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Top-level names that a bare "x at y dot com" must end in.
_ENDINGS = "com|org|net|edu|gov|info|biz|io|co|eu|uk|us|de|fr|es|it|nl|ch|at|be|ca|au|in|mx|ar|example|test"

_NAMED = "|".join(sorted(_SPELLED, key=len, reverse=True))
_GAP = r"(?:[ \t]*[-.,]?[ \t]*|[ \t]+)"
_RUN = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{_NAMED})(?:(?:[ \t,.()-]|plus)*+(?<![\p{{L}}\p{{N}}](?=\p{{L}}))(?:{_NAMED}|[0-9])(?![\p{{L}}]))+", regex.I)
_NUMBERWORD = regex.compile(rf"(?<!\p{{L}})(?:{_NAMED})(?!\p{{L}})", regex.I)
_PLUS = regex.compile(rf"(?<!\p{{L}})plus(?=[ \t]+(?:{_NAMED}|[0-9])(?!\p{{L}}))", regex.I)
# Blanks in front are taken as a whole run or not at all: tried at each blank of a long run they would take quadratic time.
_SOME, _ANY = r"(?<![ \t])[ \t]++", r"(?:(?<![ \t])[ \t]++)?"
_AT = _ANY + r"(?:(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\])[ \t]*|[_*]at[_*][ \t]*)"
_DOT = _ANY + r"(?:(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(punkt\)|\[punkt\]|\(point\)|\[point\]|\(punto\)|\[punto\]|\(\.\)|\[\.\])[ \t]*|[_*]dot[_*][ \t]*)"
_BARE_AT, _BARE_DOT = _SOME + r"(?:at|arroba|arobase)[ \t]+", _SOME + r"(?:dot|punkt|point|punto)[ \t]+"
_NAME = r"[A-Za-z0-9_%+-]++"
# An address around an at sign: its names before, read backwards, and its host after, which a marked at may have with any
# dots, a bare or real one with a known ending only.
_NAMES = regex.compile(rf"(?r)(?:{_NAME}(?:\.|{_DOT}|{_BARE_DOT}))*{_NAME}", regex.I)
_HOST = r"[A-Za-z0-9-]++"
_HOSTS = (
    regex.compile(rf"{_HOST}(?:(?:\.|{_DOT}|{_BARE_DOT}){_HOST})++", regex.I),
    regex.compile(rf"{_HOST}(?:(?:\.|{_DOT}|{_BARE_DOT}){_HOST})*(?:\.|{_DOT}|{_BARE_DOT})(?:{_ENDINGS})(?![A-Za-z0-9-])", regex.I),
)
_SIGNS = (regex.compile(_AT, regex.I), regex.compile(rf"{_BARE_AT}(?=[A-Za-z0-9-]++(?:\.|{_DOT}|{_BARE_DOT}))|(?<![ \t])[ \t]*+@[ \t]*+", regex.I))
_DOTS = regex.compile(rf"{_DOT}|{_BARE_DOT}", regex.I)
_IP_DOTS = regex.compile(rf"(?<=[0-9])(?:{_DOT}|{_BARE_DOT})(?=[0-9])", regex.I)
_PLUS_GAP = regex.compile(r"\+[ \t]+(?=[0-9])")

# Cheap signs, on folded text, that a transducer may have work: each holds wherever one of its patterns does.
_MARKS = ("dot", "punkt", "point", "punto", "(at", "[at", "{at", "<at", "_at_", "*at*", "_at*", "*at_", "arroba", "arobase", " @", "@ ", "\t@", "@\t", "@)", "@]", "(.)", "[.]")
_BARE_ATS = (" at ", " at\t", "\tat ", "\tat\t")
_AT_HOST = regex.compile(r"[ \t]at[ \t]+[a-z0-9-]+\.")
_DIGIT_WORD = re.compile(rf"(?:{_NAMED})(?:[ \t,.()-]+(?:{_NAMED}|[0-9]|plus)|[0-9]|plus)")
_KNOWN: dict[str, bool] = {}  # whether a character needs no rewriting


def _plain(c: str) -> bool:
    if c not in _KNOWN:
        _KNOWN[c] = not _NOT_ASCII.match(c)
    return _KNOWN[c]


def _folded(text: str) -> str:
    """Lower case as the patterns take it, which match the long s, the Kelvin sign and the Turkish i as well."""
    return text.lower() if text.isascii() else text.casefold().replace("\u0307", "").replace("ı", "i")


def _signs(folded: str) -> bool:
    return any(m in folded for m in _MARKS) or (any(m in folded for m in _BARE_ATS) and bool(_AT_HOST.search(folded)))


def _spelled(folded: str) -> bool:
    return bool(_DIGIT_WORD.search(folded)) or ("plus" in folded and bool(_PLUS.search(folded))) or ("+" in folded and bool(_PLUS_GAP.search(folded)))


class Rewritten:
    """A text with the source span of each character."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = [*range(len(text))] if starts is None else starts
        self.ends = [*range(1, len(text) + 1)] if ends is None else ends

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """edits: (start, end, new) in order, without overlap."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:s], new]
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            if new:
                starts += [self.starts[s]] * len(new)
                ends += [self.ends[e - 1]] * len(new)
            at = e
        return Rewritten("".join(text), starts, ends)


def plain_letters(r: Rewritten) -> Rewritten:
    """Look-alikes, full-width and styled characters to ASCII; invisible ones go."""
    if r.text.isascii():
        return r
    edits = []
    for m in _NOT_ASCII.finditer(r.text):
        c = m[0]
        new = "" if c in _INVISIBLE else _LOOKALIKES.get(c)
        if new is None and (k := unicodedata.normalize("NFKC", c)) != c and k.isascii():
            new = k
        if new is None and (d := unicodedata.digit(c, None)) is not None:
            new = str(d)
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return r.replaced(edits)


_NOT_ASCII = regex.compile(r"[^\x00-\x7F\p{Script=Latin}]|[ıɑɡⅼ＀-￯]")


def digits_of_words(r: Rewritten) -> Rewritten:
    """Runs of spelled digits to digits, without what stands between them."""
    if not _spelled(_folded(r.text)):
        return r
    edits = []
    for m in _RUN.finditer(r.text):
        run, at = [], m.start()
        for w in _NUMBERWORD.finditer(r.text, m.start(), m.end()):
            between = r.text[at : w.start()]
            if run and not _digits(between):
                run[-1] = (run[-1][0], w.end(), run[-1][2] + _SPELLED[_folded(w[0])])
            else:
                run.append((w.start(), w.end(), _SPELLED[_folded(w[0])]))
            at = w.end()
        edits += run
    edits += [(m.start(), m.end(), "+") for m in _PLUS.finditer(r.text)]
    r = r.replaced(sorted(edits))
    return r.replaced([(m.start() + 1, m.end(), "") for m in _PLUS_GAP.finditer(r.text)])


def signs_of_words(r: Rewritten) -> Rewritten:
    """Disguised at and dot to @ and a dot, where they form an address."""
    if not _signs(_folded(r.text)):
        return r
    taken: list[tuple[int, int]] = []  # addresses found, in order
    edits: list[tuple[int, int, str]] = []
    for hosts, sign in zip(_HOSTS, _SIGNS, strict=True):
        for at in sign.finditer(r.text):
            host = hosts.match(r.text, at.end())
            names = host and _NAMES.match(r.text, 0, at.start())
            if not names:
                continue
            span = (names.start(), host.end())
            i = bisect(taken, span)
            if (i and taken[i - 1][1] > span[0]) or (i < len(taken) and taken[i][0] < span[1]):
                continue
            taken.insert(i, span)
            edits.append((*at.span(), "@"))
            edits += [(d.start(), d.end(), ".") for part in (names, host) for d in _DOTS.finditer(r.text, part.start(), part.end())]
    r = r.replaced(sorted(edits))
    return r.replaced([(m.start(), m.end(), ".") for m in _IP_DOTS.finditer(r.text)])


def rewritten(text: str) -> Rewritten | None:
    """The text after all transducers; None if none changes it."""
    folded = _folded(text)
    if (text.isascii() or all(map(_plain, set(text)))) and not _signs(folded) and not _spelled(folded):
        return None
    first = Rewritten(text)
    last = signs_of_words(digits_of_words(plain_letters(first)))
    return None if last is first or last.text == text else last


def detect(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: those and what the rewritten text shows that none of the same kind covers."""
    base = find(text)
    r = rewritten(text)
    if r is None:
        return base, base
    of_kind: list[list[Span]] = [[s for s in base if s[2] == k] for k in range(len(KINDS))]
    added: list[Span] = []
    last: dict[int, int] = {}  # where the last span added of a kind ends; spans of a kind come in order
    for s, e, kind in find(r.text):
        span = (r.starts[s], r.ends[e - 1], kind)
        i = bisect(of_kind[kind], (span[0], len(text) + 1, kind))  # of spans that don't overlap, the one that starts last
        if not (i and span[1] <= of_kind[kind][i - 1][1]) and last.get(kind, -1) < span[1]:
            added.append(span)
            last[kind] = span[1]
    return base, sorted(base + added, key=lambda s: (s[0], s[2], s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


@F.pandas_udf(fields("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))
def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Counts of all spans by kind, the digest of the plain ones, all spans as text."""
    for texts in batches:
        rows = []
        for text in texts:
            base, spans = detect(text or "")
            kinds = [k for _, _, k in spans]
            rows.append((*map(kinds.count, range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


@F.pandas_udf(T.StringType())
def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts with each span replaced by its kind in angle brackets; overlapping spans go together, named by the longest of those that start first."""
    for texts in batches:
        out = []
        for text in texts:
            spans = sorted(detect(text)[1], key=lambda s: (s[0], -s[1], s[2])) if text else []
            parts, at = [], 0
            for s, e, k in spans:
                if s >= at:
                    parts += [text[at:s], f"<{KINDS[k].upper()}>"]
                at = max(at, e)
            out.append(text if not spans else "".join([*parts, text[at:]]))
        yield pd.Series(out, dtype=object)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with personal data replaced in its texts, and their lengths brought up to date."""
    new = free_name(docs, "redacted_text")
    out = docs.withColumn(new, redacted(text)).withColumn(text, F.col(new)).drop(new)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", found("text").alias("r")).select("doc_id", "r.*")
