"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The merge list bounds how far to the right a merge decision can depend on: a rule (u, v) needs v whole, and v's end can be
taken by an earlier rule whose left part is a suffix of v, which in turn depends on what stands to its right. The longest
such chain is the sufficient lookahead. A token that ends at least that far before the end of what has been read is final,
and what follows a final boundary encodes as if it stood alone. So the transducer reads a text bit by bit, emits tokens as
they become final (a word's end makes all of its tokens final), and holds READ characters, or CHUNK bytes of a word and the
lookahead, however long the text or the word is. What short pieces gave is remembered. Decoding goes the same way: ids come
as they are emitted, their bytes pass an incremental byte-to-text state machine, and the digests take the text bit by bit.
A file without a decoder, as the library reads it, shows its tokens' letters joined by one space.

Cases: null and empty texts have no tokens; special strings in a text become their ids, as in the library; any Unicode and
any length is taken; lone surrogates can't occur in a column of Spark; repeated rows give repeated results; other columns
don't matter. Files with another normaliser, pre-tokenizer or decoder than those below, or without a letter for each byte,
raise ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice, pairwise

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.common import table

END = "</w>"
#: Bytes of a word read at a time beyond the lookahead; characters of a text read at a time.
CHUNK, READ = 4096, 1 << 16
#: Distinct pieces between spaces whose ids a worker remembers, and their most letters.
PIECES, SHORT = 1 << 18, 64

# Code points that the installed `regex` takes for letters or numbers and the library, of Unicode 16, doesn't;
# capital letters that the library lowers and Python's Unicode 15.1 doesn't know, with their small letters.
_NOT_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    r"\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_NOT_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
_NEW_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_SMALL |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}
_NEW_CAPITALS = regex.compile("[" + "".join(map(chr, _NEW_SMALL)) + "]")

_SPACE, _SPACES = regex.compile(r"\s"), regex.compile(r"\s+")
_ODD = regex.compile(r"[\x1c-\x1f]")  # spaces for str.split(), not for the library


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    letter = {b: chr(b) for b in shown}
    return [letter[b] if b in letter else chr(next(hidden)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a place within which it is decided whether a merge crosses it."""
    size = lambda token: len(token.removesuffix(END))
    reach: dict[str, int] = defaultdict(int)  # by left part, over the rules so far
    most = 1
    for left, right in merges:
        bare = right.removesuffix(END)
        # a right part that ends the word can't be taken by anything further right
        taken = 0 if bare != right else max((reach.get(bare[i:], 0) for i in range(len(bare))), default=0)
        own = size(right) + taken
        reach[left] = max(reach[left], own)
        most = max(most, own)
    return most


def _pattern(text: str) -> str:
    """The file's pattern with the library's letter and number classes, for regex's set operations (V1)."""
    inside = text.replace(r"[^\s\p{L}\p{N}]", "@OTHER@").replace(r"[\p{L}]", "@LETTER@").replace(r"[\p{N}]", "@NUMBER@").replace(r"\p{L}", "@LETTER@").replace(r"\p{N}", "@NUMBER@")
    letter, number = rf"[\p{{L}}--[{_NOT_LETTERS}]]", rf"[\p{{N}}--[{_NOT_NUMBERS}]]"
    return "(?V1)" + inside.replace("@OTHER@", rf"[^\s[\p{{L}}--[{_NOT_LETTERS}]][\p{{N}}--[{_NOT_NUMBERS}]]]").replace("@LETTER@", letter).replace("@NUMBER@", number)


@cache
def _joiners() -> frozenset[str]:
    """Characters before which a text can't be cut and normalised in parts: they can join with what stands before."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        made = unicodedata.decomposition(chr(c))
        if unicodedata.combining(chr(c)):
            out.add(chr(c))
        if made and "<" not in made and len(parts := made.split()) == 2:
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


class Bpe:
    """Tables of a tokenizer file of the `tokenizers` library: byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.steps = self._normaliser(spec["normalizer"])
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if [p.get("type") for p in split] != ["Split", "ByteLevel"] or model.get("end_of_word_suffix") != END or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a byte-level BPE with word ends, a split pattern and no decoder")
        self.pattern = _pattern(split[0]["pattern"]["Regex"])
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        self.rules: list[dict[int, int]] = [{} for _ in self.tokens]  # by left part: rank by right part
        for rank, (a, b) in reversed([*enumerate(pairs)]):
            self.rules[vocab[a]][vocab[b]] = rank
        self.made = [vocab[a + b] for a, b in pairs]
        try:
            self.inner, self.last = [vocab[c] for c in byte_letters()], [vocab[c + END] for c in byte_letters()]
        except KeyError as missing:
            raise ValueError(f"{path}: no token for the byte letter {missing}") from None
        self.sizes = [len(t.removesuffix(END)) for t in self.tokens]
        self.lookahead = sufficient_lookahead(pairs)

    @staticmethod
    def _normaliser(spec: dict | None) -> list[str]:
        """The file's steps among nfc and lower; spaces drop out anyway where they only become other spaces."""
        steps = []
        for step in (spec or {}).get("normalizers", [spec] if spec else []):
            if step["type"] == "NFC":
                steps.append("nfc")
            elif step["type"] == "Lowercase":
                steps.append("lower")
            elif step["type"] != "Replace" or step["pattern"] != {"Regex": r"\s+"} or step["content"] != " ":
                raise ValueError(f"unknown normaliser {step}")
        return steps

    def normalised(self, text: str) -> str:
        for step in self.steps:
            if step == "nfc":
                text = unicodedata.normalize("NFC", text)
            else:
                text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # no final sigma
                if not text.isascii() and _NEW_CAPITALS.search(text):
                    text = text.translate(_NEW_SMALL)
        return text

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        rules, made = self.rules, self.made
        if len(ids) <= 64:
            none = len(made)
            ranks = [rules[a].get(b, none) for a, b in pairwise(ids)]
            while ranks and (rank := min(ranks)) < none:
                i = ranks.index(rank)
                new = ids[i] = made[rank]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rules[ids[i - 1]].get(new, none)
                if i < len(ranks):
                    ranks[i] = rules[new].get(ids[i + 1], none)
            return ids
        before, after = [*range(-1, len(ids) - 1)], [*range(1, len(ids)), -1]
        heap = [(rules[a][b], i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if b in rules[a]]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and ids[y] in rules[ids[x]]:
                    heapq.heappush(heap, (rules[ids[x]][ids[y]], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def stream(self, word: Iterable[int]) -> Iterator[int]:
        """Ids of one word's bytes, each emitted once it is final; the last byte carries the end mark."""
        source, held, ended = iter(word), [], False
        while not ended:
            held += islice(source, CHUNK + self.lookahead + 1 - len(held))
            ended = len(held) <= CHUNK + self.lookahead
            ids, done = [self.inner[b] for b in held], 0
            if ended and held:
                ids[-1] = self.last[held[-1]]
            for token in self.merge(ids):
                if not ended and done + self.sizes[token] > len(held) - self.lookahead:
                    break
                done += self.sizes[token]
                yield token
            held = held[done:]


class Transducer:
    """From a text to its ids, as they become final; it remembers short pieces."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.known = bpe, {}
        self.find = regex.compile(bpe.pattern).findall
        self.word = regex.compile(bpe.pattern).match
        self.letters, self.others = regex.compile(_pattern(r"[\p{L}]+")).match, regex.compile(_pattern(r"[^\s\p{L}\p{N}]+")).match
        self.special = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None

    def __call__(self, text: str) -> Iterator[list[int]]:
        """Runs of ids, of a bounded length."""
        at = 0
        for m in self.special.finditer(text) if self.special and any(s in text for s in self.bpe.special) else ():
            yield from self._plain(text, at, m.start())
            yield [self.bpe.special[m[0]]]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, stop: int) -> Iterator[list[int]]:
        """Ids of text[at:stop], which holds no special string, read between spaces."""
        while at < stop:
            if m := _SPACES.match(text, at, stop):
                at = m.end()
                continue
            end = min(stop, at + READ)
            if end < stop:
                end = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                if end <= at:
                    if not (m := _SPACE.search(text, at, min(stop, at + READ))):
                        at = yield from self._unbroken(text, at, stop)
                        continue
                    end = m.start()
            yield self._pieces(self.bpe.normalised(text[at:end]))
            at = end

    def _pieces(self, text: str) -> list[int]:
        if _ODD.search(text):
            return [*chain.from_iterable(self.bpe.stream(w.encode()) for w in self.find(text))]
        pieces = text.split()
        known = self.known
        try:
            return [*chain.from_iterable(map(known.__getitem__, pieces))]
        except KeyError:
            pass
        own: dict[str, tuple[int, ...]] = {}
        for piece in set(pieces).difference(known):
            words, ids = self.find(piece), []
            for w in words:
                if w not in known and w not in own:
                    own[w] = tuple(self.bpe.stream(w.encode()))
                ids += known.get(w) or own[w]
            own[piece] = tuple(ids)
        out = [*chain.from_iterable([known[p] if p in known else own[p] for p in pieces])]
        if len(known) + len(own) > PIECES:
            known.clear()
        known.update((p, i) for p, i in own.items() if len(p) <= SHORT)
        return out

    def _unbroken(self, text: str, at: int, stop: int):
        """Ids of a long run without white space; returns where it ends."""
        tape = _Tape(self.bpe, text, at, stop)
        while tape.fill(READ):
            words, place = [], 0
            while (m := self.word(tape.held, place)) and (tape.ended or m.end() <= len(tape.held) - 3):  # what is near the end may go on
                words.append(m[0])
                place = m.end()
            if words:
                yield [*chain.from_iterable(self.bpe.stream(w.encode()) for w in words)]
                tape.held = tape.held[place:]
            else:
                ids = self.bpe.stream(self._bytes(tape))
                while run := [*islice(ids, CHUNK)]:
                    yield run
        return tape.at

    def _bytes(self, tape: _Tape) -> Iterator[int]:
        """Bytes of a word that goes on beyond what is held."""
        kind = self.letters if self.letters(tape.held) else self.others
        while tape.fill(1) and (m := kind(tape.held)):
            yield from m[0].encode()
            tape.held = tape.held[m.end() :]
            if tape.held:
                return


class _Tape:
    """Normalised characters of text[at:stop] up to white space, in parts, cut where nothing joins."""

    def __init__(self, bpe: Bpe, text: str, at: int, stop: int):
        self.bpe, self.text, self.at, self.stop, self.held, self.ended = bpe, text, at, stop, "", False

    def fill(self, size: int) -> bool:
        """Whether anything is held, after reading on to `size` characters if there are so many."""
        while len(self.held) < size and not self.ended:
            text, at = self.text, self.at
            if at >= self.stop or _SPACE.match(text, at):
                self.ended = True
                break
            end = min(self.stop, at + READ)
            if m := _SPACE.search(text, at, end):
                end = m.start()
            while end < self.stop and not text[end].isascii() and text[end] in _joiners():
                end += 1
            self.held += self.bpe.normalised(text[at:end])
            self.at = end
        return bool(self.held)


class Decoder:
    """From ids to the text that the library's decode() gives, bit by bit: tokens' bytes pass an incremental UTF-8 machine."""

    def __init__(self, bpe: Bpe):
        self.shown = [f" {t}".encode() for t in bpe.tokens]
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def __call__(self, ids: list[int], last: bool = False) -> str:
        text = self.machine.decode(b"".join(map(self.shown.__getitem__, ids)), last)
        if self.first and text:
            self.first, text = False, text[1:]
        return text

    def start(self) -> Decoder:
        """Ready for another text."""
        self.machine.reset()
        self.first = True
        return self


def readable(bpe: Bpe, ids: Iterable[int]) -> Iterator[str]:
    """Pieces of readable text: letters stand for bytes, which pass the UTF-8 machine; a word end gives a space."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    machine, gap, special = codecs.getincrementaldecoder("utf-8")("replace"), False, {*bpe.special.values()}
    for i in ids:
        token = bpe.tokens[i]
        if i in special:
            yield (" " if gap else "") + token
            gap = True
            continue
        bare = token.removesuffix(END)
        piece = machine.decode(bytes(byte_of[c] for c in bare))
        yield (" " if gap and bare else "") + piece
        gap = bare != token
    yield machine.decode(b"", True)


_shipped: dict[tuple[str, str], object] = {}


def shipped(spark: SparkSession, path: str):
    """The tables of a vocabulary file, broadcast once for each application: workers keep what is broadcast to them."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _shipped:
        _shipped[key] = spark.sparkContext.broadcast(Bpe(path))
    return _shipped[key]


_running: dict[int, Transducer] = {}


def running(bpe: Bpe) -> Transducer:
    """The worker's transducer of these tables: what it remembers serves later tasks too."""
    if id(bpe) not in _running:
        _running.clear()
        _running[id(bpe)] = Transducer(bpe)
    return _running[id(bpe)]


def encode(spark: SparkSession, docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with a column `ids` (array of int). The tables of the vocabulary, of a size that data don't change, are broadcast."""
    tables = shipped(spark, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = running(tables.value)
        for texts in batches:
            yield pd.Series([[*chain.from_iterable(run(t or ""))] for t in texts], dtype=object)

    return docs.withColumn("ids", ids(text))


def decode(spark: SparkSession, rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with a column `decoded`: the library's text of each array of ids; null for null."""
    tables = shipped(spark, path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Decoder(tables.value)
        for arrays in batches:
            yield pd.Series([None if own is None else machine.start()(own, True) for own in arrays], dtype=object)

    return rows.withColumn("decoded", decoded(ids))


def digest_of(text: str, run: Transducer, machine: Decoder, shown: list[str]) -> tuple[int, str, str]:
    """Number of ids, and the SHA-256 of their decimals and of the text decoded from them, neither of which is held whole."""
    n, numbers, back = 0, hashlib.sha256(), hashlib.sha256()
    machine.start()
    for ids in run(text):
        if ids:
            numbers.update(((" " if n else "") + " ".join(map(shown.__getitem__, ids))).encode())
            back.update(machine(ids).encode())
            n += len(ids)
    back.update(machine([], True).encode())
    return n, numbers.hexdigest(), back.hexdigest()


def digests(spark: SparkSession, docs: DataFrame, path: str, text: str = "text") -> F.Column:
    """Struct column n_tokens, ids_sha256, decoded_sha256 of a text: encoded, then decoded from its ids."""
    tables = shipped(spark, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tables.value
        run, machine, shown = running(bpe), Decoder(bpe), [*map(str, range(len(bpe.tokens)))]
        for texts in batches:
            yield pd.DataFrame([digest_of(text or "", run, machine, shown) for text in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(F.col(text))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(spark, docs, vocabulary()).alias("r")).select("doc_id", "r.*")
