"""AVI motion-JPEG columns: payloads as 8-bit samples in intra frames, read back through the RIFF index, and timed shots.

Frames are JPEG's lossless process (SOF3, prediction from the left) with a restart marker after each line; lines are thus
coded and decoded side by side in numpy. A file holds its payload's length in an INFO chunk, since frames are filled up.
Shots begin where the distance of two frames' histograms exceeds what the frames before it lead to expect.

Cases: null and empty texts give one payload of 192 blanks; any length is stored whole; equal texts give equal files; files
that aren't of this kind raise ValueError; repeated rows and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.common import fields, table

UNIT = 192
WIDTH, HEIGHT, RATE = 64, 24, 25
#: Code length of each difference category 0 to 8 (a complete prefix code but for all ones, which JPEG forbids).
_LENGTHS = {5: 2, 6: 2, 3: 3, 4: 3, 7: 3, 0: 4, 2: 5, 1: 6, 8: 7}
#: Frames before a cut that set what distance is usual; what a cut must have at least, in 1/1000 of the greatest distance.
_MEMORY, _LEAST = 8, 150
_BLOCK_BYTES = 1 << 20


def _canonical(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """category -> (code, length)"""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


_COUNTS = [sum(v == n for v in _LENGTHS.values()) for n in range(1, 17)]
_SYMBOLS = bytes(sorted(_LENGTHS, key=lambda s: (_LENGTHS[s], s)))
_CODES = _canonical(_COUNTS, _SYMBOLS)
_HEADER = b"".join((
    b"\xff\xd8", b"\xff\xc3", struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0),
    b"\xff\xc4", struct.pack(">HB", 19 + len(_SYMBOLS), 0), bytes(_COUNTS), _SYMBOLS,
    b"\xff\xdd", struct.pack(">HH", 4, WIDTH), b"\xff\xda", struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0),
))


def jpegs(samples: np.ndarray) -> list[bytes]:
    """One intra frame for each (HEIGHT, WIDTH) picture of samples (n, HEIGHT, WIDTH)."""
    lines = samples.reshape(-1, WIDTH).astype(np.int32)
    diff = lines - np.concatenate([np.full((len(lines), 1), 128, np.int32), lines[:, :-1]], 1)
    size = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.int64)
    codes, lengths = (np.array([_CODES[s][i] for s in range(9)], np.int64) for i in (0, 1))
    bits = lengths[size] + size
    value = (codes[size] << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    ends = np.cumsum(bits, 1)
    line_bytes = (ends[:, -1] + 7) // 8
    line_start = np.cumsum(line_bytes) - line_bytes
    at = (line_start * 8)[:, None] + ends - bits
    word = (value << (32 - bits - (at & 7))).ravel()
    place, total = (at >> 3).ravel(), int(line_bytes.sum())
    coded = sum(np.bincount(place + j, ((word >> (24 - 8 * j)) & 255).astype(np.float64), total + 4) for j in range(3))[:total].astype(np.uint8)
    coded[line_start + line_bytes - 1] |= ((1 << ((-ends[:, -1]) & 7)) - 1).astype(np.uint8)
    # stuffing after FF, and a marker after each line but a frame's last
    grow = 1 + (coded == 255).astype(np.int64)
    inner = np.arange(len(lines)) % HEIGHT != HEIGHT - 1
    last = line_start + line_bytes - 1
    grow[last[inner]] += 2
    to = np.cumsum(grow) - grow
    out = np.zeros(int(grow.sum()), np.uint8)
    out[to] = coded
    after = (to + 1 + (coded == 255))[last[inner]]
    out[after], out[after + 1] = 255, 0xD0 + (np.arange(len(lines)) % HEIGHT % 8)[inner]
    firsts = to[line_start[::HEIGHT]]
    data = out.tobytes()
    return [_HEADER + data[a:b] + b"\xff\xd9" for a, b in zip(firsts, [*firsts[1:], len(data)], strict=True)]


def _headers(frame: bytes) -> tuple[int, dict]:
    """Where the coded data begin, and what the header says; ValueError for what isn't such a frame."""
    try:
        at, head = _header_parts(frame)
        if "codes" not in head:
            raise ValueError("a frame lacks its codes")
        return at, head
    except (IndexError, struct.error) as short:
        raise ValueError(f"a frame's header is cut off: {short}") from short


def _header_parts(frame: bytes) -> tuple[int, dict]:
    at, head = 2, {}
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        mark, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body, at = frame[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xC3:
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if (depth, parts) != (8, 1):
                raise ValueError("one component of 8 bits is read")
            head |= {"height": height, "width": width}
        elif mark == 0xC4:
            head["codes"] = _canonical([*body[1:17]], body[17:])
        elif mark == 0xDD:
            head["interval"] = int.from_bytes(body, "big")
        elif mark == 0xDA:
            if "width" not in head or body[-3] != 1 or head.get("interval") != head["width"]:
                raise ValueError("lossless frames with prediction from the left and a restart on each line are read")
            return at, head
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("not a lossless frame")


def pictures(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame; frames with the same header are decoded together, all their lines at once."""
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[bytes, list[int]] = {}
    starts: dict[bytes, tuple[int, dict]] = {}
    for i, frame in enumerate(frames):
        if frame.startswith(_HEADER):
            key = _HEADER
        else:
            key = frame[: _headers(frame)[0]]
        starts.setdefault(key, (len(key), _headers(frame)[1]) if key not in starts else starts[key])
        groups.setdefault(key, []).append(i)
    for key, own in groups.items():
        begin, head = starts[key]
        width, height = head["width"], head["height"]
        raw = np.frombuffer(b"".join(frames[i][begin:-2] + b"\xff\xd0" for i in own), np.uint8)
        ff = np.flatnonzero(raw == 255)
        ff = ff[ff + 1 < len(raw)]
        follow = raw[ff + 1]
        marks = ff[follow >= 0xD0]
        keep = np.ones(len(raw), bool)
        keep[ff[follow == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        line_end = np.cumsum(keep)[marks]
        if len(line_end) != len(own) * height:
            raise ValueError("lines are missing")
        data = np.concatenate([raw[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
        words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        table_length, table_size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for size, (code, n) in head["codes"].items():
            table_length[code << (16 - n) : (code + 1) << (16 - n)] = n
            table_size[code << (16 - n) : (code + 1) << (16 - n)] = size
        at = np.concatenate([[0], line_end[:-1]]) * 8
        lines, before = np.empty((width, len(at)), np.uint8), np.full(len(at), 128, np.int64)
        last = len(words) - 1
        for column in range(width):
            if at.max(initial=0) >> 3 > last:
                raise ValueError("a line goes beyond its data")
            look = ((words[at >> 3].astype(np.int64) << (at & 7)) >> 8) & 0xFFFFFF  # 24 bits from here
            n, size = table_length[look >> 8], table_size[look >> 8]
            extra = (look >> (24 - n - size)) & ((1 << size) - 1)
            before = (before + np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)) & 0xFF
            lines[column] = before
            at = at + n + size
        if not n.all():
            raise ValueError("a code is not in the table")
        for i, picture in zip(own, lines.T.reshape(len(own), height, width), strict=True):
            out[i] = picture
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], payload_bytes: int) -> bytes:
    most, n = max(map(len, frames)), len(frames)
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    heads = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ISBJ", f"payload={payload_bytes}\0".encode()))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + heads + info + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def parse(media: bytes) -> tuple[list[bytes], int, float]:
    """The frames that the index lists, the payload's length, frames a second; ValueError for what is no whole AVI file."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    if len(media) < 8 + int.from_bytes(media[4:8], "little"):
        raise ValueError("the AVI file is cut off")
    try:
        return _parsed(media)
    except (KeyError, struct.error, ZeroDivisionError) as missing:
        raise ValueError(f"the AVI file lacks a part: {missing}") from missing


def _parsed(media: bytes) -> tuple[list[bytes], int, float]:
    found: dict[bytes, tuple[int, int]] = {}

    left = [(12, len(media))]  # places and ends of lists, the first on top
    while left:
        at, end = left.pop()
        while at + 8 <= end:
            name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if at + 8 + n > end:
                raise ValueError("a chunk goes beyond its list")
            if name == b"LIST":
                found.setdefault(b"LIST" + media[at + 8 : at + 12], (at + 8, n))
                if media[at + 8 : at + 12] != b"movi":
                    left.append((at + 8 + n + (n & 1), end))
                    at, end = at + 12, at + 8 + n
                    continue
            else:
                found.setdefault(name, (at + 8, n))  # of several streams the first
            at += 8 + n + (n & 1)
    movie, (at, n) = found[b"LISTmovi"][0], found[b"idx1"]
    frames = [media[movie + o + 8 : movie + o + 8 + size] for name, _, o, size in struct.iter_unpack("<4sIII", media[at : at + n]) if name == b"00dc"]
    if any(movie + o + 8 + size > len(media) for name, _, o, size in struct.iter_unpack("<4sIII", media[at : at + n]) if name == b"00dc"):
        raise ValueError("the index goes beyond the file")
    at, n = found[b"ISBJ"]
    scale, rate = struct.unpack("<II", media[found[b"strh"][0] + 20 : found[b"strh"][0] + 28])
    return frames, int(media[at : at + n].rstrip(b"\0").partition(b"=")[2]), rate / scale


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (UNIT if not raw else -len(raw) % UNIT)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot, by histogram distances against their recent mean and spread."""
    bins = (frames >> 4).reshape(len(frames), -1).astype(np.int64) + 16 * np.arange(len(frames))[:, None]
    hist = np.bincount(bins.ravel(), minlength=16 * len(frames)).reshape(-1, 16)
    far = np.abs(np.diff(hist, axis=0)).sum(1) * 500 // frames[0].size  # 0 to 1000
    cuts, recent = [], []
    for i, d in enumerate(far.tolist()):
        usual = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - usual) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d >= max(_LEAST, usual + 3 * spread):
            cuts.append(i + 1)
            recent = []
        else:
            recent = [*recent, d][-_MEMORY:]
    return [*zip([0, *cuts], [*(c - 1 for c in cuts), len(frames) - 1], strict=True)]


def _parts(items: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for x in items:
        if part and size + len(x) > _BLOCK_BYTES:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload."""
    out, full = [], WIDTH * HEIGHT
    for part in _parts(payloads):
        counts = [-(-len(p) // full) for p in part]
        samples = np.frombuffer(b"".join(p.ljust(n * full) for p, n in zip(part, counts, strict=True)), np.uint8)
        frames, at = jpegs(samples.reshape(-1, HEIGHT, WIDTH)), 0
        for p, n in zip(part, counts, strict=True):
            out.append(avi(frames[at : at + n], len(p)))
            at += n
    return out


def load(files: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, float]]:
    """Payload, frames and frame rate of each file."""
    for part in _parts(files):
        parsed = [parse(f) for f in part]
        frames, at = pictures([x for own, _, _ in parsed for x in own]), 0
        for own, n, rate in parsed:
            pictures_ = np.stack(frames[at : at + len(own)])
            yield pictures_.tobytes()[:n], pictures_, rate
            at += len(own)


@F.pandas_udf(T.BinaryType())
def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text as an AVI file."""
    for texts in batches:
        yield pd.Series(store([*map(payload, texts)]), dtype=object)


@F.pandas_udf(fields("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"))
def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Digest of a file's payload as read back from its frames, and its shots."""
    for files in batches:
        rows = []
        for media, (data, frames, _) in zip(files, load([*files]), strict=True):
            cut = ",".join(f"{a}-{b}" for a, b in shots(frames))
            mean = int(np.frombuffer(data, np.uint8).sum(dtype=np.int64)) * 1000 // len(data)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(frames)};mean={mean};shots={cut}"))
        yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def clips(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each shot of each file: key, clip, first and last frame, start and end in seconds."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, (_, frames, rate) in zip(batch[key], load([*batch[column]]), strict=True):
                out += [(k, i, a, b, a / rate, (b + 1) / rate) for i, (a, b) in enumerate(shots(frames))]
            yield pd.DataFrame(out, columns=[key, "clip", "first_frame", "last_frame", "start_s", "end_s"])

    kind = T.StructType([media.schema[key], *fields("clip int, first_frame int, last_frame int, start_s double, end_s double")])
    return media.select(key, column).where(F.col(column).isNotNull()).mapInPandas(rows, kind)


def with_media(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    return docs.withColumn(into, stored(text))


def op9_avi_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n: Column = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select("doc_id", n.alias("n_bytes"), described(stored("text")).alias("r")).select("doc_id", "n_bytes", "r.*")
