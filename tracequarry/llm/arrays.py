"""Numpy over blocks of texts: words, rolling hashes, and the window anchors that equal windows share."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xD6E8FEB86659FD93
_POSITION_BITS = 32


def byte_classes(separators: bytes) -> np.ndarray:
    """Table of 256: True for bytes that belong to words."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


#: Words are runs of anything but space and \x09-\x0D.
SPACED = byte_classes(b" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i under n; one table for each base grows with the longest block."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = -(-n // 65536) * 65536
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table, out=table))
        _tables[base] = (both[0], both[1])
    up, down = _tables[base]
    return up[:n], down[:n]


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums from which the hash of any run of values follows."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def spans(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of values[start:end]."""
    return mix((pre[ends] - pre[starts]) * powers(base, len(pre))[1][starts])


def grams(values: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of each run of k values; empty if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pre = prefix(values, base)
    return mix((pre[k:] - pre[:-k]) * powers(base, n)[1])


def words(texts: list[str], inside: np.ndarray = SPACED, fold: np.ndarray | None = None):
    """bytes, word starts, word ends, and for each text the index of its first word (one more entry at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if fold is not None:
        data = fold[data]
    mask = np.zeros(len(data) + 1, bool)
    mask[1:] = inside[data]
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    starts, ends = edges[0::2], edges[1::2]
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return data, starts, ends, np.searchsorted(starts, at)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(prefix(BYTE_VALUES[data]), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    n = len(x) - m + 1
    padded = np.full(-(-len(x) // m) * m, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[m - 1 : m - 1 + n])


def anchors(values: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """For windows of `window` values inside each text: runs of consecutive windows with the same anchor.

    The anchor of a window is its leftmost k-gram of least hash, so equal windows have equal anchors at the same place.
    Returns text index, first window's start within the text, number of windows, the anchor's hash."""
    lengths = np.diff(offsets) - window + 1
    none = np.zeros(0, np.int64)
    if len(values) < window or lengths.max(initial=0) <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = grams(values, k)
    low = U((1 << _POSITION_BITS) - 1)
    least = _sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), window - k + 1)
    fits = np.maximum(lengths, 0)
    text = np.repeat(np.arange(len(fits)), fits)
    start = np.arange(len(text)) - np.repeat(np.cumsum(fits) - fits, fits)
    at = (least[offsets[text] + start] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    return text[new], start[new], np.diff(np.append(new, len(at))), hashes[at[new]]


def window_hashes(values: np.ndarray, window: int) -> np.ndarray:
    """A second hash, independent of the anchors', of each window."""
    return grams(values, window, _SECOND)


def covered(starts: np.ndarray, counts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Mask of the places covered by windows that start in [start, start + count)."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + window - 1, -1)
    return np.cumsum(change[:-1]) > 0
