"""Words and shingles of many texts at once, as 64-bit hashes, by array operations on bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p)
    return _powers[name][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word (ASCII white space between words, none across texts).
    offsets: where each text begins in data, and the end of the last."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ink = ~SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~ink[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~ink[1:]
    return np.flatnonzero(ink & (before | border[:-1])), np.flatnonzero(ink & (after | border[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[starts[k]:ends[k]], for spans in order that don't overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", _BACK, len(data))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of ``size`` words of each text, sorted within each text;
    and where each text's begin. A text of fewer words has its whole word sequence as its one
    shingle; a text without words has none. A-Z count as lower case."""
    data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # each text's first word
    n_words = np.diff(first)
    keys = [mix(h + np.uint64(0x9FB21C651E98DF25))]
    for k in range(1, size):  # keys[k - 1]: of k words from each place on
        more = np.zeros_like(h)
        if len(h) > k:
            more[:-k] = h[k:]
        keys.append(mix(keys[-1] * np.uint64(0xD6E8FEB86659FD93) + more + np.uint64(k)))
    own = np.maximum(n_words - size + 1, np.minimum(n_words, 1))
    at = np.repeat(first[:-1] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    doc = np.repeat(np.arange(len(own)), own)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(own) + 1, np.int64)
    rows = np.minimum(np.repeat(n_words, own), size) - 1
    found = np.choose(rows, [k[at] for k in keys]) if rows.min() < size - 1 else keys[-1][at]
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[fresh], np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=len(own)))))


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column without nulls, and where each value begins."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]
