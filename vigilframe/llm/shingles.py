"""Word shingles of whole texts as 64-bit hashes, and signatures over them, in numpy batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about this many bytes, cut between words, so the working arrays stay small.
PIECE = 1 << 19
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + PIECE // 4)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def _hash_piece(raw: np.ndarray, gap: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word. gap: the byte is white space; first: a text starts at this byte."""
    word = ~gap
    start = word.copy()
    start[1:] &= gap[:-1] | first[1:]
    starts = np.flatnonzero(start)
    end = word.copy()
    end[:-1] &= gap[1:] | first[1:]
    ends = np.flatnonzero(end) + 1
    lower = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words). A-Z count as lower case; null as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    bounds = offsets - low
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    first = first[: len(raw)]
    cuts, at = [0], PIECE
    while at < len(raw):  # cut after white space only
        ahead = np.flatnonzero(gap[at - 1 : at - 1 + PIECE])
        if len(ahead):
            cuts.append(min(at + int(ahead[0]), len(raw)))
            at = cuts[-1]
        at += PIECE
    cuts.append(len(raw))
    starts, hashes = [], []
    for a, b in zip(cuts, cuts[1:]):
        s, h = _hash_piece(raw[a:b], gap[a:b], first[a:b])
        starts.append(s + a)
        hashes.append(h)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, bounds)


_ORDER = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct word shingles of each text, sorted within the text; offsets of the texts).

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    hashes, offsets = word_hashes(texts)
    n = len(hashes) - words + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for i in range(words):
            total += mix(hashes[i : i + n] + _ORDER[i]) * _ORDER[-1 - i]
        total = mix(total)
    sets, counts = [], np.zeros(len(texts) + 1, np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a >= words:
            s = np.unique(total[a : b - words + 1])
        elif b > a:
            few = np.zeros(1, np.uint64)
            for i, h in enumerate(hashes[a:b]):
                few += mix(np.array([h], np.uint64) + _ORDER[i]) * _ORDER[-1 - i]
            s = mix(few + np.uint64(b - a))
        else:
            continue
        sets.append(s)
        counts[k + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(counts)


def signatures(sets: np.ndarray, offsets: np.ndarray, values: int, bits: int, seed: int) -> np.ndarray:
    """The lowest ``bits`` of ``values`` minimum hashes of each set, as uint16 (texts x values); 0 for empty sets."""
    out = np.zeros((len(offsets) - 1, values), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    starts = offsets[full]
    draw = np.random.Generator(np.random.Philox(seed)).integers(0, 1 << 63, (values, 2), dtype=np.uint64)
    keep = np.uint64((1 << bits) - 1)
    for k in range(values):
        h = (sets * (draw[k, 0] * np.uint64(2) + np.uint64(1)) + draw[k, 1]) >> np.uint64(20)
        out[full, k] = (np.minimum.reduceat(h, starts) & keep).astype(np.uint16)
    return out


def fingerprints(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits that stand for each whole set (texts x 2, int64); zero for empty sets."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full, 0] = np.add.reduceat(mix(sets ^ _ORDER[0]), offsets[full])
        out[full, 1] = np.add.reduceat(mix(sets ^ _ORDER[1]), offsets[full]) ^ np.diff(offsets)[full].astype(np.uint64)
    return out.view(np.int64)
