"""Rolling hashes over Arrow batches of text, in numpy, with memory bounded by the chunk size.

``anchored_runs`` names each fixed-length window by the smallest gram hash inside it, so equal windows
always carry the same name, wherever they stand. Anchors only bring together what is then compared; their
hashes are prefix sums of ``value * BASE**position`` modulo 2**64, which differ too little for texts over
two letters. What decides is named otherwise: words by a chain of mixed 8-byte lanes (``word_codes``),
windows by sums modulo the prime 2**61 - 1 (``window_hashes``), whole runs by a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)

#: Separators of a word of ``[^\x20\x09-\x0D]+``.
WHITE = bytes([0x20, *range(0x09, 0x0E)])


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values; ``salt`` chooses the function."""
    out = values + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & _MASK)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 1)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(count: int, forward: bool = True) -> np.ndarray:
    """BASE**0.. or its inverses; kept between calls, grown when a longer span comes."""
    have = _powers[forward]
    if len(have) < count:
        steps = np.full(count, BASE if forward else INVERSE, np.uint64)
        steps[0] = 1
        have = _powers[forward] = np.cumprod(steps, dtype=np.uint64)
    return have[:count]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Hash of every prefix; entry i covers the first i codes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), dtype=np.uint64, out=out[1:])
    return out


def gram_hashes(sums: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``length`` codes that start at every position."""
    count = len(sums) - length
    if count <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[length:] - sums[:count]) * powers(count, False), salt)


PRIME = (1 << 61) - 1
_PRIME, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_prime_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _reduced(values: np.ndarray) -> np.ndarray:
    out = (values >> np.uint64(61)) + (values & _PRIME)
    return np.where(out >= _PRIME, out - _PRIME, out)


def prime_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it, in halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a0 * b1 + a1 * b0
    high = a1 * b1 * np.uint64(2) + (middle >> np.uint64(30))
    return _reduced(high + ((middle & _LOW30) << np.uint64(31)) + a0 * b0)


def prime_powers(count: int, forward: bool = True) -> np.ndarray:
    """Powers of a fixed base, or of its inverse, modulo the prime; grown by doubling."""
    have = _prime_powers[forward]
    base = pow(BASE % PRIME, 1 if forward else -1, PRIME)
    while len(have) < count:
        have = np.concatenate([have, prime_product(have, np.uint64(pow(base, len(have), PRIME)))])
    _prime_powers[forward] = have
    return have[:count]


def window_hashes(codes: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Rabin-Karp hash modulo the prime of the ``length`` codes that start at every position."""
    count = len(codes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    terms = prime_product(_reduced(codes), prime_powers(len(codes)))
    low, high = np.cumsum(terms & _LOW30, dtype=np.uint64), np.cumsum(terms >> np.uint64(30), dtype=np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    sums[1:] = _reduced(prime_product(_reduced(high), np.uint64(1 << 30)) + _reduced(low))
    spans = _reduced(sums[length:] + (_PRIME - sums[:count]))
    return mix(prime_product(spans, prime_powers(count, False)), salt)


#: Longer words are hashed one by one.
LONG_WORD = 512


def word_codes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every word: its 8-byte lanes go through a chain that is not linear."""
    padded = np.zeros(len(buffer) + 8, np.uint8)
    padded[: len(buffer)] = buffer
    lanes = np.ndarray((len(buffer) + 1,), np.uint64, padded, 0, (1,))
    left = end - start
    out = mix(left.astype(np.uint64), 4)
    part, at = np.flatnonzero(left <= LONG_WORD), start.copy()
    while len(part):
        lane, have = lanes[at[part]], left[part]
        used = np.uint64(8) * np.minimum(have, 7).astype(np.uint64)
        lane = np.where(have < 8, lane & ((np.uint64(1) << used) - np.uint64(1)), lane)
        out[part] = mix(out[part] ^ lane, 5)
        part = part[have > 8]
        at[part] += 8
        left[part] -= 8
    for long in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[long] = digest64(buffer[start[long] : end[long]])
    return out


def digest64(values: np.ndarray) -> int:
    """A digest of an array's bytes."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little")


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Runs(NamedTuple):
    """Maximal rows of windows with one anchor: first and last window start, both included.

    ``units`` are the words or bytes that starts count; a run covers ``length - 1`` beyond its last start.
    """

    segment: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    units: np.ndarray


def anchored_runs(codes: np.ndarray, segments: np.ndarray, length: int, gram: int) -> Runs:
    """Runs of the ``length``-windows that lie within one segment.

    ``segments`` gives the segment of every code. The anchor of a window is its smallest gram,
    the rightmost one of equals. A run ends when the anchor's place changes, so no two windows of
    a run are equal.
    """
    count = len(codes) - length + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), codes)
    grams = gram_hashes(prefix_sums(codes), gram, 2)
    width = length - gram + 1
    least = sliding_min(grams, width)
    valid = segments[:count] == segments[length - 1 :]
    begins = valid & (grams[width - 1 :] == least)
    begins[1:] |= valid[1:] & ((least[1:] != least[:-1]) | (segments[1:count] != segments[: count - 1]))
    begins[0] = valid[0]
    ends = np.zeros(count, bool)
    ends[:-1] = valid[:-1] & (begins[1:] | ~valid[1:] | (segments[1:count] != segments[: count - 1]))
    ends[-1] = valid[-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    return Runs(segments[first], first, last, least[first], codes)


class Words(NamedTuple):
    """Words of some documents: document number in the batch, hash, byte span in its text."""

    document: np.ndarray
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _pieces(text: bytes, white: bytes, limit: int) -> Iterator[tuple[int, bytes]]:
    """Cut a long text at separators; a piece without one stays whole."""
    at = 0
    while len(text) - at > limit:
        cut = min((p for p in (text.find(bytes([c]), at + limit) for c in white) if p >= 0), default=len(text))
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def _words(buffer: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = table[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return word_codes(_LOWERED[buffer] if lower else buffer, start, end), start, end


def word_chunks(
    texts: Iterable[bytes | None], white: bytes = WHITE, lower: bool = False, limit: int = CHUNK_BYTES
) -> Iterator[Words]:
    """Hashed words of whole documents, about ``limit`` bytes of text at a time.

    A null text has no words. ``lower`` folds A-Z. A document longer than ``limit`` is a chunk of
    its own, hashed piece by piece.
    """
    table = np.ones(256, bool)
    table[list(white)] = False
    gap = white[:1]
    numbers: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> Words:
        buffer = np.frombuffer(gap.join(parts), np.uint8)
        code, start, end = _words(buffer, table, lower)
        lengths = np.array([len(part) for part in parts], np.int64)
        offsets = np.cumsum(lengths + 1) - lengths - 1
        owner = np.searchsorted(offsets, start, "right") - 1
        return Words(np.array(numbers, np.int64)[owner], code, start - offsets[owner], end - offsets[owner])

    for number, text in enumerate(texts):
        if not text:
            continue
        if len(text) > limit:
            found = []
            for at, piece in _pieces(text, white, limit):
                code, start, end = _words(np.frombuffer(piece, np.uint8), table, lower)
                found.append((code, start + at, end + at))
            code, start, end = (np.concatenate(column) for column in zip(*found, strict=True))
            yield Words(np.full(len(code), number, np.int64), code, start, end)
            continue
        numbers.append(number)
        parts.append(text)
        size += len(text) + 1
        if size >= limit:
            yield flush()
            numbers, parts, size = [], [], 0
    if parts:
        yield flush()


def byte_chunks(texts: Iterable[bytes | None], overlap: int, limit: int = CHUNK_BYTES):
    """(codes, segment of each code, document and offset of each segment), ``limit`` bytes at a time.

    Longer texts are cut into segments that share ``overlap`` bytes, so that every window of
    ``overlap + 1`` bytes lies in exactly one segment.
    """
    owners: list[int] = []
    offsets: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush():
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        segments = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
        return buffer, segments, np.array(owners, np.int64), np.array(offsets, np.int64)

    for number, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, max(1, len(text) - overlap), limit):
            part = text[at : at + limit + overlap]
            owners.append(number)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= limit:
                yield flush()
                owners, offsets, parts, size = [], [], [], 0
    if parts:
        yield flush()
