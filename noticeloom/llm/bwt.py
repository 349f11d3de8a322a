"""Repeated substrings of a bounded block: a Burrows-Wheeler order and its common prefixes."""

from __future__ import annotations

import numpy as np

_PACKED = 7  # symbols of 9 bits in one sort key


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling.

    Also gives the last length that doubling passed before ``depth``, and the suffixes' ranks by
    that many symbols.
    """
    count = len(symbols)
    padded = np.concatenate([symbols, np.zeros(_PACKED, symbols.dtype)]).astype(np.int64)
    key = np.zeros(count, np.int64)
    for at in range(_PACKED):
        key |= padded[at : at + count] << (9 * (_PACKED - 1 - at))
    have, known, rank = _PACKED, 0, np.zeros(count, np.int64)
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order, known, rank
        ordered = key[order]
        steps = np.empty(count, np.int64)
        steps[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
        rank = np.empty(count, np.int64)
        rank[order] = steps
        key = rank << 32
        if have < count:
            key[: count - have] |= rank[have:] + 1
        known, have = have, have * 2


def equal_windows(symbols: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and whether each shares fewer than ``least`` symbols with the one before.

    ``left`` counts the symbols up to the end of the suffix's text. The order's ranks tell the
    pairs that share fewer symbols than doubling had passed. From there it goes level by level: a
    boundary between two suffixes that share l symbols becomes one of l + 1 between the suffixes
    one symbol to the left, if both start with the same symbol. Levels end at ``least``; what has
    no boundary by then shares at least that much. Symbol 0 ends a text and equals nothing, itself
    included.
    """
    order, known, rank = suffix_order(symbols, least)
    count = len(order)
    place = np.empty(count + 1, np.int32)
    place[order] = np.arange(count, dtype=np.int32)
    place[count] = 0
    first, known = symbols[order], max(1, min(known, least))
    short, ranks = left[order] < known, rank[order]
    boundary = np.ones(count, bool)
    boundary[1:] = (first[1:] != first[:-1]) | (ranks[1:] != ranks[:-1]) | short[1:] | short[:-1]
    after = place[order + 1]
    open_ = np.flatnonzero(~boundary[1:])
    low = np.minimum(after[open_], after[open_ + 1])
    high = np.maximum(after[open_], after[open_ + 1])
    passed = np.empty(count, np.int32)
    for _ in range(known, least):
        np.cumsum(boundary, dtype=np.int32, out=passed)
        hit = passed[high] != passed[low]
        if not hit.any():
            break
        boundary[open_[hit] + 1] = True
        rest = ~hit
        open_, low, high = open_[rest], low[rest], high[rest]
    return order, boundary


def repeats(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, start) of every ``least``-byte string that also starts earlier in the block.

    Earlier: in a text that comes before, or further left in the same one.
    """
    total = sum(map(len, texts)) + len(texts)
    symbols = np.zeros(total, np.int16)
    lengths = np.array([len(text) for text in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    filled = np.ones(total, bool)
    filled[starts + lengths] = False
    symbols[filled] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    ends = np.repeat(starts + lengths, lengths + 1)
    order, boundary = equal_windows(symbols, ends - np.arange(total), least)
    heads = np.flatnonzero(boundary)
    keeper = np.minimum.reduceat(order, heads)
    later = np.ones(total, bool)
    later[keeper] = False
    found = np.flatnonzero(later)
    owner = np.searchsorted(starts, found, "right") - 1
    return owner, found - starts[owner]
