"""Content-defined anchors of sequences: where two documents share a window, they share its anchor.

A window of `length` symbols holds `length - gram + 1` grams; the one of least hash (the leftmost on a tie) is its anchor. Neighbouring windows mostly
have one anchor in common, so a sequence has about 2 / (length - gram + 2) anchors a symbol, each with a run of windows: its context. Equal windows
have equal anchors at equal offsets, wherever they stand, so it is enough to compare contexts of one anchor; no repeated window is missed.
"""

from __future__ import annotations

import numpy as np

BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Positions in an array of symbols take so many bits beside a gram's hash.
BITS = 26


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` symbols (uint64), by doubling."""

    def up(x: np.ndarray, shift: int, power: int, y: np.ndarray) -> np.ndarray:
        n = max(0, min(len(x), len(y) - shift))
        return x[:n] * np.uint64(power) + y[shift : shift + n]

    mask, total, size, block, width, power = (1 << 64) - 1, None, 0, symbols.astype(np.uint64), 1, BASE
    while gram:
        if gram & 1:
            total = block if total is None else up(total, size, power, block)
            size += width
        gram >>= 1
        if gram:
            block = up(block, width, power, block)
            width, power = 2 * width, power * power & mask
    total = (total ^ (total >> np.uint64(32))) * np.uint64(MIX)
    return total ^ (total >> np.uint64(29))


def contexts(symbols: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in concatenated documents that end at `ends`: first window, number of windows, place of the anchor, its hash."""
    if len(symbols) >= 1 << BITS:
        raise ValueError("cut longer sequences into segments that overlap by a window")
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(symbols, gram)
    span, done = length - gram + 1, 1
    low = (hashes >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(hashes), dtype=np.uint64)
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    starts = np.concatenate(([0], ends[:-1]))
    whole = np.zeros(len(symbols) + 1, np.int32)
    fits = ends - starts >= length
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(windows):
        return none, none, none, none.astype(np.uint64)
    place = (low[windows] & np.uint64((1 << BITS) - 1)).astype(np.int64)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
    first, place = windows[cut[:-1]], place[cut[:-1]]
    return first, np.diff(cut), place, hashes[place]
