"""XXH64 of many spans of one buffer at a time, with numpy: spans of equal length are hashed together."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Longer spans are hashed one by one by the library.
LONG = 512

# The primes of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def at_every_byte(data: np.ndarray) -> np.ndarray:
    """The 8-byte little-endian number that begins at each byte of ``data``, zeros behind its end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def _round(value: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(value + lane * P2, 31) * P1


def xxh64_runs(numbers: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """XXH64 with seed 0 of every run of ``length`` bytes; ``numbers`` is :func:`at_every_byte` of the buffer."""
    at, left = starts, length
    if length >= 32:
        with np.errstate(over="ignore"):
            sums = [np.full(len(starts), x, U) for x in (P1 + P2, P2, U(0), U(0) - P1)]
        while left >= 32:
            sums = [_round(x, numbers[at + 8 * k]) for k, x in enumerate(sums)]
            at, left = at + 32, left - 32
        value = _left(sums[0], 1) + _left(sums[1], 7) + _left(sums[2], 12) + _left(sums[3], 18)
        for x in sums:
            value = (value ^ _round(np.zeros_like(x), x)) * P1 + P4
    else:
        value = np.full(len(starts), P5, U)
    value = value + U(length)
    while left >= 8:
        value = _left(value ^ _round(np.zeros_like(value), numbers[at]), 27) * P1 + P4
        at, left = at + 8, left - 8
    rest = numbers[at]
    if left >= 4:
        value = _left(value ^ ((rest & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
        rest, left = rest >> U(32), left - 4
    for k in range(left):
        value = _left(value ^ (((rest >> U(8 * k)) & U(255)) * P5), 11) * P1
    value = (value ^ (value >> U(33))) * P2
    value = (value ^ (value >> U(29))) * P3
    return value ^ (value >> U(32))


def xxh64_spans(data: np.ndarray, numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 of every span, a vectorised call for each length."""
    out = np.empty(len(starts), U)
    short = np.minimum(lengths, LONG + 1).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    ends = np.cumsum(np.bincount(short, minlength=1))
    for length in np.flatnonzero(np.diff(ends, prepend=0)):
        own = order[ends[length - 1] if length else 0 : ends[length]]
        if length <= LONG:
            out[own] = xxh64_runs(numbers, starts[own], int(length))
        else:
            out[own] = [xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(starts[own].tolist(), lengths[own].tolist(), strict=True)]
    return out
