"""Vectorised word hashing: whole batches of texts are hashed as one byte buffer with numpy.

A word is a run of bytes outside the separator set; a word's hash is the XXH64 of its bytes, computed for all words of one
length together, so no Python code runs per word of usual length.  A text's key is the 128-bit XXH3 of its words' hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .shared import GROUP_BYTES
from .xxh64 import at_every_byte, xxh64_spans

U = np.uint64
#: Bytes \x20 and \x09-\x0D, which part words.
SPACES = bytes([32, *range(9, 14)])
BASE = 0x9E3779B97F4A7C15 & ~7 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit integer over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` well-mixed 64-bit numbers, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


WEIGHTS = numbers(1, 256)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = np.full((2, size), base, U)
        both[1] = pow(base, -1, 1 << 64)
        both[:, 0] = 1
        _POWERS[base] = tuple(np.cumprod(x, dtype=U) for x in both)
    return _POWERS[base]


def table(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def spans(data: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    sep = np.concatenate(([True], parts[data], [True]))
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    return edge[::2], edge[1::2]


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Order-sensitive hash of each run ``values[start:end]``."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def pieces(data: bytes, limit: int, parts: np.ndarray):
    """A long text in parts of about ``limit`` bytes that end at a separator."""
    at = 0
    while len(data) - at > limit:
        window = np.frombuffer(data, np.uint8, limit, at)
        seps = np.flatnonzero(parts[window])
        if len(seps):
            end = at + int(seps[-1]) + 1
        else:  # one huge word: take all of it
            rest = np.flatnonzero(parts[np.frombuffer(data, np.uint8, len(data) - at, at)])
            end = at + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(
    texts: list, separators: bytes = SPACES, limit: int = GROUP_BYTES, prefix: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z lower-cased) and each text's first index into them, with the end.

    None counts as an empty text.  With ``prefix`` only so many bytes of each word are hashed.
    """
    parts = table(separators)
    out, counts = [], np.zeros(len(texts) + 1, np.int64)
    group: list[bytes] = []
    sizes: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b" ".join(group), np.uint8)
        starts, ends = spans(data, parts)
        lengths = ends - starts if prefix is None else np.minimum(ends - starts, prefix)
        out.append(xxh64_spans(data, at_every_byte(data), starts, lengths))
        firsts = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
        np.add.at(counts, np.array(owners) + 1, np.diff(np.searchsorted(starts, firsts)))
        group.clear()
        sizes.clear()
        owners.clear()

    held = 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        for part in pieces(data, limit, parts) if len(data) > limit else (data,):
            if held + len(part) > limit:
                flush()
                held = 0
            group.append(part)
            sizes.append(len(part))
            owners.append(k)
            held += len(part) + 1
    flush()
    return np.concatenate(out) if out else np.zeros(0, U), np.cumsum(counts)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words of each text, in order, and the texts' bounds in them.

    A text of fewer words, but some, has its whole sequence as its only shingle.
    """
    n = np.diff(bounds)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    if not len(words):
        return np.zeros(0, U), out_bounds
    factors = numbers(2, 2 * width + 1) | U(1)
    runs = np.zeros(len(words), U)
    for k in range(min(width, len(words))):
        runs[: len(words) - k] += words[k:] * factors[k]
    place = np.arange(len(words))
    keep = place + width <= np.repeat(bounds[1:], n)
    for k in np.flatnonzero((n > 0) & (n < width)):
        first, last = bounds[k], bounds[k + 1]
        runs[first] = (words[first:last] * factors[width : width + last - first]).sum(dtype=U) + U(int(last - first))
        keep[first] = True
    return mix(runs[keep]), out_bounds


def sequence_keys(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit hash of each text's whole word sequence; equal sequences have equal pairs."""
    data = memoryview(np.ascontiguousarray(words, "<u8")).cast("B")
    ends = (bounds * 8).tolist()
    keys = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))
    both = np.frombuffer(keys, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def pack(values: np.ndarray) -> bytes:
    """Distinct 64-bit hashes, sorted."""
    return np.unique(values).astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(values, U).view(np.int64)
