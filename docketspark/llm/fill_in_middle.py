"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES`` each, with the units, code points and bytes up
to every frame's end (:func:`store`).  A unit is a word with the white space before it, or white space at the text's end.
The two cuts fall behind units, so only the one or two frames that hold a cut are decompressed to find it
(:meth:`Frames.cut`); the frames between the cuts are moved as they are.  The transformed text is itself a sequence of
such frames, so that its digest and that of the text rebuilt from it stream one frame at a time: a task never holds a
whole decompressed text beside the one Spark hands it.

Results for odd input: a null text counts as empty; an empty text is plain with 0 units; a null ``doc_id`` draws its
numbers from the seed and an empty id; rows that repeat a ``doc_id`` are transformed one by one, alike if their texts
are; a text of one huge word is one unit over many frames; a text that holds a marker is plain, so that the markers
of an output are its own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch

FRAME_BYTES = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: White space that parts words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: A frame as a value of a table: its zstandard data and the units, code points and bytes of the text up to its end.
FRAME_TYPE = "struct<data: binary, units: bigint, chars: bigint, bytes: bigint>"
_FRAME = pa.struct([("data", pa.binary()), ("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64())])


class Codec:
    """The compressor and decompressor of a task; every frame says its own size."""

    def __init__(self) -> None:
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.unpack = zstandard.ZstdDecompressor().decompress


def unit_ends(data: bytes, more: bytes | None) -> np.ndarray:
    """Where units end in ``data``; ``more`` is what follows, of which only the first byte counts (None: the text ends)."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    follows = np.empty(len(space), bool)
    follows[:-1] = space[1:]
    if len(space):
        follows[-1] = more is None or bool(_SPACE[more[0]])
    ends = follows & ~space
    if len(space) and more is None:
        ends[-1] = True
    return np.flatnonzero(ends) + 1


def code_points(data: bytes) -> int:
    """How many code points the UTF-8 bytes hold."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


@dataclass
class Frames:
    """A text in compressed frames; ``units``, ``chars`` and ``bytes`` are counts up to the end of each."""

    data: list[bytes] = field(default_factory=list)
    units: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)

    def add(self, data: bytes, units: int, chars: int, size: int) -> None:
        self.data.append(data)
        for counts, n in ((self.units, units), (self.chars, chars), (self.bytes, size)):
            counts.append(n + (counts[-1] if counts else 0))

    def before(self, counts: list[int], k: int) -> int:
        return counts[k - 1] if k else 0

    @classmethod
    def of(cls, text: bytes, codec: Codec, limit: int = FRAME_BYTES) -> Frames:
        out, at = cls(), 0
        while at < len(text):
            end = min(len(text), at + limit)
            while end < len(text) and text[end] & 0xC0 == 0x80:  # a code point stays whole
                end += 1
            part = text[at:end]
            out.add(codec.pack(part), len(unit_ends(part, text[end : end + 1] or None)), code_points(part), len(part))
            at = end
        return out

    def cut(self, units: int, codec: Codec) -> tuple[int, int]:
        """Byte and code point behind the first ``units`` units; at most one frame is decompressed."""
        if units <= 0 or not self.data:
            return 0, 0
        k = bisect_left(self.units, units)
        part = codec.unpack(self.data[k])
        inside = units - self.before(self.units, k)
        ends = unit_ends(part, b"x")
        # a unit that ends with the frame is known by the frame's count alone
        end = int(ends[inside - 1]) if inside <= len(ends) else len(part)
        return self.before(self.bytes, k) + end, self.before(self.chars, k) + code_points(part[:end])

    def read(self, begin: int, end: int, codec: Codec) -> Iterator[bytes]:
        """The bytes of a range, a frame at a time; frames outside it are not touched."""
        k = bisect_left(self.bytes, begin + 1)
        while begin < end:
            low = self.before(self.bytes, k)
            part = codec.unpack(self.data[k])
            yield part[begin - low : end - low]
            begin, k = self.bytes[k], k + 1

    def move(self, begin: int, end: int, codec: Codec, to: Frames) -> None:
        """Append a range to ``to``: whole frames as they are, the cut ones' parts compressed anew."""
        k = bisect_left(self.bytes, begin + 1)
        while begin < end:
            low, high = self.before(self.bytes, k), self.bytes[k]
            if begin == low and high <= end:
                to.add(self.data[k], 0, self.chars[k] - self.before(self.chars, k), high - low)
            else:
                part = codec.unpack(self.data[k])[begin - low : end - low]
                to.add(codec.pack(part), 0, code_points(part), len(part))
            begin, k = high, k + 1

    def find(self, markers: tuple[bytes, ...], codec: Codec) -> dict[bytes, int]:
        """The first byte of each marker that occurs, from one pass over the frames."""
        found: dict[bytes, int] = {}
        longest = max(map(len, markers))
        tail, at = b"", 0
        for data in self.data:
            part = tail + codec.unpack(data)
            for marker in markers:
                if marker not in found and (place := part.find(marker)) >= 0:
                    found[marker] = at + place
            keep = min(len(part), longest - 1)
            at += len(part) - keep
            tail = part[len(part) - keep :]
        return found

    @property
    def size(self) -> int:
        return self.bytes[-1] if self.bytes else 0

    def digest(self, codec: Codec, ranges: list[tuple[int, int]] | None = None) -> str:
        """SHA-256 of the ranges one behind the other, or of the whole."""
        out = hashlib.sha256()
        for begin, end in [(0, self.size)] if ranges is None else ranges:
            for part in self.read(begin, end, codec):
                out.update(part)
        return out.hexdigest()

    def value(self) -> list[dict]:
        return [{"data": d, "units": u, "chars": c, "bytes": b} for d, u, c, b in zip(self.data, self.units, self.chars, self.bytes, strict=True)]

    @classmethod
    def from_value(cls, value: list[dict] | None) -> Frames:
        rows = value or []
        return cls(*([x[key] for x in rows] for key in ("data", "units", "chars", "bytes")))


@dataclass(frozen=True)
class Rates:
    """What is drawn: of 100 texts so many are transformed, and of those so many with the suffix first."""

    seed: int = 42
    transformed: int = 50
    suffix_first: int = 80


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


@dataclass
class Made:
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: Frames


def transform(text: Frames, doc_id: int | None, rates: Rates, codec: Codec) -> Made:
    """The transformed text in frames."""
    h1, h2, h3, h4 = draws(rates.seed, doc_id)
    n = text.units[-1] if text.units else 0
    if not text.size or h3 % 100 >= rates.transformed or text.find(MARKERS, codec):
        return Made("plain", None, None, text)
    (a, a_chars), (b, b_chars) = (text.cut(x, codec) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, text.size)}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < rates.suffix_first else ("psm", (PREFIX, SUFFIX, MIDDLE))
    out = Frames()
    for marker in order:
        out.add(codec.pack(marker), 0, len(marker), len(marker))
        text.move(*parts[marker], codec, out)
    return Made(form, a_chars, b_chars - a_chars, out)


def restored(output: Frames, form: str, codec: Codec) -> list[tuple[int, int]]:
    """The byte ranges of an output that make up the text it came from, found by its markers alone."""
    if form == "plain":
        return [(0, output.size)]
    begins = output.find(MARKERS, codec)
    ordered = sorted(begins.values()) + [output.size]
    ranges = {m: (at + len(m), ordered[ordered.index(at) + 1]) for m, at in begins.items()}
    return [ranges[m] for m in (PREFIX, MIDDLE, SUFFIX)]


def _ids_and_texts(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return batch.column("doc_id").to_pylist(), [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``doc_id, frames``: every text of ``docs (doc_id, text)`` in compressed frames."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec()
        ids, texts = _ids_and_texts(batch)
        frames = pa.array([Frames.of(x, codec, frame_bytes).value() for x in texts], pa.list_(_FRAME))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), frames], ["doc_id", "frames"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(plain, work, f"doc_id long, frames array<{FRAME_TYPE}>")


def fill_in_middle(stored: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of :func:`store`; ``output`` is in frames."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec()
        ids = batch.column("doc_id").to_pylist()
        texts = [Frames.from_value(x) for x in batch.column("frames").to_pylist()]
        made = [transform(x, k, rates, codec) for x, k in zip(texts, ids, strict=True)]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([x.units[-1] if x.units else 0 for x in texts], pa.int64()),
            pa.array([x.form for x in made], pa.string()),
            pa.array([x.prefix_chars for x in made], pa.int64()),
            pa.array([x.middle_chars for x in made], pa.int64()),
            pa.array([x.output.value() for x in made], pa.list_(_FRAME)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return by_batch(stored.select("doc_id", "frames"), work, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<{FRAME_TYPE}>")


def digests(made: DataFrame) -> DataFrame:
    """``made`` with ``output_sha256`` and ``restored_sha256`` in place of ``output``: the output's frames are streamed."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec()
        outputs = [Frames.from_value(x) for x in batch.column("output").to_pylist()]
        forms = batch.column("form").to_pylist()
        whole = [x.digest(codec) for x in outputs]
        again = [x.digest(codec, restored(x, form, codec)) for x, form in zip(outputs, forms, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(whole, pa.string()), pa.array(again, pa.string())], [*names, "output_sha256", "restored_sha256"])

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return by_batch(made.select(*names, "output"), work, schema)


def texts(made: DataFrame) -> DataFrame:
    """``made`` with ``output`` decompressed to a string, and ``restored``, the text rebuilt from it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec()
        outputs = [Frames.from_value(x) for x in batch.column("output").to_pylist()]
        whole = [b"".join(x.read(0, x.size, codec)) for x in outputs]
        again = [b"".join(b"".join(x.read(*r, codec)) for r in restored(x, form, codec)) for x, form in zip(outputs, batch.column("form").to_pylist(), strict=True)]
        columns = [pa.array(x, pa.binary()).cast(pa.string()) for x in (whole, again)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*names, "output", "restored"])

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    return by_batch(made.select(*names, "output"), work, schema)
