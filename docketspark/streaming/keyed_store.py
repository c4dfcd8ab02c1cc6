"""A keyed table that takes upserts: copy on write by bucket of the key, so a batch rewrites only what it touches.

Rows are dealt to buckets by the lowest bits of their key's hash.  A bucket is an immutable Parquet folder; the pointer, a
small text file, names the version of every bucket.  A batch reads the buckets that its keys fall into, merges, writes
their new versions into a folder of its own and then publishes a pointer that names these and leaves the others.  What a
batch writes is thus bounded by its keys: at most one bucket for each, of about ``rows_per_bucket`` rows however large the
table is, because a bucket that outgrows that is written in parts, told apart by as many more bits as that takes.  Large
buckets are written by several tasks, so no task holds more rows than a bounded number.  The pointer has a
line for each bucket and is the only thing of the table's size in buckets.

A pointer is written under another name and renamed, which fails where the number is taken, so of two writers one
fails and nothing is lost; a batch that dies before that leaves files that no pointer names.  The pointer also holds
the number of the last batch, so a batch that runs again after it was published changes nothing.  ``retire`` deletes what
neither the newest pointers nor a running batch can name.

Results for odd input: rows with a null in a key column are keyed like any others; of rows of one key in a batch the
highest sequence holds, a null one being the lowest, equal ones decided by a hash of the row; a batch's row replaces a held
one of equal or lower sequence; an empty batch publishes a pointer and no data; reading a store without a pointer gives no
rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relational as R

#: About how many rows a task writes; a bucket of more is written by several.
ROWS_PER_TASK = 250_000
#: Coverage takes the smallest date over plausible ones only.
FLOOR = "1900-01-01"


@dataclass(frozen=True)
class Bucket:
    """Keys whose hash ends in the ``bits`` lowest bits of ``code``; ``version`` is its folder, "" while it is empty."""

    bits: int
    code: int
    version: str = ""
    rows: int = 0
    low: str | None = None
    high: str | None = None


@dataclass(frozen=True)
class Pointer:
    number: int
    batch: int
    buckets: tuple[Bucket, ...]


class Conflict(RuntimeError):
    """Another writer published first."""


class Files:
    """The few operations on Spark's file systems that publishing needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.plain = spark._sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole file under ``name`` at once, or :class:`Conflict` if there is one."""
        draft = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self.context.rename(self.path(draft), self.path(name), self.plain)
        except Py4JJavaError as error:
            self.delete(draft)
            if self.fs.exists(self.path(name)):
                raise Conflict(name) from error
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedStore:
    """A table of ``schema`` at ``folder``; of each key the row with the highest ``sequence``.

    ``date`` names a column of ISO text whose coverage the pointer keeps.  With ``present``, a column of names, a batch's
    row sets only the columns it names and the others keep their values (see :func:`relational.merge_fields`).
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, keys: Sequence[str], sequence: str, date: str | None = None, present: str | None = None, rows_per_bucket: int = 2_000_000):
        self.spark, self.folder, self.keys, self.sequence, self.date, self.present = spark, folder.rstrip("/"), list(keys), sequence, date, present
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.rows_per_bucket = rows_per_bucket
        self.files = Files(spark, self.folder)

    # the pointer

    def numbers(self) -> list[int]:
        return sorted(int(x) for x in self.files.names(f"{self.folder}/pointers") if x.isdigit())

    def pointer(self) -> Pointer:
        numbers = self.numbers()
        return self._pointer(numbers[-1]) if numbers else Pointer(0, -1, (Bucket(0, 0),))

    def _pointer(self, number: int) -> Pointer:
        head, *lines = self.files.read(f"{self.folder}/pointers/{number}").splitlines()
        return Pointer(number, json.loads(head)["batch"], tuple(Bucket(*json.loads(x)) for x in lines))

    def _publish(self, old: Pointer, batch: int, buckets: list[Bucket]) -> Pointer:
        rows = [[b.bits, b.code, b.version, b.rows, b.low, b.high] for b in buckets]
        self.files.publish(f"{self.folder}/pointers/{old.number + 1}", "\n".join(map(json.dumps, [{"batch": batch}, *rows])))
        return Pointer(old.number + 1, batch, tuple(buckets))

    # reading

    def read(self, pointer: Pointer | None = None) -> DataFrame:
        """All rows, as of a pointer or the newest."""
        return self._rows([b for b in (pointer or self.pointer()).buckets if b.version])

    def _rows(self, buckets: list[Bucket]) -> DataFrame:
        paths = [f"{self.folder}/data/{b.version}/__bits={b.bits}/__code={b.code}" for b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def coverage(self) -> tuple[str | None, str | None]:
        """Smallest plausible and largest date, from the pointer alone."""
        buckets = self.pointer().buckets
        return min((b.low for b in buckets if b.low), default=None), max((b.high for b in buckets if b.high), default=None)

    def count(self) -> int:
        return sum(b.rows for b in self.pointer().buckets)

    # writing

    def _hashed(self) -> Column:
        return F.xxhash64(*[F.struct(F.col(k).isNull(), F.col(k)) for k in self.keys])

    def _place(self, rows: DataFrame, buckets: Sequence[Bucket]) -> DataFrame:
        """``rows`` with the bits and the code of their bucket."""
        hashed = self._hashed()
        depths = sorted({b.bits for b in buckets})
        at = [F.struct(F.lit(d).alias("__bits"), hashed.bitwiseAND(F.lit((1 << d) - 1).cast("long")).alias("__code")) for d in depths]
        if len(depths) == 1:
            return rows.withColumn("__at", at[0]).select(*rows.columns, "__at.*")
        directory = self.spark.createDataFrame([(b.bits, b.code) for b in buckets], "__bits int, __code long")
        return rows.withColumn("__at", F.explode(F.array(*at))).select(*rows.columns, "__at.*").join(directory, ["__bits", "__code"])

    def _latest(self, rows: DataFrame, priority: Column | None = None) -> DataFrame:
        """One row for each key and bucket, by an aggregate that begins before the shuffle."""
        names = self.schema.fieldNames() + ([self.present] if self.present else [])
        order = F.struct(F.col(self.sequence), priority if priority is not None else F.lit(0), F.xxhash64(*names))
        picked = rows.groupBy("__bits", "__code", *[F.struct(F.col(k).isNull(), F.col(k)).alias(f"__key{n}") for n, k in enumerate(self.keys)])
        return picked.agg(F.max_by(F.struct(*names), order).alias("__row")).select("__bits", "__code", "__row.*")

    def _merged(self, held: DataFrame, new: DataFrame) -> DataFrame:
        if self.present:
            both = R.merge_fields(held, new, ["__bits", "__code", *self.keys], self.sequence, self.present)
            return both.select("__bits", "__code", *self.schema.fieldNames())
        both = held.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        return self._latest(both, F.col("__new"))

    def _dealt(self, rows: DataFrame, most: dict[tuple[int, int], int]) -> DataFrame:
        """``rows`` with those of a bucket in one task, or in several by their keys where ``most`` of it is too many."""
        parts = {at: -(-n // ROWS_PER_TASK) or 1 for at, n in most.items()}
        if max(parts.values(), default=1) == 1:
            return rows.repartition("__bits", "__code")
        firsts = accumulate(parts.values(), initial=0)
        directory = self.spark.createDataFrame([(*at, first, n) for (at, n), first in zip(parts.items(), firsts)], "__bits int, __code long, __first long, __parts long")
        task = F.col("__first") + F.pmod(F.shiftrightunsigned(self._hashed(), 40), F.col("__parts"))
        dealt = rows.join(F.broadcast(directory), ["__bits", "__code"]).repartitionById(sum(parts.values()), task.cast("int"))
        return dealt.select(*self.schema.fieldNames(), "__bits", "__code")

    def _write(self, rows: DataFrame, most: dict[tuple[int, int], int]) -> list[Bucket]:
        """New versions of the buckets of ``rows``, parted by as many bits as one that is too large takes.

        ``most`` has at most how many rows each bucket holds, by its bits and code.
        """
        version = uuid.uuid4().hex
        self._dealt(rows, most).write.partitionBy("__bits", "__code").parquet(f"{self.folder}/data/{version}")
        back = self.spark.read.schema(T.StructType([*self.schema, T.StructField("__bits", T.IntegerType()), T.StructField("__code", T.LongType())])).parquet(f"{self.folder}/data/{version}")
        dates = [F.min(F.when(F.col(self.date) >= FLOOR, F.col(self.date))), F.max(self.date)] if self.date else [F.lit(None), F.lit(None)]
        found = back.groupBy("__bits", "__code").agg(F.count(F.lit(1)), *dates).collect()  # a row for each bucket
        buckets = [Bucket(bits, code, version, n, low, high) for bits, code, n, low, high in found]
        large = [b for b in buckets if b.rows > self.rows_per_bucket]
        if not large:
            return buckets
        more = {b: (-(-b.rows // self.rows_per_bucket) - 1).bit_length() for b in large}
        halves = [Bucket(b.bits + more[b], b.code + k * (1 << b.bits)) for b in large for k in range(1 << more[b])]
        size = {(b.bits + more[b], b.code + k * (1 << b.bits)): b.rows >> more[b] for b in large for k in range(1 << more[b])}
        split = self._write(self._place(self._rows(large), halves), size)
        below = lambda half: any(b.bits >= half.bits and b.code & ((1 << half.bits) - 1) == half.code for b in split)
        return [b for b in buckets if b not in large] + split + [half for half in halves if not below(half)]

    def upsert(self, batch: DataFrame, number: int | None = None) -> Pointer:
        """Merge a batch and publish it; a ``number`` that was published already, or a later one, changes nothing."""
        old = self.pointer()
        if number is not None and number <= old.batch:
            return old
        names = self.schema.fieldNames() + ([self.present] if self.present else [])
        staged = self._place(batch.select(*names), old.buckets)
        staged = staged if self.present else self._latest(staged)
        path = f"{self.folder}/data/{uuid.uuid4().hex}-staged"
        staged.write.parquet(path)
        staged = self.spark.read.schema(staged.schema).parquet(path)
        asked = {(bits, code): n for bits, code, n in staged.groupBy("__bits", "__code").count().collect()}  # a row for each bucket
        touched = [b for b in old.buckets if (b.bits, b.code) in asked]
        others = [b for b in old.buckets if (b.bits, b.code) not in asked]
        held = self._place(self._rows([b for b in touched if b.version]), touched or old.buckets)
        most = {(b.bits, b.code): b.rows + asked[b.bits, b.code] for b in touched}
        new = self._write(self._merged(held, staged), most) if touched else []
        pointer = self._publish(old, old.batch if number is None else number, others + new)
        self.files.delete(path)
        return pointer

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch is an upsert under its number."""
        return lambda batch, number: self.upsert(batch, number) and None

    def retire(self, keep: int = 2) -> int:
        """Delete versions that none of the ``keep`` newest pointers names, and older pointers; how many were deleted.

        Not to run beside a writer, whose files no pointer names yet.
        """
        numbers = self.numbers()
        named = {b.version for n in numbers[-keep:] for b in self._pointer(n).buckets}
        gone = [x for x in self.files.names(f"{self.folder}/data") if x not in named]
        for name in gone:
            self.files.delete(f"{self.folder}/data/{name}")
        for n in numbers[:-keep]:
            self.files.delete(f"{self.folder}/pointers/{n}")
        return len(gone)
