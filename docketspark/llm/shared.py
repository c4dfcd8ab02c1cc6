"""Helpers shared by the corpus operators: lineage cuts, size-checked joins, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side, in bytes, that a join may broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: At most so many keys, those with most rows and more than ``HOT_ROWS``, are dealt to ``SALTS`` tasks each.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 2000, 32
#: Documents of one Arrow batch are worked on in groups of about so many bytes.
GROUP_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder in the warehouse, which all machines share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its lineage, still partitioned as it was."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a compressed Parquet table in the shared folder: for wide or many rows."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what :func:`written` wrote, once all that was read from it is written itself."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        each = lambda total, x: total + width(x, kind.elementType)
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), each), F.lit(16).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((width(value[f.name], f.dataType) for f in kind), F.lit(16).cast("long"))
    return F.lit(16).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all values of ``df`` (already cut) take at most about ``limit`` bytes, arrays and texts counted in full."""
    each = sum((width(F.col(f.name), f.dataType) for f in df.schema), F.lit(0).cast("long"))
    return (df.agg(F.sum(each)).first()[0] or 0) <= limit


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``right`` (already cut) broadcast if its bytes are counted and few, else by a shuffle."""
    return left.join(F.broadcast(right) if small(right, limit) else right, on, how)


def join_spread(
    rows: DataFrame, keyed: DataFrame, on: str | list[str], salt: Column, how: str = "inner", counts: DataFrame | None = None, hashed: bool = False
) -> DataFrame:
    """Join many ``rows`` of a key with its one row of ``keyed``; a hot key's rows go to ``SALTS`` tasks.

    ``counts`` holds ``on`` and a ``count`` of rows, where known.  Only the ``HOT_KEYS`` largest keys are looked at, so
    they alone are broadcast; their rows are dealt by ``salt`` and their row of ``keyed`` is copied.  With ``hashed`` each
    task holds its share of ``keyed``, a few numbers for each key, instead of sorting the rows.
    """
    on = [on] if isinstance(on, str) else on
    counts = rows.groupBy(*on).count() if counts is None else counts.select(*on, "count")
    most = counts.orderBy(F.desc("count")).limit(HOT_KEYS)
    hot = [row[:-1] for row in most.collect() if row["count"] > HOT_ROWS]
    held = (lambda df: df.hint("shuffle_hash")) if hashed else (lambda df: df)
    if not hot:
        return rows.join(held(keyed), on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot, counts.select(*on).schema).withColumn("__hot", F.lit(True)))
    dealt = F.when(F.col("__hot"), F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(0)
    many = rows.join(hot, on, "left").withColumn("__salt", dealt).drop("__hot")
    copies = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    one = keyed.join(hot, on, "left").withColumn("__salt", copies).drop("__hot")
    return many.join(held(one), [*on, "__salt"], how).drop("__salt")


def tagged(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """``rows`` with ``tag``: 0, but a hash of the content where rows of one ``key`` hold different contents.

    So (key, tag) tells rows of one id with different contents apart and costs nothing where ids are unique.
    """
    hashed = F.xxhash64(content)
    several = rows.groupBy(key).agg(F.min(hashed).alias("x"), F.max(hashed).alias("y")).where("x <> y").select(key)
    several = cut(several.withColumn("__several", F.lit(True)))
    return join_checked(rows, several, key, "left").withColumn("tag", F.when(F.col("__several"), hashed).otherwise(F.lit(0).cast("long"))).drop("__several")


def node(key: str) -> Column:
    """One number for (key, tag): the key itself, but where its rows hold different contents a hash of both."""
    return F.when(F.col("tag") == 0, F.col(key)).otherwise(F.xxhash64(key, "tag"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, as spark-submit's --py-files would."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="package")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` of a function on one record batch; it never sees more than one batch at a time."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 8 * GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes, so that long texts don't pile up in memory."""
    rows = batch.num_rows
    step = rows if batch.nbytes <= limit or rows == 0 else max(1, rows * limit // batch.nbytes)
    for at in range(0, rows, max(1, step)):
        yield batch.slice(at, step)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def held_out(doc_id) -> F.Column:
    """Whether a document belongs to the held-out fold: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled documents outside the held-out fold.

    The sample is the ``bound`` smallest hashes of the ids, so it is the same for every partitioning; it is small
    by construction and is the only broadcast side.  Null labels are left out, of repeated ones the largest holds;
    of documents that repeat an id the smallest text counts, so that ``bound`` holds for documents too.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def plain_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tag``: all that the operators on documents take from a table."""
    return tagged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", F.col("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ..., so that none clashes, and ``doc_id, text, tag`` beside them."""
    plain = docs.select(*[F.col(f"`{x}`").alias(f"c{k}") for k, x in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return tagged(plain, "doc_id", F.col("text"))


def rewrite(docs: DataFrame, hints: DataFrame, work: Callable[[str | None, object], str | None], on: list[str]) -> DataFrame:
    """``docs`` with the text of every document that ``hints (on, hint)`` names replaced by ``work(text, hint)``.

    ``on`` is ``doc_id``, or that and ``tag``, which then tells apart texts of one id; ``tag`` is not returned.
    All columns and rows are kept; ``n_chars``, where it exists, follows the text.
    """
    names = list(docs.columns)
    joined = numbered(docs).join(hints.select(*on, "hint").hint("merge"), on, "left")  # hints grow with the corpus
    joined = joined.select(*[F.col("text") if x == "text" else F.col(f"c{k}") for k, x in enumerate(names)], "hint").toDF(*[f"c{k}" for k in range(len(names))], "hint")

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index("text")
        texts, given = batch.column(at).to_pylist(), batch.column(len(names))
        for k in given.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]:
            texts[k] = work(texts[k], given[k].as_py())
        columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(names))])

    kinds = T.StructType([T.StructField(f"c{k}", T.StringType() if f.name == "text" else f.dataType) for k, f in enumerate(docs.schema)])
    out = by_batch(joined, change, kinds).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
