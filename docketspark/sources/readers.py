"""Readers of delimited files, XML, JSON pages, feeds, archives and live sources with a cached fallback."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.dates import parse_compact, rfc_date
from ..session import ship


def tab_separated(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated text with a header; cells are never quoted, missing ones are blank."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE").na.fill("")


def quoted_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, lines_in_cells: bool = True) -> DataFrame:
    """Comma-separated text with quoted cells and doubled quotes inside them.

    A file whose cells may hold line ends can't be split, so it is one task; without ``lines_in_cells`` it is many.
    """
    return spark.read.schema(schema).csv(path, header=header, quote='"', escape='"', multiLine=lines_in_cells)


def settlements(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited settlement lines: date, instrument, symbol, quantity, description, price, and their product.

    Lines of fewer than six cells and headers are dropped.
    """
    cells = F.split("value", r"\|")
    rows = spark.read.text(path).where((F.size(cells) >= 6) & cells[0].rlike(r"^\d{8}$"))
    quantity, price = cells[3].try_cast("long"), cells[5].try_cast("double")
    return rows.select(
        parse_compact(cells[0]).alias("settlement_date"),
        cells[1].alias("instrument"),
        cells[2].alias("symbol"),
        quantity.alias("quantity"),
        price.alias("price"),
        F.coalesce(quantity * price, F.lit(0.0)).alias("fail_value"),
    )


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    """Elements of XML files as rows; a lone child and a list of children both read as an array."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def json_pages(spark: SparkSession, path: str, schema: StructType | str, field: str = "results") -> DataFrame:
    """The records of saved pages of a paged service, a list under ``field`` of each page; from any file system.

    Every page is a task's row and its records are exploded in the plan; fields that a record lacks are null, pages that
    are no JSON or have no list give no rows.
    """
    record = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    page = StructType([StructField(field, ArrayType(record))])
    pages = spark.read.text(path, wholetext=True).select(F.from_json("value", page).alias("page"))
    return pages.select(F.explode(F.col("page")[field]).alias("record")).select("record.*")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """``title, link, guid, description, published`` of the items of RSS feeds; ``published`` is an ISO instant in UTC.

    A date that is not of RFC 822 is null.  A guid with attributes and one without read alike.
    """
    guid = StructType([StructField("_VALUE", StringType())])
    schema = StructType([*[StructField(x, StringType()) for x in ("title", "link", "description", "pubDate")], StructField("guid", guid)])
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select("title", "link", F.col("guid")["_VALUE"].alias("guid"), "description", rfc_date(F.col("pubDate")).alias("published"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """``path, member, method, data`` of every file in the archives of a path, still compressed: a row, and a task, each.

    Spark reads an archive through its own file systems; one task takes its directory apart, and the members are then
    dealt out by name, so that each is unpacked by itself.
    """
    ship(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                whole = memoryview(content.as_buffer())
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for x in archive.infolist():
                        if x.is_dir():
                            continue
                        # the local header repeats the name and may have extra fields of another length
                        begin = x.header_offset + 30 + sum(struct.unpack("<HH", whole[x.header_offset + 26 : x.header_offset + 30]))
                        data = whole[begin : begin + x.compress_size].tobytes()
                        yield pa.RecordBatch.from_pylist([{"path": name, "member": x.filename, "method": x.compress_type, "data": data}], _MEMBERS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(listed, "path string, member string, method int, data binary").repartition("path", "member")


_MEMBERS = pa.schema([("path", pa.string()), ("member", pa.string()), ("method", pa.int32()), ("data", pa.binary())])
#: The tables of a quarterly bundle.
BUNDLE = ("SUBMISSION", "REPORTINGOWNER", "NONDERIV_TRANS", "DERIV_TRANS", "NONDERIV_HOLDING", "DERIV_HOLDING", "FOOTNOTES", "OWNER_SIGNATURE")
#: Lines of a batch, and bytes inflated at once.
LINES, PIECE = 10_000, 1 << 20


def _inflated(method: int, data: bytes) -> Iterator[bytes]:
    """A member's content in pieces of bounded size."""
    if method == zipfile.ZIP_STORED:
        yield from (data[at : at + PIECE] for at in range(0, len(data), PIECE))
        return
    if method != zipfile.ZIP_DEFLATED:
        raise ValueError(f"compression method {method} is not known")
    inflate, rest = zlib.decompressobj(-15), data
    while rest and not inflate.eof:
        yield inflate.decompress(rest, PIECE)
        rest = inflate.unconsumed_tail
    yield inflate.flush()


def zip_lines(members: DataFrame) -> DataFrame:
    """``path, member, n, value``: the numbered lines of unpacked members, in batches, so none is held whole."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, tail, out = 0, b"", []
                for piece in _inflated(row["method"], row["data"]):
                    *whole, tail = (tail + piece).split(b"\n")
                    out += whole
                    while len(out) >= LINES:
                        yield _lines(row, n, out[:LINES])
                        n, out = n + LINES, out[LINES:]
                out += [tail] if tail else []
                if out:
                    yield _lines(row, n, out)

    return members.mapInArrow(lines, "path string, member string, n long, value string")


def _lines(row: dict, n: int, values: list[bytes]) -> pa.RecordBatch:
    texts = [x.rstrip(b"\r").decode("utf-8", "replace") for x in values]
    columns = [pa.array([row["path"]] * len(texts)), pa.array([row["member"]] * len(texts)), pa.array(range(n, n + len(texts)), pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["path", "member", "n", "value"])


def zip_bundle(spark: SparkSession, path: str, schemas: Mapping[str, StructType | str], required: tuple[str, ...] = BUNDLE) -> dict[str, DataFrame]:
    """The tab-separated tables of ``schemas`` from bundles, by name; a bundle that lacks a required table fails.

    A table is the member of its name with ``.tsv``, in any folder of the archive and in any case; its first line is the header.
    Cells are never quoted and missing ones are blank.
    """
    members = zip_members(spark, path)
    name = F.upper(F.regexp_extract("member", r"([^/]+)\.[tT][sS][vV]$", 1))
    named = members.withColumn("table", name)
    have = named.groupBy("path").agg(F.collect_set("table").alias("tables"))  # a name for each member
    lacking = have.select("path", F.array_except(F.array(*map(F.lit, required)), "tables").alias("lacking")).where(F.size("lacking") > 0)
    for row in lacking.limit(10).collect():
        raise ValueError(f"{row.path} lacks {', '.join(sorted(row.lacking))}")
    out = {}
    for table, schema in schemas.items():
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        rows = zip_lines(named.where(F.col("table") == table.upper()).drop("table")).where("n > 0 and value <> ''")
        cells = F.split("value", "\t")
        made = [F.coalesce(F.get(cells, F.lit(k)), F.lit("")) for k in range(len(kind))]
        out[table] = rows.select(*[(c if isinstance(f.dataType, StringType) else F.nullif(c, F.lit("")).try_cast(f.dataType)).alias(f.name) for c, f in zip(made, kind, strict=True)])
    return out


def live_first(live: Callable[[], DataFrame], cached: Callable[[], DataFrame]) -> tuple[DataFrame, str | None]:
    """Rows of a live source, or the cached ones with a warning if it fails; ``source`` says which."""
    try:
        rows = live()
        rows.limit(1).count()
        return rows.withColumn("source", F.lit("live")), None
    except Exception as error:  # noqa: BLE001  any failure of the service leads to the cache
        return cached().withColumn("source", F.lit("cache")), f"live source failed: {str(error).splitlines()[0]}"
