"""Checks of stored files as files: digests, headers, and whether keys rise.

A file is never gathered. Digests are taken in chunks as a file streams past; order is tested block by
block, as the scan splits the files, and what a block says of itself (first key, last key, descents)
combines with its neighbours'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 4 << 20
_BLOCK = ("file string, block long, rows long, unread long, descents long, header_ok boolean, first_key string, "
          "last_key string, first_descent string")


def digests(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``path, file, sha256, bytes`` of every file of a glob, however large.

    Spark lists the files; tasks read each in chunks through the file system that the path's scheme names
    (local, mounted, HDFS, S3, GCS). A file that changes while it is listed and read is an error. Spark's
    scans pass over empty files, so these have no row.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
              .select("path", F.col("length").alias("bytes")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                digest, seen = hashlib.sha256(), 0
                with store.open_input_file(name) as stream:
                    while piece := stream.read(chunk):
                        digest.update(piece)
                        seen += len(piece)
                if seen != size:
                    raise OSError(f"{uri}: {seen} bytes read, {size} listed")
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "bytes", "sha256"])

    out = listed.mapInArrow(hashed, "path string, bytes long, sha256 string")
    return out.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "bytes")


def block_orders(rows: DataFrame, key: Column, header: Column | None = None) -> DataFrame:
    """One row per block of a file: its rows, first and last key, descents, and whether its header fits.

    ``rows`` come straight from a scan, with its ``_metadata``; so a block's rows are together and in order in
    one task, which keeps the last key alone. ``header`` says of a line that it is the right header; then the
    first row of a file is not data. A null key is counted as unread.
    """
    headed = header is not None
    flag = header if headed else F.lit(None).cast("boolean")
    flat = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       flag.alias("header"), key.cast("string").alias("key"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([here], pa.schema([
                ("file", pa.string()), ("block", pa.int64()), ("rows", pa.int64()), ("unread", pa.int64()),
                ("descents", pa.int64()), ("header_ok", pa.bool_()), ("first_key", pa.string()),
                ("last_key", pa.string()), ("first_descent", pa.string())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pc.or_(pc.not_equal(batch["file"][1:], batch["file"][:-1]), pc.not_equal(batch["block"][1:], batch["block"][:-1]))
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                name, block = batch["file"][a].as_py(), batch["block"][a].as_py()
                if here is None or (here["file"], here["block"]) != (name, block):
                    if here is not None:
                        yield told()
                    here = {"file": name, "block": block, "rows": 0, "unread": 0, "descents": 0}
                    if headed and block == 0:
                        here["header_ok"] = bool(batch["header"][a].as_py())
                        a += 1
                keys = batch["key"].slice(a, b - a)
                here["rows"] += len(keys)
                here["unread"] += keys.null_count
                keys = keys.drop_null()
                if not len(keys):
                    continue
                before = pa.concat_arrays([pa.array([here.get("last_key")], pa.string()), keys[:-1]])
                falls = keys.filter(pc.fill_null(pc.less_equal(keys, before), False))
                here["descents"] += len(falls)
                if len(falls):
                    here.setdefault("first_descent", falls[0].as_py())
                here.setdefault("first_key", keys[0].as_py())
                here["last_key"] = keys[-1].as_py()
        if here is not None:
            yield told()

    return flat.mapInArrow(summed, _BLOCK)


def file_orders(blocks: DataFrame) -> DataFrame:
    """``file, rows, unread, descents, header_ok, first_key, last_key, first_descent`` of whole files.

    Blocks meet in file order; one whose first key does not follow the last key before it adds a descent.
    ``header_ok`` is null where no header was asked for.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = blocks.withColumn("_falls", F.coalesce(
        F.col("first_key") <= F.last("last_key", ignorenulls=True).over(earlier), F.lit(False)))
    first = F.when(F.col("_falls"), F.col("first_key")).otherwise(F.col("first_descent"))
    position = F.struct("block")
    return joined.withColumn("_first", first).groupBy("file").agg(
        F.sum("rows").alias("rows"), F.sum("unread").alias("unread"),
        (F.sum("descents") + F.count_if("_falls")).alias("descents"), F.bool_and("header_ok").alias("header_ok"),
        F.min_by("first_key", F.when(F.col("first_key").isNotNull(), position)).alias("first_key"),
        F.max_by("last_key", F.when(F.col("last_key").isNotNull(), position)).alias("last_key"),
        F.min_by("_first", F.when(F.col("_first").isNotNull(), position)).alias("first_descent"))


def csv_orders(spark: SparkSession, path: str, names: Sequence[str], key: Sequence[str]) -> DataFrame:
    """:func:`file_orders` of delimited files with a header line: is the header exactly ``names``, and does ``key``
    (texts, compared column by column) rise strictly from row to row?

    One pass over the lines, plain or compressed; quoted line breaks are not supported. Values of files with
    another header are read by place.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", "_metadata")
    fields = F.from_csv("value", ", ".join(f"`{n}` string" for n in names))
    parts = [fields[n] for n in key]
    missing = F.lit(False)
    for part in parts:
        missing = missing | part.isNull()
    right = F.replace("value", F.lit('"'), F.lit("")) == F.lit(",".join(names))
    return file_orders(block_orders(lines, F.when(~missing, F.concat_ws("\x1f", *parts)), header=right))


def partition_value(file: str, name: str) -> Column:
    """The value of a partition column as a file's path has it, or null."""
    found = F.regexp_extract(F.col(file), rf"(?:^|/){name}=([^/]+)/", 1)
    return F.when(found != "", found)
