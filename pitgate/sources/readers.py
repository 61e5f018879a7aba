"""Scans: strict tables, raw payloads, manifests, digests."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgate.functions.text import unwrap_jsonp
from pitgate.operators.checks import violations


class HeaderError(ValueError):
    """A table does not have the columns its contract names."""


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV (plain or gzip, one file or a glob) typed on read; the header must fit the schema.

    Spark tests names and order of every file's header while it reads that file.
    """
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").csv(path))


def require_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The frame, if its leading columns are exactly the expected ones."""
    if list(df.columns[: len(expected)]) != list(expected):
        raise HeaderError(f"unexpected header {df.columns}, want {list(expected)}")
    return df


def resolve_headers(df: DataFrame, aliases: Mapping[str, Sequence[str]],
                    required: Sequence[str] = ()) -> DataFrame:
    """Rename the first column found among each name's aliases; other columns drop out."""
    found = {}
    for name, options in aliases.items():
        match = next((c for c in df.columns if "".join(c.split()) in options), None)
        if match is not None:
            found[name] = match
    missing = [name for name in required if name not in found]
    if missing:
        raise HeaderError(f"no column for {missing} among {df.columns}")
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON file holding an array (or one object), as rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Raw payload files: ``path``, whole ``payload`` text and its digest."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"),
                      F.sha2("value", 256).alias("sha256"))


def payload_rows(payloads: DataFrame, payload: str, fields: Sequence[str],
                 arrays: Sequence[str] = ("result", "data")) -> DataFrame:
    """Rows of the first non-empty array of a JSON or JSONP payload.

    Every row keeps the other columns, its text fields, and its own JSON as ``row_json``.
    """
    body = unwrap_jsonp(F.col(payload))
    row = T.ArrayType(T.StringType())
    lists = [F.from_json(F.get_json_object(body, f"$.{name}"), row) for name in arrays]
    first = F.coalesce(*[F.when(F.size(a) > 0, a) for a in lists])
    rest = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*rest, F.explode(first).alias("row_json"))
    return rows.select(*rest, *[F.get_json_object("row_json", f"$.{f}").alias(f) for f in fields], "row_json")


def unreadable_payloads(payloads: DataFrame, payload: str, key: str) -> DataFrame:
    """Violations for payloads that are no JSON; :func:`objects_with_key` passes them over."""
    broken = payloads.where(F.try_parse_json(payload).isNull())
    return violations(broken, "payload is no JSON", F.col(key).cast("string"))


def objects_with_key(payloads: DataFrame, payload: str, *keys: str) -> DataFrame:
    """One row per object, at any depth of the payload, that has one of ``keys``.

    SQL recursion would rescan the payload level by level and stops at a row limit, so a
    small Arrow-batched function walks each document where it lies. It is defined in here
    so that it travels to the workers with the query.
    """
    def holders(doc: str) -> Iterator[dict]:
        pending = [json.loads(doc)]
        while pending:
            item = pending.pop()
            if isinstance(item, dict):
                if any(key in item for key in keys):
                    yield item
                pending.extend(reversed(list(item.values())))
            elif isinstance(item, list):
                pending.extend(reversed(item))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def walk(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: [json.dumps(o, ensure_ascii=False, sort_keys=True) for o in holders(d)])

    rest = [c for c in payloads.columns if c != payload]
    readable = F.when(F.try_parse_json(payload).isNotNull(), F.col(payload)).otherwise("null")
    return payloads.select(*rest, F.posexplode(walk(readable)).alias("position", "object_json"))


def json_fields(col: Column, fields: Sequence[str]) -> list[Column]:
    return [F.get_json_object(col, f"$.{f}").alias(f) for f in fields]


def read_manifests(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Manifest sidecars of a glob, one row per file, with ``manifest`` naming the file."""
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return rows.withColumn("manifest", F.element_at(F.split(F.input_file_name(), "/"), -1))


def manifest_entries(manifests: DataFrame, array: str) -> DataFrame:
    """The entries of one array of every manifest, next to its scalar columns."""
    scalars = [f.name for f in manifests.schema.fields if not isinstance(f.dataType, T.ArrayType)]
    return manifests.select(*scalars, F.explode(array).alias("_e")).select(*scalars, "_e.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of every file of a glob (files of shard size, read whole)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"),
                        F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_digest_list(spark: SparkSession, path: str) -> DataFrame:
    """A ``digest name`` text list."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(0)).alias("sha256"))
