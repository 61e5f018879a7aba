"""Sinks: sorted unique tables, year partitions, shards, reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgate.operators.blocks import dense_index


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as ``spark.checkpoint.dir`` names it.

    Only a session whose executors are threads of this process gets a folder of its own where
    the setting is missing; every cluster, also one of local processes, must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="pitgate-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table below the shared folder, for steps that read it several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder: lost executors do not lose it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str], partition_by: Sequence[str] = (),
                     mode: str = "overwrite") -> None:
    """Gzip CSV with header. Ranges of the order go to files, each sorted within.

    Range partitioning splits a long key over several files; nothing is sorted in one task.
    """
    keys = [*partition_by, *order]
    arranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = arranged.write.mode(mode).option("header", True).option("compression", "gzip")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_years(df: DataFrame, path: str, day: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet partitioned by exchange and year, for partition-pruned reads."""
    dated = df.withColumn("year", F.year(day))
    arranged = dated.repartitionByRange("exchange", "year", *order).sortWithinPartitions(
        "exchange", "year", *order)
    arranged.write.mode(mode).partitionBy("exchange", "year").parquet(path)


def rewrite_years(df: DataFrame, path: str, day: str, order: Sequence[str]) -> None:
    """Replace only the (exchange, year) partitions that ``df`` holds."""
    dated = df.withColumn("year", F.year(day))
    arranged = dated.repartitionByRange("exchange", "year", *order).sortWithinPartitions(
        "exchange", "year", *order)
    (arranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("exchange", "year").parquet(path))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def hash_shard(n: int, *keys: str) -> Column:
    """Shard by hash of the key: what to use when the number has no meaning of its own."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def rank_shards(universe: DataFrame, keys: Sequence[str], prefix: Column, n: int) -> DataFrame:
    """Shard number = rank of the key in the sorted universe, modulo ``n``."""
    ranked = dense_index(universe, keys, prefix, "position")
    return ranked.withColumn("shard", F.pmod(F.col("position"), F.lit(n)).cast("int"))
