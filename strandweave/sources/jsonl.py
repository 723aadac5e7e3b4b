"""JSON lines of users and of windowed users, and their long form."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times
from .schemas import RAW_USER, WINDOWED_USER

# File names of windowed data sets.
WINDOWED_GLOBS = {"contiguous": "community_*.jsonl", "monthly_chain": "monthly_chain_community_*.jsonl"}


def input_list(inputs: list[str] | None = None, listed: list[str] | None = None) -> list[str]:
    """Named inputs and listed ones, each once, in order."""
    return list(dict.fromkeys([*(inputs or []), *sorted(listed or [])]))


def split_path(root: str, split: str | None) -> str:
    return f"{root}/{split}" if split else root


def _read(spark: SparkSession, paths: str | list[str], schema: str, glob: str | None) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(paths)


def read_users(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Raw user records with ``source_file``; blank and malformed lines vanish."""
    return _read(spark, paths, RAW_USER, glob).select("*", F.col("_metadata.file_name").alias("source_file"))


def read_windowed(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    return _read(spark, paths, WINDOWED_USER, glob).select("*", F.col("_metadata.file_name").alias("source_file"))


def long_actions(users: DataFrame) -> DataFrame:
    """The long form with ``pos`` (place in the record), ``ingest_seq`` (unique, in input order), action_ts and month_idx.

    ``ingest_seq`` is the running number of the record times the length of the longest record,
    plus the place. Records are numbered exactly: those of each partition of the scan are
    counted in a first pass, and a partition starts behind all before it. ``users`` must come
    straight from a scan, whose partitions are the same in both passes; nothing is shuffled
    but one count for each partition.
    """
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rec = users.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    counts = rec.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("actions")).alias("_m"))
    everything = Window.orderBy("_part")
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.max("_m").over(Window.partitionBy(F.lit(0))).alias("_most"))
    placed = rec.join(starts, "_part")
    first = (F.col("_start") + row) * F.col("_most").cast("bigint")
    rows = placed.select("community_id", "user_id", "source_file", first.alias("_first"), F.posexplode("actions").alias("pos", "a"))
    out = rows.select("community_id", "user_id", "source_file", (F.col("_first") + F.col("pos")).alias("ingest_seq"), "pos", "a.*")
    return out.withColumn("action_ts", times.action_time(F.col("date"), F.col("timestamp"))).withColumn("month_idx", times.month_index(F.col("date"), F.col("timestamp")))


def output_stem(path: str, dataset: str | None = None) -> str:
    """The file's stem with ``_dataset`` behind it, once."""
    stem = PurePosixPath(path).name.rsplit(".", 1)[0]
    return stem if not dataset or stem.endswith(f"_{dataset}") else f"{stem}_{dataset}"
