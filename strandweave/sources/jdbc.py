"""Relational sources over JDBC. Credentials come from Spark conf or the environment only."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts, times
from ..functions.constants import TEXT_LONG

FETCH_ROWS, QUERY_TIMEOUT_S, BATCH_ROWS = 100_000, 60, 1_000


def connection(spark: SparkSession, prefix: str = "spark.strandweave.jdbc.") -> dict[str, str]:
    """url, user, password and driver from ``{prefix}*`` of the session, else from STRANDWEAVE_JDBC_*."""
    out = {}
    for name in ("url", "user", "password", "driver"):
        value = spark.conf.get(prefix + name, None) or os.environ.get(f"STRANDWEAVE_JDBC_{name.upper()}")
        if value:
            out[name] = value
    return out


def read_table(spark: SparkSession, name: str, *, partition_by: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A table with cursor fetches and a statement timeout, split on ``partition_by`` when bounds are given."""
    opts = {**connection(spark), "dbtable": name, "fetchsize": str(FETCH_ROWS), "queryTimeout": str(QUERY_TIMEOUT_S), **options}
    if partition_by and bounds:
        opts |= {"partitionColumn": partition_by, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**opts).load()


def normalise_rows(rows: DataFrame) -> DataFrame:
    """Rows of the action table as actions: derived target, time text cut from the date."""
    own = lambda c: texts.cut(F.col(c).cast("string"), TEXT_LONG * 1000)
    return rows.select(
        "user_id", "action_type", "action_text", "original_text", F.col("date").cast("string").alias("date"),
        texts.derive_target(F.col("action_type"), own("action_text"), own("original_text"), F.col("post_id")).alias("target"),
        times.date_text(F.col("date").cast("string")).alias("timestamp"),
    )


def user_actions(actions: DataFrame, stats: DataFrame, community: int | None = None, users: DataFrame | None = None) -> DataFrame:
    """Actions of users with a community; the filter reaches the scan, a list of users is a semi-join."""
    s = stats.select("user_id", "community_id")
    if community is not None:
        s = s.where(F.col("community_id") == community)
    out = actions.join(s, "user_id")
    return out.join(users.select("user_id").distinct(), "user_id", "left_semi") if users is not None else out


def append_rows(rows: DataFrame, name: str, **options: str) -> None:
    """Insert in batches, one connection a task; a failed task is tried again by Spark."""
    rows.write.format("jdbc").mode("append").options(**{**connection(rows.sparkSession), "dbtable": name, "batchsize": str(BATCH_ROWS), **options}).save()
