"""The pN_ queries of the general operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entity_features import NULL_TYPE, entity_features, vocabulary_table
from ..operators.moments import minute_text, resolve_minutes
from ..operators.tree_aggregate import key_positions, key_totals
from ..sources import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "actions").select("ingest_seq", "date", "timestamp", "feed")
    got = resolve_minutes(rows, table(spark, d, "feeds"))
    return got.where("utc_min is not null").select("ingest_seq", minute_text(F.col("utc_min")).alias("utc_minute"))


def p6_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "actions").select("user_id", "action_type", "date", "timestamp", "feed")
    got = resolve_minutes(rows, table(spark, d, "feeds")).select("user_id", "action_type", "utc_min")
    return entity_features(got, entity="user_id", type_="action_type", moment="utc_min")


def p6_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The same features with the arrival number as the moment, which SQL can say too."""
    got = entity_features(table(spark, d, "actions").select("user_id", "action_type", "ingest_seq"), entity="user_id", type_="action_type", moment="ingest_seq")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ").alias(c)
    return got.select("user_id", "n_total", "n_types", F.col("first_min").alias("first_seq"), F.col("last_min").alias("last_seq"), F.col("since_min").alias("since_seq"), said("n"), said("since"))


def p6_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_table(table(spark, d, "actions"), "action_type").withColumn("type", F.when(F.col("type") != NULL_TYPE, F.col("type")))


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return key_positions(table(spark, d, "actions").select("ingest_seq", "user_id", "community_id"), ["user_id", "community_id"])


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    return key_totals(table(spark, d, "actions").select("ingest_seq", "user_id", "community_id"), ["user_id", "community_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p6_features": p6_features,
    "p6_arrivals": p6_arrivals,
    "p6_vocabulary": p6_vocabulary,
    "p7_sequences": p7_sequences,
    "p7_totals": p7_totals,
}

_PLACES = "v AS (SELECT action_type AS type, CAST(row_number() OVER (ORDER BY encode(coalesce(action_type, chr(0) || 'null'))) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT action_type FROM actions))"

SQL: dict[str, str] = {
    "p6_vocabulary": f"WITH {_PLACES} SELECT place, type FROM v",
    "p6_arrivals": f"""
        WITH {_PLACES}, e AS (SELECT max(ingest_seq) AS as_of FROM actions),
        c AS (SELECT user_id, action_type, count(*) AS n, max(ingest_seq) AS last FROM actions GROUP BY ALL),
        g AS (SELECT u.user_id, v.place, coalesce(c.n, 0) AS n, e.as_of - c.last AS since
              FROM (SELECT DISTINCT user_id FROM actions) u CROSS JOIN v CROSS JOIN e LEFT JOIN c ON c.user_id = u.user_id AND c.action_type IS NOT DISTINCT FROM v.type),
        l AS (SELECT user_id, string_agg(n::VARCHAR, ' ' ORDER BY place) AS n, string_agg(coalesce(since::VARCHAR, '-'), ' ' ORDER BY place) AS since FROM g GROUP BY user_id)
        SELECT a.user_id, count(*) AS n_total, CAST(count(DISTINCT coalesce(action_type, chr(0) || 'null')) AS INTEGER) AS n_types, min(ingest_seq) AS first_seq, max(ingest_seq) AS last_seq,
               any_value(e.as_of) - max(ingest_seq) AS since_seq, any_value(l.n) AS n, any_value(l.since) AS since
        FROM actions a JOIN l ON l.user_id = a.user_id CROSS JOIN e GROUP BY a.user_id""",
    "p7_sequences": """
        SELECT ingest_seq, user_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ingest_seq) - 1 AS user_id_pos,
               count(*) OVER (PARTITION BY user_id) AS user_id_n,
               community_id,
               CASE WHEN community_id IS NOT NULL THEN row_number() OVER (PARTITION BY community_id ORDER BY ingest_seq) - 1 END AS community_id_pos,
               CASE WHEN community_id IS NOT NULL THEN count(*) OVER (PARTITION BY community_id) END AS community_id_n
        FROM actions""",
    "p7_totals": """
        SELECT 'user_id' AS kind, user_id AS key, count(*) AS n, min(ingest_seq) AS first_seq, max(ingest_seq) AS last_seq
        FROM actions WHERE user_id IS NOT NULL GROUP BY user_id
        UNION ALL
        SELECT 'community_id', community_id, count(*), min(ingest_seq), max(ingest_seq)
        FROM actions WHERE community_id IS NOT NULL GROUP BY community_id""",
}
