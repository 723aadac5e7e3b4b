"""Instruction samples from action sequences, and the persona lookup they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import texts
from .ranks import first_per_key, seeded_below


def recent_actions(actions: DataFrame, stats: DataFrame, n: int = C.SFT_PROFILE_ACTIONS, *, communities: list[int] | None = None) -> DataFrame:
    """The last ``n`` actions of each user who has a community, oldest first, with ``apos`` from 0 and ``n_actions``.

    Gathers at most ``n`` rows of a user; order is by date text and arrival.
    """
    users = stats.where(F.col("community_id").isNotNull())
    if communities:
        users = users.where(F.col("community_id").isin(*communities))
    users = users.select("user_id", F.col("community_id").cast("bigint").alias("community"))
    # salted cut first: the join then meets at most n rows of a user
    last = first_per_key(actions, ["user_id"], [F.col("date").desc_nulls_last(), F.col("ingest_seq").desc()], n, salt_by=["ingest_seq"]).join(users, "user_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return last.withColumn("n_actions", size.cast("int")).withColumn("apos", (F.col("n_actions") - 1 - F.col("rn")).cast("int")).drop("rn")


def lookup_personas(users: DataFrame, cache: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Adds ``profile``: the cached persona of (community, user), else the user's legacy one, else a placeholder."""
    exact = cache.select(F.col("community_id").cast("bigint").alias("community"), "user_id", F.col("profile_text").alias("_exact"))
    df = users.join(exact, ["community", "user_id"], "left")
    old = F.lit(None).cast("string")
    if legacy is not None:
        df = df.join(legacy.select("user_id", F.col("profile_text").alias("_old")), "user_id", "left")
        old = F.col("_old")
    stand_in = F.concat(F.lit("UserID "), F.col("user_id").cast("string"), F.lit(", Community "), F.col("community").cast("string"))
    return df.withColumn("profile", F.coalesce(F.nullif("_exact", F.lit("")), old, stand_in)).drop("_exact", "_old")


def sft_samples(
    actions: DataFrame, stats: DataFrame, cache: DataFrame, *, t: int = C.SFT_T, per_user: int = C.SFT_ACTIONS, decision_share: float = C.SFT_DECISION_SHARE, seed: int = 0, communities: list[int] | None = None
) -> DataFrame:
    """(user_id, community, ingest_seq, sample_kind, Instruction, input, output) for every action with ``t`` before it.

    A post or reply becomes a decision sample for ``decision_share`` of the rows (a repeatable
    draw) and a content sample otherwise; all others become decision samples.
    """
    rows = recent_actions(actions, stats, per_user, communities=communities).where(F.col("n_actions") > t)
    rows = rows.withColumn("target", texts.derive_target(F.col("action_type"), F.col("action_text"), F.col("original_text"), F.col("ingest_seq")))
    act = F.struct(*[F.col(c) for c in ("action_type", "action_text", "original_text", "target", "timestamp")])
    before = Window.partitionBy("user_id").orderBy("apos").rowsBetween(-t, -1)
    rows = rows.withColumn("_a", act).withColumn("_h", F.collect_list("_a").over(before)).where(F.col("apos") >= t)
    draw = seeded_below([F.col("user_id"), F.col("ingest_seq")], decision_share, seed)
    rows = rows.withColumn("_content", F.coalesce(F.col("action_type").isin("post", "reply") & ~draw, F.lit(False)))
    users = stats.where(F.col("community_id").isNotNull()).select("user_id", F.col("community_id").cast("bigint").alias("community")).distinct()
    rows = rows.join(lookup_personas(users, cache), ["user_id", "community"])
    s = texts.sft_sample(F.col("profile"), F.col("_h"), F.col("_a"), F.col("_content"))
    return rows.select("user_id", "community", "ingest_seq", F.when(F.col("_content"), F.lit("content")).otherwise(F.lit("decision")).alias("sample_kind"), s.alias("s")).select("user_id", "community", "ingest_seq", "sample_kind", "s.*")


def sample_counts(samples: DataFrame) -> DataFrame:
    """Samples by real kind, and by the substring test on the whole input (which persona text can mislead)."""
    looks = F.col("input").contains("Write a post") | F.col("input").contains("Comment on")
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("sample_kind") == "content").alias("content"), F.count_if(F.col("sample_kind") == "decision").alias("decision"), F.count_if(looks).alias("content_by_text")
    )
