"""Reports by community, method and step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("error"), F.lit("")) == "") if "error" in rows.columns else rows


def by_community(scores: DataFrame) -> DataFrame:
    """(community_id, method, window_idx, n, mean_q): the mean over known scores, null where there are none."""
    return without_errors(scores).groupBy("community_id", "method", "window_idx").agg(F.count(F.lit(1)).alias("n"), F.avg(F.nanvl("q", F.lit(None).cast("double"))).alias("mean_q"))


def by_method(scores: DataFrame) -> DataFrame:
    """(method, users, mean_q, mean_q_chain): means over users of their mean, and of their mean after the first window; none gives 0."""
    ok = without_errors(scores)
    per = ok.groupBy("method", "user_id").agg(F.avg("q").alias("mq"), F.avg(F.when(F.col("window_idx") > 0, F.col("q"))).alias("mc"))
    return per.groupBy("method").agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.avg("mq"), F.lit(0.0)).alias("mean_q"), F.coalesce(F.avg("mc"), F.lit(0.0)).alias("mean_q_chain"))


def by_step(scores: DataFrame) -> DataFrame:
    """(method, step_index, n, f, l, q): means by step of the chain."""
    return without_errors(scores).groupBy("method", F.col("window_idx").alias("step_index")).agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("f"), F.avg("l").alias("l"), F.avg("q").alias("q"))


def first_step(steps: DataFrame, array: str, index: int, field: str = "target_window") -> DataFrame:
    """Adds ``label``: the ``field`` of the first step with ``index`` in an array of steps."""
    return steps.withColumn("label", F.try_element_at(F.filter(array, lambda s: s["step_index"] == index), F.lit(1))[field])


def run_summary(users: DataFrame, pairs: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    """One row: users, pairs, users with pairs, and the seconds of the run in all and per user (null where not measured)."""
    per = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = users.select("user_id").distinct().join(per, "user_id", "left")
    took = F.lit(elapsed_s).cast("double")
    one = total.agg(F.count(F.lit(1)).alias("total_users"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_pairs"), F.count_if(F.col("n") > 0).alias("users_with_pairs"))
    return one.withColumn("elapsed_seconds", took).withColumn("avg_user_elapsed_seconds", F.try_divide(took, F.col("total_users")))
