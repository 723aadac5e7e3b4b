"""Writers of windowed users, pairs, evaluation rows and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import pair_distribution


def write_json(df: DataFrame, path: str, *, by: list[str] | None = None, append: bool = False) -> None:
    """JSON lines in UTF-8, in folders by the columns ``by``."""
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_rows(df: DataFrame, path: str, *, resume: bool = False, by: str | None = "method") -> None:
    """Result rows as Parquet, routed by ``by``; without ``resume`` what was there is replaced."""
    w = df.write.mode("append" if resume else "overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_details_and_pairs(rounds: DataFrame, pairs: DataFrame, out: str, *, resume: bool = False) -> None:
    """Two sinks of a run: a detail row per user with its rounds, and its pairs with what they lack from the user.

    Pairs without a round belong to the first. Rows are appended with ``resume``, else what was there is replaced.
    """
    of_user = [c for c in rounds.columns if c != "user_id"]
    counts = pair_distribution(pairs.withColumn("round_idx", F.coalesce("round_idx", F.lit(1))))
    details = rounds.groupBy("user_id").agg(F.min("community_id").alias("community_id"), F.min("error").alias("error"), F.array_sort(F.collect_list(F.struct("round_idx", *[c for c in of_user if c not in ("round_idx", "community_id", "error")]))).alias("rounds"))
    details = details.join(counts, "user_id", "left").withColumn("num_pairs", F.coalesce("num_pairs", F.lit(0)))
    write_json(details, f"{out}/details", append=resume)
    tagged = pairs.withColumn("round_idx", F.coalesce("round_idx", F.lit(1))).withColumn("round_tag", F.concat(F.lit("round_"), F.col("round_idx").cast("string")))
    if "community_id" not in pairs.columns:
        tagged = tagged.join(rounds.groupBy("user_id").agg(F.min("community_id").alias("community_id")), "user_id")
    write_json(tagged, f"{out}/pairs", append=resume)


def write_personas(personas: DataFrame, out: str, *, resume: bool = False) -> None:
    """Personas of a run by method; without ``resume`` those of before are cleared."""
    write_json(personas, f"{out}/personas", by=["method"], append=resume)


def write_summary(summary: DataFrame, out: str, stem: str) -> None:
    """One row, one file."""
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/summary_{stem}")
