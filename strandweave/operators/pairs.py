"""Preference pairs of candidates from their rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.numbers import candidate_source


def preference_pairs(
    reward: DataFrame, keys: list[str], *, n_candidates: int = C.CANDIDATES, tau_plus: float = C.TAU_PLUS, tau_minus: float = C.TAU_MINUS, delta: float = C.DELTA, abs_delta: float = C.ABS_DELTA
) -> DataFrame:
    """(keys, chosen, rejected, margin, pair_rule, sources) of all pairs that rule A or rule B allows.

    Rule A (tau_delta): chosen above ``tau_plus``, rejected below ``tau_minus``, margin above
    ``delta``. Rule B (abs_delta): opposite signs and a gap above ``abs_delta``; a pair of both
    rules belongs to A. One aggregation by the keys and no join: a key has at most
    ``n_candidates`` rows, so a user contributes a bounded number of pairs, however many
    actions they have.
    """
    rows = reward.groupBy(*keys).agg(F.collect_list(F.struct("cand", "r_all")).alias("_c"))
    rows = rows.select(*keys, F.filter("_c", lambda x: x["r_all"] < 0).alias("_lo"), F.explode(F.filter("_c", lambda x: x["r_all"] > 0)).alias("_hi"))
    rows = rows.select(*keys, "_hi", F.explode("_lo").alias("_l"))
    rows = rows.select(*keys, F.col("_hi.cand").alias("chosen"), F.col("_hi.r_all").alias("r_hi"), F.col("_l.cand").alias("rejected"), F.col("_l.r_all").alias("r_lo"))
    gap = F.col("r_hi") - F.col("r_lo")
    rule_a = (F.col("r_hi") > tau_plus) & (F.col("r_lo") < tau_minus) & (gap > delta)
    df = rows.withColumn("pair_rule", F.when(rule_a, F.lit("tau_delta")).when(gap > abs_delta, F.lit("abs_delta"))).where("pair_rule is not null")
    n = F.lit(n_candidates)
    return df.select(
        *keys, "chosen", "rejected", "pair_rule", gap.alias("margin"),
        candidate_source(F.col("chosen"), n).alias("chosen_source"), candidate_source(F.col("rejected"), n).alias("rejected_source"),
    )


def pair_distribution(pairs: DataFrame) -> DataFrame:
    """(user_id, num_pairs, round_pair_distribution): the number of pairs of each round as a map."""
    per = pairs.groupBy("user_id", "round_idx").agg(F.count(F.lit(1)).cast("int").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("round_idx", "n")))
    return per.groupBy("user_id").agg(
        F.sum("n").alias("num_pairs"), F.map_from_entries(F.transform(entries, lambda e: F.struct(F.concat(F.lit("round_"), e["round_idx"].cast("string")), e["n"]))).alias("round_pair_distribution")
    )
