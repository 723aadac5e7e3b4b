"""F, L and Q of predictions against the actions that happened; rewards of candidate personas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import texts
from ..functions.numbers import quality


def match(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions beside the actions of the same user, window and position; a prediction delivered twice counts once."""
    p = predictions.dropDuplicates(["user_id", "community_id", "method", "persona_id", "window_idx", "wpos", "pred_type", "pred_content", "semantic_similarity"])
    a = actuals.select("user_id", "window_idx", "wpos", "action_type", "action_text", "target")
    return p.join(a, ["user_id", "window_idx", "wpos"])


def decision_f1(pred: Column, actual: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the classes' F1 over rows whose labels are both known; a class that does not occur has 0."""
    weights = weights or C.ACTION_WEIGHTS
    known = pred.isin(*weights) & actual.isin(*weights)
    total = F.lit(0.0)
    for label, w in weights.items():
        tp = F.count_if(known & (pred == label) & (actual == label))
        fp = F.count_if(known & (pred == label) & (actual != label))
        fn = F.count_if(known & (pred != label) & (actual == label))
        total = total + F.lit(w) * F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))
    return total / F.lit(float(sum(weights.values())))


def content_similarity(similarity: Column, pred: Column, actual_type: Column, actual_text: Column) -> Column:
    """Mean similarity of posts and replies with both texts; rows without a similarity are left out; none gives 0."""
    usable = actual_type.isin("post", "reply") & (texts.text(pred) != "") & (texts.text(actual_text) != "")
    return F.coalesce(F.avg(F.when(usable, F.nanvl(similarity, F.lit(None).cast("double")))), F.lit(0.0))


def score(matched: DataFrame, keys: list[str], *, alpha: float = C.ALPHA, parser: str = "exact", unit: bool = False) -> DataFrame:
    """(keys, n, f, l, q) and, if ``matched`` has it, ``error``. ``parser`` reads labels: ``substring_ordered`` or ``exact``.

    A key with an error in any of its rows has that error (the first in text order) and null scores.
    """
    read = texts.parse_action_type if parser == "substring_ordered" else texts.exact_action_type
    df = matched.withColumn("_p", read(F.col("pred_type"))).withColumn("_a", texts.exact_action_type(F.col("action_type")))
    failed = [F.min(F.nullif(F.col("error"), F.lit(""))).alias("error")] if "error" in matched.columns else []
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), decision_f1(F.col("_p"), F.col("_a")).alias("f"),
        content_similarity(F.col("semantic_similarity"), F.col("pred_content"), F.col("_a"), F.col("action_text")).alias("l"), *failed,
    )
    out = out.withColumn("q", quality(F.col("f"), F.col("l"), alpha, unit))
    if failed:
        out = out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("f", "l", "q")})
    return out


def rewards(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cand, r_pre, r_cur, r_fut, r_all) from (keys, cand, w, q): candidate 0 is the baseline, a missing window counts 0.

    One aggregation by the keys: a key has a baseline and a few candidates in three windows.
    """
    rows = scores.groupBy(*keys).agg(F.collect_list(F.struct("cand", "w", "q")).alias("_s"))
    of = lambda cand, w: F.coalesce(F.array_max(F.transform(F.filter("_s", lambda x: (x["cand"] == cand) & (x["w"] == w)), lambda x: x["q"])), F.lit(0.0))
    base = F.filter("_s", lambda x: x["cand"] == 0)
    rows = rows.where(F.size(base) > 0).withColumns({f"_b{w}": of(F.lit(0), F.lit(w)) for w in range(3)})
    rows = rows.withColumn("_c", F.explode(F.array_distinct(F.transform(F.filter("_s", lambda x: x["cand"] > 0), lambda x: x["cand"]))))
    df = rows.select(*keys, (F.col("_c") - 1).alias("cand"), *[(of(F.col("_c"), F.lit(w)) - F.col(f"_b{w}")).alias(n) for w, n in enumerate(("r_pre", "r_cur", "r_fut"))])
    return df.withColumn("r_all", F.col("r_pre") + F.col("r_cur") + F.col("r_fut"))


def best_candidate(reward: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the highest reward of each key, the first of equals (candidates of a key are few by construction)."""
    by = Window.partitionBy(*keys).orderBy(F.col("r_all").desc(), F.col("cand"))
    return reward.withColumn("_r", F.row_number().over(by)).where("_r = 1").select(*keys, F.col("cand").alias("best_cand"), F.col("r_all").alias("best_r_all"))


def gate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, improved): whether any candidate is strictly better than the baseline in the middle window."""
    mid = scores.where("w = 1")
    return mid.groupBy(*keys).agg((F.max(F.when(F.col("cand") > 0, F.col("q"))) > F.max(F.when(F.col("cand") == 0, F.col("q")))).alias("improved"))
