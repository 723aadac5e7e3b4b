"""The text block of differences between predicted and actual actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import texts


def _core(scenario: Column) -> Column:
    """A scenario without blank lines and without a first line in brackets, for comparison."""
    lines = F.filter(F.transform(F.split(scenario, "\n"), texts.strip), lambda x: x != "")
    head = F.try_element_at(lines, F.lit(1))
    bracketed = head.startswith("[") & head.endswith("]")
    return F.array_join(F.when(bracketed, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), "\n")


def discrepancy_blocks(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, discrepancies): one text per key from predictions beside actions (columns of ``scoring.match``).

    Posts and replies always give a text block (with the similarity, if known); a different
    type gives a decision block. Equal blocks are kept once, numbered after that, in order of
    position. A key without blocks gets the fixed sentence. A key is one window of one
    persona, so its rows are few.
    """
    a = F.struct(*[F.col(c) for c in ("action_type", "action_text", "target")])
    kind, pred = F.coalesce("action_type", F.lit("unknown")), F.coalesce("pred_type", F.lit("unknown"))
    said, body, target = texts.text("pred_content"), texts.text("action_text"), texts.text("target")
    shown = lambda c: F.when(c != "", texts.cut(c, 200)).otherwise(F.lit("(empty)"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    sim = F.nanvl(F.col("semantic_similarity"), F.lit(None).cast("double"))
    actual_full = F.when(kind == "reply", body).otherwise(texts.first_of(body, target))
    scene = texts.content_scenario_short(a)
    scene = F.when(sim.isNotNull() & (said != "") & (actual_full != ""), F.concat(scene, F.lit(" [Similarity: "), F.format_string("%.3f", sim), F.lit("]"))).otherwise(scene)
    block = lambda n, s, o, p, q: F.struct(F.lit(n).alias("part"), s.alias("scene"), o.alias("object"), p.alias("pred"), q.alias("actual"))
    written = F.when(kind.isin("post", "reply"), block(0, F.concat(F.lit("[TEXT_GENERATION] "), scene), F.lit(""), quoted(shown(said)), quoted(shown(actual_full))))
    context = F.when((kind == "reply") & (target != ""), F.concat(F.lit('Reply context: "'), texts.cut(target, 200), F.lit('"\n'))).when(
        kind.isin("post", "like", "repost") & (texts.first_of(target, body) != ""), F.concat(F.lit('Content: "'), texts.cut(texts.first_of(target, body), 150), F.lit('"\n'))
    )
    chosen = F.when(pred != kind, block(1, F.concat(F.lit("[DECISION_ONLY] "), texts.decision_scenario_short(a)), F.coalesce(context, F.lit("")), pred, kind))
    rows = matched.select(*keys, "wpos", F.explode(F.array_compact(F.array(written, chosen))).alias("b"))
    signature = F.struct(_core(F.col("b.scene")), texts.strip(F.col("b.object")), texts.strip(F.col("b.pred")), texts.strip(F.col("b.actual")))
    rows = rows.withColumn("_core", signature)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_core").orderBy("wpos", "b.part"))).where("_r = 1")
    first = first.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("wpos", "b.part")))
    line = F.concat(F.lit("Scenario ["), F.col("_i").cast("string"), F.lit("]: "), F.col("b.scene"), F.lit("\n"), F.col("b.object"), F.lit("Predicted action: "), F.col("b.pred"), F.lit("\nActual action: "), F.col("b.actual"), F.lit("\n"))
    got = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", line.alias("t")))).alias("_l")).select(*keys, F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("discrepancies"))
    return matched.select(*keys).distinct().join(got, keys, "left").withColumn("discrepancies", F.coalesce("discrepancies", F.lit(C.NO_DISCREPANCY)))
