"""Count windows and calendar windows of users' action sequences."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import times
from ..session import cut
from .ranks import first_per_key, group_ranks

USER = ["user_id"]


def contiguous_windows(actions: DataFrame, *, size: int = C.WINDOW_SIZE, number: int = C.NUM_WINDOWS, order: str = "ingest_seq") -> DataFrame:
    """The first ``number`` windows of ``size`` actions of each user with enough actions, in input order (not by time).

    Adds window_idx and wpos. Only the first ``size * number`` rows of a user are ever
    gathered; the count that decides is aggregated on the map side.
    """
    enough = actions.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= size * number).select("user_id")
    first = first_per_key(actions, USER, [F.col(order)], size * number, salt_by=[order])
    return first.join(enough, "user_id", "left_semi").withColumn("window_idx", F.floor(F.col("rn") / size).cast("int")).withColumn("wpos", F.pmod("rn", F.lit(size)).cast("int")).drop("rn")


def split_stats(actions: DataFrame, *, size: int = C.WINDOW_SIZE, number: int = C.NUM_WINDOWS) -> DataFrame:
    """One row: users in all, kept and skipped by ``contiguous_windows``."""
    per = actions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("total_users"), F.count_if(F.col("n") >= size * number).alias("kept_users"), F.count_if(F.col("n") < size * number).alias("skipped_users"))


def timed(actions: DataFrame) -> DataFrame:
    """Adds action_ts and month_idx by the lenient rules of ``functions.times``."""
    return actions.withColumn("action_ts", times.action_time(F.col("date"), F.col("timestamp"))).withColumn("month_idx", times.month_index(F.col("date"), F.col("timestamp")))


def time_order() -> list[Column]:
    """Order by time (unknown last), then the raw texts, then arrival."""
    return [F.col("action_ts").asc_nulls_last(), F.col("date").asc_nulls_first(), F.col("timestamp").asc_nulls_first(), F.col("ingest_seq")]


def _month_stats(rows: DataFrame, entity: list[str]) -> DataFrame:
    us = times.micros(F.col("action_ts"))
    return rows.where("month_idx is not null").groupBy(*entity, "month_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count("action_ts").alias("n_timed"), F.min(us).alias("t_lo"), F.max(us).alias("t_hi")
    )


def month_chain(rows: DataFrame, *, per_window: int = C.WINDOW_SIZE, months: int = C.CHAIN_MONTHS, per_month: int = 1, entity: list[str] | None = None) -> DataFrame:
    """Per entity the earliest month that starts ``months`` consecutive months with enough timed actions.

    ``rows`` needs action_ts and month_idx. A month counts if it has ``per_window * per_month``
    actions, all with a time, and with two windows a month if both halves of its time span
    have enough. Consecutive months are islands of ``month_idx - row_number``. Columns:
    entity, month_start. Entities without a chain are left out; another ``per_month`` gives none.
    """
    entity = entity or USER
    if per_month not in (1, 2):
        return _month_stats(rows, entity).where(F.lit(False)).select(*entity, F.col("month_idx").alias("month_start"))
    good = _month_stats(rows, entity).where((F.col("n") >= per_window * per_month) & (F.col("n") == F.col("n_timed")))
    if per_month == 2:
        halves = half_months(rows, entity=entity).groupBy(*entity, "month_idx").agg(F.count_if(F.col("half") == 0).alias("a"), F.count_if(F.col("half") == 1).alias("b"))
        good = good.join(halves.where((F.col("a") >= per_window) & (F.col("b") >= per_window)).select(*entity, "month_idx"), [*entity, "month_idx"], "left_semi")
    by = Window.partitionBy(*entity).orderBy("month_idx")
    islands = good.withColumn("_island", F.col("month_idx") - F.row_number().over(by))
    ends = islands.withColumn("_end", F.max("month_idx").over(Window.partitionBy(*entity, "_island")))
    return ends.where(F.col("month_idx") + months - 1 <= F.col("_end")).groupBy(*entity).agg(F.min("month_idx").alias("month_start"))


def half_months(rows: DataFrame, *, entity: list[str] | None = None) -> DataFrame:
    """Adds ``half``: 0 up to the midpoint of the month's first and last action, else 1. Untimed rows are left out."""
    entity = entity or USER
    span = _month_stats(rows, entity).select(*entity, "month_idx", ((F.col("t_lo") + F.col("t_hi")) / 2).alias("_mid"))
    us = times.micros(F.col("action_ts")).cast("double")
    return rows.where("action_ts is not null and month_idx is not null").join(span, [*entity, "month_idx"]).withColumn("half", F.when(us <= F.col("_mid"), 0).otherwise(1)).drop("_mid")


def even_indexes(m: Column, n: int) -> Column:
    """Indexes of ``n`` evenly spaced items of ``m``, rounded half to even; the middle one for n = 1; null if m < n."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i.cast("double") * (m - 1).cast("double") / F.lit(float(max(n - 1, 1))), 0).cast("int"))
    return F.when(m < n, F.lit(None)).otherwise(F.array(F.floor(m / 2).cast("int")) if n == 1 else spread)


def _greedy(times_: list[int], targets: list[float]) -> list[int]:
    """For each target the nearest unused index, the earlier of equals."""
    used: set[int] = set()
    out = []
    for t in targets:
        best = min((i for i in range(len(times_)) if i not in used), key=lambda i: (abs(times_[i] - t), i), default=None)
        if best is None:
            break
        used.add(best)
        out.append(best)
    return sorted(out)


def even_time_sample(rows: DataFrame, groups: list[str], n: int, *, order: list[str], span: str = "t_us") -> DataFrame:
    """``n`` rows of each group, nearest in time to ``n`` evenly spaced points, none twice (the earlier of equals in ``order``).

    ``rows`` has ``span`` (microseconds) and the columns ``order`` (time order, unique in a
    group). Groups with fewer than ``n`` rows give none; if all times are equal, rows are taken
    evenly by place. Only the ``n`` nearest rows of each point are gathered: of these at most
    n - 1 can be used up by other points, so the greedy choice never needs any other row, and
    a task sees at most n * n rows of a group of any size. ``rows`` is read several times: cut it before.
    """
    stats = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_m"), F.min(span).alias("_lo"), F.max(span).alias("_hi")).where(F.col("_m") >= n)
    places = [F.col(c) for c in order]
    spread = rows.join(stats.where("_lo < _hi"), groups)
    near = spread.select("*", F.posexplode(times.even_targets(F.col("_lo"), F.col("_hi"), n)).alias("_i", "_t"))
    near = near.withColumn("_d", F.abs(F.col(span).cast("double") - F.col("_t")))
    near = first_per_key(near, [*groups, "_i"], [F.col("_d"), *places], n, salt_by=order).drop("rn", "_i", "_t", "_d").dropDuplicates([*groups, *order])
    points = near.withColumn("_targets", times.even_targets(F.col("_lo"), F.col("_hi"), n)).drop("_m", "_lo", "_hi")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.iloc[_greedy(pdf[span].tolist(), list(pdf["_targets"].iloc[0]))]

    chosen = points.groupBy(*groups).applyInPandas(choose, points.schema).drop("_targets")
    flat = stats.where("_lo = _hi")
    if flat.isEmpty():
        return chosen
    by_place = group_ranks(rows.join(flat, groups), groups, places, rank="_at", total="_all").where(F.array_contains(even_indexes(F.col("_m"), n), (F.col("_at") - 1).cast("int")))
    return chosen.unionByName(by_place.drop("_at", "_all", "_m", "_lo", "_hi"))


def month_chain_windows(actions: DataFrame, *, per_window: int = C.WINDOW_SIZE, months: int = C.CHAIN_MONTHS, per_month: int = 1) -> DataFrame:
    """Windows of the calendar chain: from each month (or half month) of the chain ``per_window`` actions evenly in time."""
    rows = timed(actions)
    start = month_chain(rows, per_window=per_window, months=months, per_month=per_month)
    inside = rows.join(start, "user_id").where((F.col("month_idx") >= F.col("month_start")) & (F.col("month_idx") < F.col("month_start") + months))
    inside = half_months(inside) if per_month == 2 else inside.withColumn("half", F.lit(0))
    inside = inside.withColumn("window_idx", ((F.col("month_idx") - F.col("month_start")) * per_month + F.col("half")).cast("int"))
    inside = inside.withColumns({"t_us": times.micros(F.col("action_ts")), "_by_date": F.coalesce("date", F.lit("")), "_by_stamp": F.coalesce("timestamp", F.lit(""))})
    order = ["t_us", "_by_date", "_by_stamp", "ingest_seq"]
    got = even_time_sample(cut(inside), ["user_id", "window_idx"], per_window, order=order)
    place = Window.partitionBy("user_id", "window_idx").orderBy(*order)
    return got.withColumn("wpos", (F.row_number().over(place) - 1).cast("int")).drop("_by_date", "_by_stamp", "half")


ACTION_FIELDS = ("ingest_seq", "action_type", "action_text", "original_text", "target", "date", "timestamp")


def nest(windows: DataFrame) -> DataFrame:
    """One row per user and window with its actions as an ordered array (windows are of bounded size)."""
    fields = [c for c in ACTION_FIELDS if c in windows.columns]
    acts = F.array_sort(F.collect_list(F.struct("wpos", *fields)))
    return windows.groupBy("user_id", "window_idx").agg(F.min("community_id").alias("community_id"), acts.alias("actions"))


def window_map(nested: DataFrame) -> DataFrame:
    """One row per user with the map W0, W1, ... (the form of windowed files)."""
    pairs = F.array_sort(F.collect_list(F.struct("window_idx", "actions")))
    keyed = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.concat(F.lit("W"), p["window_idx"].cast("string")), p["actions"])))
    return nested.groupBy("user_id").agg(F.min("community_id").alias("community_id"), keyed.alias("windows"), F.sum(F.size("actions")).cast("int").alias("used_actions"))


def unmap(windowed: DataFrame) -> DataFrame:
    """Long form of windowed records: keys that begin with W, ordered by their number."""
    long = windowed.select("user_id", "community_id", F.explode("windows").alias("key", "actions")).where(F.col("key").rlike("^W[0-9]+$"))
    return long.select("user_id", "community_id", F.substring("key", 2, 9).cast("int").alias("window_idx"), "actions")


def sliding_history(windows: DataFrame, n: int = C.HISTORY) -> DataFrame:
    """Adds ``history``: ingest_seq of the last ``n`` real actions before each action (windows of bounded size)."""
    before = Window.partitionBy("user_id").orderBy("window_idx", "wpos").rowsBetween(-n, -1)
    return windows.withColumn("history", F.collect_list("ingest_seq").over(before))


def fixed_history(nested: DataFrame, n: int = C.HISTORY) -> DataFrame:
    """Adds ``history``: the last ``n`` actions of the previous window, the same for all targets; empty in the first."""
    prev = F.lag("actions").over(Window.partitionBy("user_id").orderBy("window_idx"))
    tail = F.when(F.size(prev) > n, F.slice(prev, -n, n)).otherwise(prev)
    empty = F.slice(F.col("actions"), 1, 0)
    return nested.withColumn("history", F.coalesce(tail, empty))


def triplets(nested: DataFrame, rounds: int = C.ROUNDS) -> DataFrame:
    """(user_id, round_idx, pre, cur, fut): three consecutive windows for each round."""
    by = Window.partitionBy("user_id").orderBy("window_idx")
    df = nested.select("user_id", (F.row_number().over(by) - 1).alias("round_idx"), F.col("window_idx").alias("pre"), F.lead("window_idx", 1).over(by).alias("cur"), F.lead("window_idx", 2).over(by).alias("fut"))
    return df.where(F.col("fut").isNotNull() & (F.col("round_idx") < rounds))


def cumulative(nested: DataFrame) -> DataFrame:
    """Adds ``so_far``: the actions of all windows up to this one."""
    upto = Window.partitionBy("user_id").orderBy("window_idx").rowsBetween(Window.unboundedPreceding, 0)
    return nested.withColumn("so_far", F.flatten(F.collect_list("actions").over(upto)))


def enough_windows(nested: DataFrame, needed: int) -> DataFrame:
    """(user_id, n_windows, error): the error code of users with too few windows, else null."""
    code = "need_" + "_".join(f"W{i}" for i in range(needed))
    return nested.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_windows")).withColumn("error", F.when(F.col("n_windows") < needed, F.lit(code)))


