"""First or last rows of a key, without gathering a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SALTS = 32


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, *, rank: str = "rn", salt_by: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with ``rank`` from 0.

    Each key is split into ``salts`` groups first and only ``n`` rows of each go on, so a
    task of the second step sees at most ``n * salts`` rows of a key, and one of the first
    a ``salts``-th of it. Spark turns ``row_number() <= n`` into a group limit on both
    sides of the exchange. ``order`` must be total.
    """
    salt = F.pmod(F.xxhash64(*(salt_by or rows.columns)), F.lit(salts))
    local = rows.withColumn("_salt", salt)
    local = local.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")
    return local.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col(rank) < n)


def group_ranks(rows: DataFrame, group: list[str], order: list[Column], *, rank: str = "rn", total: str = "n") -> DataFrame:
    """Exact ``rank`` (from 1) of every row in its group and the group's size, for groups of any size.

    Rows are sorted over all tasks by range; a row's rank is its place in its partition plus
    the rows of the group in earlier partitions, so no task holds a whole group. ``order``
    must be total. Null group values are a group.
    """
    key = F.to_json(F.struct(*[F.col(g) for g in group])) if group else F.lit("")
    placed = rows.withColumn("_g", F.coalesce(key, F.lit("{}"))).repartitionByRange(F.col("_g"), *order).withColumn("_p", F.spark_partition_id())
    # the partition of a row is read twice and must not be drawn again
    placed = cut(placed)
    counts = placed.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy("_g")
    counts = counts.select("_g", "_p", F.coalesce(F.sum("_c").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_c").over(by).alias(total))
    local = placed.withColumn("_l", F.row_number().over(Window.partitionBy("_g", "_p").orderBy(*order)))
    return local.join(counts, ["_g", "_p"]).withColumn(rank, F.col("_l") + F.col("_o")).drop("_g", "_p", "_l", "_o")


def cap_users(users: DataFrame, *, per_community: int | None = None, max_users: int | None = None, cap_order: str = "community_first", order: str = "first_seq") -> DataFrame:
    """At most ``per_community`` users of each community and ``max_users`` in all, in input order.

    ``cap_order`` says which cap comes first: ``community_first`` or ``total_first``.
    """

    def by_community(df: DataFrame) -> DataFrame:
        return first_per_key(df, ["community_id"], [F.col(order), F.col("user_id")], per_community).drop("rn") if per_community else df

    def total(df: DataFrame) -> DataFrame:
        return df.orderBy(order, "user_id").limit(max_users) if max_users else df

    return total(by_community(users)) if cap_order == "community_first" else by_community(total(users))


def sample_users(users: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` users without replacement in a seeded order (all if there are fewer).

    The order is by arithmetic on the id, repeatable anywhere, and not that of another generator.
    """
    mixed = F.pmod(F.pmod(F.col("user_id").cast("bigint"), F.lit(1_000_003)) * F.lit(7919 + 2 * seed) + F.lit(seed * 104_729), F.lit(1_000_003))
    return users.orderBy(mixed, F.col("user_id")).limit(n)


def seeded_below(keys: list[Column], share: float, seed: int = 0) -> Column:
    """A repeatable draw: true for ``share`` of the rows, by integer arithmetic on the keys."""
    mixed = F.lit(seed).cast("bigint")
    for k, prime in zip(keys, (7919, 104729, 1299709, 15485863), strict=False):
        mixed = mixed + F.pmod(k.cast("bigint"), F.lit(1_000_003)) * F.lit(prime)
    return F.pmod(mixed, F.lit(1000)) < F.lit(int(round(share * 1000)))


def trim_tails(rows: DataFrame, value: str, *, group: list[str] | None = None, tail: float = 0.05, sides: str = "both", by: str = "value") -> DataFrame:
    """Rows whose ``value`` is not in the lowest or highest ``tail`` of its group (``sides``: both, lower, upper).

    ``floor(n * tail)`` rows are cut on each chosen side; null values are left out; equal values
    are cut in the order of the other columns. With ``by`` = ``deviation`` the rows farthest from
    the mean of their group are cut: ``floor(n * tail)`` for each chosen side, counting only rows
    on that side of the mean. A group by step gives the trim per step.
    """
    others = [F.col(c) for c in rows.columns if c != value and dict(rows.dtypes)[c] in ("bigint", "int", "string")]
    known = rows.where(F.col(value).isNotNull())
    group = group or []
    if by == "deviation":
        mean = known.groupBy(*group).agg(F.avg(value).alias("_mean"))
        known = known.join(mean, group) if group else known.withColumn("_mean", F.lit(mean.first()[0]).cast("double"))
        known = known.withColumn("_side", F.when(F.col(value) < F.col("_mean"), F.lit("lower")).otherwise(F.lit("upper"))).withColumn("_far", F.round(F.abs(F.col(value) - F.col("_mean")), 12))
        sizes = known.groupBy(*group).agg(F.floor(F.count(F.lit(1)) * F.lit(tail)).alias("_k"))
        ranked = group_ranks(known, [*group, "_side"], [F.col("_far").desc(), *others], rank="_r", total="_n")
        ranked = ranked.join(sizes, group) if group else ranked.withColumn("_k", F.lit(sizes.first()[0]).cast("bigint"))
        cut_side = F.lit(sides == "both") | (F.col("_side") == sides)
        return ranked.where(~cut_side | (F.col("_r") > F.col("_k"))).drop("_mean", "_side", "_far", "_k", "_r", "_n")
    df = group_ranks(known, group, [F.col(value), *others], rank="_r", total="_n")
    k = F.floor(F.col("_n") * F.lit(tail))
    keep = F.lit(True)
    if sides in ("both", "lower"):
        keep = keep & (F.col("_r") > k)
    if sides in ("both", "upper"):
        keep = keep & (F.col("_r") <= F.col("_n") - k)
    return df.where(keep).drop("_r", "_n")
