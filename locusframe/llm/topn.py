"""Top N rows of every group, however large a group is.

Score histograms of the groups that hold a noticeable share of all rows give a lower threshold that
at least N different items pass; rows below it are dropped at the scan.  What is left is made one row for
each repeated one, then ranked exactly with tie keys.  Groups below that share can't make a task large, so
their rows go to the ranking as they are, and Spark's window group limit cuts them again before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is heavy from one part in this many of all rows; so there are never more heavy groups than this.
HEAVY_PARTS = 20_000
#: Edges of a group's bins: the shares of its rows below them, denser to the top, and how exact they are.
EDGES = [1 - 0.5**i for i in range(1, 11)]
ACCURACY = 2000


def _of_groups(df: DataFrame, listed: DataFrame, group: list[str], how: str) -> DataFrame:
    """``df`` with the other columns of ``listed``, at most HEAVY_PARTS groups, by null-safe equality."""
    named = listed.withColumnsRenamed({g: f"_k{i}" for i, g in enumerate(group)})
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)))
    return df.join(F.broadcast(named), same, how).drop(*[f"_k{i}" for i in range(len(group))])


def score_floors(df: DataFrame, group: list[str], score: str, item: str, n: int, heavy_parts: int = HEAVY_PARTS) -> DataFrame | None:
    """Of each heavy group a score that at least ``n`` different items reach, as ``_floor``.

    ``df`` has no null group or unusable score.  The bins of a group lie between quantiles of its own scores,
    so outliers and narrow ranges leave them alike full.  A bin holds one bit for each of 64 hash slots of
    the item, so that repeated items never count twice: the bits set are at most the different items.
    None if there is nothing to cut.
    """
    total = df.count()
    if not total:
        return None
    least = max(8 * n, -(-total // heavy_parts))
    heavy = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    used = df.select(*group, score, item)
    edges = _of_groups(used, heavy, group, "left_semi").groupBy(*group).agg(F.percentile_approx(score, F.array(*map(F.lit, EDGES)), F.lit(ACCURACY)).alias("_edges"))
    number = reduce(lambda a, b: a + b, ((F.col(score) >= F.col("_edges")[i]).cast("int") for i in range(len(EDGES))))
    slot = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(item), F.lit(64)).cast("int"))
    edge = F.when(number > 0, F.col("_edges")[number - 1]).otherwise(F.lit(float("-inf")))
    counted = _of_groups(used, edges, group, "inner").select(*group, edge.alias("_edge"), slot.alias("_slot")).groupBy(*group, "_edge").agg(F.bit_count(F.bit_or("_slot")).alias("_items"))
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("_edge", "_items"))))
    start = F.struct(F.lit(0).alias("seen"), F.lit(float("-inf")).alias("floor"))
    walk = F.aggregate(
        falling,
        start,
        lambda a, x: F.when(a["seen"] >= n, a).otherwise(F.struct((a["seen"] + x["_items"]).cast("int").alias("seen"), x["_edge"].alias("floor"))),
        lambda a: F.when(a["seen"] >= n, a["floor"]).otherwise(F.lit(float("-inf"))),
    )
    return counted.groupBy(*group).agg(walk.alias("_floor"))


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], item: str, n: int, rank: str = "rank_no", heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """``item`` and its ``rank`` for the ``n`` items of each group with the highest score.

    Equal scores rank by ``ties`` ascending (nulls last), then by ``item``.  Rows with a null in the
    last column of ``group``, or with a null or NaN score, aren't ranked; nulls in the other group
    columns make groups of their own; -0.0 counts as 0.0 and infinities rank as such.  Rows that
    repeat an item with the same values count once.  Fewer than ``n`` items: all of them.  An empty
    table gives no rows; columns that aren't named are never read.
    """
    used = list(dict.fromkeys([*group, score, *ties, item]))
    kept = df.select(*used).filter(F.col(group[-1]).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).withColumn(score, F.col(score).cast("double") + F.lit(0.0))
    floors = score_floors(kept, group, score, item, n, heavy_parts)
    if floors is not None:
        kept = _of_groups(kept, floors, group, "left").filter(F.col("_floor").isNull() | (F.col(score) >= F.col("_floor"))).drop("_floor")
    # copies of one row go before they could meet in the task of their group
    once = kept.distinct()
    order = Window.partitionBy(*group).orderBy(F.desc(score), *[F.col(t).asc_nulls_last() for t in ties], F.col(item).asc_nulls_last())
    ranked = once.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)
    return ranked.select(item, F.col(rank).cast("int").alias(rank))
