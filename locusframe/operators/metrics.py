"""Evaluation metrics of scored labels, computed over all rows without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.intervals import carried, range_tiles
from locusframe.session import cut_lineage, write_once


def ranked_scores(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each different score (of each group), falling: n rows, hits among them, and both counted from the top."""
    tally = df.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("hits")).withColumn("_down", -F.col("s"))
    tiles = range_tiles(tally, [*by, "_down"])
    seen = carried(carried(tiles, [*by], ["_down"], F.col("n"), "seen", "sum", inclusive=True), [*by], ["_down"], F.col("hits"), "found", "sum", inclusive=True)
    return seen.drop("_down", "_tile")


def average_precision(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``ap``: the sum over different scores of the recall gained times the precision there; 0 without a true label."""
    r = ranked_scores(df, score, label, by)
    return r.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("hits") * F.col("found") / F.col("seen")), F.sum("hits")), F.lit(0.0)).alias("ap"), F.sum("hits").alias("positives"))


def top_kl(df: DataFrame, score: str, label: str, tie: str, ks: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0), by: tuple[str, ...] = ()) -> DataFrame:
    """For each k (and group, of which there are few): accuracy among the floor(k * true labels) highest scores, and the least score there.

    Equal scores at the cut are taken by rising ``tie``; the accuracy is hits over the smaller of both numbers.
    """
    group = ["_all", *by]
    rows = write_once(df.select(F.lit(0).alias("_all"), *by, F.col(score).alias("s"), F.col(label).alias("_y"), F.col(tie).alias("_tie")))
    r = cut_lineage(ranked_scores(rows, "s", "_y", tuple(group)))
    of = r.groupBy(*group).agg(F.sum("n").alias("total"), F.sum("hits").alias("true"))
    wanted = of.select(*group, "true", F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.least(F.floor(F.lit(float(k)) * F.col("true")), F.col("total")).cast("bigint").alias("taken")) for k in ks])).alias("c"))
    cuts = wanted.select(*group, "true", "c.k", "c.taken")
    at = r.join(F.broadcast(cuts), group).filter((F.col("seen") >= F.col("taken")) & (F.col("seen") - F.col("n") < F.col("taken")))
    edge = at.select(*group, "k", "s", (F.col("found") - F.col("hits")).alias("above"), (F.col("taken") - F.col("seen") + F.col("n")).alias("want"))
    tied = rows.join(F.broadcast(edge), [*group, "s"])
    tiles = range_tiles(tied, [*group, "k", "_tie"])
    placed = carried(tiles, [*group, "k"], ["_tie"], F.lit(1).cast("bigint"), "_place", "sum", inclusive=True)
    some = placed.groupBy(*group, "k").agg(F.count_if(F.col("_y") & (F.col("_place") <= F.col("want"))).alias("there"))
    out = cuts.join(edge, [*group, "k"], "left").join(some, [*group, "k"], "left")
    hits = F.coalesce(F.col("above"), F.lit(0)) + F.coalesce(F.col("there"), F.lit(0))
    return out.select(*by, "k", "taken", F.try_divide(hits, F.least(F.col("taken"), F.col("true"))).alias("accuracy"), F.col("s").alias("threshold"))


def evaluation(points: DataFrame, kind: str, score: str, label: str, tie: str, ks: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """The metrics of each class ``kind`` in one pass: ``top_kl`` beside the class's average precision and number of true labels."""
    rows = write_once(points.select(kind, score, label, tie))
    return top_kl(rows, score, label, tie, ks, (kind,)).join(average_precision(rows, score, label, (kind,)), kind)


def masked_cross_entropy(p_of_label: Column, labelled: Column) -> Column:
    """Mean of -log(p + 1e-10) over the labelled rows: an aggregate."""
    return F.sum(F.when(labelled, -F.log(p_of_label + 1e-10))) / (F.count_if(labelled) + 1e-8)
