"""Rank statistics over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from parcelspark.session import cut_lineage


def rank_auc(scored: DataFrame, groups: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(groups, n, n_positive, auc): the exact area under the ROC curve by the rank sum, ties counted half.

    Equal scores of a group are counted first. The counts are dealt by ranges of (group, score), every range is
    summed up on its own and then moved by the negatives of the group in the ranges before it, so that no
    task holds a group. ``auc`` is null where a group has one class only; rows with a null score or label are left out.
    """
    value = F.col(score).cast("double")
    positive = F.col(label).cast("double") > 0.5
    counts = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*groups, value.alias("_s")).agg(
        F.count(F.when(positive, 1)).alias("_pos"), F.count(F.when(~positive, 1)).alias("_neg"))
    # written, as the place of a row must not change between the two readings
    dealt = cut_lineage(counts.repartitionByRange(*groups, "_s").withColumn("_p", F.spark_partition_id()))
    earlier = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = dealt.groupBy(*groups, "_p").agg(F.sum("_neg").alias("_n")).select(
        *groups, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    below = Window.partitionBy(*groups, "_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_below", F.coalesce(F.sum("_neg").over(below), F.lit(0))).join(ranges, [*groups, "_p"])
    # doubled, so that ties stay whole numbers
    won = F.sum((F.col("_pos") * (2 * (F.col("_start") + F.col("_below")) + F.col("_neg"))).cast("decimal(38,0)"))
    return placed.groupBy(*groups).agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n"), F.sum("_pos").alias("n_positive"),
        F.try_divide(won.cast("double"), 2.0 * F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias("auc"))
