"""Joins and aggregates that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelspark.session import cut_lineage

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], hot_rows: int = HOT_ROWS, counts: DataFrame | None = None,
    keep_salt: bool = False,
) -> DataFrame:
    """Inner equi-join that spreads keys with more than ``hot_rows`` big-side rows.

    Rows of a hot key are split by a hash of ``spread_by`` (columns that tell the
    rows of one key apart), and only the small side's rows of those keys are
    repeated per part; cold keys pay nothing and the big side is shuffled once.
    The salt is a pure function of the row, so a recomputed task places it the
    same way. A key is hot above ``hot_rows`` rows or a ``MAX_HOT_KEYS``-th of all
    rows, whichever is more: so there are fewer hot keys than that, which bounds
    the broadcast, and every one of them is salted. ``counts`` are the big side's
    rows per key as column ``_n``, where the caller has them. ``keep_salt`` leaves the part's number as ``_salt``:
    rows equal in ``keys`` and ``_salt`` are in one task, so grouping by these and more columns needs no shuffle.
    """
    counts = counts if counts is not None else big.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = (
        counts.filter((F.col("_n") > hot_rows) & (F.col("_n") * MAX_HOT_KEYS > total))
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        big.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts"))
    right = (
        small.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts"))
    met = left.join(right, [*keys, "_salt"])
    return met if keep_salt else met.drop("_salt")


def top_rows(
    df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank", spread_by: list[str] | None = None
) -> DataFrame:
    """First ``k`` rows per group with their rank.

    A row_number filter is planned with a per-task limit ahead of the shuffle,
    so at most ``k`` rows per group and task reach the final sort. The planner
    does this for k up to 1000; for more, name ``spread_by`` columns and the
    group is first cut down in 64 hashed parts.
    """
    if spread_by and k > 1000:
        part = Window.partitionBy(*groups, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.lit(64)))
            .withColumn("_pre", F.row_number().over(part)).filter(F.col("_pre") <= k).drop("_part", "_pre"))
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def _scaled(value: Column) -> Column:
    """Monotone position of a double; one unit is about 0.2 % of its size."""
    return F.signum(value) * F.log1p(F.abs(value)) * F.lit(512.0)


def grouped_median(df: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group without bringing a group into one task.

    Two rounds of bucket counts narrow each group down to the slice that holds the
    middle ranks, and only that slice is shuffled and sorted. The rows are read for each
    round, the buckets found are stored. Even counts give the mean of the two middle values.
    """
    df = df.select(*groups, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    position = _scaled(F.col("_v"))
    rows = df.withColumn("_b1", F.floor(position)).withColumn(
        "_b2", F.floor((position - F.floor(position)) * F.lit(4096.0)))

    def locate(level: DataFrame, keys: list[str], by: str) -> DataFrame:
        """Buckets that hold a middle rank; ranks are relative to ``keys``."""
        window = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        level = level.withColumn("_cum", F.sum("_c").over(window))
        before = F.col("_cum") - F.col("_c")
        return (
            level.withColumn("_l", F.col("_lo") - before).withColumn("_h", F.col("_hi") - before)
            .filter(((F.col("_l") >= 1) & (F.col("_l") <= F.col("_c"))) | ((F.col("_h") >= 1) & (F.col("_h") <= F.col("_c")))))

    first = rows.groupBy(*groups, "_b1").agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(*groups))
    first = first.withColumn("_lo", F.floor((total + 1) / 2)).withColumn("_hi", F.floor(total / 2) + 1)
    # stored, the tables of buckets have a known size: small ones go to the rows
    b1 = cut_lineage(locate(first, groups, "_b1").select(*groups, "_b1", F.col("_l").alias("_lo"), F.col("_h").alias("_hi")))

    second = rows.join(b1, [*groups, "_b1"]).groupBy(*groups, "_b1", "_b2", "_lo", "_hi").agg(F.count("*").alias("_c"))
    b2 = cut_lineage(locate(second, [*groups, "_b1"], "_b2").select(
        *groups, "_b1", "_b2", F.col("_l").alias("_lo"), F.col("_h").alias("_hi")))

    slice_ = rows.join(b2, [*groups, "_b1", "_b2"]).groupBy(*groups, "_b1", "_b2", "_lo", "_hi", "_v").agg(F.count("*").alias("_c"))
    values = locate(slice_, [*groups, "_b1", "_b2"], "_v")

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= 1) & (F.col(rank) <= F.col("_c")), F.col("_v")))

    return values.groupBy(*groups).agg(((at("_l") + at("_h")) / 2.0).alias(name))
