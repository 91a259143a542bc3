"""Ranks within few large groups, without one task for each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: str, value: Column, order: list[str], parts: int = 64, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with rank (from 1, in order of ``value``, then ``order``) and group_rows within each ``group``.

    Approximate quantiles of the value cut a group into ranges; rows are counted by
    range and ranked within it, so that a group of any size is dealt to many tasks.
    Equal values lie in one range. ``value`` is a number and not null. The
    rows are read three times, for cuts, sizes and ranks: ``keep``, if given, writes them once.
    """
    x = df.withColumn("_value", value.cast("double"))
    x = keep(x) if keep else x
    cuts = x.groupBy(group).agg(F.percentile_approx("_value", F.array(*(F.lit(k / parts) for k in range(1, parts))), 1000).alias("_cuts"))
    x = x.join(cuts, group).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_value")))).drop("_cuts")
    sizes = x.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(group, "_range", before.alias("_before"), F.sum("_n").over(whole).alias("group_rows"))
    here = F.row_number().over(Window.partitionBy(group, "_range").orderBy("_value", *order))
    return x.withColumn("_here", here).join(sizes, [group, "_range"]).withColumn("rank", F.col("_before") + F.col("_here")).drop("_value", "_range", "_here", "_before")
