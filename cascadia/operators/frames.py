"""Selections, lookups and checks of tables, as the studies need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scenario(df: DataFrame, level: float, tolerance: float = 0.0, column: str = "co2l") -> DataFrame:
    """Rows of one scenario, by exact level or within a tolerance."""
    return df.where(F.col(column) == level if tolerance == 0 else F.abs(F.col(column) - level) < tolerance)


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows each combination of keys has, where it isn't one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n <> 1")


def snapshots_by(times: DataFrame, wanted: list | None = None, column: str = "snapshot") -> DataFrame:
    """Distinct snapshots: all, those at positions (from 0, negative from the end), or those by label.

    A position beyond the ends or a label that isn't there raises ValueError.
    """
    t = times.select(column).distinct()
    if wanted is None:
        return t
    spark = times.sparkSession
    if all(isinstance(w, int) for w in wanted):
        # One row for each snapshot of one study.
        n = F.count("*").over(Window.partitionBy())
        t = t.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("at"), n.alias("n"))
        asked = spark.createDataFrame([(w,) for w in wanted], "want long")
        found = t.join(asked, F.col("at") == F.when(F.col("want") < 0, F.col("want") + F.col("n")).otherwise(F.col("want"))).select(column)
        kind = None
    else:
        kind = dict(times.dtypes)[column]
        asked = spark.createDataFrame([(str(w),) for w in wanted], "want string").select(F.col("want").cast(kind).alias(column))
        found = t.join(asked.distinct(), column)
    if found.count() != len(set(wanted)):
        raise ValueError("some snapshots aren't there")
    return found


def larger_blackouts(s: DataFrame, least: float, with_shedding: bool = False) -> DataFrame:
    """Splits that lose more than a share of load, in blackouts or in all."""
    return s.where(F.col("lost_load_share_total" if with_shedding else "lost_load_share_blackout") > least)


def least_share(c: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """Components with this share of load at least, or more."""
    return c.where(F.col("load_share") > least if strict else F.col("load_share") >= least)


def subsample(df: DataFrame, keys: list[str], by: str, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows, or a fraction (rounded down), of each group without replacement: those with the smallest hashes of key and seed.

    The draw is the same at every run, whatever the partitions.
    """
    w = Window.partitionBy(by)
    x = df.withColumn("_r", F.row_number().over(w.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)))
    if fraction is not None:
        x = x.withColumn("_n", F.floor(F.count("*").over(w) * fraction))
    return x.where(F.col("_r") <= (F.lit(n) if fraction is None else F.col("_n"))).drop("_r", "_n")


def renamed(df: DataFrame, column: str, names: DataFrame, missing: str | None = None) -> DataFrame:
    """``column`` as its ``nice_name`` in ``names`` (name, nice_name); a name without one stays, or is ``missing``."""
    out = df.join(names.select(F.col("name").alias(column), "nice_name"), column, "left")
    return out.withColumn(column, F.coalesce("nice_name", F.lit(missing) if missing is not None else F.col(column))).drop("nice_name")


def looked_up(df: DataFrame, key: str, table: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with ``value`` of the row of ``table`` whose ``name`` is ``key``; null if there is none."""
    return df.join(table.select(F.col(name).alias(key), value), key, "left")


def without_triggers(s: DataFrame, reinforced: DataFrame) -> DataFrame:
    """Splits neither of whose triggers is among the reinforced edges (column ``edge``)."""
    for k in (0, 1):
        s = s.join(reinforced.select(F.col("edge").alias(f"init_failure_{k}")), f"init_failure_{k}", "left_anti")
    return s


def with_trigger_pair(s: DataFrame, a: int, b: int) -> DataFrame:
    """Splits triggered by these two lines, in either order."""
    return s.where(F.sort_array(F.array("init_failure_0", "init_failure_1")) == F.array(*map(F.lit, sorted((a, b)))))


def spread_labels(unique: DataFrame, rows: DataFrame, vector: str) -> DataFrame:
    """Labels of unique vectors given to all rows with that vector."""
    return rows.join(unique.select(vector, "label"), vector).drop(vector)


def missing_from(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``part`` that ``whole`` lacks: no rows, if it is a subset."""
    return part.select(key).distinct().join(whole, key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both."""
    return a.select(key).intersect(b.select(key))


def same_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with the side: no rows, if both are the same bag."""
    x, y = a.select(columns), b.select(columns)
    return x.exceptAll(y).withColumn("side", F.lit("first")).union(y.exceptAll(x).withColumn("side", F.lit("second")))


def wide(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """One row for each ``row`` and one column for each of ``values``; null where there is no entry (an outer join of series)."""
    return df.groupBy(row).pivot(column, values).agg(F.sum(value))


def long(df: DataFrame, row: str, columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """The inverse of ``wide``: an entry for each value that isn't null."""
    return df.unpivot([row], columns, name, value).where(F.col(value).isNotNull())


def aligned_sum(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two long tables added entry by entry; an entry of one side only counts as it is."""
    return a.select(*keys, value).unionByName(b.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def time_batches(df: DataFrame, time: str, n: int) -> DataFrame:
    """``df`` with batch: n slices of equal duration from the first to the last time; the last time is in the last slice."""
    t = F.unix_timestamp(F.col(time).cast("timestamp"))
    ends = df.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))  # one row
    k = F.floor((t - F.col("_lo")) * n / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)))
    return df.join(F.broadcast(ends)).withColumn("batch", F.least(k, F.lit(n - 1)).cast("int")).drop("_lo", "_hi")


def step_size(times: DataFrame, column: str = "snapshot") -> DataFrame:
    """Median distance of distinct times in seconds, and how many make a day."""
    # One row for each snapshot of one study.
    t = times.select(F.unix_timestamp(F.col(column).cast("timestamp")).alias("t")).distinct()
    gap = t.select((F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("gap")).where("gap is not null")
    return gap.agg(F.percentile("gap", 0.5).alias("seconds")).withColumn("per_day", 86400 / F.col("seconds"))


def nearest_lines(loading: DataFrame, targets: list[float], each: int = 2) -> DataFrame:
    """For each target in turn the lines with the nearest mean loading that no earlier target has taken: target, line, loading.

    ``loading`` has one row for each line; ties go to the smaller line.
    """
    out, left = None, loading.select("line", "loading")
    for t in targets:
        near = left.withColumn("gap", F.abs(F.col("loading") - t)).orderBy("gap", "line").limit(each)
        near = near.select(F.lit(float(t)).alias("target"), "line", "loading")
        out = near if out is None else out.union(near)
        left = left.join(near.select("line"), "line", "left_anti")
    return out


def ratio_histogram(x: DataFrame, ratio: Column, low: float, high: float, n: int) -> DataFrame:
    """Counts of ratios by bin of [low, high): bin, n; -1 counts finite ones outside. Zero and non-finite ratios are left out."""
    r = x.select(ratio.alias("r")).where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf")) & (F.col("r") != 0))
    at = F.floor((F.col("r") - low) / ((high - low) / n))
    inside = (F.col("r") >= low) & (F.col("r") < high)
    return r.groupBy(F.when(inside, F.least(at, F.lit(n - 1))).otherwise(-1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def series_by_kind(g: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Signed power by snapshot of kinds of carriers, each by the parts of names that make it; 0 where there is none."""
    def of(parts: list[str]) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.col("carrier").contains(p)
        return F.coalesce(F.sum(F.when(hit, F.col("p") * F.col("sign"))), F.lit(0.0))

    return g.groupBy("snapshot").agg(*(of(v).alias(k) for k, v in kinds.items()))
