"""Exact ranks inside pools: average-rank quantiles, nearest-rank threshold, shortlist. One form for pools of any size.

Rows are sorted over many tasks by pool and value: the task borders follow the data, so a pool that holds most rows, or values
of any size and spread, are cut into even runs. The sorted rows are written, which fixes the runs for every later
step; a place is the place in its run plus the sizes of the pool's runs before. Only those sizes, one row per pool and run,
meet in one place. Quantiles and thresholds are found on counts per value, shortlists on the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revmatch.functions.numeric import round_half_even
from revmatch.schemas import PAPER
from revmatch.session import materialize

# A value tied this often is looked up by broadcast; by count there are few of them.
TIE_LIMIT = 2_000_000


def _before(partition: list[str], order: str):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def sorted_runs(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows written in the order of ``keys`` and ``order``; ``_at`` rises with it and ``_run`` tells the task."""
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed, "sorted").withColumn("_run", F.shiftright("_at", 33))


def _runs(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Per pool and run: its first ``_at``, and the pool's weight in the runs before and in all."""
    sizes = rows.groupBy(*keys, "_run").agg(F.min("_at").alias("_first"), F.sum(weight).alias("_size"))
    return sizes.select(
        *keys, "_run", "_first", F.coalesce(F.sum("_size").over(_before(keys, "_run")), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("n"))


def cumulative(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``n`` (rows of the pool) to counts per value."""
    rows = sorted_runs(counts, keys, F.col(value))
    inside = F.coalesce(F.sum("cnt").over(_before([*keys, "_run"], "_at")), F.lit(0))
    return (
        rows.withColumn("_inside", inside).join(_runs(rows, keys, F.col("cnt")), [*keys, "_run"])
        .withColumn("below", F.col("_before") + F.col("_inside"))
        .select(*counts.columns, "below", "n")
    )


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], ties: str = "cnt", limit: int = TIE_LIMIT) -> DataFrame:
    """Bring columns of a table with unique keys back to the rows it was counted from.

    Keys tied more than ``limit`` times go by broadcast: there are at most rows/limit of them.
    All others are shuffled, with at most ``limit`` rows per key.
    """
    heavy = F.broadcast(table.filter(F.col(ties) > limit).drop(ties))
    light = table.filter(F.col(ties) <= limit).drop(ties)
    return (
        rows.join(heavy, keys, "left_anti").join(light, keys)
        .unionByName(rows.join(heavy, keys))
    )


def _quantile(below: Column, ties: Column, n: Column) -> Column:
    return (below + (ties - 1) / F.lit(2.0) + F.lit(0.5)) / n


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("cnt"))


def quantile_table(counts: DataFrame, keys: list[str], value: str, out: str = "q") -> DataFrame:
    """Quantile per distinct value, from counts per value."""
    ranked = cumulative(counts, keys, value)
    return ranked.select(*keys, value, "cnt", _quantile(F.col("below"), F.col("cnt"), F.col("n")).alias(out))


def quantile(df: DataFrame, keys: list[str], value: str, out: str = "q", tie_limit: int = TIE_LIMIT) -> DataFrame:
    """Average-rank quantile of every row in its pool. The rows are read more than once: hand over a written table."""
    table = quantile_table(value_counts(df, keys, value), keys, value, out)
    return lookup(df, table, [*keys, value], limit=tie_limit).select(*df.columns, out)


def threshold_index(n: Column, positive_frac: float) -> Column:
    at = round_half_even(F.lit(1.0 - positive_frac) * n).cast("bigint")
    return F.least(F.greatest(at, F.lit(0)), n - 1)


def threshold_table(counts: DataFrame, keys: list[str], value: str, positive_frac: float) -> DataFrame:
    """Threshold, smallest and largest value per pool, from counts per value; one row per pool."""
    ranked = cumulative(counts, keys, value)
    at = threshold_index(F.col("n"), positive_frac)
    holds = (F.col("below") <= at) & (at < F.col("below") + F.col("cnt"))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(holds, F.col(value))).alias("tau"), F.min(value).alias("v_min"), F.max(value).alias("v_max"))


def first(df: DataFrame, keys: list[str], value: str, size: Column, out: str) -> DataFrame:
    """Flag the ``size`` rows of each pool with the largest value, ties by submission id."""
    rows = sorted_runs(df, keys, F.desc(value), F.col(PAPER))
    starts = _runs(rows, keys, F.lit(1)).drop("n")
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return rows.join(starts, [*keys, "_run"]).withColumn(out, place < size).select(*df.columns, out)


def topk_per_group(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k largest per group. The limit is applied per task before the shuffle, so a hot group stays small."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)).cast("bigint")
    return df.withColumn("place", place).filter(F.col("place") <= k)


