"""Fragment-and-replicate grid.

A pool is cut into row fragments of submissions and column fragments of papers. Each side
is placed in its own fragment and copied to every fragment of the other side, so each
(submission, paper) combination meets in exactly one cell. The size of a cell is bounded by
the two fragment sizes, whatever share of all rows one round or one reviewer holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["cell_row", "cell_col"]


def fragments(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / F.lit(float(size))), F.lit(1)).cast("int")


def cell_tasks(sizes: DataFrame, n_rows: Column, n_cols: Column, rows: int, cols: int) -> int:
    """Number of tasks for a grid: one per cell, between one and 16 times the shuffle partitions.

    ``sizes`` is a small table with one row per pool. Few cells per task keep its sums in cache
    and the load even. A stated number also keeps adaptive execution from merging cells, which
    are small in bytes but long in work. Fewer tasks than shuffle partitions would make the
    planner shuffle again for the join.
    """
    cells = fragments(n_rows, rows).cast("bigint") * fragments(n_cols, cols)
    total = sizes.agg(F.sum(cells)).first()[0] or 1
    partitions = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(total, 16 * partitions))


def own(ids: list[str], count: Column, size: int) -> Column:
    """Fragment an item belongs to, by hash of its identity (stable under recomputation)."""
    return F.pmod(F.xxhash64(*ids), fragments(count, size).cast("bigint")).cast("int")


def all_of(count: Column, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), fragments(count, size) - 1))


def place_rows(df: DataFrame, ids: list[str], n_rows: Column, n_cols: Column, rows: int, cols: int) -> DataFrame:
    return df.withColumn("cell_row", own(ids, n_rows, rows)).withColumn("cell_col", all_of(n_cols, cols))


def place_cols(df: DataFrame, ids: list[str], n_rows: Column, n_cols: Column, rows: int, cols: int) -> DataFrame:
    return df.withColumn("cell_col", own(ids, n_cols, cols)).withColumn("cell_row", all_of(n_rows, rows))


def top_values(values: Column, k: int) -> Column:
    """Largest k of an array, in falling order."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def merge_tops(arrays: Column, k: int) -> Column:
    return top_values(F.flatten(arrays), k)


def top_mean(top: Column, k: Column) -> Column:
    """Mean over k places; places without a value count as 0."""
    return F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x) / k
