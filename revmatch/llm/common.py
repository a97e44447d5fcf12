"""What the operators share: reading tables, fold rules, written tables, and ids of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revmatch.session import materialize

ID, TEXT = "doc_id", "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only the id and the whole text; a null text is empty. Other columns, whatever their names, are left behind."""
    return docs.select(F.col(ID).cast("long").alias(ID), F.coalesce(F.col(TEXT).cast("string"), F.lit("")).alias(TEXT))


def fold(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(ID).cast("string"), F.lit(""))) % divisor


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: a cut of the lineage that survives lost executors."""
    return materialize(df, f"llm-{name}")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``, any type with an order: ``node``, ``root`` (its smallest node).

    Alternates large-star and small-star steps until nothing changes; each round is one written table, and
    no node gathers more than its current neighbours as rows (never as a list). Ends in O(log n) rounds as a rule.
    """
    spark = links.sparkSession
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.*").filter("a <> b").distinct(), "links")
        sums = [t.select(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first()
                for t in (edges, after)]
        edges = after
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def placed(df: DataFrame, order: list[str], name: str, group: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by ``group`` and ``order`` over many tasks and written, and where each run of them starts.

    The rows have ``at``, rising in that order, and ``part``. The second table has one row per group and part with
    ``first`` (smallest ``at``), ``rows`` and ``before`` (rows of the group in earlier parts): the place of a row in its
    group is ``at - first + before``. It has as many rows as there are groups and parts, and no task sees a whole group.
    """
    group = group or []
    cut = df.repartitionByRange(*[F.col(c) for c in group + order]) if group + order else df
    rows = written((cut.sortWithinPartitions(*group, *order) if group + order else cut).withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, runs.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
