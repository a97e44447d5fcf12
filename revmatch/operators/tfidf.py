"""Sparse text vectors: term counts, vocabulary of the pool, weights, top terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revmatch.functions.text import with_terms
from revmatch.params import MAX_DF, MIN_DF, TOP_TERMS
from revmatch.schemas import K, ROUND


def term_arrays(df: DataFrame, keys: list[str], text: str, stop: Sequence[str]) -> DataFrame:
    """Distinct terms of each text with their counts, as two arrays on the row.

    Counting runs inside the row (sort, find where runs start, subtract) so that no token is
    shuffled: a text's terms only leave their task once, already counted.
    """
    start_of_run = lambda i: (i == 1) | (
        F.element_at("_sorted", i) != F.element_at("_sorted", F.greatest(i - 1, F.lit(1))))
    none = F.expr("cast(array() as array<int>)")
    return (
        with_terms(df.select(*keys, F.col(text).alias("_text")), "_text", "_terms", stop)
        .select(*keys, F.sort_array("_terms").alias("_sorted"))
        .withColumn("_at", F.when(F.size("_sorted") > 0, F.sequence(F.lit(1), F.size("_sorted"))).otherwise(none))
        .withColumn("_starts", F.filter("_at", start_of_run))
        .withColumn("_ends", F.when(F.size("_starts") > 0, F.concat(
            F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_sorted") + 1))).otherwise(none))
        .select(*keys,
                F.transform("_starts", lambda i: F.element_at("_sorted", i)).alias("term"),
                F.zip_with("_starts", "_ends", lambda a, b: b - a).alias("tf"))
    )


def postings(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (text, term).

    The outer form, because the plain one infers a filter on the array, which is pushed below
    the projections that build it and makes every text be cut into terms again.
    """
    rows = arrays.select(*keys, "tf", F.posexplode_outer("term").alias("_at", "term"))
    return rows.filter(F.col("term").isNotNull()).select(*keys, "term", F.col("tf")[F.col("_at")].cast("bigint").alias("tf"))


def pool_sizes(submissions: DataFrame) -> DataFrame:
    return submissions.groupBy(ROUND).agg(F.count("*").alias("n_subs"))


def vocabulary(counted: DataFrame, pools: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Terms of the pool (round_id, term, df) kept by document frequency, both bounds inclusive, with their idf."""
    n, df = F.col("n_subs"), F.col("df")
    return (
        counted.filter(df >= min_df)
        .join(pools.select(ROUND, "n_subs"), ROUND)
        .filter(df <= F.lit(max_df) * n)
        .withColumn("idf", F.log((1 + n) / (1 + df)) + 1).drop("n_subs")
    )


def number_terms(vocab: DataFrame) -> DataFrame:
    """First half of the term ids: the hash range of each term (first three hex digits of its md5) and its place there.

    A task numbers one of 4,096 ranges; no term is sorted beyond its range. Write the result before ``with_term_ids``.
    """
    partitions = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = vocab.withColumn("term_range", F.substring(F.md5("term"), 1, 3)).repartition(partitions, "term_range", ROUND)
    # the range comes first, as rows are told apart by it soonest
    place = F.row_number().over(Window.partitionBy("term_range", ROUND).orderBy("term")) - 1
    return ranged.withColumn("range_place", place)


def range_starts(numbered: DataFrame) -> DataFrame:
    """How many terms of the round stand in the ranges before; at most 4,096 rows a round are added up in one place."""
    sizes = numbered.groupBy(ROUND, "term_range").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(ROUND).orderBy("term_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(ROUND, "term_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("range_start"))


def with_term_ids(numbered: DataFrame, starts: DataFrame) -> DataFrame:
    """Add ``term_id``: 0, 1, 2, ... in each round without gaps, the same for any partitioning."""
    placed = numbered.join(starts, [ROUND, "term_range"])
    return placed.withColumn("term_id", F.col("range_start") + F.col("range_place")).drop("term_range", "range_place", "range_start")


def raw_weights(posted: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Weights before scaling to unit length, with further vocabulary columns if asked for.

    The vocabulary side has one row per key, so a frequent term is only heavy on the postings
    side, which adaptive execution splits.
    """
    weight = (1 + F.log("tf")) * F.col("idf")
    return posted.join(vocab.select(ROUND, "term", "idf", *keep), [ROUND, "term"]).withColumn("w", weight).drop("tf", "idf")


def _square() -> Column:
    """Squares are summed as integers: a length, and with it every tie, is the same for any partitioning."""
    return F.floor(F.col("w") * F.col("w") * 1e10 + F.lit(0.5))


def mark_shared(vocab: DataFrame, paper_posted: DataFrame) -> DataFrame:
    """Flag the vocabulary terms that occur in a paper; the others only matter for vector lengths."""
    used = paper_posted.select(ROUND, "term").distinct().withColumn("shared", F.lit(True))
    return vocab.join(used, [ROUND, "term"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def _length() -> Column:
    return F.sqrt(F.sum(_square()) / F.lit(1e10))


def packed(posted: DataFrame, vocab: DataFrame, doc: list[str]) -> DataFrame:
    """One compressed sparse row per text: ``norm``, and ``ids`` (rising) and ``ws`` of its terms that papers share.

    Terms of a text leave the task that met the vocabulary as one row, already collected, and never as text.
    """
    raw = raw_weights(posted, vocab, ("term_id", "shared"))
    entry = F.when(F.col("shared"), F.struct("term_id", "w"))
    rows = raw.groupBy(*doc).agg(_length().alias("norm"), F.sort_array(F.collect_list(entry)).alias("_row"))
    return rows.select(*doc, "norm", F.col("_row.term_id").alias("ids"), F.col("_row.w").alias("ws"))


def unit(rows: DataFrame) -> DataFrame:
    """Packed rows scaled to unit length; every term of the text must be in the row."""
    return rows.withColumn("ws", F.transform("ws", lambda w: w / F.col("norm")))


def top_terms(paper_rows: DataFrame, vocab: DataFrame, roster: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """Terms with the highest mean weight over a reviewer's papers, ties by term. ``paper_rows`` are packed, of unit length.

    Weights are added up by term id; a term's text joins its sum.
    """
    each = paper_rows.select(*K, F.explode(F.arrays_zip("ids", "ws")).alias("_e")).select(*K, F.col("_e.ids").alias("term_id"), F.col("_e.ws").alias("w"))
    sums = each.groupBy(*K, "term_id").agg(F.sum(F.floor(F.col("w") * 1e12 + F.lit(0.5))).alias("_s"))
    means = sums.join(roster.select(*K, "n_papers"), K).join(vocab.filter("shared").select(ROUND, "term_id", "term"), [ROUND, "term_id"]).select(
        *K, "term", (F.floor(F.col("_s") / F.lit(1e3) / F.col("n_papers") + F.lit(0.5)) / F.lit(1e9)).alias("mean_weight"))
    place = F.row_number().over(Window.partitionBy(*K).orderBy(F.desc("mean_weight"), "term")).cast("bigint")
    return means.filter(F.col("mean_weight") > 0).withColumn("place", place).filter(F.col("place") <= k)
