"""The given tables read as submissions, papers, ratings, pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revmatch.sources.papers import enroll
from revmatch.sources.submissions import submissions as typed_submissions

REVIEWERS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; where it is one file, which one task reads, its rows are dealt to all cores before any text work."""
    docs = table(spark, sf_dir, "documents")
    return docs.repartition(spark.sparkContext.defaultParallelism) if len(docs.inputFiles()) == 1 else docs


def round_of(column: str):
    """Two rounds; the first holds two thirds of the rows."""
    return F.when(F.col(column) % 3 == 0, "B").otherwise("A")


def raw_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As an export: all text columns, topics joined by semicolons."""
    title = F.substring_index("text", "\n", 1)
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("paper"), title.alias("title"), F.lit("").alias("preference"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("abstract"),
        F.concat("lang", F.lit(" ; "), "source", F.lit(";")).alias("topics"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_submissions(raw_submissions(spark, sf_dir), round_of("paper"), check_rows=False)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reviewer takes part in both rounds."""
    own = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") % REVIEWERS).alias("reviewer_id"), F.col("item_id").alias("paper_key"), "text")
    members = own.select("reviewer_id").distinct().withColumn("round_id", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return enroll(own, members)


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings per reviewer and topic; one source stays unrated."""
    topics = (
        table(spark, sf_dir, "documents")
        .select(F.explode(F.array("lang", F.when(F.col("source") != "src19", F.col("source")))).alias("topic"))
        .filter(F.col("topic").isNotNull()).distinct())
    base = (
        F.when(F.col("topic") == "en", 2).when(F.col("topic") == "fr", 1).when(F.col("topic") == "de", 0)
        .when(F.col("topic") == "es", -1).otherwise(F.try_to_number(F.substring("topic", 4, 9), F.lit("999")).cast("int") % 5 - 2))
    return (
        topics.withColumn("reviewer_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(REVIEWERS - 1).cast("bigint"))))
        .select("reviewer_id", "topic", ((base + 2 + F.col("reviewer_id")) % 5 - 2).cast("int").alias("interest")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("paper_key"), F.col("turn").alias("page"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submission vectors, paper vectors (the first five per label) and the plain submissions table.

    The fifth id per label is found by a limited window and joined back, so no label sits in one task.
    """
    e = table(spark, sf_dir, "embeddings")
    first = e.select("label", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    cuts = first.filter("r <= 5").groupBy("label").agg(F.max("vec_id").alias("cut"))
    placed = e.join(cuts, "label")
    rounds = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("round_id")
    own = placed.filter("vec_id <= cut").select(
        F.col("label").cast("bigint").alias("reviewer_id"), F.col("vec_id").alias("paper_key"), F.col("embedding").alias("vec"))
    rest = placed.filter("vec_id > cut").select(
        round_of("vec_id").alias("round_id"), F.col("vec_id").alias("paper"), F.col("embedding").alias("vec"))
    return rest, own.select("*", rounds), rest.select("round_id", "paper")


def paper_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading text of a paper as a PDF reader gives it: preprint line, broken title, abstract, introduction.

    Every seventh text has no abstract heading.
    """
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("paper_key"),
        F.when(F.col("item_id") % 7 == 6, F.col("text")).otherwise(F.concat(
            F.lit("arXiv: x\nTi-\ntle "), F.col("item_id").cast("string"), F.lit("\nAbstract\n"), F.col("text"),
            F.lit("\n1. Introduction"))).alias("text"))
