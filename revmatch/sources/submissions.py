"""Submission tables: CSV scan, topics column lookup, scored output and topic template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revmatch.functions.text import split_topics
from revmatch.schemas import PAPER, REVIEWER, ROUND


class MissingInput(ValueError):
    """A required column, row or topic is not there."""


def scan_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Every column as text, by header name.

    Quoted line breaks need ``multiLine``, which keeps one file in one task: split a very
    large export into many files, or pass ``multiline=False`` when no field holds a line break.
    """
    return (
        spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    )


def input_mode(columns: list[str]) -> str:
    """Which optional columns the input has; shown in the report."""
    have = [name for name in ("abstract", "topics") if name in columns]
    return "+".join(have) if have else "title-only"


def submissions(raw: DataFrame, round_id: Column | str, check_rows: bool = True) -> DataFrame:
    """Typed submissions from an all-text table; missing optional columns become empty."""
    if "preference" not in raw.columns:
        raise MissingInput("input must have a 'preference' column")
    if check_rows and raw.isEmpty():
        raise MissingInput("input has no data rows")
    text = lambda name: F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit("")
    return raw.select(
        (F.lit(round_id) if isinstance(round_id, str) else round_id).alias(ROUND),
        F.col("paper").cast("bigint").alias(PAPER),
        text("title").alias("title"),
        text("abstract").alias("abstract"),
        split_topics(text("topics")).alias("topics"),
        F.col("preference"),
    )


def scan_submissions(spark: SparkSession, path: str, round_id: Column | str, multiline: bool = True) -> DataFrame:
    return submissions(scan_csv(spark, path, multiline), round_id)


def resolve_topics_column(columns: list[str]) -> str:
    """The column named ``topics`` in any letter case, else the fifth one."""
    for name in columns:
        if name.strip().lower() == "topics":
            return name
    if len(columns) >= 5:
        return columns[4]
    raise MissingInput("no 'topics' column (fifth column) found")


def distinct_topics(df: DataFrame, topics: str) -> DataFrame:
    """Distinct topics of an array column. Partial aggregation removes most repeats before the shuffle."""
    return df.select(F.explode(topics).alias("topic")).distinct()


def topic_template(raw: DataFrame, check: bool = True) -> DataFrame:
    """Every topic once, in code point order, rated 0."""
    column = resolve_topics_column(raw.columns)
    parts = raw.select(split_topics(F.col(f"`{column}`")).alias("_topics"))
    topics = distinct_topics(parts, "_topics")
    if check and topics.isEmpty():
        raise MissingInput("no topics found in the topics column")
    return topics.orderBy("topic").withColumn("interest", F.lit(0))


def write_topic_template(raw: DataFrame, path: str, force: bool = False) -> None:
    """Refuses to replace an edited template unless forced."""
    template = topic_template(raw)
    template.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def scored_output(raw: DataFrame, bids: DataFrame, keys: list[str]) -> DataFrame:
    """Input columns without the abstract, preference replaced by the bid, one row per reviewer."""
    kept = [name for name in raw.columns if name != "abstract"]
    lead = [name for name in (ROUND, REVIEWER) if name in bids.columns and name not in kept]
    own = list(dict.fromkeys([*keys, *lead]))
    joined = raw.drop("abstract", "preference").join(bids.select(*own, F.col("bid").alias("preference")), keys)
    return joined.select(*lead, *kept)


def write_scored(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = scored.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)
