"""Topic ratings: text files of ``topic,interest`` lines with # comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revmatch.functions.numeric import affinity, parse_rating
from revmatch.functions.text import strip
from revmatch.schemas import REVIEWER
from revmatch.sources.submissions import MissingInput

def rating_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order: file, split start, position inside the split. Directory keys are kept."""
    lines = spark.read.text(path)
    meta = F.col("_metadata")
    return lines.withColumn(
        "line_no",
        F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"),
                 F.monotonically_increasing_id().alias("at")),
    )


def parse_rating_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Comment lines dropped, header row found per file, columns taken by header name; files of any width."""
    # as many fields as the widest line can hold
    width = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    fields = [f"c{i}" for i in range(width)]
    parsed = (
        lines.filter(~F.ltrim(strip(F.col("value"))).startswith("#") & (strip(F.col("value")) != ""))
        .select(*keys, "line_no", F.from_csv("value", ", ".join(f"{f} string" for f in fields),
                                             {"mode": "PERMISSIVE", "escape": '"'}).alias("row"))
        .select(*keys, "line_no", F.array(*[F.col("row")[f] for f in fields]).alias("cells"))
        .withColumn("file", F.col("line_no.file"))
    )
    header = parsed.groupBy("file").agg(
        F.min("line_no").alias("header_at"), F.min_by("cells", "line_no").alias("names"))
    column = lambda name: F.get(F.col("cells"), F.array_position("names", name).cast("int") - 1)
    return (
        parsed.join(header, "file")
        .filter(F.col("line_no") > F.col("header_at"))
        .select(*keys, "line_no",
                F.array_contains("names", "topic").alias("has_topic"),
                F.array_contains("names", "interest").alias("has_interest"),
                column("topic").alias("topic"), column("interest").alias("raw_interest"))
    )


def interests(rows: DataFrame, keys: list[str], order: str = "line_no", raw: str = "raw_interest") -> DataFrame:
    """One rating per key and topic; blank topics dropped, the last duplicate wins."""
    return (
        rows.withColumn("topic", strip(F.coalesce(F.col("topic"), F.lit(""))))
        .filter(F.col("topic") != "")
        .groupBy(*keys, "topic")
        .agg(F.max_by(parse_rating(F.col(raw)), F.col(order)).alias("interest"))
    )


def scan_interests(spark: SparkSession, path: str, reviewer_id: Column | int | str | None = None) -> DataFrame:
    """Ratings of one reviewer, or of many when files sit in ``reviewer_id=...`` folders."""
    lines = rating_lines(spark, path)
    if reviewer_id is not None:
        lines = lines.withColumn(REVIEWER, reviewer_id if isinstance(reviewer_id, Column) else F.lit(reviewer_id))
    keys = [REVIEWER] if REVIEWER in lines.columns else []
    rows = parse_rating_lines(lines, keys)
    state = rows.agg(F.count("*").alias("n"), F.bool_and("has_topic").alias("t"), F.bool_and("has_interest").alias("i"),
                     F.count_if(strip(F.coalesce(F.col("topic"), F.lit(""))) != "").alias("topics")).first()
    if not state["n"] or not state["t"] or not state["i"]:
        raise MissingInput("ratings must have columns: topic,interest")
    if not state["topics"]:
        raise MissingInput("no topics found in the ratings")
    return interests(rows, keys)


def with_affinity(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("affinity", affinity(F.col("interest")))
