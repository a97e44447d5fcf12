"""Reviewer papers: file scan, content dedup, leading pages, minimum count, round membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmatch.params import LEADING_PAGES, MIN_PAPERS
from revmatch.schemas import K, REVIEWER


class TooFewPapers(ValueError):
    """A reviewer has fewer unique papers than required."""


def unique_contents(df: DataFrame, content: str, path: str, keys: list[str] | None = None) -> DataFrame:
    """One row per content hash; the first path in order stands for all copies.

    Only the hash and the path are shuffled, after a partial minimum per task, so a group
    of copies of any size collapses before the exchange.
    """
    keys = keys or []
    hashed = df.select(*keys, F.sha2(F.col(content), 256).alias("sha"), F.col(path).alias(path))
    return hashed.groupBy(*keys, "sha").agg(F.min(path).alias(path))


def scan_paper_files(spark: SparkSession, folder: str) -> DataFrame:
    """Unique PDF files of a folder, or of ``reviewer_id=...`` folders below it; not recursive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder)
    keys = [REVIEWER] if REVIEWER in files.columns else []
    pdf = files.filter(F.startswith(F.col("content"), F.lit(b"%PDF")))
    return unique_contents(pdf, "content", "path", keys)


def leading_pages(pages: DataFrame, keys: list[str], pages_read: int = LEADING_PAGES) -> DataFrame:
    """First pages of each paper joined without a separator; a page without text adds nothing.

    A fixed number of conditional maxima, so a paper of any length keeps constant state. A paper with no such page
    has empty text.
    """
    page_text = [F.coalesce(F.max(F.when(F.col("page") == i, F.col("text"))), F.lit("")) for i in range(pages_read)]
    return pages.groupBy(*keys).agg(F.concat(*page_text).alias("text"))


def distinct_papers(papers: DataFrame, keys: list[str], paper_key: str, text: str) -> DataFrame:
    """One paper per reviewer and text, the one with the smallest key; papers without text are told apart by key only.

    Hashes and keys are shuffled, never texts, until the chosen keys pick their rows.
    """
    told = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.concat(F.lit("key:"), F.col(paper_key).cast("string"))).otherwise(F.sha2(F.col(text), 256))
    chosen = papers.select(*keys, paper_key, told.alias("_content")).groupBy(*keys, "_content").agg(F.min(paper_key).alias(paper_key))
    return papers.join(chosen.select(*keys, paper_key), [*keys, paper_key], "left_semi")


def count_unique(papers: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """Unique papers per reviewer. Duplicates go first, so counting shuffles one row per paper at most."""
    return papers.select(*keys, content).distinct().groupBy(*keys).agg(F.count("*").alias("n_papers"))


def papers_guard(papers: DataFrame, content: str, keys: list[str] | None = None, minimum: int = MIN_PAPERS) -> DataFrame:
    """Unique-paper count per reviewer with a flag for those who have enough."""
    counts = count_unique(papers, content, keys or K)
    return counts.withColumn("accepted", F.col("n_papers") >= minimum)


def enroll(papers: DataFrame, members: DataFrame) -> DataFrame:
    """Give each reviewer's papers the rounds the reviewer takes part in."""
    return papers.join(members, REVIEWER)
