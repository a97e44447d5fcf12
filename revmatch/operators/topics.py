"""Topic side of a score: rating lookup and topic base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmatch.functions.numeric import AFFINITY_PER_RATING
from revmatch.schemas import REVIEWER

# Weights of the best and of the mean affinity.
MAX_SHARE, MEAN_SHARE = 0.6, 0.4


def rating_maps(interests: DataFrame) -> DataFrame:
    """One topic -> rating map per reviewer. Ratings are unique per topic, so a map is bounded by the topic list."""
    entries = F.collect_list(F.struct("topic", "interest"))
    return interests.groupBy(REVIEWER).agg(F.map_from_entries(entries).alias("ratings"))


def affinities(topics: Column, ratings: Column) -> Column:
    """Affinity per tag, duplicates kept; a tag without a rating counts as 0. Case matters."""
    return F.transform(topics, lambda t: F.coalesce(F.try_element_at(ratings, t), F.lit(0)) * AFFINITY_PER_RATING)


def topic_affinity_join(tags: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    """Affinity of each (row, tag); ``tags`` has one row per pool row with its ``topics`` and ``reviewer_id``."""
    joined = tags.join(maps, REVIEWER, "left")
    rated = joined.select(*keys, "topics", affinities(F.col("topics"), F.col("ratings")).alias("_a"))
    zipped = rated.select(*keys, F.posexplode(F.arrays_zip("topics", "_a")).alias("tag_no", "_z"))
    return zipped.select(*keys, "tag_no", F.col("_z.topics").alias("topic"), F.col("_z._a").alias("affinity"))


def with_topic_base(df: DataFrame, topics: str = "topics", ratings: str = "ratings", out: str = "topic_base") -> DataFrame:
    """0.6 of the best plus 0.4 of the mean affinity over the tags; 0 without tags. Row-local, no shuffle."""
    best, count = F.array_max("_aff"), F.size("_aff")
    total = F.aggregate("_aff", F.lit(0), lambda acc, x: acc + x)
    base = F.lit(MAX_SHARE) * best + F.lit(MEAN_SHARE) * (total / count)
    return (
        df.withColumn("_aff", affinities(F.col(topics), F.col(ratings)))
        .withColumn(out, F.when(count > 0, base).otherwise(F.lit(0.0)))
        .drop("_aff")
    )
