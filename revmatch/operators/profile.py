"""Reviewer profile: run facts, topic affinities and top terms as one JSON row per reviewer and round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.functions.numeric import affinity
from revmatch.params import ScoringParams
from revmatch.schemas import K, REVIEWER, ROUND

# How each method is named in the profile.
MATCHING = {
    "tfidf": "TF-IDF cosine similarity to your papers, blended with topic interests",
    "embedding": "neural-embedding similarity to your papers, blended with topic interests",
    "rerank": "TF-IDF cosine similarity to your papers, blended with topic interests",
}
NOTE = "Generated - do not edit by hand."


def topic_affinities(interests: DataFrame) -> DataFrame:
    """Topic -> (affinity, interest) per reviewer, topics in order; bounded by the topic list."""
    entry = F.struct(F.col("topic").alias("key"), F.struct(
        affinity(F.col("interest")).alias("affinity"), F.col("interest").alias("interest")).alias("value"))
    return interests.groupBy(REVIEWER).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("topic_affinity"))


def profile(interests: DataFrame, terms: DataFrame, roster: DataFrame, rounds: DataFrame,
            params: ScoringParams, method: str, built: str) -> DataFrame:
    """``terms`` holds a bounded number of placed terms per reviewer; ``built`` is an argument so output repeats."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
    listed = terms.groupBy(*K).agg(ordered.alias("corpus_top_terms"))
    meta = F.struct(
        F.lit(built).alias("built"), F.lit(MATCHING[method]).alias("matching"),
        F.lit(float(params.interest_weight)).alias("interest_weight"), F.lit(float(params.sem_gain)).alias("sem_gain"),
        F.col("n_papers").alias("unique_papers"), F.col("n_subs").alias("submissions_scored"), F.lit(NOTE).alias("note"))
    return (
        roster.join(rounds.select(ROUND, "n_subs"), ROUND)
        .join(topic_affinities(interests), REVIEWER, "left")
        .join(listed, K, "left")
        .select(*K, F.to_json(F.struct(
            meta.alias("meta"),
            F.coalesce(F.col("topic_affinity"), F.expr("cast(map() as map<string, struct<affinity:int,interest:int>>)")).alias("topic_affinity"),
            F.coalesce(F.col("corpus_top_terms"), F.expr("cast(array() as array<string>)")).alias("corpus_top_terms"),
        )).alias("profile"))
    )
