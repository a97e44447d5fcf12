"""Reviewer/submission matching and bid scoring on Spark."""

from revmatch.params import RunOptions, ScoringParams
from revmatch.plans.pipelines import (
    BidRun,
    bids_embedding,
    bids_from_texts,
    bids_rerank,
    bids_tfidf,
    prepare,
    run_bids,
    semantic_scores,
    topic_template,
)

__all__ = [
    "RunOptions",
    "ScoringParams",
    "BidRun",
    "bids_embedding",
    "bids_from_texts",
    "bids_rerank",
    "bids_tfidf",
    "prepare",
    "run_bids",
    "semantic_scores",
    "topic_template",
]
