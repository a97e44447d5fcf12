"""User entry points: prepared inputs, similarity by method, bids, topic template.

Tables that several later steps read (term counts, vocabulary, scores) are written once to the
shared folder. Everything else stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from revmatch.functions.stopwords import default_stop_words
from revmatch.functions.text import DENSE_JOINER, SPARSE_JOINER, submission_text, with_paper_text
from revmatch.operators import blocks, rerank, similarity, tfidf
from revmatch.operators.bids import bids
from revmatch.operators.topics import rating_maps, with_topic_base
from revmatch.params import FRACTION_TOLERANCE, MAX_DF, METHODS, MIN_DF, RunOptions, ScoringParams
from revmatch.schemas import K, PAPER, PAPER_KEY, REVIEWER, ROUND
from revmatch.session import materialize
from revmatch.sources.papers import TooFewPapers, distinct_papers, papers_guard
from revmatch.sources.submissions import topic_template
from revmatch.sources.vector_cache import Encode, VectorCache

__all__ = ["BidRun", "Prepared", "SparseSide", "bids_embedding", "bids_from_texts", "bids_rerank", "bids_tfidf", "embedding_inputs",
           "paper_top_terms", "pool_with_topics", "prepare", "run_bids", "semantic_scores", "set_aside", "sparse_side", "topic_template"]


class PoolTooSmall(ValueError):
    """No term can satisfy both document-frequency bounds in so small a pool."""


@dataclass(frozen=True)
class Prepared:
    submissions: DataFrame      # round_id, paper, title, abstract, topics
    papers: DataFrame           # round_id, reviewer_id, paper_key, text
    interests: DataFrame | None  # reviewer_id, topic, interest
    roster: DataFrame           # round_id, reviewer_id, n_papers
    rounds: DataFrame           # round_id, n_subs, n_papers, n_reviewers, fits
    guard: DataFrame            # unique papers per reviewer, accepted or not


@dataclass(frozen=True)
class SparseSide:
    vocabulary: DataFrame       # round_id, term, df, bucket, idf, shared, term_id
    sub_rows: DataFrame         # round_id, paper, norm, ids, ws (raw weights of the terms some paper has)
    paper_rows: DataFrame       # round_id, reviewer_id, paper_key, norm, ids, ws (unit length)
    blocks: blocks.TermBlocks   # the submissions' terms
    answered: DataFrame         # the vocabulary's answers to the blocks


def prepare(submissions: DataFrame, papers: DataFrame, interests: DataFrame | None = None,
            options: RunOptions = RunOptions()) -> Prepared:
    """Set reviewers with too few papers aside (or raise) and size every round.

    Papers of one reviewer with the same text count once. What is set aside is listed by ``set_aside``.
    """
    if "text" in papers.columns:
        papers = distinct_papers(papers, K, PAPER_KEY, "text")
    guard = papers_guard(papers, PAPER_KEY, K, options.min_papers)
    roster = materialize(guard.filter("accepted").select(*K, "n_papers"), "roster")
    per_round = roster.groupBy(ROUND).agg(F.sum("n_papers").alias("n_papers"), F.count("*").alias("n_reviewers"))
    rounds = materialize(
        tfidf.pool_sizes(submissions).join(per_round, ROUND)
        .withColumn("fits", F.lit(MAX_DF) * F.col("n_subs") >= MIN_DF), "rounds")
    if options.strict:
        short = guard.filter(~F.col("accepted")).first()
        if short is not None:
            raise TooFewPapers(f"reviewer {short[REVIEWER]!r} has {short['n_papers']} unique papers; "
                               f"at least {options.min_papers} required")
        small = rounds.filter(~F.col("fits")).first()
        if small is not None:
            raise PoolTooSmall(f"round {small[ROUND]!r} has only {small['n_subs']} submissions")
    return Prepared(submissions, papers.join(roster.select(*K), K, "left_semi"), interests, roster, rounds, guard)


def set_aside(prep: Prepared) -> DataFrame:
    """What the sparse methods give no bids for: reviewers with too few papers, rounds too small for a vocabulary, and
    rounds without an accepted reviewer (``reviewer_id`` is null for rounds)."""
    no_one = F.lit(None).cast(prep.guard.schema[REVIEWER].dataType).alias(REVIEWER)
    few = prep.guard.filter(~F.col("accepted")).select(*K, F.lit("too few papers").alias("reason"), F.col("n_papers").alias("n"))
    small = prep.rounds.filter(~F.col("fits")).select(ROUND, no_one, F.lit("too few submissions").alias("reason"), F.col("n_subs").alias("n"))
    empty = (tfidf.pool_sizes(prep.submissions).join(prep.rounds, ROUND, "left_anti")
             .select(ROUND, no_one, F.lit("no accepted reviewer").alias("reason"), F.col("n_subs").alias("n")))
    return few.unionByName(small.select(*few.columns)).unionByName(empty.select(*few.columns))


def sparse_side(prep: Prepared, stop_words: Sequence[str] | None = None) -> SparseSide:
    """Vocabulary of each pool of submissions, and both sides weighted in it."""
    stop = default_stop_words() if stop_words is None else list(stop_words)
    fitted = prep.rounds.filter("fits").select(ROUND, "n_subs")
    texts = prep.submissions.select(ROUND, PAPER, submission_text(F.col("title"), F.col("abstract")).alias("text"))
    paper = [*K, PAPER_KEY]
    with ThreadPoolExecutor(2) as pool:
        gathered, own = pool.submit(blocks.gather, texts, "text", stop), pool.submit(
            lambda: materialize(tfidf.term_arrays(prep.papers, paper, "text", stop), "paper_terms"))
        side, paper_posted = gathered.result(), tfidf.postings(own.result(), paper)
    kept = tfidf.vocabulary(blocks.counts(side, MIN_DF), fitted)
    numbered = materialize(tfidf.number_terms(tfidf.mark_shared(kept, paper_posted)), "vocabulary")
    vocab = tfidf.with_term_ids(numbered, materialize(tfidf.range_starts(numbered), "range_starts"))
    answered = blocks.answers(side, vocab)
    paper_rows = tfidf.packed(paper_posted, vocab.filter("shared"), paper)  # every term of a paper is shared
    return SparseSide(vocab, blocks.packed(side, answered), tfidf.unit(paper_rows), side, answered)


def paper_top_terms(prep: Prepared, sparse: SparseSide) -> DataFrame:
    return tfidf.top_terms(sparse.paper_rows, sparse.vocabulary, prep.roster)


def pool_with_topics(prep: Prepared, options: RunOptions, fitted: bool = False) -> DataFrame:
    """One row per reviewer and submission with the topic base; ``fitted`` (sparse methods) leaves out rounds without a vocabulary."""
    rounds = prep.rounds.filter("fits") if fitted else prep.rounds
    reviewers = prep.roster
    if prep.interests is not None:
        reviewers = reviewers.join(rating_maps(prep.interests), REVIEWER, "left")
    else:
        reviewers = reviewers.withColumn("ratings", F.lit(None).cast("map<string,int>"))
    topics = (F.coalesce(F.col("topics"), F.expr("cast(array() as array<string>)"))
              if "topics" in prep.submissions.columns else F.expr("cast(array() as array<string>)"))
    subs = prep.submissions.select(ROUND, PAPER, topics.alias("topics"))
    pool = with_topic_base(similarity.pool_rows(subs, reviewers, rounds, options))
    return pool.select(*K, PAPER, "topic_base", "n_subs", "n_papers")


def _scores(prep: Prepared, tops: DataFrame, options: RunOptions, fitted: bool = False) -> DataFrame:
    return materialize(similarity.topk_mean(tops, pool_with_topics(prep, options, fitted)), "scores")


def _tfidf_scores(prep: Prepared, options: RunOptions, sparse: SparseSide) -> DataFrame:
    tops = similarity.sparse_tops(sparse.sub_rows, sparse.paper_rows, prep.rounds, prep.roster, options)
    return _scores(prep, tops, options, fitted=True)


def _rerank_scores(prep: Prepared, options: RunOptions, scored: DataFrame,
                   scorer: rerank.ColumnScorer | rerank.BatchScorer | rerank.CellScorer) -> DataFrame:
    shortlisted = materialize(rerank.shortlist(scored, options), "shortlist")
    texts = prep.submissions.select(ROUND, PAPER, submission_text(F.col("title"), F.col("abstract")).alias("text"))
    paper_texts = with_paper_text(prep.papers, "text", "joined", SPARSE_JOINER)
    subs = rerank.side_features(texts, [ROUND, PAPER], "text", "sub_side", scorer)
    papers = rerank.side_features(paper_texts, [*K, PAPER_KEY], "joined", "paper_side", scorer)
    means = rerank.pair_means(rerank.scored_pairs(shortlisted, subs, papers, prep.rounds, prep.roster, options, scorer))
    return materialize(rerank.rerank_bands(shortlisted, means), "bands")


def embedding_inputs(prep: Prepared, cache: VectorCache, load: Callable[[], Encode]) -> tuple[DataFrame, DataFrame]:
    """Vectors of submissions and papers through the cache and the embedder hook; what is missing on either side is one run."""
    subs = prep.submissions.select(
        ROUND, PAPER, submission_text(F.col("title"), F.col("abstract"), DENSE_JOINER).alias("text"))
    papers = with_paper_text(prep.papers, "text", "joined", DENSE_JOINER).select(*K, PAPER_KEY, F.col("joined").alias("text"))
    cache.add(subs.select("text").unionByName(papers.select("text")), load)
    return cache.vectors(subs).select(ROUND, PAPER, "vec"), cache.vectors(papers).select(*K, PAPER_KEY, "vec")


def semantic_scores(prep: Prepared, options: RunOptions = RunOptions(), *, sparse: SparseSide | None = None,
                    vectors: tuple[DataFrame, DataFrame] | None = None,
                    scorer: rerank.ColumnScorer | rerank.BatchScorer | rerank.CellScorer = rerank.TOKEN_OVERLAP,
                    stop_words: Sequence[str] | None = None, scored: DataFrame | None = None) -> DataFrame:
    """``sim`` for every reviewer and submission by ``options.method``, next to the topic base.

    ``scored`` is what method 'tfidf' gave for the same inputs, if the caller has it; 'rerank' cuts its shortlist from it.
    """
    if options.method not in METHODS:
        raise ValueError(f"unknown method {options.method!r}")
    if options.method == "embedding":
        if vectors is None:
            raise ValueError("method 'embedding' needs submission and paper vectors")
        tops = similarity.dense_tops(*vectors, prep.rounds, prep.roster, options)
        return _scores(prep, tops, options)
    if scored is None:
        scored = _tfidf_scores(prep, options, sparse or sparse_side(prep, stop_words))
    return _rerank_scores(prep, options, scored, scorer) if options.method == "rerank" else scored


@dataclass(frozen=True)
class BidRun:
    """Bids with what a user has to know beside them."""

    bids: DataFrame
    set_aside: DataFrame        # round_id, reviewer_id, reason, n
    positive_frac: float
    watch: Observation

    def achieved(self) -> dict:
        """Facts taken while the bids were written or collected, without a job of their own: number of bids, of positive
        ones, their share, and whether that is off the target. Waits for the first action on ``bids``."""
        seen = self.watch.get
        share = seen["positive"] / seen["bids"] if seen["bids"] else 0.0
        return {**seen, "share": share, "off_target": bool(seen["bids"]) and abs(share - self.positive_frac) > FRACTION_TOLERANCE}


def run_bids(method: str, submissions: DataFrame, papers: DataFrame, interests: DataFrame | None,
             params: ScoringParams = ScoringParams(), options: RunOptions = RunOptions(), *,
             embed: tuple[VectorCache, Callable[[], Encode]] | None = None, **kwargs) -> BidRun:
    """Bids of one method, what was set aside, and the share of positive bids.

    ``embed`` (a cache and the loader of an encoder) lets the embedding method start from texts.
    """
    options = RunOptions(**{**options.__dict__, "method": method})
    prep = prepare(submissions, papers, interests, options)
    if embed is not None:
        kwargs["vectors"] = embedding_inputs(prep, *embed)
    found, watch = bids(semantic_scores(prep, options, **kwargs), params, options), Observation()
    watched = found.observe(watch, F.count(F.lit(1)).alias("bids"), F.count_if(F.col("bid") > 0).alias("positive"))
    return BidRun(watched, set_aside(prep), options.positive_frac, watch)


def _run(method: str, submissions: DataFrame, papers: DataFrame, interests: DataFrame | None,
         params: ScoringParams, options: RunOptions, **kwargs) -> DataFrame:
    options = RunOptions(**{**options.__dict__, "method": method})
    prep = prepare(submissions, papers, interests, options)
    return bids(semantic_scores(prep, options, **kwargs), params, options)


def bids_tfidf(submissions: DataFrame, papers: DataFrame, interests: DataFrame | None,
               params: ScoringParams = ScoringParams(), options: RunOptions = RunOptions(),
               stop_words: Sequence[str] | None = None) -> DataFrame:
    """Bids from sparse text similarity."""
    return _run("tfidf", submissions, papers, interests, params, options, stop_words=stop_words)


def bids_embedding(submissions: DataFrame, papers: DataFrame, interests: DataFrame | None,
                   vectors: tuple[DataFrame, DataFrame], params: ScoringParams = ScoringParams(),
                   options: RunOptions = RunOptions()) -> DataFrame:
    """Bids from vectors (round_id, paper, vec) and (round_id, reviewer_id, paper_key, vec)."""
    return _run("embedding", submissions, papers, interests, params, options, vectors=vectors)


def bids_from_texts(submissions: DataFrame, papers: DataFrame, interests: DataFrame | None, cache: VectorCache,
                    load: Callable[[], Encode], params: ScoringParams = ScoringParams(), options: RunOptions = RunOptions()) -> DataFrame:
    """Bids from texts: vectors come from the cache, missing ones from the encoder that ``load`` returns, and are cached."""
    return run_bids("embedding", submissions, papers, interests, params, options, embed=(cache, load)).bids


def bids_rerank(submissions: DataFrame, papers: DataFrame, interests: DataFrame | None,
                params: ScoringParams = ScoringParams(), options: RunOptions = RunOptions(),
                scorer: rerank.ColumnScorer | rerank.BatchScorer | rerank.CellScorer = rerank.TOKEN_OVERLAP,
                stop_words: Sequence[str] | None = None) -> DataFrame:
    """Bids from a sparse shortlist whose pairs are scored jointly."""
    return _run("rerank", submissions, papers, interests, params, options, scorer=scorer, stop_words=stop_words)
