"""Shortlist by sparse similarity, joint scoring of pairs, and reconciliation of the two scales."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmatch.functions.numeric import round9, shortlist_size
from revmatch.functions.text import tokens
from revmatch.operators import ranking
from revmatch.operators.cells import CELL, cell_tasks, merge_tops, own, top_mean, top_values
from revmatch.operators.similarity import paper_cells
from revmatch.params import SHORTLIST_CUSHION, SHORTLIST_FLOOR, TOP_PAPERS, RunOptions
from revmatch.schemas import K, PAPER, PAPER_KEY, REVIEWER, ROUND
from revmatch.session import materialize


@dataclass(frozen=True)
class ColumnScorer:
    """Pair scorer made of column expressions: features once per text, then a score per pair."""

    features: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class BatchScorer:
    """Pair scorer in Python, for models: ``load`` runs once per task and returns
    ``predict(paper_texts, submission_texts) -> scores``."""

    load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]
    batch: int = 32


@dataclass(frozen=True)
class CellScorer:
    """Pair scorer for whole cells: features once per text, then ``load`` runs once per task and returns
    ``scores(paper_sides, submission_sides)``, Arrow columns in, one row of the matrix per submission out."""

    features: Callable[[Column], Column]
    load: Callable[[], Callable[[pa.Array, pa.Array], np.ndarray]]


def _jaccard(a: Column, b: Column) -> Column:
    """A one-element transform binds the intersection size, so it is computed once per pair."""
    shared = F.array(F.size(F.array_intersect(a, b)))
    share = F.transform(shared, lambda s: s / F.nullif(F.size(a) + F.size(b) - s, F.lit(0)))[0]
    return F.coalesce(share, F.lit(0.0))


def _overlap():
    """Overlap of token sets, each given as words joined by blanks: shared words are counted by bounded matrix products."""
    width = 1 << 13  # distinct words of the cell's papers in one product

    def words(sides: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.fill_null(sides, ""), " ")
        owner, flat = pc.list_parent_indices(parts), parts.flatten()
        some = pc.not_equal(flat, "")
        owner = owner.filter(some).to_numpy(zero_copy_only=False)
        return flat.filter(some), owner, np.bincount(owner, minlength=len(sides))

    def scores(papers: pa.Array, subs: pa.Array) -> np.ndarray:
        own, holder, sizes = words(papers)
        named, reader, lengths = words(subs)
        coded = own.dictionary_encode()
        codes, found = coded.indices.to_numpy(zero_copy_only=False), pc.index_in(named, value_set=coded.dictionary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        reader, found = reader[known], found.drop_null().to_numpy(zero_copy_only=False)
        shared = np.zeros((len(subs), len(papers)))
        for start in range(0, len(coded.dictionary), width):
            left, right = (np.zeros((len(x), width), np.float32) for x in (subs, papers))
            for side, row, code in ((left, reader, found), (right, holder, codes)):
                here = (code >= start) & (code < start + width)
                side[row[here], code[here] - start] = 1
            shared += left @ right.T
        union = lengths[:, None] + sizes[None, :] - shared
        return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)

    return scores


# Stand-in for a neural scorer: overlap of the two token sets, for whole cells and in native columns.
TOKEN_OVERLAP = CellScorer(features=lambda text: F.array_join(F.array_distinct(tokens(text)), " "), load=_overlap)
COLUMN_OVERLAP = ColumnScorer(features=lambda text: F.array_distinct(tokens(text)), score=_jaccard)


def shortlist_length(n: Column, options: RunOptions) -> Column:
    wanted = (
        F.lit(options.rerank_topn).cast("bigint") if options.rerank_topn is not None
        else shortlist_size(n, options.positive_frac, SHORTLIST_FLOOR, SHORTLIST_CUSHION)
    )
    return F.greatest(F.lit(1), F.least(wanted, n))


def shortlist(scored: DataFrame, options: RunOptions) -> DataFrame:
    """Flag the best submissions of each pool by sparse similarity."""
    return ranking.first(scored, K, "sim", shortlist_length(F.col("n_subs"), options), "is_candidate")


def candidate_texts(shortlisted: DataFrame, subs: DataFrame, papers: DataFrame, rounds: DataFrame) -> DataFrame:
    """Each candidate once per cell that holds a paper to meet, with ``asked_by``: the reviewers there who shortlisted it.

    ``subs`` has (round_id, paper, sub_side); ``papers`` stand in their cells. Only ids are put together per reviewer;
    how often a text is copied depends on the cells, not on how many reviewers ask for it.
    """
    homes = papers.select(*K, "cell_col").distinct()
    asked = (
        shortlisted.filter("is_candidate").select(*K, PAPER).join(homes, K)
        .groupBy(ROUND, PAPER, "cell_col").agg(F.collect_set(REVIEWER).alias("asked_by"))
    )
    return asked.join(subs, [ROUND, PAPER]).join(rounds.select(ROUND, "n_subs"), ROUND)


def candidate_pairs(shortlisted: DataFrame, subs: DataFrame, papers: DataFrame, rounds: DataFrame,
                    roster: DataFrame, options: RunOptions) -> DataFrame:
    """Each candidate with each of the reviewer's papers, met cell by cell.

    ``subs`` has (round_id, paper, sub_side) and ``papers`` (round_id, reviewer_id, paper_key, paper_side). Each side is
    shuffled once, by cell; a pair is made inside its cell if the paper's reviewer asked for the submission.
    """
    left, right, n = _placed(shortlisted, subs, papers, rounds, roster, options)
    cell = [ROUND, *CELL]
    pairs = left.repartition(n, *cell).join(right.repartition(n, *cell), cell).filter(F.array_contains("asked_by", F.col(REVIEWER)))
    return pairs.drop("asked_by")


def _placed(shortlisted: DataFrame, subs: DataFrame, papers: DataFrame, rounds: DataFrame,
            roster: DataFrame, options: RunOptions) -> tuple[DataFrame, DataFrame, int]:
    """Candidates and papers in their cells, and the number of tasks."""
    size = options.pair_cell
    right = paper_cells(papers, rounds, roster, size, size).withColumnRenamed("_own_papers", "n_papers")
    left = candidate_texts(shortlisted, subs, paper_cells(papers.drop("paper_side"), rounds, roster, size, size), rounds)
    left = left.withColumn("cell_row", own([PAPER], F.col("n_subs"), size)).drop("n_subs")
    return left, right, cell_tasks(rounds, F.col("n_subs"), F.col("n_papers"), size, size)


def scored_pairs(shortlisted: DataFrame, subs: DataFrame, papers: DataFrame, rounds: DataFrame, roster: DataFrame,
                 options: RunOptions, scorer: ColumnScorer | BatchScorer | CellScorer = TOKEN_OVERLAP) -> DataFrame:
    """The pairs of ``candidate_pairs`` with ``pair_sim``; no score (null, NaN) counts as 0.

    For scorers in Python a text goes there once per cell, however many pairs it stands in; pairs are made there.
    """
    if isinstance(scorer, ColumnScorer):
        return pair_score(candidate_pairs(shortlisted, subs, papers, rounds, roster, options), scorer)
    left, right, n = _placed(shortlisted, subs, papers, rounds, roster, options)
    load, batch, held = scorer.load, getattr(scorer, "batch", None), []
    cell, names = [ROUND, *CELL], {"reviewer": REVIEWER, "paper": PAPER}
    kept = [*K, PAPER, PAPER_KEY, *CELL, "n_papers"]

    def score(subs: pa.Table, papers: pa.Table) -> pa.Table:
        subs, papers = subs.combine_chunks(), papers.combine_chunks()
        reviewers = papers[names["reviewer"]].combine_chunks().dictionary_encode()
        asked = subs["asked_by"].combine_chunks()
        which = pc.index_in(asked.flatten(), value_set=reviewers.dictionary)
        rows = np.repeat(np.arange(subs.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
        known = which.is_valid().to_numpy(zero_copy_only=False)
        met = np.zeros((subs.num_rows, len(reviewers.dictionary)), bool)
        met[rows[known], which.drop_null().to_numpy(zero_copy_only=False)] = True
        row, col = np.nonzero(met[:, reviewers.indices.to_numpy(zero_copy_only=False)])
        sims = np.zeros(len(row))
        if len(row):
            if not held:
                held.append(load())
            if batch is None:
                sims = held[0](*(t[c].combine_chunks() for t, c in ((papers, "paper_side"), (subs, "sub_side"))))[row, col]
            own, texts = (t[c].to_pylist() if batch else [] for t, c in ((papers, "paper_side"), (subs, "sub_side")))
            for i in range(0, len(row) if batch else 0, batch or 1):
                sims[i:i + batch] = held[0]([own[c] for c in col[i:i + batch]], [texts[r] for r in row[i:i + batch]])
        row, col = pa.array(row), pa.array(col)
        columns = {c: subs[c].take(row) if c == names["paper"] else papers[c].take(col) for c in kept}
        return pa.table({**columns, "pair_sim": np.floor(np.nan_to_num(sims, nan=0.0) * 1e9 + 0.5) / 1e9})

    types = {f.name: f.dataType.simpleString() for t in (left, right) for f in t.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", pair_sim double"
    return left.repartition(n, *cell).groupBy(*cell).cogroup(right.repartition(n, *cell).groupBy(*cell)).applyInArrow(score, schema)


def pair_score(pairs: DataFrame, scorer: ColumnScorer | BatchScorer = COLUMN_OVERLAP) -> DataFrame:
    """Add ``pair_sim`` to pairs with ``paper_side`` and ``sub_side`` (features or texts); no score (null, NaN) counts as 0."""
    if isinstance(scorer, ColumnScorer):
        sim = scorer.score(F.col("paper_side"), F.col("sub_side"))
        return pairs.withColumn("pair_sim", round9(F.coalesce(F.nanvl(sim.cast("double"), F.lit(0.0)), F.lit(0.0)))).drop(
            "paper_side", "sub_side")
    kept = [c for c in pairs.columns if c not in ("paper_side", "sub_side")]
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in kept) + ", pair_sim double"

    load, batch = scorer.load, scorer.batch

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for frame in frames:
            if frame.empty:
                continue
            predict = predict or load()
            a, b = frame["paper_side"].tolist(), frame["sub_side"].tolist()
            parts = [np.asarray(predict(a[i:i + batch], b[i:i + batch]), dtype="float64") for i in range(0, len(a), batch)]
            yield frame[kept].assign(pair_sim=np.floor(np.nan_to_num(np.concatenate(parts), nan=0.0) * 1e9 + 0.5) / 1e9)

    return pairs.mapInPandas(run, schema)


def side_features(df: DataFrame, keys: list[str], text: str, out: str, scorer: ColumnScorer | BatchScorer | CellScorer) -> DataFrame:
    side = F.col(text) if isinstance(scorer, BatchScorer) else scorer.features(F.col(text))
    return df.select(*keys, side.alias(out))


def pair_means(pair_scores: DataFrame, k: int = TOP_PAPERS) -> DataFrame:
    """Mean of the k best pair scores of each candidate; lists are bounded by a cell, then by k per cell."""
    by_cell = pair_scores.groupBy(*K, *CELL, PAPER).agg(
        top_values(F.collect_list("pair_sim"), k).alias("_top"), F.max("n_papers").alias("n_papers"))
    merged = by_cell.groupBy(*K, PAPER).agg(
        merge_tops(F.collect_list("_top"), k).alias("_top"), F.max("n_papers").alias("n_papers"))
    places = F.least(F.lit(k), F.col("n_papers"))
    return merged.select(*K, PAPER, round9(top_mean(F.col("_top"), places)).alias("pair_mean"))


def rerank_bands(shortlisted: DataFrame, means: DataFrame) -> DataFrame:
    """Candidates at 1 + quantile of the pair score, the rest at their sparse quantile, each group on its own."""
    joined = shortlisted.join(means, [*K, PAPER], "left").withColumn(
        "_score", F.when(F.col("is_candidate"), F.col("pair_mean")).otherwise(F.col("sim")))
    # written, because the ranks read the rows several times and the pairs must be scored once
    ranked = ranking.quantile(materialize(joined, "pair_means"), [*K, "is_candidate"], "_score", "_q")
    band = F.when(F.col("is_candidate"), 1 + F.col("_q")).otherwise(F.col("_q"))
    return ranked.withColumn("tfidf_sim", F.col("sim")).withColumn("sim", band).drop("_score", "_q")
