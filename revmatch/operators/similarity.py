"""Similarity of submissions to reviewer papers: sparse and dense cosine, best pairs, top-k mean.

``rounds`` has one row per round (n_subs, n_papers, n_reviewers) and ``roster`` one per round
and reviewer (n_papers); both are small written tables, so their joins broadcast by measured size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.functions.numeric import round9
from revmatch.operators.cells import CELL, cell_tasks, merge_tops, own, place_cols, place_rows, top_mean
from revmatch.operators.ranking import topk_per_group
from revmatch.params import TOP_PAPERS, RunOptions
from revmatch.schemas import K, PAPER, PAPER_KEY, REVIEWER, ROUND

def paper_cells(papers: DataFrame, rounds: DataFrame, roster: DataFrame, rows: int, cols: int) -> DataFrame:
    """Papers in every cell of their column. A reviewer's papers stay together unless there are more than a cell takes."""
    n_subs, n_papers = F.col("n_subs"), F.col("n_papers")
    per_reviewer = roster.select(*K, F.col("n_papers").alias("_own_papers"))
    placed = (
        papers.join(per_reviewer, K)
        .withColumn("_part", own([PAPER_KEY], F.col("_own_papers"), cols))
        .join(rounds.select(ROUND, "n_subs", "n_papers"), ROUND)
    )
    return place_cols(placed, [REVIEWER, "_part"], n_subs, n_papers, rows, cols).drop("n_subs", "n_papers", "_part")


def _cells(subs: DataFrame, papers: DataFrame, rounds: DataFrame, roster: DataFrame, options: RunOptions):
    """Place both sides."""
    rows, cols = options.cell_submissions, options.cell_papers
    left = place_rows(subs.join(rounds.select(ROUND, "n_subs", "n_papers"), ROUND), [PAPER], F.col("n_subs"), F.col("n_papers"), rows, cols)
    return left.drop("n_subs", "n_papers"), paper_cells(papers, rounds, roster, rows, cols).drop("_own_papers")


def _sparse_kernel():
    """Cosines of packed rows: ``(sims, met)`` of two Arrow tables with ``ids`` and ``ws``; a local function, so tasks need no import.

    Products are rounded to twelve decimals and added by rising term, so any layout of the cells gives the same sums.
    """
    room = 1 << 21  # products held at once

    def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = table["ids"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, ws = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ws"))
        return ids, ws, np.concatenate([[0], np.cumsum(lengths)])

    def cosines(subs: pa.Table, papers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, ws, starts = flat(subs)
        terms, weights, cuts = flat(papers)
        owner, width = np.repeat(np.arange(papers.num_rows), np.diff(cuts)), papers.num_rows
        order = np.argsort(terms, kind="stable")
        terms, weights, owner = terms[order], weights[order], owner[order]
        low = np.searchsorted(terms, ids, "left")
        many = np.searchsorted(terms, ids, "right") - low
        done = np.concatenate([[0], np.cumsum(many)])
        ends = done[starts]
        dots, met = np.zeros((subs.num_rows, width)), np.zeros((subs.num_rows, width), bool)
        row = 0
        while row < subs.num_rows:
            # whole rows, as many as make at most ``room`` products, and one at least
            end = max(row + 1, int(np.searchsorted(ends, ends[row] + room, "right")) - 1)
            part = slice(starts[row], starts[end])
            n = many[part]
            at = np.repeat(low[part] - (done[starts[row]:starts[end]] - ends[row]), n) + np.arange(n.sum())
            spot = np.repeat(np.repeat(np.arange(end - row) * width, np.diff(starts[row:end + 1])), n) + owner[at]
            products = np.floor(np.repeat(ws[part], n) * weights[at] * 1e12 + 0.5)
            size = (end - row) * width
            dots[row:end] = np.bincount(spot, products, size).reshape(-1, width)
            met[row:end] = np.bincount(spot, minlength=size).reshape(-1, width) > 0
            row = end
        norm = subs["norm"].to_numpy()[:, None]
        cos = np.divide(dots / 1e12, norm, out=np.zeros_like(dots), where=norm > 0)
        return np.floor(cos * 1e9 + 0.5) / 1e9, met

    return cosines


def _cosine_kernel():
    """Cosines of two Arrow tables with a ``vec`` column; a local function, so tasks need no import.

    A null vector counts as a zero vector; vectors of different lengths are an error.
    """

    def unit(table: pa.Table, width: int) -> np.ndarray:
        vec = table["vec"].combine_chunks()
        sizes = np.array([width if n is None else n for n in vec.value_lengths().to_pylist()])
        if (sizes != width).any():
            raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} numbers among those of {width}")
        matrix = np.zeros((table.num_rows, width))
        matrix[vec.is_valid().to_numpy(zero_copy_only=False)] = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else 0
        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)

    def cosines(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        width = max([0, *(n for t in (left, right) for n in t["vec"].combine_chunks().value_lengths().drop_null().to_pylist())])
        sims = np.floor(unit(left, width) @ unit(right, width).T * 1e9 + 0.5) / 1e9
        return sims, np.ones(sims.shape, bool)

    return cosines


def _tops(left: DataFrame, right: DataFrame, sizes: DataFrame, kernel, options: RunOptions, k: int) -> DataFrame:
    """At most k best papers per submission and reviewer in each cell: ``top`` (falling) and ``keys``, ties by paper key.

    Each side is shuffled once, by cell. A cell is one bounded product in its task; only the best k leave it.
    """
    names = {"round": ROUND, "reviewer": REVIEWER, "paper": PAPER, "key": PAPER_KEY}

    def best(subs: pa.Table, papers: pa.Table) -> pa.Table:
        papers = papers.sort_by([(names["reviewer"], "ascending"), (names["key"], "ascending")]).combine_chunks()
        reviewers = papers[names["reviewer"]].combine_chunks().dictionary_encode()
        codes, keys = reviewers.indices.to_numpy(zero_copy_only=False), papers[names["key"]].combine_chunks()
        parts = []
        if subs.num_rows and papers.num_rows:
            sims, met = kernel(subs, papers)
            # one whole number per pair orders by similarity, then by key
            places = np.rint(sims * 1e9).astype(np.int64) * papers.num_rows + np.arange(papers.num_rows)[::-1]
            places[~met] = np.iinfo(np.int64).min + 1
            for code, reviewer in enumerate(reviewers.dictionary):
                first, last = np.searchsorted(codes, [code, code + 1])
                width = min(k, last - first)
                block = places[:, first:last]
                chosen = np.argpartition(-block, width - 1, axis=1)[:, :width]
                chosen = first + np.take_along_axis(chosen, np.argsort(-np.take_along_axis(block, chosen, 1), axis=1), 1)
                have = np.take_along_axis(met, chosen, 1)
                some = np.flatnonzero(have.any(axis=1))
                offsets = pa.array(np.concatenate([[0], np.cumsum(have[some].sum(axis=1))]).astype(np.int32))
                rows, picked = subs.take(some), have[some]
                parts.append(pa.table({
                    names["round"]: rows[names["round"]], names["reviewer"]: pa.array([reviewer.as_py()] * len(some), reviewers.dictionary.type),
                    names["paper"]: rows[names["paper"]],
                    "top": pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(sims, chosen, 1)[some][picked])),
                    "keys": pa.ListArray.from_arrays(offsets, keys.take(pa.array(chosen[some][picked])))}))
        none = pa.table({names["round"]: subs[names["round"]].slice(0, 0), names["reviewer"]: papers[names["reviewer"]].slice(0, 0),
                         names["paper"]: subs[names["paper"]].slice(0, 0), "top": pa.array([], pa.list_(pa.float64())), "keys": pa.array([], pa.list_(keys.type))})
        return pa.concat_tables([none, *parts])

    types = _types(left, right)
    schema = ", ".join([*(f"{c} {types[c]}" for c in (ROUND, REVIEWER, PAPER)), "top array<double>", f"keys array<{types[PAPER_KEY]}>"])
    return _in_cells(left, right, sizes, options).applyInArrow(best, schema)


def _types(*tables: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for t in tables for f in t.schema}


def _in_cells(left: DataFrame, right: DataFrame, sizes: DataFrame, options: RunOptions):
    """Both placed sides, shuffled once each, put together by cell."""
    cell = [ROUND, *CELL]
    n = cell_tasks(sizes, F.col("n_subs"), F.col("n_papers"), options.cell_submissions, options.cell_papers)
    return left.repartition(n, *cell).groupBy(*cell).cogroup(right.repartition(n, *cell).groupBy(*cell))


def _pairs(left: DataFrame, right: DataFrame, sizes: DataFrame, kernel, options: RunOptions) -> DataFrame:
    """Every pair that meets in a cell, with ``sim``. A cell is one bounded product; pairs leave it as rows and are not shuffled."""
    names, room = {"round": ROUND, "reviewer": REVIEWER, "paper": PAPER, "key": PAPER_KEY}, 1 << 20

    def every(subs: pa.Table, papers: pa.Table) -> pa.Table:
        subs, papers = subs.combine_chunks(), papers.combine_chunks()
        none = pa.table({names["round"]: subs[names["round"]].slice(0, 0), names["reviewer"]: papers[names["reviewer"]].slice(0, 0),
                         names["paper"]: subs[names["paper"]].slice(0, 0), names["key"]: papers[names["key"]].slice(0, 0), "sim": pa.array([], pa.float64())})
        parts, step = [none], max(1, room // max(papers.num_rows, 1))
        for start in range(0, subs.num_rows if papers.num_rows else 0, step):
            some = subs.slice(start, step).combine_chunks()
            sims, met = kernel(some, papers)
            row, col = (pa.array(x) for x in np.nonzero(met))
            parts.append(pa.table({
                names["round"]: some[names["round"]].take(row), names["reviewer"]: papers[names["reviewer"]].take(col),
                names["paper"]: some[names["paper"]].take(row), names["key"]: papers[names["key"]].take(col), "sim": pa.array(sims[met])}))
        return pa.concat_tables(parts)

    types = _types(left, right)
    schema = ", ".join([*(f"{c} {types[c]}" for c in (ROUND, REVIEWER, PAPER, PAPER_KEY)), "sim double"])
    return _in_cells(left, right, sizes, options).applyInArrow(every, schema)


def sparse_tops(sub_rows: DataFrame, paper_rows: DataFrame, rounds: DataFrame, roster: DataFrame, options: RunOptions, k: int = TOP_PAPERS) -> DataFrame:
    """The k best cosines of packed rows that share a term, per submission, reviewer and cell.

    ``sub_rows`` has raw weights and the length of the whole vector, ``paper_rows`` weights of unit length.
    """
    left, right = _cells(sub_rows, paper_rows, rounds, roster, options)
    return _tops(left, right, rounds, _sparse_kernel(), options, k)


def dense_tops(sub_vectors: DataFrame, paper_vectors: DataFrame, rounds: DataFrame, roster: DataFrame, options: RunOptions, k: int = TOP_PAPERS) -> DataFrame:
    """The k best vector cosines per submission, reviewer and cell; zero vectors give 0."""
    left, right = _cells(sub_vectors, paper_vectors, rounds, roster, options)
    return _tops(left, right, rounds, _cosine_kernel(), options, k)


def sparse_pairs(sub_rows: DataFrame, paper_rows: DataFrame, rounds: DataFrame, roster: DataFrame, options: RunOptions) -> DataFrame:
    """Cosines of all pairs that share a term: one row per submission, reviewer and paper."""
    left, right = _cells(sub_rows, paper_rows, rounds, roster, options)
    return _pairs(left, right, rounds, _sparse_kernel(), options)


def dense_pairs(sub_vectors: DataFrame, paper_vectors: DataFrame, rounds: DataFrame, roster: DataFrame, options: RunOptions) -> DataFrame:
    """Vector cosines of all pairs; zero vectors give 0."""
    left, right = _cells(sub_vectors, paper_vectors, rounds, roster, options)
    return _pairs(left, right, rounds, _cosine_kernel(), options)


def best_pairs(tops: DataFrame, k: int = TOP_PAPERS) -> DataFrame:
    """The k most similar papers of each reviewer to each submission, from the cells' tops: one row per pair with its place.

    Every task cuts its own rows to k per group before the exchange, so what travels does not grow with the papers.
    """
    pairs = tops.select(*K, PAPER, F.explode(F.arrays_zip("keys", "top")).alias("_e")).select(
        *K, PAPER, F.col("_e.keys").alias(PAPER_KEY), F.col("_e.top").alias("sim"))
    return topk_per_group(pairs, [*K, PAPER], "sim", PAPER_KEY, k)


def pool_rows(subs: DataFrame, reviewers: DataFrame, rounds: DataFrame, options: RunOptions) -> DataFrame:
    """One row per reviewer and submission of the round: the result has a bid for each of them."""
    sizes = rounds.select(ROUND, "n_subs", "n_reviewers")
    n_subs, n_reviewers = F.col("n_subs"), F.col("n_reviewers")
    rows, cols = options.cell_submissions, options.cell_papers
    left = place_rows(subs.join(sizes, ROUND), [PAPER], n_subs, n_reviewers, rows, cols)
    right = place_cols(reviewers.join(sizes, ROUND), [REVIEWER], n_subs, n_reviewers, rows, cols)
    return left.drop("n_reviewers").join(right.drop("n_subs", "n_reviewers"), [ROUND, *CELL]).drop(*CELL)


def topk_mean(tops: DataFrame, pool: DataFrame, k: int = TOP_PAPERS) -> DataFrame:
    """Mean of the k best similarities for every row of the pool, 0 where nothing matched.

    The pool rows are united with the partial tops and reduced in one aggregation, which
    stands in for a left join and shuffles each side once. A list holds k values per cell.
    """
    carried = [c for c in pool.columns if c not in (*K, PAPER)]
    united = tops.select(*K, PAPER, "top").unionByName(pool, allowMissingColumns=True)
    merged = united.groupBy(*K, PAPER).agg(
        merge_tops(F.collect_list("top"), k).alias("_top"), *[F.max(c).alias(c) for c in carried])
    places = F.greatest(F.least(F.lit(k), F.col("n_papers")), F.lit(1))
    return merged.select(*K, PAPER, round9(top_mean(F.col("_top"), places)).alias("sim"), *carried)
