"""Language-model scores by deleted interpolation of n-grams.

P(w | v) mixes the maximum-likelihood bigram, the maximum-likelihood unigram and a uniform distribution; the three weights depend on
how often the context v was seen (a bucket per octave) and are learnt by expectation-maximisation on held-out counts: a
sixth of the training documents is deleted from the counts while the weights are fitted to it. The final model counts all
training documents. Beginnings and ends of documents are contexts and tokens of their own.

How it scales. Documents are gathered into batches of a few MB, written once. Each batch sends every distinct
word and bigram it has, with its count, to the key's hash range (one small binary per batch and range), where the counts
of all batches are summed; the sums go back in the same order. So a worker holds one batch or one hash range, never
the vocabulary, a frequent key arrives once per batch and not once per occurrence, and nothing but
(N, V) and a bounded histogram for the mixture weights reaches the driver.

Cases: null and empty texts are one end token; equal rows get equal scores and count as often as they stand there; a null id has its
crc32 taken of empty text; without training documents N and V are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.llm.batches import gather, grow, hash_ranges, range_count, shrink, unpack
from revmatch.llm.common import ID, TEXT, fold, texts, written
from revmatch.llm.text import Words, buffer, chain

FOLDS, HELD, DELETED = 7, 2, 3
BUCKETS, GRID, CELLS = 32, 4, 200
_BEGIN, _END = chain([np.array([1, 2], np.uint64), np.array([7, 11], np.uint64)])


class Batch:
    """A batch's documents and, per token, its word, its context and their keys."""

    def __init__(self, packed: bytes):
        docs = unpack(packed)
        data, offsets = buffer(docs.column(0))
        self.ids, self.held = docs.column(1).combine_chunks(), docs.column(2).to_numpy()
        w = Words(data, offsets, lower=True)
        n = len(offsets) - 1
        self.count = w.count + 1  # the end is a token
        self.doc = np.repeat(np.arange(n), self.count)
        self.token = np.full(len(w.hash) + n, _END)
        self.token[np.arange(len(w.hash)) + w.doc] = w.hash
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[np.cumsum(self.count) - self.count] = _BEGIN

    def keys(self, places: bool = False):
        """Sorted distinct keys of words (with the beginning of a document as one) and of bigrams; optionally the
        place of every token's word, context and bigram among them."""
        starts = np.full(len(self.count), _BEGIN)
        words = np.concatenate([self.token, starts])
        pairs = chain([self.context, self.token])
        if not places:
            return words, pairs
        word_keys, at = np.unique(words, return_inverse=True)
        pair_keys, pair_at = np.unique(pairs, return_inverse=True)
        word_at = at[:len(self.token)]
        context_at = np.empty_like(word_at)
        context_at[1:] = word_at[:-1]
        context_at[np.cumsum(self.count) - self.count] = np.searchsorted(word_keys, _BEGIN)
        return word_keys, pair_keys, word_at, context_at, pair_at


def _counted(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how many of their occurrences are in training documents."""
    if trains.all():
        return np.unique(keys, return_counts=True)
    all_keys = np.unique(keys)
    some, n = np.unique(keys[trains], return_counts=True)
    out = np.zeros(len(all_keys), np.int64)
    out[np.searchsorted(all_keys, some)] = n
    return all_keys, out


_SENT = "batch long, range long, deleted boolean, words binary, word_n binary, pairs binary, pair_n binary"


def _send(ranges: int):
    """Each batch's keys and counts, one row per hash range that it has keys in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, deleted, packed in zip(*(c.to_pylist() for c in b.columns)):
                batch = Batch(packed)
                words, pairs = batch.keys()
                trains = ~batch.held
                by_token = trains[batch.doc]
                kinds = [_counted(words, np.concatenate([by_token, trains])), _counted(pairs, by_token)]
                cuts = [np.searchsorted(hash_ranges(k, ranges), np.arange(ranges + 1, dtype=np.uint64)) for k, _ in kinds]
                rows = []
                for r in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist():
                    row = [number, r, deleted]
                    for (k, n), cut in zip(kinds, cuts):
                        part = k[cut[r]:cut[r + 1]]
                        row += [shrink(np.diff(part, prepend=np.uint64(0))), shrink(n[cut[r]:cut[r + 1]].astype(np.uint32))]
                    rows.append(row)
                types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
                names = [c.split()[0] for c in _SENT.split(", ")]
                del batch, words, pairs, kinds
                for k in range(0, len(rows), 64):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 64]), types)], names=names)

    return run


def _sum(group: pa.Table) -> pa.Table:
    """Sums of one hash range over all batches, sent back to each in the order of its keys; one more row has N and V."""
    deleted = group.column("deleted").to_numpy()
    back: list[list[bytes]] = []
    totals = []
    for keys_of, counts_of in (("words", "word_n"), ("pairs", "pair_n")):
        keys = [np.cumsum(grow(v, np.uint64), dtype=np.uint64) for v in group.column(keys_of).to_pylist()]
        counts = [grow(v, np.uint32) for v in group.column(counts_of).to_pylist()]
        sizes = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(counts).astype(float)
        every = np.bincount(at, n, len(distinct))
        lost = np.bincount(at, n * np.repeat(deleted, sizes), len(distinct))
        if keys_of == "words":
            real = distinct != _BEGIN
            totals = [int(every[real].sum()), int((every[real] > 0).sum()), int(lost[real].sum())]
        cut = np.cumsum(sizes)[:-1]
        back.append([shrink(every[p].astype(np.uint64)) for p in np.split(at, cut)])
        back.append([shrink(lost[p].astype(np.uint64)) if d else None for p, d in zip(np.split(at, cut), deleted)])
    rows = group.num_rows
    columns = [pa.array([*group.column("batch").to_pylist(), None], pa.int64()), pa.array([*group.column("range").to_pylist(), None], pa.int64()),
               *(pa.array([*v, None], pa.binary()) for v in back),
               *(pa.array([None] * rows + [t], pa.int64()) for t in totals)]
    return pa.table(columns, names=_BACK_NAMES)


_BACK = "batch long, range long, words binary, words_lost binary, pairs binary, pairs_lost binary, n long, v long, n_lost long"
_BACK_NAMES = [c.split()[0] for c in _BACK.split(", ")]


def _meet(group: pa.Table, lost: bool) -> tuple[Batch, list[np.ndarray], list[np.ndarray]]:
    """A batch with the counts that came back: ``(word, context, pair)`` counts of each token, and the places' keys."""
    packed = next(v for v in group.column("docs").to_pylist() if v is not None)
    batch = Batch(packed)
    order = [i for _, i in sorted((r, i) for i, r in enumerate(group.column("range").to_pylist()) if r is not None)]
    names = ["words", "pairs"] + (["words_lost", "pairs_lost"] if lost else [])
    got = {}
    for name in names:
        column = group.column(name)
        got[name] = np.concatenate([grow(column[i].as_py(), np.uint64) for i in order]).astype(float)
    _, _, word_at, context_at, pair_at = batch.keys(places=True)
    every = [got["words"][word_at], got["words"][context_at], got["pairs"][pair_at]]
    gone = [got["words_lost"][word_at], got["words_lost"][context_at], got["pairs_lost"][pair_at]] if lost else []
    return batch, every, gone


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(context + 1)), BUCKETS - 1).astype(int)


def _mixture(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram estimates, as multiples of the uniform one."""
    return np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0) * (v + 1), word / max(n, 1) * (v + 1)


def _histogram(n: int, v: int):
    """Held-out tokens counted by bucket and by the two estimates on a grid of ``GRID`` steps an octave."""
    def run(group: pa.Table) -> pa.Table:
        _, every, gone = _meet(group, True)
        word, context, pair = (a - b for a, b in zip(every, gone))
        two, one = _mixture(word, context, pair, n, v)
        step = lambda x: np.where(x > 0, np.clip(np.round(np.log2(np.maximum(x, 1e-30)) * GRID) + CELLS // 2, 1, CELLS - 1), 0).astype(np.int64)
        cell, count = np.unique((bucket(context) * CELLS + step(two)) * CELLS + step(one), return_counts=True)
        return pa.table([pa.array(cell), pa.array(count)], names=["cell", "n"])

    return run


def learn(cells: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights ``(bucket, bigram/unigram/uniform)`` by EM; buckets without held-out tokens take those of their lower neighbour."""
    def value(k):
        return np.where(k > 0, 2.0 ** ((k - CELLS // 2) / GRID), 0.0)

    of, two, one = cells // (CELLS * CELLS), value(cells // CELLS % CELLS), value(cells % CELLS)
    parts = np.stack([two, one, np.ones(len(cells))], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    seen = np.bincount(of, counts, BUCKETS)
    for _ in range(rounds):
        each = weights[of] * parts
        each *= (counts / each.sum(1))[:, None]
        new = np.stack([np.bincount(of, each[:, k], BUCKETS) for k in range(3)], 1) + np.array([0.05, 0.5, 0.05])
        weights = new / new.sum(1, keepdims=True)
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    weights[0, 0] = min(weights[0, 0], 1e-9)  # a context never seen has no bigrams
    return weights / weights.sum(1, keepdims=True)


def _score(n: int, v: int, weights: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        batch, (word, context, pair), _ = _meet(group, False)
        two, one = _mixture(word, context, pair, n, v)
        mix = weights[bucket(context)]
        p = (mix[:, 0] * two + mix[:, 1] * one + mix[:, 2]) / (v + 1)
        docs = len(batch.count)
        add = lambda x: np.bincount(batch.doc, x, docs)
        base = np.log10(word + 1) - np.log10(n + v + 1)
        return pa.table([batch.ids, pa.array(batch.held), pa.array(batch.count.astype(np.int64)), pa.array(add(word > 0).astype(np.int64)),
                         pa.array(np.full(docs, n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))], names=_OUT_NAMES)

    return run


_OUT = f"{ID} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def score(docs: DataFrame) -> DataFrame:
    """Scores of all documents under the model of those outside the held-out fold."""
    flags = texts(docs).select((fold(FOLDS) == DELETED).alias("apart"), TEXT, ID, (fold(FOLDS) == HELD).alias("held"))
    batches = written(flags.mapInArrow(gather, "batch long, apart boolean, docs binary").withColumnRenamed("apart", "deleted"), "lm-batches")
    ranges = range_count(docs.agg(F.sum(F.octet_length(TEXT))).first()[0])
    back = written(batches.mapInArrow(_send(ranges), _SENT).groupBy("range").applyInArrow(_sum, _BACK), "lm-counts")
    n, v, lost = (int(x or 0) for x in back.filter("batch is null").agg(F.sum("n"), F.sum("v"), F.sum("n_lost")).first())
    counts = back.filter("batch is not null").select("batch", "range", "words", "words_lost", "pairs", "pairs_lost", F.lit(None).cast("binary").alias("docs"))
    empty = {c: F.lit(None).cast("binary").alias(c) for c in ("words", "words_lost", "pairs", "pairs_lost")}

    def met(flag: bool | None) -> DataFrame:
        some = batches if flag is None else batches.filter(F.col("deleted") == flag)
        held = counts if flag is None else counts.filter("words_lost is not null")
        return some.select("batch", F.lit(None).cast("long").alias("range"), *empty.values(), "docs").unionByName(held).groupBy("batch")

    cells = met(True).applyInArrow(_histogram(n - lost, v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    weights = learn(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float))  # at most BUCKETS * CELLS * CELLS rows
    return met(None).applyInArrow(_score(n, v, weights), _OUT)
