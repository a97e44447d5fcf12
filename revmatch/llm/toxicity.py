"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words and word beginnings (4 to 8 bytes) that labelled toxic documents have and others have not.
A text's features are densities of lexicon hits by strength and length of the entry, closeness of hits to second-person
words, capitals, punctuation and obfuscation rates, and length. A training document's features leave its own label out of
the lexicon's counts, and the calibration sees margins of trees that were fitted without the document, all from a sample
of at most ``SAMPLE`` labelled documents (a parameter; the choice is by a hash of the id). Every text is then scored whole, in one pass without
a shuffle.

Labels are read only where crc32(doc_id) mod 4 is not 2; label, lang, source and id are no inputs of a score.

Cases: null and empty texts have all-zero features and get a score like any other; without labels of both classes
every score is the share of toxic labels (0 without labels); equal texts get equal scores; several labels of a document
count as their largest; null labels are no labels; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.llm.common import ID, TEXT, fold, texts
from revmatch.llm.text import Words, doc_sums, each_block, lut, mix, per_doc, span_hashes

SAMPLE = 20000
#: Parts of the sample for the calibration.
PARTS = 4
#: Entries kept in the lexicon at most, the strongest first.
LEXICON = 20000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 8)
# Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself yourselves du dich dir dein deine tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER, _DIGIT, _MARK = lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), lut("0123456789"), lut("*@$#%^&_+=~")
_SHOUT, _STOP = lut("!?"), lut(".,;:")
FEATURES = ("hits", "hit_density", "strong", "strong_density", "word_hits", "prefix_hits", "weight_sum", "weight_max", "weight_density",
            "near_you", "you_density", "capitals", "shout", "stops", "obfuscated", "length")


def _keys(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word index and key of every word without outer punctuation, and of every word beginning."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (end - start > 1) & ~_LETTER[w.data[start]] & ~_DIGIT[w.data[start]]
        end -= (end - start > 1) & ~_LETTER[w.data[end - 1]] & ~_DIGIT[w.data[end - 1]]
    index = np.arange(len(start))
    out = [(index, span_hashes(w.data, start, end, lower=True))]
    for size in PREFIXES:
        long = np.flatnonzero(end - start > size)
        out.append((long, mix(span_hashes(w.data, start[long], start[long] + size, lower=True) + np.uint64(size))))
    return out


_YOU: np.ndarray | None = None


def _second_person() -> np.ndarray:
    global _YOU
    if _YOU is None:
        data = " ".join(SECOND_PERSON).encode()
        w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        _YOU = np.sort(_keys(w)[0][1])
    return _YOU


def _look_up(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Lexicon:
    """Sorted keys with the numbers of toxic and other documents that have them, among ``bad`` and ``good`` documents."""

    def __init__(self, keys=(), n1=(), n0=(), bad: int = 0, good: int = 0):
        keys = np.asarray(keys, np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        n1, n0 = np.asarray(n1, float)[order], np.asarray(n0, float)[order]
        self.least = max(3, round(0.003 * bad))
        self.weights = self._weigh(n1, n0, bad, good)
        self.without = self._weigh(n1, n0 - 1, bad, good), self._weigh(n1 - 1, n0, bad, good)  # one other, one toxic document less

    def _weigh(self, n1, n0, bad, good):
        w = np.log((n1 + 0.1) / (bad + 0.2)) - np.log((np.maximum(n0, 0) + 0.1) / (good + 0.2))
        return np.where((n1 >= self.least) & (w >= 1.8), w, 0.0)


def features(column, lexicon: Lexicon, toxic: np.ndarray | None = None) -> np.ndarray:
    """One row of ``FEATURES`` per text. ``toxic``: labels that the lexicon has counted, to be left out of it again."""
    keys, found = lexicon.keys, []
    for i, j, w in each_block(column, hashes=False):
        n, count = w.n, np.maximum(w.count, 1)
        best, kind = np.zeros(len(w.start)), np.zeros(len(w.start), int)
        parts = _keys(w)
        for k, (index, key) in enumerate(parts):
            at = _look_up(keys, key)
            hit = at >= 0
            value = np.zeros(len(at))
            if toxic is None:
                value[hit] = lexicon.weights[at[hit]]
            else:
                own = toxic[i:j][w.doc[index[hit]]]
                value[hit] = np.where(own == 1, lexicon.without[1][at[hit]], lexicon.without[0][at[hit]])
            better = value > best[index]
            best[index[better]], kind[index[better]] = value[better], k + 1
        hits = np.flatnonzero(best > 0)
        doc, value = w.doc[hits], best[hits]
        you = np.flatnonzero(_look_up(_second_person(), parts[0][1]) >= 0)
        near = np.zeros(len(hits))
        if len(you) and len(hits):
            after = np.searchsorted(you, hits)
            for side in (np.maximum(after - 1, 0), np.minimum(after, len(you) - 1)):
                gap = np.abs(you[side] - hits)
                near = np.maximum(near, np.where(w.doc[you[side]] == doc, 1 / (1 + gap), 0))
        top, close = np.zeros(n), np.zeros(n)
        np.maximum.at(top, doc, value)
        np.maximum.at(close, doc, near)
        letters = np.concatenate(([0], np.cumsum(_LETTER[w.data])))
        odd = np.concatenate(([0], np.cumsum(_DIGIT[w.data] | _MARK[w.data])))
        masked = (letters[w.end] - letters[w.start] >= 2) & (odd[w.end - 1] - odd[np.minimum(w.start + 1, w.end - 1)] > 0) if len(w.start) else np.zeros(0, bool)
        total, strong = per_doc(doc, n), per_doc(doc[value > 3], n)
        size = np.maximum(np.diff(w.offsets), 1)
        sums = per_doc(doc, n, value)
        found.append(np.stack([
            total, total / count, strong, strong / count, per_doc(w.doc[hits[kind[hits] == 1]], n), per_doc(w.doc[hits[kind[hits] > 1]], n),
            sums, top, sums / count, close, per_doc(w.doc[you], n) / count, doc_sums(_UPPER[w.data], w.offsets) / size,
            doc_sums(_SHOUT[w.data], w.offsets) / count, doc_sums(_STOP[w.data], w.offsets) / count, per_doc(w.doc[masked], n) / count,
            np.log1p(w.count)], 1).astype(float))
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 2.0):
    """Gradient-boosted trees for the logistic loss, split on histograms. Returns ``(start, [(feature, cut, leaves)])``:
    full binary trees, ``x > cut`` goes right."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], 1)
    margin, forest = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), int)
        feature, cut = np.zeros(2 ** depth - 1, int), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            split = np.full(width, bins + 1)
            for f in range(x.shape[1]):
                slot = node * (bins + 1) + binned[:, f]
                gs = np.bincount(slot, g, width * (bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(slot, h, width * (bins + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
                gain[(hs < least / 10) | (ht - hs < least / 10)] = 0
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                for k in np.flatnonzero(value > best):
                    if at[k] < len(cuts[f]):
                        best[k], split[k] = value[k], at[k]
                        feature[first + k], cut[first + k] = f, cuts[f][at[k]]
            right = binned[np.arange(len(y)), feature[first + node]] > split[node]
            node = 2 * node + right
        gs, hs = np.bincount(node, g, 2 ** depth), np.bincount(node, h, 2 ** depth)
        leaves = rate * gs / (hs + 1)
        margin += leaves[node]
        forest.append((feature, cut, leaves))
    return start, forest


def margins(x: np.ndarray, model) -> np.ndarray:
    start, forest = model
    out = np.full(len(x), start)
    for feature, cut, leaves in forest:
        node = np.zeros(len(x), int)
        first, width = 0, 1
        while width < len(leaves):
            f = feature[first + node]
            node = 2 * node + (x[np.arange(len(x)), f] > cut[first + node])
            first, width = first + width, width * 2
        out += leaves[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a monotone curve from margin to probability: pooled adjacent violators, each pool at its mean margin."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of y, size, sum of margins
    for m, v in zip(margin[order], y[order]):
        pools.append([float(v), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array(pools)
    return at[:, 2] / at[:, 1], at[:, 0] / at[:, 1]


def score(x: np.ndarray, model, knots) -> np.ndarray:
    if model is None:
        return np.full(len(x), knots)
    m = margins(x, model)
    raw = 1 / (1 + np.exp(-m))
    return np.clip(0.98 * np.interp(m, *knots) + 0.02 * raw, 0, 1)  # the share of the raw value orders what a pool makes equal


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, documents) of a batch's labelled texts."""
    for b in batches:
        toxic = np.asarray(b.column(1), np.int64)
        for i, j, w in each_block(b.column(0), hashes=False):
            for index, key in _keys(w):
                pair = np.unique(np.stack([key, w.doc[index].astype(np.uint64)], 1), axis=0)
                flag = toxic[i:j][pair[:, 1].astype(int)]
                for c in (0, 1):
                    keys, n = np.unique(pair[flag == c, 0], return_counts=True)
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), c)), pa.array(n)], names=["key", "toxic", "n"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """``(lexicon, model, knots)`` from at most ``sample`` labelled documents."""
    few = (labels.select(F.col(ID).cast("long").alias(ID), F.col("toxic").cast("int").alias("toxic")).filter(f"{ID} is not null and toxic is not null")
           .filter(fold(4) != 2).groupBy(ID).agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64(ID), ID).limit(sample))
    part = F.pmod(F.xxhash64(ID, F.lit("part")), F.lit(10))
    known = texts(docs).join(F.broadcast(few), ID).select(TEXT, "toxic", part.alias("part"))  # at most ``sample`` rows are sent
    sizes = {r["toxic"]: r["n"] for r in few.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    share = bad / max(bad + good, 1)
    if not bad or not good:
        return Lexicon(), None, share
    seen = known.select(TEXT, "toxic").mapInArrow(_word_counts, "key long, toxic long, n long")
    n1, n0 = (F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)) for c in (1, 0))
    weight = F.log((F.col("n1") + 0.1) / (bad + 0.2)) - F.log((F.col("n0") + 0.1) / (good + 0.2))
    top = (seen.groupBy("key").agg(n1.alias("n1"), n0.alias("n0")).filter(F.col("n1") >= max(3, round(0.003 * bad)))
           .filter(weight >= 1.5).orderBy(F.desc(weight * F.log1p("n1")), "key").limit(LEXICON).toPandas())
    lexicon = Lexicon(top["key"], top["n1"], top["n0"], bad, good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(0), lexicon, np.asarray(b.column(1), np.int64))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([b.column(1), b.column(2), lists], names=["toxic", "part", "x"])

    rows = known.mapInArrow(run, "toxic int, part long, x array<double>").toPandas()  # numbers of at most ``sample`` rows
    if not len(rows):
        return lexicon, None, share
    x, y, part = np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(float), rows["part"].to_numpy() % PARTS
    order = np.lexsort((part, y, *x.T))  # rows arrive in any order; the fit must not depend on it
    return lexicon, *calibrated(x[order], y[order], part[order], share)


def calibrated(x: np.ndarray, y: np.ndarray, part: np.ndarray, share: float):
    """Trees fitted to all rows, and a calibration fitted to margins that trees of the other parts give each part."""
    margin = np.zeros(len(y))
    for k in range(PARTS):
        rest = part != k
        if len(set(y[rest])) < 2:
            return None, share
        margin[~rest] = margins(x[~rest], boost(x[rest], y[rest]))
    return boost(x, y), isotonic(margin, y)


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A function from an Arrow text column to scores."""
    lexicon, model, knots = train(docs, labels, sample)
    return lambda column: score(features(column, lexicon), model, knots)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every text."""
    rate = scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(rate(b.column(1)))], names=[ID, "score"])

    return (texts(docs).mapInArrow(run, f"{ID} long, score double")
            .select(ID, (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, whose text scores below the threshold."""
    rate = scorer(docs, labels)
    at = docs.columns.index(TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(rate(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
