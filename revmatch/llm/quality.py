"""Quality rules by weak supervision.

Rules look at each whole text and vote good, bad, or abstain. Votes of all documents are counted by pattern (at most
3^rules patterns, whatever the size of the corpus); expectation-maximisation over those counts estimates how often each
rule is right for good and for bad documents, and the posterior probability of good decides. Two plain limits
(``base_failed``) stay hard, and what fails them is not learnt from: those short or repetitive texts are rejected already, and would
pass for the bad class by their number alone.

Cases: null and empty texts have zero counts and fail the base; equal rows get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.llm.common import ID, TEXT, texts, written
from revmatch.llm.text import chain, doc_sums, each_block, lut, mix, per_doc, span_hashes

SYMBOLS = "#*$%&|<>"
_SYMBOL, _UPPER, _END = lut(SYMBOLS), lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), lut(".!?")
_SHOUT, _DIGIT = lut("!"), lut("0123456789")

#: name: (numerator, denominator, bad at or above); good at ``FAR`` of that or less, and between the two the rule abstains.
HIGH_IS_BAD = {
    "symbols": ("n_symbols", "word_chars", 0.05),
    "capitals": ("n_upper", "word_chars", 0.30),
    "shouting": ("n_shout", "n_words", 0.15),
    "repeated_words": ("n_repeat_words", "n_words", 0.30),
    "repeated_lines": ("n_dup_lines", "n_lines", 0.30),
    "digits": ("n_digits", "word_chars", 0.20),
    "same_words": ("n_same_words", "n_words", 0.80),
}
#: name: (numerator, denominator, bad below, good from, good to, bad above)
IN_RANGE = {
    "word_length": ("word_chars", "n_words", 2.5, 3.5, 9.0, 14.0),
    "sentence_length": ("n_words", "n_ends", 1.5, 3.0, 60.0, 250.0),
    "length": ("n_words", None, 50.0, 80.0, 1e12, 1e15),
}
FAR = 0.5
#: How often a rule is expected to accuse good documents before any is seen.
FALSE_ALARM = 0.005
RULES = (*HIGH_IS_BAD, *IN_RANGE)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_shout", "n_digits", "n_ends", "n_same_words")
_SCHEMA = f"{ID} long, " + ", ".join(f"{c} long" for c in (*_COUNTS, *_MORE))


def measures(column) -> dict[str, np.ndarray]:
    """The counts of every text of an Arrow column."""
    found: dict[str, list[np.ndarray]] = {c: [] for c in (*_COUNTS, *_MORE)}
    for _, _, w in each_block(column):
        n, data, offsets = w.n, w.data, w.offsets
        put = lambda name, values: found[name].append(np.asarray(values, np.int64))
        put("n_words", w.count)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        put("word_chars", per_doc(w.doc, n, points[w.end] - points[w.start]))
        for name, mask in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_shout", _SHOUT), ("n_digits", _DIGIT)):
            put(name, doc_sums(mask[data], offsets))
        put("n_ends", per_doc(w.doc, n, _END[data[w.end - 1]]) if len(w.end) else np.zeros(n))
        # lines
        cut = np.zeros(len(data) + 1, bool)
        cut[np.flatnonzero(data == 10) + 1] = True
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        end = np.concatenate((start[1:], [len(data)])) if len(start) else start
        end = np.where((end > start) & (data[np.maximum(end, 1) - 1] == 10), end - 1, end) if len(start) else end
        doc = np.searchsorted(offsets, start, "right") - 1
        first_word = np.searchsorted(w.start, start, "left")
        has = (first_word < len(w.start)) & (np.append(w.start, len(data) + 1)[first_word] < end)
        start, end, doc = start[has], end[has], doc[has]
        put("n_lines", per_doc(doc, n))
        put("n_dup_lines", per_doc(doc, n) - _distinct(span_hashes(data, start, end), doc, n))
        # words in repeated windows of three
        at, key = w.windows(3)
        _, group, size = np.unique(_keyed(key, w.doc[at]), return_inverse=True, return_counts=True)
        twice = at[size[group] > 1]
        marked = np.zeros(len(w.start) + 3, bool)
        for k in range(3):
            marked[twice + k] = True
        put("n_repeat_words", per_doc(w.doc[marked[:len(w.doc)]], n))
        put("n_same_words", w.count - _distinct(w.hash, w.doc, n))
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in found.items()}


def _keyed(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return chain([key, mix(doc.astype(np.uint64))])


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return per_doc(doc[np.unique(_keyed(key, doc), return_index=True)[1]], n)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = measures(b.column(1))
        yield pa.record_batch([b.column(0), *(pa.array(v) for v in got.values())], names=[ID, *got])


def votes() -> list:
    """One column per rule: 1 good, 0 bad, null abstains."""
    share = lambda top, below: F.col(top) / F.greatest(F.col(below), F.lit(1)) if below else F.col(top).cast("double")
    out = []
    for name, (top, below, bad) in HIGH_IS_BAD.items():
        x = share(top, below)
        out.append(F.when(x >= bad, 0).when(x <= FAR * bad, 1).alias(name))
    for name, (top, below, low, good, to, high) in IN_RANGE.items():
        x = share(top, below)
        out.append(F.when((x < low) | (x > high), 0).when((x >= good) & (x <= to), 1).alias(name))
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (1, 0, nan). Returns the posterior of each pattern, the share of good documents, and
    the accuracies ``(rule, class)``: how often a rule that votes is right when the document is bad (0) or good (1).

    A rule has three outcomes (bad, good, abstain) with a probability of each per class, so a rule that seldom speaks
    but is right when it does weighs more than many that wave everything through. The start and a few pseudo-counts assume
    rules that accuse good documents rarely, which keeps the classes from changing places; all rates are learnt, without bounds,
    so a bad vote that good documents get as often as bad ones loses its weight.
    """
    outcome = np.stack([patterns == 0, patterns == 1, np.isnan(patterns)], 2).astype(float)  # pattern, rule, outcome
    speaks = (patterns == 1).any(0)  # rules that vote good as well
    right = 1 / max(2, len(speaks))  # a bad document is expected to fail about one rule
    prior = np.where(speaks[:, None, None], [[[right, 0.8 - right, 0.2], [FALSE_ALARM, 0.8, 0.2]]],
                     [[[right, 1e-9, 1 - right], [FALSE_ALARM, 1e-9, 1]]])  # rule, class (bad, good), outcome
    prior = prior / prior.sum(2, keepdims=True)
    theta = prior.copy()
    share, total = 0.85, float(counts.sum())
    strength = 2 + 0.002 * total
    post = np.full(len(patterns), share)
    for _ in range(rounds):
        like = np.einsum("pro,rco->pc", outcome, np.log(theta))
        new = 1 / (1 + np.exp(-np.clip(like[:, 1] - like[:, 0] + np.log(share / (1 - share)), -500, 500)))
        moved = np.abs(new - post).max(initial=0)
        post = new
        share = (float((post * counts).sum()) + 0.85 * strength) / (total + strength)
        for c, p in ((0, 1 - post), (1, post)):
            hits = np.einsum("p,pro->ro", p * counts, outcome) + strength * prior[:, c]
            theta[:, c] = hits / hits.sum(1, keepdims=True)
        if moved < 1e-9:
            break
    spoken = theta[:, :, :2]
    return post, share, np.stack([spoken[:, c, c] / spoken[:, c].sum(1) for c in (0, 1)], 1)


def judge(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, every rule's vote, ``posterior`` of good, ``base_failed`` and ``kept``."""
    spark = docs.sparkSession
    counted = written(texts(docs).mapInArrow(_measure, _SCHEMA).select("*", *votes()), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    seen = counted.groupBy(*RULES).agg(F.sum(F.when(failed, 0).otherwise(1)).alias("count")).collect()  # at most 3^len(RULES) rows
    patterns = np.array([[np.nan if r[x] is None else r[x] for x in RULES] for r in seen], float).reshape(len(seen), len(RULES))
    post, _, _ = fit(patterns, np.array([r["count"] for r in seen], float))
    code = lambda values: "".join("-" if v is None else str(v) for v in values)
    known = spark.createDataFrame([(code(r[x] for x in RULES), float(p)) for r, p in zip(seen, post)], "pattern string, posterior double")
    return (counted.withColumn("pattern", F.concat(*(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in RULES)))
            .join(F.broadcast(known), "pattern")  # bounded as above
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("posterior") >= keep_from)))


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select(ID, *_COUNTS, "base_failed", "kept", "posterior")
