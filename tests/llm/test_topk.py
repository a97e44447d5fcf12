"""Three-phase top-k against all products."""

import math
from collections import Counter

import numpy as np
import pytest

from revmatch.llm import topk
from revmatch.llm.common import table
from revmatch.llm.queries import SQL
from tests.check_oracle import connect
from tests.llm.helpers import nothing

SCHEMA = "vec_id long, embedding array<double>, label int, x string, rows string, found string, q long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "clash", "clash", "clash", 5) for i, v in vectors], SCHEMA)


def brute(vectors, k=5, every=50):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, c)), j is None, j or 0) for b, (j, c) in enumerate(kept) if b != a)[:k]
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(found)]
    return Counter(out)


def got(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_whole_table(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    want = brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert got(topk.search(vectors)) == want
    assert Counter(connect(sf_dir).execute(f"select query_id, rank, vec_id, score from ({SQL['op11_topk']})").fetchall()) == want


@pytest.mark.parametrize("lists,depth,size", [(2, 24, (2048, 8192)), (3, 1, (7, 50)), (1, 6, (16, 64)), (99, 2, (4, 1000))])
def test_copies_ties_and_awkward_rows(spark, lists, depth, size):
    rng = np.random.default_rng(5)
    vectors = [(int(k), [float(c) for c in rng.integers(-3, 4, 7) / 4]) for k in range(900)]
    same = [0.5, -0.25, 0.0, 0.75, 0.125, -1.0, 0.5]
    vectors += [(k, same) for k in range(2000, 2400)] + [(2050, same), (100, same), (100, vectors[3][1]), (100, vectors[100][1]), (100, vectors[100][1])]
    vectors += [(None, same), (None, [1.0] * 7), (3000, None), (3050, [float("nan")] * 7), (3100, [None] * 7), (3150, [float("-inf")] * 7),
                (3200, [0.5, 0.5]), (3250, []), (-50, [-1.0] * 7)]
    df = frame(spark, vectors).repartition(3)
    assert got(topk.search(df, lists=lists, depth=depth, size=size, hot=3)) == brute(vectors)


def test_few_rows(spark):
    for vectors in ([], [(50, [1.0, 2.0])], [(50, [1.0]), (50, [1.0])], [(50, [1.0]), (100, [-1.0]), (7, [2.0])], [(50, None), (1, [1.0])],
                    [(50, []), (1, [])], [(k, [1.0, 1.0]) for k in range(40, 60)], [(1, [1.0]), (2, [1.0])]):
        df = topk.search(frame(spark, vectors))
        assert got(df) == brute(vectors), vectors
        assert df.columns == ["query_id", "rank", "vec_id", "score"]
    assert got(topk.search(nothing(frame(spark, [(50, [1.0])])))) == Counter()


def test_large_numbers(spark):
    """Products beyond what doubles hold exactly, and beyond what whole-number columns hold."""
    rng = np.random.default_rng(6)
    vectors = [(k * 25, [float(c) for c in rng.integers(-(1 << 33), 1 << 33, 4) / 8192]) for k in range(60)]
    assert got(topk.search(frame(spark, vectors), depth=2)) == brute(vectors)
    with pytest.raises(Exception, match="2\\^62"):
        topk.search(frame(spark, [(50, [1e15, 1.0]), (1, [1e15, 2.0])])).collect()


def test_phases_prune(spark, sf_dir):
    """The second phase sends a small part of all pairs, and what it does not send can't be among the best."""
    vectors = topk.padded(topk.whole_vectors(table(spark, sf_dir, "embeddings"), 256.0), 64, 0)
    rows = vectors.collect()
    c = spark.createDataFrame([(n, r["x"]) for n, r in enumerate(rows)], "c long, x array<long>")
    q = c.filter("c % 50 = 0").withColumnRenamed("c", "q")
    asked = []
    real = topk._Lists.whole_scores
    try:
        topk._Lists.whole_scores = lambda self, pairs: (asked.append(pairs.count()), real(self, pairs))[1]
        found = topk.nearest(q, c, 64, 6).collect()
    finally:
        topk._Lists.whole_scores = real
    x = np.array([r["x"] for r in rows])
    for n in range(0, len(rows), 50):
        scores = x @ x[n]
        assert sorted((-r["score"], r["c"]) for r in found if r["q"] == n) == sorted((-int(s), j) for j, s in enumerate(scores))[:6]
    assert asked[1] < asked[0] < 10 * 2 * topk.DEPTH + 1
