"""Whitening against numpy on the same rows."""

import math

import numpy as np

from revmatch.llm import whiten
from revmatch.llm.common import table
from tests.llm.helpers import nothing

SCHEMA = "vec_id long, embedding array<float>, label int, row long, x string, y string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 7, "clash", "clash") for i, v in vectors], SCHEMA)


def check(df, vectors, components=32):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] + [1000000] * (d - len(v)) for _, v in kept], dtype=object)
    n, s = len(kept), x.sum(axis=0)
    centred = np.array([[float(int(x[r, c]) - s[c] / n) for c in range(d)] for r in range(n)])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    want, trace = centred @ axes[:, :k] / np.sqrt(e[:k]), e.sum()
    rows = df.collect()
    assert len(rows) == n * k and {r["component"] for r in rows} == set(range(1, k + 1))
    exact = {}
    for (i, _), r in zip(kept, x):
        exact.setdefault(i, []).append(sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s)))
    order = {i: [j for j, (v, _) in enumerate(kept) if v == i] for i, _ in kept}
    for c in range(1, k + 1):
        mine = [r for r in rows if r["component"] == c]
        assert {r["n"] for r in mine} == {n} and all(abs(r["explained"] / (e[c - 1] / trace) - 1) < 1e-6 and r["identity_error"] < 1e-8 for r in mine)
        assert sorted(((r["vec_id"], r["deviation"]) for r in mine), key=str) == sorted(((i, v) for i, vs in exact.items() for v in vs), key=str)
        by = {}
        for r in mine:
            by.setdefault(r["vec_id"], []).append(r["whitened"])
        signs = [max(np.abs(np.sort(by[i]) - np.sort(sign * want[order[i], c - 1])).max() for i in by) for sign in (1, -1)]
        assert min(signs) < 1e-5, (c, signs)


def test_whole_table(spark, sf_dir):
    check(whiten.whiten(table(spark, sf_dir, "embeddings")), [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()])


def test_uneven_repeated_and_broken_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(c) for c in rng.normal(size=9) * np.arange(1, 10) * 3]) for k in range(3000)]
    vectors += [(5, vectors[5][1])] * 2 + [(None, vectors[6][1]), (9001, None), (9002, [1.0, None] * 4), (9003, [float("nan")] * 9),
                                           (9004, [float("inf")] + [0.0] * 8), (9005, [1.0, -2.0]), (9006, [])]
    check(whiten.whiten(frame(spark, vectors).repartition(5)), vectors, 32)
    check(whiten.whiten(frame(spark, vectors), 4), vectors, 4)


def test_flat_directions_and_small_tables(spark):
    """A direction without variance has no component; one vector alone, or none, gives no rows."""
    flat = [(k, [float(k % 7), 3.0, float(k % 5) * 2]) for k in range(70)]
    check(whiten.whiten(frame(spark, flat)), flat)
    for vectors in ([(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        df = whiten.whiten(frame(spark, vectors))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten.whiten(nothing(frame(spark, flat))).collect() == []


def test_blocks_are_split_along_the_rows(spark):
    """More blocks than one task adds up give the same scatter."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(5000, 6))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "row long, y array<double>")
    old = whiten.SPAN
    try:
        whiten.SPAN = 1
        got = whiten.scatter(whiten.matrix(df, "y", 5000, 6), 5000, 6)
    finally:
        whiten.SPAN = old
    assert np.allclose(got, rows.T @ rows, rtol=1e-12)
