import math
import random
from bisect import bisect_left, bisect_right

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revmatch.operators import bids, ranking, rerank
from revmatch.params import RunOptions, ScoringParams
from revmatch.schemas import K

V = [-20.0, -10.0, -10.0, 0.0, 5.0, 8.0, 12.0, 15.0, 18.0, 20.0]


def half_away(x):
    x = round(x, 9)
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def brute_quantiles(values):
    n = len(values)
    return [(sum(u < v for u in values) + (sum(u == v for u in values) - 1) / 2 + 0.5) / n for v in values]


def brute_bids(values, frac, top):
    ordered = sorted(values)
    n = len(values)
    tau = ordered[min(max(round((1.0 - frac) * n), 0), n - 1)]
    high, low = (ordered[-1] - tau) or 1.0, (tau - ordered[0]) or 1.0
    return [max(1, min(top, 1 + half_away((v - tau) / high * (top - 1)))) if v > tau
            else max(-top, min(0, half_away((v - tau) / low * top))) for v in values]


def pool(spark, values, round_id="r", reviewer=1, topic=0.0):
    rows = [(round_id, reviewer, i, float(v), float(topic), len(values), 5) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "round_id string, reviewer_id bigint, paper bigint, sim double, topic_base double, n_subs bigint, n_papers bigint")


def by_paper(df, column):
    return [r[column] for r in df.orderBy("paper").collect()]


def bids_of(spark, values, frac, params=ScoringParams()):
    df = pool(spark, values).withColumn("value", F.col("sim"))
    bounds = ranking.threshold_table(ranking.value_counts(df, K, "value"), K, "value", frac)
    return by_paper(bids._with_bid(df.join(bounds, K), params), "bid")


def test_quantiles_share_the_mean_rank(spark):
    got = by_paper(ranking.quantile(pool(spark, [0, 0, 0, .2, .5]), K, "sim"), "q")
    assert got == pytest.approx([.3, .3, .3, .7, .9])


@pytest.mark.parametrize("gain, want", [
    (9.0, [-8, -8, -8, 8, 16]), (4.5, [-3.2, -3.2, -3.2, 3.2, 12.8]),
    (18.0, [-12.649111] * 3 + [12.649111, 17.888544]), (0.0, [-8, -8, -8, 8, 16])])
def test_signal_curve(spark, gain, want):
    q = ranking.quantile(pool(spark, [0, 0, 0, .2, .5]), K, "sim")
    got = by_paper(q.withColumn("sem", bids.sem_signal(F.col("q"), ScoringParams(sem_gain=gain))), "sem")
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("frac, want", [
    (0.0, [-20, -15, -15, -10, -8, -6, -4, -3, -1, 0]), (0.1, [-20, -15, -15, -10, -8, -6, -4, -3, -1, 0]),
    (0.3, [-20, -14, -14, -9, -6, -4, -2, 0, 12, 20]), (0.5, [-20, -13, -13, -6, -2, 0, 7, 12, 17, 20]),
    (1.0, [0, 6, 6, 11, 13, 14, 16, 18, 19, 20])])
def test_bids_at_fractions(spark, frac, want):
    assert bids_of(spark, V, frac) == want


def test_bid_edges(spark):
    assert bids_of(spark, V, 0.3, ScoringParams(bid_max=1)) == [-1, -1, -1, 0, 0, 0, 0, 0, 1, 1]
    assert bids_of(spark, [3.0] * 3, 0.1) == [0, 0, 0]
    assert bids_of(spark, [7.0], 0.5) == [0]


def skewed(spark, seed=3):
    """One pool with most rows, heavy ties at 0 and a group of copies; two small pools."""
    rnd = random.Random(seed)
    big = [0.0] * 300 + [0.25] * 200 + [round(rnd.random(), 9) for _ in range(400)]
    rnd.shuffle(big)
    df = pool(spark, big, "big", 1).withColumn("topic_base", (F.col("paper") % 5 - 2) * 4.0)
    return df.unionByName(pool(spark, [round(rnd.random(), 9) for _ in range(37)], "big", 2)).unionByName(
        pool(spark, [0.5] * 11, "small", 1))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tie_limit", [5, 10_000])
def test_quantiles_of_skewed_pools_equal_brute_force(spark, tie_limit):
    got = rows(ranking.quantile(skewed(spark), K, "sim", tie_limit=tie_limit))
    for key in (("big", 1), ("big", 2), ("small", 1)):
        mine = [r for r in got if r[:2] == key]
        assert [r[-1] for r in mine] == pytest.approx(brute_quantiles([r[3] for r in mine]))
    assert len(got) == 948


@pytest.mark.parametrize("frac, tie_limit", [(0.1, 20), (1.0, 10_000)])
def test_bids_of_skewed_pools_equal_the_plain_formula(spark, frac, tie_limit):
    params = ScoringParams()
    got = rows(bids.bids(skewed(spark), params, RunOptions(positive_frac=frac), tie_limit).select("round_id", "reviewer_id", "paper", "sim", "topic_base", "bid"))
    for key in (("big", 1), ("big", 2), ("small", 1)):
        mine = [r for r in got if r[:2] == key]
        sems = [max(-20, min(20, (1 if x >= 0 else -1) * abs(x) ** 1.0 * 20)) for x in (2 * q - 1 for q in brute_quantiles([r[3] for r in mine]))]
        values = [math.floor((0.65 * s + 0.35 * r[4]) * 1e9 + 0.5) / 1e9 for s, r in zip(sems, mine)]
        assert [r[-1] for r in mine] == brute_bids(values, frac, 20)


@pytest.mark.parametrize("topn", [1, 450, 600])
def test_shortlist_equals_stable_sort(spark, topn):
    df = skewed(spark)
    big = [(r["sim"], r["paper"]) for r in df.filter("round_id = 'big' and reviewer_id = 1").collect()]
    want = {p for _, p in sorted(big, key=lambda x: (-x[0], x[1]))[:topn]}
    out = rerank.shortlist(df, RunOptions(rerank_topn=topn))
    assert {r["paper"] for r in out.filter("round_id = 'big' and reviewer_id = 1 and is_candidate").collect()} == want
    assert rows(out.drop("is_candidate")) == rows(df)


@pytest.mark.parametrize("values", [
    [5.0] * 3000, [1e9 + k % 977 for k in range(3000)], [(-1) ** k * 1e9 / (k + 1) for k in range(3000)], [1e9 + k * 1e-6 for k in range(3000)]])
def test_one_pool_of_any_values_is_cut_into_even_runs(spark, values):
    """All rows in one pool: all tied, far from zero, of all sizes, and closer together than any fixed bucket."""
    df = pool(spark, values).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small runs would be merged
    try:
        got = by_paper(ranking.quantile(df, K, "sim"), "q")
        runs = [r["count"] for r in ranking.sorted_runs(df, K, F.desc("sim"), F.col("paper")).groupBy("_run").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(values)
    want = [((bisect_left(order, v) + bisect_right(order, v) - 1) / 2 + 0.5) / len(values) for v in values]
    assert got == pytest.approx(want, rel=1e-12)
    assert len(runs) == 4 and max(runs) < 3000 / 2


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20_000, 20_000), min_size=1, max_size=40), st.floats(0, 1), st.integers(1, 100))
def test_bids_match_the_plain_formula(spark, raw, frac, top):
    values = [v / 1000 for v in raw]
    got = bids_of(spark, values, frac, ScoringParams(bid_max=top))
    assert got == brute_bids(values, frac, top)
    assert all(-top <= b <= top for b in got)
    assert all(b1 <= b2 for (_, b1), (_, b2) in zip(sorted(zip(values, got)), sorted(zip(values, got))[1:]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60))
def test_quantile_properties(spark, raw):
    values = [v / 7 for v in raw]
    q = by_paper(ranking.quantile(pool(spark, values), K, "sim"), "q")
    assert all(0 < x < 1 for x in q)
    assert sum(q) / len(q) == pytest.approx(0.5)


def test_checks_of_arguments():
    for bad in ({"bid_max": 0}, {"bid_max": 101}, {"bid_max": 2.5}, {"bid_max": True}, {"interest_weight": 1.1}):
        with pytest.raises(ValueError):
            ScoringParams(**bad)
    for bad in ({"positive_frac": -0.1}, {"positive_frac": 1.1}, {"rerank_topn": 0}, {"method": "other"}):
        with pytest.raises(ValueError):
            RunOptions(**bad)
