"""From similarity and topic base to integer bids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmatch.functions.numeric import clamp, round9, round_half_away, signed_power
from revmatch.operators import ranking
from revmatch.params import RunOptions, ScoringParams
from revmatch.schemas import K
from revmatch.session import materialize


def sem_signal(q: Column, params: ScoringParams) -> Column:
    limit = float(params.ref_max)
    return clamp(signed_power(2 * q - 1, params.exponent) * F.lit(limit), -limit, limit)


def blend(sem: Column, topic: Column, params: ScoringParams) -> Column:
    limit, weight = float(params.ref_max), float(params.interest_weight)
    return round9(clamp(F.lit(1 - weight) * sem + F.lit(weight) * topic, -limit, limit))


def bid(value: Column, tau: Column, v_min: Column, v_max: Column, params: ScoringParams) -> Column:
    """Each side of the threshold rescaled to the full bid range; a side without width divides by 1."""
    top = params.bid_max
    high = F.coalesce(F.nullif(v_max - tau, F.lit(0.0)), F.lit(1.0))
    low = F.coalesce(F.nullif(tau - v_min, F.lit(0.0)), F.lit(1.0))
    positive = clamp(round_half_away((value - tau) / high * F.lit(float(top - 1))) + 1, 1, top)
    negative = clamp(round_half_away((value - tau) / low * F.lit(float(top))), -top, 0)
    return F.when(value > tau, positive).otherwise(negative)


def _with_bid(df: DataFrame, params: ScoringParams) -> DataFrame:
    return df.withColumn("bid", bid(F.col("value"), F.col("tau"), F.col("v_min"), F.col("v_max"), params))


def _with_value(df: DataFrame, params: ScoringParams) -> DataFrame:
    return df.withColumn("sem", sem_signal(F.col("q"), params)).withColumn(
        "value", blend(F.col("sem"), F.col("topic_base"), params))


def bids(scored: DataFrame, params: ScoringParams, options: RunOptions, tie_limit: int = ranking.TIE_LIMIT) -> DataFrame:
    """Add q, sem, value, tau, v_min, v_max and bid to scored pool rows (sim, topic_base).

    Everything is decided per distinct (similarity, topic base) and brought back to the rows once.
    """
    keys = [*K, "sim", "topic_base"]
    combos = scored.groupBy(*keys).agg(F.count("*").alias("cnt"))
    per_sim = combos.groupBy(*K, "sim").agg(F.sum("cnt").alias("cnt"))
    quantiles = ranking.quantile_table(per_sim, K, "sim").drop("cnt")
    valued = materialize(_with_value(combos.join(quantiles, [*K, "sim"]), params), "valued")
    per_value = valued.groupBy(*K, "value").agg(F.sum("cnt").alias("cnt"))
    bounds = ranking.threshold_table(per_value, K, "value", options.positive_frac)
    table = _with_bid(valued.join(bounds, K), params)
    return ranking.lookup(scored, table, keys, limit=tie_limit).select(
        *scored.columns, "q", "sem", "value", "tau", "v_min", "v_max", "bid")
