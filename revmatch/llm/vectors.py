"""Tables of vectors: which ones count, and their components as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VEC = "vec_id"


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    fine = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def whole_vectors(table: DataFrame, scale: float, shift: int = 0) -> DataFrame:
    """``vec_id, x``: ``floor(scale * c) + shift`` of every component c, as doubles; vectors that are not usable are left out."""
    named = table.select(F.col(VEC).cast("long").alias(VEC), F.col("embedding").alias("_v")).filter(usable(F.col("_v")))
    return named.select(VEC, F.transform("_v", lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(shift).cast("long")).alias("x"))


def width(vectors: DataFrame) -> int:
    """Components of the longest vector."""
    return vectors.agg(F.max(F.size("x"))).first()[0] or 0


def padded(vectors: DataFrame, d: int, missing: int) -> DataFrame:
    """Vectors of one length: components that a shorter one lacks count as 0, which is ``missing`` as a whole number."""
    at = F.sequence(F.lit(0), F.lit(d - 1)) if d else F.expr("cast(array() as array<int>)")
    return vectors.withColumn("x", F.when(F.size("x") == d, F.col("x")).otherwise(
        F.transform(at, lambda i: F.coalesce(F.get(F.col("x"), i), F.lit(missing).cast("long")))))
