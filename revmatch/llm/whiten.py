"""Whitening of embeddings with distributed block matrices.

Rows get gapless numbers, are centred on the exact mean and become a BlockMatrix of 1,024 rows a block. Its transpose times
itself is the scatter; the product is split along the rows, so no task gathers all blocks of its one cell. The scatter has
the size of the vectors' length squared and its eigenvectors are taken on the driver. A second BlockMatrix product with the
whitening matrix projects all rows; a third, of the projection with itself, measures how far it is from white.

Results: rows without a usable vector are left out; a shorter vector counts as filled up with zeros; repeated rows stay and
count as often as they stand; equal eigenvalues have any orthonormal components; components without variance (an eigenvalue
not above ``RANK`` times the largest) can't be whitened and are left out, so a table of one vector gives no rows, like an empty one.
A ``deviation`` beyond the range of a long is an error (from some 10^7 vectors that differ by 100 in each of 64 components), never a wrong number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmatch.llm.common import placed, written
from revmatch.llm.vectors import VEC, padded, whole_vectors, width

SCALE, SHIFT = 64.0, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Rows in a block, and row blocks whose products one task adds up.
BLOCK, SPAN = 1024, 16
#: An eigenvalue is not above rounding if the largest times this is not below it.
RANK = 1e-12
_RESULT = f"{VEC} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each of their ``d`` components. One row an Arrow batch leaves the tasks."""
    def add(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                yield pa.record_batch([pa.array([b.num_rows]), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "s"])

    parts = vectors.select("x").mapInArrow(add, "n long, s array<long>")
    total = parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (total[0]["n"], [r["s"] for r in total]) if total else (0, [])


def matrix(rows: DataFrame, column: str, n: int, d: int) -> BlockMatrix:
    """``row`` (0 to n-1) and an array column as a BlockMatrix; conversion stays in the JVM."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector(column).alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, d).toBlockMatrix(BLOCK, d)


def scatter(a: BlockMatrix, n: int, d: int) -> np.ndarray:
    """Transpose times itself, with the inner dimension split over tasks of ``SPAN`` row blocks each; d x d numbers reach the driver."""
    turned = a.transpose()
    parts = max(1, -(-n // (BLOCK * SPAN)))
    product = turned._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, d, d).toLocalMatrix().toArray()


def as_rows(a: BlockMatrix) -> DataFrame:
    """``row`` and ``y`` (array) of a BlockMatrix."""
    found = callMLlibFunc("getIndexedRows", a.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("row"), vector_to_array("vector").alias("y"))


def _small(spark: SparkSession, values: np.ndarray) -> BlockMatrix:
    """A d x k matrix of the driver as one block."""
    d, k = values.shape
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, values.flatten(order="F").tolist()))], 1), d, k)


def _blank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _RESULT)


def numbered(vectors: DataFrame, name: str) -> DataFrame:
    """Written rows with a gapless ``row`` from 0; a row keeps its number when a task runs again."""
    rows, runs = placed(vectors, [], name)
    return rows.join(runs.drop("rows"), "part").withColumn("row", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: its whitened coordinate, and what the component explains."""
    spark, vectors = table.sparkSession, whole_vectors(table, SCALE, SHIFT)
    d = width(vectors)
    n, totals = sums(vectors := numbered(padded(vectors, d, SHIFT), "vectors"), d) if d else (0, [])
    if not n:
        return _blank(spark)
    # n times the distance from the mean, exact
    apart = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in totals]), lambda x, s: x * F.lit(n).cast("long") - s)
    a = matrix(vectors.withColumn("y", F.transform(apart, lambda v: v / F.lit(float(n)))), "y", n, d)
    values, axes = np.linalg.eigh(scatter(a, n, d) / n)
    order = np.argsort(-values, kind="stable")
    trace = float(values.sum())
    order = order[values[order] > RANK * values[order[0]]][:components] if values[order[0]] > 0 else order[:0]
    if not len(order):
        return _blank(spark)
    values, axes = values[order], axes[:, order]
    k = len(values)
    projected = written(as_rows(a.multiply(_small(spark, axes / np.sqrt(values)))), "whitened")
    # the mean of a centred projection is rounding error only; it is taken off all the same before the covariance
    middle = [r["m"] for r in projected.select(F.posexplode("y").alias("i", "y")).groupBy("i").agg(F.avg("y").alias("m")).orderBy("i").collect()]
    level = projected.withColumn("y", F.zip_with("y", F.array(*[F.lit(m) for m in middle]), lambda y, m: y - m))
    off = float(np.abs(scatter(matrix(level, "y", n, k), n, k) / n - np.eye(k)).max())

    deviation = F.aggregate(F.transform(apart, lambda v: v * v), F.lit(0).cast("long"), lambda acc, v: acc + v)
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    rows = vectors.select("row", VEC, deviation.alias("deviation")).join(projected, "row")
    told = rows.select(VEC, "deviation", F.posexplode(F.arrays_zip("y", explained.alias("e"))).alias("i", "z"))
    return told.select(VEC, (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                       F.col("z.y").alias("whitened"), F.col("z.e").alias("explained"), F.lit(off).alias("identity_error"))
