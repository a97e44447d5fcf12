"""Embedding cache table and the embedder hook."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmatch.functions.text import text_key

Encode = Callable[[list[str]], np.ndarray]
BATCH = 16


class VectorCache:
    """Vectors by text hash, in runs. A run's folder holds its vectors and, written last, a manifest; only runs with one are read.

    ``path/vectors/model_id=.../run_id=...`` has the vectors and ``path/manifests`` one line per finished run. A job that dies leaves a run
    without a manifest, which no one reads. Appending under a run id that is finished does nothing, and one that is not is
    written anew, so a repeated job adds nothing twice. Tables read before and after an append must not meet in one plan: Spark
    takes two scans of a path for one. ``compact`` puts all runs of the model into one with a vector per key.
    """

    def __init__(self, spark: SparkSession, path: str, model_id: str):
        self.spark, self.path, self.model_id = spark, path, model_id
        self._vectors, self._manifests = f"{path}/vectors", f"{path}/manifests"

    def _table(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """Finished runs of the model that no later one replaces: ``run_id, vectors``."""
        lines = self._table(self._manifests, "model_id string, run_id string, vectors long, replaces array<string>").filter(F.col("model_id") == self.model_id)
        gone = lines.select(F.explode("replaces").alias("run_id"))
        return lines.select("run_id", "vectors").dropDuplicates(["run_id"]).join(gone, "run_id", "left_anti")

    def _all(self) -> DataFrame:
        return self._table(self._vectors, "text_sha string, vec array<float>, model_id string, run_id string").filter(F.col("model_id") == self.model_id)

    def _rows(self) -> DataFrame:
        return self._all().join(self.runs().select("run_id"), "run_id", "left_semi").select("text_sha", "vec")

    def read(self) -> DataFrame:
        """One vector per key; two jobs that ran side by side may have appended the same one."""
        return self._rows().groupBy("text_sha").agg(F.max("vec").alias("vec"))

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """Distinct texts whose key is not cached for this model.

        Missing keys are found on hashes alone; texts that are cached never reach a shuffle.
        """
        keyed = texts.select(text_key(F.col(text)).alias("text_sha"), F.col(text).alias("text"))
        todo = keyed.select("text_sha").distinct().join(self._rows().select("text_sha"), "text_sha", "left_anti")
        return keyed.join(todo, "text_sha", "left_semi").dropDuplicates(["text_sha"])

    def _write(self, vectors: DataFrame, run_id: str) -> int:
        rows = vectors.select("text_sha", F.col("vec").cast("array<float>").alias("vec"), F.lit(self.model_id).alias("model_id"), F.lit(run_id).alias("run_id"))
        # replaces this run's folder only
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "run_id").parquet(self._vectors)
        return self._all().filter(F.col("run_id") == run_id).count()

    def _finish(self, run_id: str, count: int, replaces: list[str]) -> None:
        line = [(self.model_id, run_id, count, replaces)]
        self.spark.createDataFrame(line, "model_id string, run_id string, vectors long, replaces array<string>").coalesce(1).write.mode("append").parquet(self._manifests)

    def append(self, vectors: DataFrame, run_id: str | None = None) -> None:
        """Add vectors (text_sha, vec) as one run; give the same ``run_id`` when a job is repeated."""
        run_id = run_id or uuid.uuid4().hex
        if self.runs().filter(F.col("run_id") == run_id).isEmpty():
            self._finish(run_id, self._write(vectors, run_id), [])

    def add(self, texts: DataFrame, load: Callable[[], Encode], text: str = "text", batch: int = BATCH, run_id: str | None = None) -> None:
        """Encode the texts that are not cached, each once, and append them as one run."""
        self.append(embed(self.missing(texts, text), load, batch), run_id)

    def vectors(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``texts`` that have a cached vector, with ``text_sha`` and ``vec``."""
        return texts.withColumn("text_sha", text_key(F.col(text))).join(self.read(), "text_sha")

    def compact(self) -> None:
        """All finished runs as one with a vector per key; readers see the old runs until its manifest is there."""
        old = [r["run_id"] for r in self.runs().select("run_id").collect()]
        if len(old) > 1:
            run_id = uuid.uuid4().hex
            self._finish(run_id, self._write(self.read(), run_id), old)


def embed(missing: DataFrame, load: Callable[[], Encode], batch: int = BATCH) -> DataFrame:
    """Encode texts ``batch`` at a time; the model is loaded once per task and only if a row arrives.

    Only the texts of one call to the model are Python objects at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                encode = encode or load()
                vectors = np.asarray(encode(part["text"].to_pylist()), dtype="float32")
                yield pa.RecordBatch.from_arrays([part["text_sha"], pa.array(list(vectors), pa.list_(pa.float32()))], ["text_sha", "vec"])

    return missing.mapInArrow(run, "text_sha string, vec array<float>")


def embed_missing(texts: DataFrame, cache: VectorCache, load: Callable[[], Encode],
                  text: str = "text", batch: int = BATCH, run_id: str | None = None) -> DataFrame:
    """Vectors of all texts: cached ones read, the others encoded once and appended as one run."""
    cache.add(texts, load, text, batch, run_id)
    return cache.vectors(texts, text)
