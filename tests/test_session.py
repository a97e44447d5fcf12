"""Written tables and the disk they leave behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from revmatch.session import materialize


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {p for d in manager.localDirsString() for p in Path(d).glob("*/shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(10_000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    grouped = rows.repartition(7, "h").groupBy("h").agg(F.max("id").alias("id")).join(rows.repartition(5, "id"), ["id", "h"])
    before, was = shuffle_files(spark), spark.conf.get(setting)
    kept = materialize(grouped, "grouped")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(setting) == was
    assert kept.count() == 10_000 and kept.agg(F.sum("id")).first()[0] == sum(range(10_000))
    assert grouped.count() == 10_000  # the table that was written can be asked again
