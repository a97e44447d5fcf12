"""Column names and table schemas shared by every operator."""

from pyspark.sql import types as T

ROUND = "round_id"
REVIEWER = "reviewer_id"
PAPER = "paper"
PAPER_KEY = "paper_key"
K = [ROUND, REVIEWER]

SUBMISSION = T.StructType([
    T.StructField(ROUND, T.StringType()),
    T.StructField(PAPER, T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("preference", T.StringType()),
])
