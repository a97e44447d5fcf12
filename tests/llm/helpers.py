"""Small tables with every awkward case, and whole tables as plain rows."""

from pyspark.sql import DataFrame, SparkSession

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."), (2, None), (3, ""), (4, " \n\t "), (None, "a text without an id"),
    (5, "same words here " * 40), (5, "same words here " * 40), (6, "x" * 30000), (7, "Ünïcode 日本 text\x0bwith\x0ctabs\r\n"), (None, None),
    (8, "The quick brown fox jumps over the lazy dog and runs away."), (9, "mail a.b@c.org or +1 (555) 555-0100 or 10.0.0.1"),
]
# names that operators use for columns of their own
CLASHING = ("score", "fp", "root", "key", "batch", "component_id", "row_key", "spans", "pattern", "kept", "content", "range")


def awkward(spark: SparkSession) -> DataFrame:
    rows = [(i, t, "en", "s", None if t is None else len(t), *(["clash"] * len(CLASHING))) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHING))


def nothing(df: DataFrame) -> DataFrame:
    return df.filter("1 = 0")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
