from pyspark.sql import functions as F

from revmatch.functions import numeric, stopwords, text
from revmatch.functions.text import with_paper_text, with_terms, with_title_abstract


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_tokens_reject_words_with_accents_digits_underscores(spark):
    got = values(spark, ["thérapie learn1ng a_b état well-known machine x", "", "learn-\ning A\nb CD"], text.tokens)
    assert got == [["well", "known", "machine"], [], ["learning", "cd"]]


def test_bigrams_bridge_removed_words(spark):
    df = spark.createDataFrame([("deep well known machine",), ("one",), ("",)], "text string")
    got = [r[0] for r in with_terms(df, "text", "t", ["known"]).select("t").collect()]
    assert got == [["deep", "well", "machine", "deep well", "well machine"], ["one"], []]


def test_stop_list_is_united(spark):
    words = {r[0] for r in stopwords.stop_words(spark).collect()}
    assert len(stopwords.EXTRA) == len(set(stopwords.EXTRA)) == 96
    assert words == set(stopwords.default_stop_words())


def test_split_topics_strips_unicode_space(spark):
    got = values(spark, ["a ;\tb ; ;;a", "", None], text.split_topics)
    assert got == [["a", "b", "a"], [], []]


def title_abstract(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    return tuple(with_title_abstract(df, "raw").select("title", "abstract").first())


def test_title_abstract_split(spark):
    body = "We study the matching of reviewers to submissions at scale."
    raw = f"arXiv: 1234\n\n  A Ti-\ntle \nAuthors\nABSTRACT\n{body}\n\n2) Introduction\nrest"
    assert title_abstract(spark, raw) == ("A Title", body)
    assert title_abstract(spark, f"Abstract {body} Keywords: x") == ("", body)
    assert title_abstract(spark, f"T\nAbstract\n{body} more") == ("T", body + " more")
    assert title_abstract(spark, f"T\nabstracts\n{body}") == (None, None)
    assert title_abstract(spark, "T\nAbstract\ntoo short") == (None, None)
    assert title_abstract(spark, "T\nAbstract\n" + "x" * 3000)[1] == "x" * 2499  # the line break after the heading counts


def test_paper_text_falls_back_to_whole_text(spark):
    long = "word  " * 2000
    df = spark.createDataFrame([(long,)], "raw string")
    assert with_paper_text(df, "raw", "out", ". ").first()["out"] == " ".join(long.split())


def test_roundings(spark):
    xs = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 2.4]
    assert values(spark, xs, numeric.round_half_away, "x double") == [1, 2, 3, -1, -2, -3, 2]
    assert values(spark, xs, numeric.round_half_even, "x double") == [0, 2, 2, 0, -2, -2, 2]


def test_rating_parse(spark):
    raw = [" 2", "1.5", "", None, "-9", "nan", "2.5x", "inf", "-inf", "1d", "1e0", "0.5", "1_0", " -1\t"]
    assert values(spark, raw, numeric.parse_rating) == [2, 2, 0, 0, -2, 0, 0, 2, -2, 0, 1, 0, 2, -1]


def test_shortlist_size(spark):
    got = values(spark, [10, 1000, 2000, 10000], lambda n: numeric.shortlist_size(n, 0.1, 150, 3), "x bigint")
    assert got == [150, 301, 601, 3001]
