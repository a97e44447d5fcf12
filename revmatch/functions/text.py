"""Text expressions: cleaning, tokens, terms, title/abstract split, text assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode-aware classes, spelled out because Java's \b, \s and \d are ASCII by default.
_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BEYOND_ASCII = r"[[\x80-\x{ffff}]&&[\p{L}\p{N}]]|([[\x{10000}-\x{10ffff}]&&[\p{L}\p{N}]])"
_TOKEN = rf"(?<!{_WORD})[a-z]{{2,}}+(?!{_WORD})"

# Where an abstract starts and ends, line prefix that is no title, lengths in characters.
_ABSTRACT = rf"(?i)(?<!{_WORD})abstract(?!{_WORD})"
_ABSTRACT_END = (
    rf"(?i)(?<!{_WORD})(?:"
    rf"\p{{Nd}}+{_SPACE}*[.)]?{_SPACE}*introduction|introduction|keywords|index terms|"
    rf"categories and subject|ccs concepts|general terms"
    rf")(?!{_WORD})"
)
_ARXIV_LINE = rf"(?i)^arxiv(:|{_SPACE})"
MIN_ABSTRACT = 40
OPEN_ABSTRACT = 2500
SPARSE_JOINER = ". "
DENSE_JOINER = "[SEP]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{_SPACE}+", " "))


def join_broken_words(text: Column) -> Column:
    return F.replace(text, F.lit("-\n"), F.lit(""))


def clean_text(text: Column) -> Column:
    return F.lower(F.replace(join_broken_words(text), F.lit("\n"), F.lit(" ")))


def tokens(text: Column) -> Column:
    """Whole word runs of two or more a-z letters, in order, from cleaned text."""
    return F.regexp_extract_all(clean_text(text), F.lit(_TOKEN), F.lit(0))


def word_text(text: Column) -> Column:
    """Text in which every letter and digit beyond ASCII is ``0``: its words can be cut out byte by byte, and are those of ``tokens``.

    Java looks back by one UTF-16 unit, so a letter beyond U+FFFF holds off the word before it and not the one behind it: it stays, after a ``0``.
    """
    return F.regexp_replace(F.lower(join_broken_words(text)), _BEYOND_ASCII, "0$1")


def drop_stop_words(words: Column, stop: Sequence[str]) -> Column:
    """``isin`` over literals becomes a hash-set probe, so the list length does not matter."""
    return F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of an array column that already exists on the row (not a derived one)."""
    paired = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(paired, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def with_terms(df: DataFrame, text: str, out: str, stop: Sequence[str]) -> DataFrame:
    """Add the array of unigrams then bigrams; bigrams bridge the stop words that were removed."""
    words = df.withColumn(out, drop_stop_words(tokens(F.col(text)), stop))
    return words.withColumn(out, F.concat(F.col(out), bigrams(F.col(out))))


def with_title_abstract(df: DataFrame, raw: str, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Add title and abstract found in leading page text; both null when no abstract is found."""
    lines = F.transform(F.split(F.col("_cut")[0], _LINE_END), strip)
    usable = F.filter(lines, lambda x: (x != "") & ~x.rlike(_ARXIV_LINE))
    return (
        df.withColumn("_cut", F.split(join_broken_words(F.col(raw)), _ABSTRACT, 2))
        .withColumn("_end", F.split(F.try_element_at("_cut", F.lit(2)), _ABSTRACT_END, 2))
        .withColumn("_body", collapse_space(
            F.when(F.size("_end") == 2, F.col("_end")[0]).otherwise(F.substring(F.col("_end")[0], 1, OPEN_ABSTRACT))))
        .withColumn("_found", (F.size("_cut") == 2) & (F.length("_body") >= MIN_ABSTRACT))
        .withColumn(abstract, F.when(F.col("_found"), F.col("_body")))
        .withColumn(title, F.when(F.col("_found"), F.coalesce(F.get(usable, F.lit(0)), F.lit(""))))
        .drop("_cut", "_end", "_body", "_found")
    )


def submission_text(title: Column, abstract: Column, joiner: str = SPARSE_JOINER) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(joiner), F.coalesce(abstract, F.lit("")))


def with_paper_text(df: DataFrame, raw: str, out: str, joiner: str) -> DataFrame:
    """Title and abstract of a paper joined, or its whole text with white space collapsed."""
    split = with_title_abstract(df, raw, "_title", "_abstract")
    joined = F.concat(F.col("_title"), F.lit(joiner), F.col("_abstract"))
    return split.withColumn(out, F.coalesce(joined, collapse_space(F.col(raw)))).drop("_title", "_abstract")


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def split_topics(raw: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), strip)
    return F.filter(parts, lambda t: t != "")
