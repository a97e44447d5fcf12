"""Stop-word lists: Spark's English list plus the extra words for paper text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spark's English stop list, kept here so that no jar or MLlib class is needed.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

# Words dropped on top of the English list (boilerplate of papers and PDF text, filler).
EXTRA = """
et al fig figs figure figures table tables section sec eq ref refs arxiv doi http https
www com org edu university email abstract introduction conclusion ing like also however
thus paper papers results result show shows shown using used use based proposed approach
method methods work works can may given ieee acm usenix proceedings conference workshop
preprint appendix springer lncs cite vol pp
different example number overall fact possible previous related follow focus particular
various general specific order find found consider considered note specifically
way similar instance main generally typically essentially known popular uk us
""".split()


def english() -> list[str]:
    return list(ENGLISH)


def default_stop_words() -> list[str]:
    return sorted(set(english()) | set(EXTRA))


def stop_words(spark: SparkSession, base: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Union of the base and the extra list as a table."""
    base = english() if base is None else base
    extra = EXTRA if extra is None else extra
    as_table = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    return as_table(base).union(as_table(extra)).distinct()
