"""Report tables over bids, and the text form for every reviewer and round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revmatch.functions.numeric import round9
from revmatch.params import FRACTION_TOLERANCE
from revmatch.schemas import K, PAPER

# Layout of the report.
BAR_WIDTH = 50
EXTREMES = 10
TITLE_WIDTH = 78
STRONG_SHARE = 0.75


def strong_cut(bid_max: int) -> int:
    return round(bid_max * STRONG_SHARE)


def report_summary(bids: DataFrame, bid_max: int, mode: str) -> DataFrame:
    cut, bid = strong_cut(bid_max), F.col("bid")
    return bids.groupBy(*K).agg(
        F.count("*").alias("n_scored"),
        round9(F.sum(bid) / F.count("*")).alias("mean_bid"),
        F.count_if(bid > 0).alias("want"),
        F.count_if(bid == 0).alias("neutral"),
        F.count_if(bid < 0).alias("avoid"),
        F.count_if(bid >= cut).alias("strong_pos"),
        F.count_if(bid <= -cut).alias("strong_neg"),
    ).withColumn("strong_cut", F.lit(cut)).withColumn("mode", F.lit(mode))


def report_histogram(bids: DataFrame) -> DataFrame:
    """Count per bid that occurs; the window runs over one row per bid value."""
    counts = bids.groupBy(*K, "bid").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(*K))
    return counts.withColumn("bar", F.floor(F.lit(BAR_WIDTH) * F.col("n") / most).cast("int"))


def achieved_fraction(bids: DataFrame, positive_frac: float) -> DataFrame:
    share = F.count_if(F.col("bid") > 0) / F.count("*")
    return (
        bids.groupBy(*K).agg(round9(share).alias("achieved"), share.alias("_share"))
        .withColumn("off_target", F.abs(F.col("_share") - positive_frac) > FRACTION_TOLERANCE).drop("_share")
    )


def report_extremes(bids: DataFrame, titles: DataFrame, title_keys: list[str], k: int = EXTREMES) -> DataFrame:
    """First and last k rows by falling bid, ties by submission id; titles joined after the cut."""
    def cut(section: str, *order) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*K).orderBy(*order)).cast("bigint")
        rows = bids.select(*K, PAPER, "bid").withColumn("place", place).filter(F.col("place") <= k)
        return rows.withColumn("section", F.lit(section))

    top = cut("top", F.desc("bid"), F.asc(PAPER))
    bottom = cut("bottom", F.asc("bid"), F.desc(PAPER))
    shown = top.unionByName(bottom)
    return shown.join(titles, title_keys).withColumn(
        "title", F.substring(F.coalesce(F.col("title"), F.lit("")), 1, TITLE_WIDTH))


# Lines of the report.
RULE = "=" * 60
HEAD = "Reviewer bidding report"
DISTRIBUTION = "distribution (bid: count)"
SECTIONS = {"top": "top 10 (highest bids)", "bottom": "bottom 10 (lowest bids)"}


def report_texts(bids: DataFrame, titles: DataFrame, title_keys: list[str], bid_max: int, mode: str) -> DataFrame:
    """The text report of every reviewer and round: ``round_id, reviewer_id, report``.

    The three report tables become numbered lines, and a pool's lines are joined in order. A report has at most
    2 * bid_max + 36 lines, whatever the pool holds; the tables themselves are partial aggregates and cut tops.
    """
    def line(part: int, order, text) -> list:
        return [F.lit(part).alias("part"), order.cast("bigint").alias("at"), text.alias("line")]

    zero, fmt = F.lit(0), F.format_string
    s = report_summary(bids, bid_max, mode)
    head = fmt("\n".join([
        HEAD, RULE, "mode            : %s", "papers scored   : %d", "mean bid        : %+.2f", "want (>0)       : %d", "neutral (=0)    : %d",
        "avoid (<0)      : %d", "strong + (>=%+d) : %d", "strong - (<=%d) : %d", "", DISTRIBUTION]),
        "mode", "n_scored", "mean_bid", "want", "neutral", "avoid", "strong_cut", "strong_pos", -F.col("strong_cut"), "strong_neg")
    bar = fmt(f"  %+3d | %-{BAR_WIDTH}s %d", F.col("bid"), F.repeat(F.lit("#"), F.col("bar")), F.col("n"))
    shown = fmt("  %+3d  %s", F.col("bid"), F.col("title"))
    # rows of a section stand by falling bid, then by submission
    place = F.row_number().over(Window.partitionBy(*K, "section").orderBy(F.desc("bid"), PAPER))
    ends = report_extremes(bids, titles, title_keys).withColumn("_place", place)
    parts = [s.select(*K, *line(0, zero, head)), report_histogram(bids).select(*K, *line(1, -F.col("bid"), bar))]
    for part, (section, label) in zip((2, 4), SECTIONS.items()):
        parts += [s.select(*K, *line(part, zero, F.lit("\n" + label))),
                  ends.filter(F.col("section") == section).select(*K, *line(part + 1, F.col("_place"), shown))]
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"])
    return lines.groupBy(*K).agg(F.array_join(ordered, "\n").alias("report"))


def write_report_texts(texts: DataFrame, path: str) -> None:
    """One folder per round and reviewer with the text in it."""
    texts.write.mode("errorifexists").partitionBy(*K).text(path)


def report_text(bids: DataFrame, titles: DataFrame, title_keys: list[str], round_id, reviewer_id,
                bid_max: int, mode: str) -> str:
    """Text report of one reviewer in one round."""
    mine = bids.filter((F.col("round_id") == round_id) & (F.col("reviewer_id") == reviewer_id))
    found = report_texts(mine, titles, title_keys, bid_max, mode).first()
    if found is None:
        raise ValueError(f"no bids for round {round_id!r}, reviewer {reviewer_id!r}")
    return found["report"]
