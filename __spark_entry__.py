
from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import bindings as b
import oracle as o
from revmatch import RunOptions, ScoringParams, bids_embedding, bids_from_texts, bids_rerank, bids_tfidf, prepare, run_bids, semantic_scores, topic_template
from revmatch.functions import numeric, text
from revmatch.functions.stopwords import default_stop_words, stop_words
from revmatch.operators import bids as bidding
from revmatch.operators import blocks
from revmatch.operators import profile as profiles
from revmatch.operators import ranking, reports, rerank, similarity, tfidf, topics
from revmatch.plans import pipelines
from revmatch.schemas import K, PAPER, PAPER_KEY, ROUND
from revmatch.session import materialize, scratch_path
from revmatch.sources import papers as paper_source
from revmatch.sources import ratings, vector_cache
from revmatch.sources import submissions as subs_source

PARAMS, OPTIONS = ScoringParams(), RunOptions()
MODEL = "letter-counts"
LETTERS = o.LETTERS
Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None):
    """Register a query under its function name with its twin."""
    def add(fn: Query) -> Query:
        _REGISTRY[fn.__name__] = (fn, sql)
        return fn
    return add


# ---- tables several operator queries start from; written once per application ----

_KEPT: dict[tuple, object] = {}


def _keep(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def _prep(spark: SparkSession, sf: str) -> pipelines.Prepared:
    return _keep(spark, sf, "prep", lambda: prepare(b.submissions(spark, sf), b.papers(spark, sf), b.interests(spark, sf)))


def _base(spark: SparkSession, sf: str) -> tuple[pipelines.Prepared, pipelines.SparseSide]:
    prep = _prep(spark, sf)
    return prep, _keep(spark, sf, "sparse", lambda: pipelines.sparse_side(prep))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    prep, sparse = _base(spark, sf)
    return _keep(spark, sf, "scored", lambda: semantic_scores(prep, OPTIONS, sparse=sparse))


def _bids(spark: SparkSession, sf: str) -> DataFrame:
    return bidding.bids(_scored(spark, sf), PARAMS, OPTIONS)


def _short(spark: SparkSession, sf: str) -> DataFrame:
    return _keep(spark, sf, "shortlist", lambda: materialize(rerank.shortlist(_scored(spark, sf), OPTIONS), "shortlist"))


def _sides(spark: SparkSession, sf: str, scorer) -> tuple:
    """What joins the shortlist to pairs: features of both sides, rounds, roster."""
    prep = _prep(spark, sf)
    own = text.with_paper_text(prep.papers, "text", "joined", text.SPARSE_JOINER)
    subs = rerank.side_features(_sub_texts(spark, sf), [ROUND, PAPER], "text", "sub_side", scorer)
    papers = rerank.side_features(own, [*K, PAPER_KEY], "joined", "paper_side", scorer)
    return subs, papers, prep.rounds, prep.roster, OPTIONS


def _scored_pairs(spark: SparkSession, sf: str, scorer=rerank.TOKEN_OVERLAP) -> DataFrame:
    return rerank.scored_pairs(_short(spark, sf), *_sides(spark, sf, scorer), scorer)


# ---- sources and sinks ----

@_query(o.sql("select round_id, paper, title, abstract, lang || '|' || source as topics, '' as preference from subs"))
def scan_submissions(spark, sf):
    path = scratch_path(spark, "submissions_csv")
    subs_source.write_scored(b.raw_submissions(spark, sf), path)
    scanned = subs_source.scan_submissions(spark, path, b.round_of("paper"))
    return scanned.withColumn("topics", F.array_join("topics", "|")).withColumn("preference", F.coalesce("preference", F.lit("")))


_RAW_RATING = "case doc_id % 7 when 0 then ' 2' when 1 then '1.5' when 2 then '' when 3 then '-9' when 4 then 'nan' when 5 then '2.5x' else '-0.5e0' end"
_RATING = ("cast(round_even(greatest(-2::double, least(2::double, case when isnan(v) then 0 else coalesce(v, 0) end)), 0) as int)")


@_query(f"""select reviewer_id, topic, {_RATING} as interest from (
    select doc_id % 5 as reviewer_id, source as topic, try_cast(trim({_RAW_RATING}) as double) as v,
    row_number() over (partition by doc_id % 5, source order by doc_id desc) as back from documents
    where doc_id % 11 <> 3 and doc_id % 13 <> 5) where back = 1""")
def scan_interests(spark, sf):
    """Rating files written from the documents, with comment lines, blank topics and repeated topics."""
    topic = F.expr("case when doc_id % 11 = 3 then concat('  # ', source) when doc_id % 13 = 5 then '  ' else source end")
    lines = b.table(spark, sf, "documents").select(
        (F.col("doc_id") % 5).alias("reviewer_id"), "doc_id", topic.alias("topic"), F.expr(_RAW_RATING).alias("interest"))
    path = scratch_path(spark, "ratings")
    (lines.repartitionByRange("doc_id").sortWithinPartitions("reviewer_id", "doc_id").drop("doc_id").write.partitionBy("reviewer_id")
     .option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return ratings.scan_interests(spark, path).withColumn("reviewer_id", F.col("reviewer_id").cast("bigint"))


@_query("select sha256(text) as sha, min(doc_id) as doc_id from documents group by 1")
def unique_papers(spark, sf):
    return paper_source.unique_contents(b.table(spark, sf, "documents"), "text", "doc_id")


@_query("""select conv_id as paper_key, coalesce(max(case when turn = 0 then text end), '') || coalesce(max(case when turn = 1 then text end), '')
    || coalesce(max(case when turn = 2 then text end), '') as text from conversations group by conv_id""")
def leading_pages(spark, sf):
    return paper_source.leading_pages(b.pages(spark, sf), ["paper_key"])


@_query(o.sql("""select round_id, reviewer_id, count(distinct sha256(text)) as n_papers, count(distinct sha256(text)) >= 5 as accepted
    from (select round_id, cast(floor(sqrt(paper_key)) as bigint) as reviewer_id, text from papers) group by round_id, reviewer_id"""))
def papers_guard(spark, sf):
    """Reviewers of 1, 3, 5, ... papers, so that some have too few."""
    shares = b.papers(spark, sf).withColumn("reviewer_id", F.floor(F.sqrt("paper_key"))).withColumn("sha", F.sha2("text", 256))
    return paper_source.papers_guard(shares, "sha")


def _letter_model(letters: str = LETTERS):
    """Stand-in embedder: how often eight letters occur. Local functions travel to tasks by value."""
    return lambda: lambda texts: np.array([[t.count(c) for c in letters] for t in texts], dtype="float32")


def _flat(df: DataFrame) -> DataFrame:
    kept = [c for c in (ROUND, PAPER, "text_sha") if c in df.columns]
    return df.select(*kept, *[F.col("vec")[i].cast("double").alias(f"v{i}") for i in range(len(LETTERS))])


def _dense_texts(spark, sf):
    return b.submissions(spark, sf).select(
        ROUND, PAPER, text.submission_text(F.col("title"), F.col("abstract"), text.DENSE_JOINER).alias("text"))


def _half_cache(spark, sf) -> vector_cache.VectorCache:
    """Cache that already holds the texts of even submissions."""
    cache = vector_cache.VectorCache(spark, scratch_path(spark, "vectors"), MODEL)
    cache.append(vector_cache.embed(cache.missing(_dense_texts(spark, sf).filter("paper % 2 = 0")), _letter_model()))
    return cache


_DENSE_SQL = "select round_id, paper, title || '[SEP]' || abstract as text from subs"
_COUNTS_SQL = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::double as v{i}" for i, c in enumerate(LETTERS))


@_query(o.sql(f"select distinct sha256(text) as text_sha, {_COUNTS_SQL} from (select title || '[SEP]' || abstract as text from subs)"))
def emb_cache(spark, sf):
    cache = _half_cache(spark, sf)
    vector_cache.embed_missing(_dense_texts(spark, sf), cache, _letter_model())
    return _flat(cache.read())


@_query(o.sql("""select distinct sha256(text) as text_sha from (select title || '[SEP]' || abstract as text from subs)
    where sha256(text) not in (select sha256(title || '[SEP]' || abstract) from subs where paper % 2 = 0)"""))
def emb_cache_miss(spark, sf):
    return _half_cache(spark, sf).missing(_dense_texts(spark, sf)).select("text_sha")


@_query(o.sql(f"select round_id, paper, sha256(text) as text_sha, {_COUNTS_SQL} from (select round_id, paper, title || '[SEP]' || abstract as text from subs)"))
def embed_missing(spark, sf):
    return _flat(vector_cache.embed_missing(_dense_texts(spark, sf), _half_cache(spark, sf), _letter_model()))


@_query(o.sql("""select round_id, reviewer_id, paper, title, bid as preference, lang || ' ; ' || source || ';' as topics
    from tf_bids join subs using (round_id, paper)"""))
def scored_output(spark, sf):
    raw = b.raw_submissions(spark, sf).withColumn(PAPER, F.col(PAPER).cast("bigint"))
    return subs_source.scored_output(raw, _bids(spark, sf).select(*K, PAPER, "bid"), [PAPER])


_PLACED_TERMS = """select round_id, reviewer_id, term, mean_weight, row_number() over (partition by round_id, reviewer_id
    order by mean_weight desc, term) as place from (
      select round_id, reviewer_id, term, floor(sum(cast(floor(w * 1e12 + 0.5) as hugeint))::double / 1e3 / max(n_papers) + 0.5) / 1e9 as mean_weight
      from paper_w join roster using (round_id, reviewer_id) group by round_id, reviewer_id, term) where mean_weight > 0"""


@_query(o.sql(f"""select round_id, reviewer_id, to_json({{'meta': {{'built': '2026-01-31',
    'matching': '{profiles.MATCHING["tfidf"]}', 'interest_weight': 0.35::double, 'sem_gain': 9.0::double, 'unique_papers': n_papers,
    'submissions_scored': n_subs, 'note': '{profiles.NOTE}'}}, 'topic_affinity': m, 'corpus_top_terms': terms}})::varchar as profile
    from roster join pools using (round_id)
    join (select reviewer_id, map_from_entries(list(row(topic, {{'affinity': interest * 10, 'interest': interest}}) order by topic)) as m
      from interests group by reviewer_id) using (reviewer_id)
    join (select round_id, reviewer_id, list(term order by place) as terms from ({_PLACED_TERMS}) where place <= 40
      group by round_id, reviewer_id) using (round_id, reviewer_id)"""))
def profile(spark, sf):
    prep, sparse = _base(spark, sf)
    return profiles.profile(prep.interests, pipelines.paper_top_terms(prep, sparse), prep.roster, prep.rounds, PARAMS,
                            "tfidf", "2026-01-31")


# E4 is the same query: the template pipeline ends in this table.
@_query(o.sql("select distinct topic, 0 as interest from tags"))
def topic_template_query(spark, sf):
    return topic_template(b.raw_submissions(spark, sf))


# ---- projections and scalar functions ----

@_query(o.sql(f"select paper, {o.clean('text')} as cleaned from sub_texts"))
def clean_text(spark, sf):
    return _sub_texts(spark, sf).select(PAPER, text.clean_text(F.col("text")).alias("cleaned"))


def _sub_texts(spark, sf):
    return b.submissions(spark, sf).select(
        ROUND, PAPER, text.submission_text(F.col("title"), F.col("abstract")).alias("text"))


@_query(o.sql(f"select paper, array_to_string({o.tokens('text')}, ' ') as words from sub_texts"))
def tokens(spark, sf):
    return _sub_texts(spark, sf).select(PAPER, F.array_join(text.tokens(F.col("text")), " ").alias("words"))


@_query(o.sql(f"""select paper, array_to_string(list_filter({o.tokens('text')}, lambda x: not list_contains(words, x)), ' ') as words
    from sub_texts cross join stop"""))
def stop_filter(spark, sf):
    kept = text.drop_stop_words(text.tokens(F.col("text")), default_stop_words())
    return _sub_texts(spark, sf).select(PAPER, F.array_join(kept, " ").alias("words"))


@_query(o.sql(f"""select paper, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') as terms
    from (select paper, list_filter({o.tokens('text')}, lambda x: not list_contains(words, x)) as w from sub_texts cross join stop)"""))
def ngrams12(spark, sf):
    return text.with_terms(_sub_texts(spark, sf), "text", "terms", default_stop_words()).select(
        PAPER, F.array_join("terms", "|").alias("terms"))


_DUMP = """select item_id as paper_key, replace(raw, '-' || chr(10), '') as txt, raw from (select item_id, case when item_id % 7 = 6 then text
    else 'arXiv: x' || chr(10) || 'Ti-' || chr(10) || 'tle ' || item_id || chr(10) || 'Abstract' || chr(10) || text || chr(10)
    || '1. Introduction' end as raw from benchmark)"""
_END = r"\b(?:\d+\s*[.)]?\s*introduction\b|introduction\b|keywords\b|index terms\b|categories and subject\b|ccs concepts\b|general terms\b)"
_SPLIT = rf"""select paper_key, raw, case when length(body) >= 40 then coalesce(list_filter(list_transform(
      string_split_regex(head, '[\n-\r]'), lambda x: {o.strip('x')}), lambda x: x <> '' and not regexp_matches(x, '(?i)^arxiv[:\s]'))[1], '') end as title,
      case when length(body) >= 40 then body end as abstract
    from (select paper_key, raw, head, {o.collapse(f"case when regexp_matches(rest, '(?i){_END}') then regexp_extract(rest, '(?is)^(.*?){_END}', 1) else substr(rest, 1, 2500) end")} as body
      from (select paper_key, raw, case when regexp_matches(txt, '(?i)\babstract\b') then regexp_extract(txt, '(?is)^(.*?)\babstract\b', 1) end as head,
        case when regexp_matches(txt, '(?i)\babstract\b') then regexp_extract(txt, '(?is)^.*?\babstract\b(.*)$', 1) end as rest from ({_DUMP})))"""


@_query(f"select paper_key, title, abstract from ({_SPLIT})")
def split_title_abstract(spark, sf):
    return text.with_title_abstract(b.paper_dumps(spark, sf), "text").select("paper_key", "title", "abstract")


@_query(o.sql(f"""select 'submission' as side, paper as id, title || '. ' || abstract as sparse_text, title || '[SEP]' || abstract as dense_text from subs
    union all select 'paper', paper_key, coalesce(title || '. ' || abstract, {o.collapse('raw')}), coalesce(title || '[SEP]' || abstract, {o.collapse('raw')})
    from ({_SPLIT})"""))
def assemble_text(spark, sf):
    s = b.submissions(spark, sf)
    title, abstract = F.col("title"), F.col("abstract")
    left = s.select(F.lit("submission").alias("side"), F.col(PAPER).alias("id"),
                    text.submission_text(title, abstract).alias("sparse_text"),
                    text.submission_text(title, abstract, text.DENSE_JOINER).alias("dense_text"))
    dumps = text.with_paper_text(b.paper_dumps(spark, sf), "text", "sparse_text", text.SPARSE_JOINER)
    dumps = text.with_paper_text(dumps, "text", "dense_text", text.DENSE_JOINER)
    return left.unionByName(dumps.select(F.lit("paper").alias("side"), F.col("paper_key").alias("id"), "sparse_text", "dense_text"))


@_query(o.sql("select paper, sha256(text) as text_sha from sub_texts"))
def text_key(spark, sf):
    return _sub_texts(spark, sf).select(PAPER, text.text_key(F.col("text")).alias("text_sha"))


@_query(o.sql("select paper, tag_no, topic from tags"))
def split_topics(spark, sf):
    raw = b.raw_submissions(spark, sf)
    parts = raw.select(F.col("paper").cast("bigint").alias(PAPER), text.split_topics(F.col("topics")).alias("t"))
    return parts.select(PAPER, F.posexplode("t").alias("tag_no", "topic"))


@_query(f"select doc_id, x, {o.away('x')} as rounded from (select doc_id, (n_chars % 1000)::double / 8 - 60 as x from documents)")
def round_half_away(spark, sf):
    x = b.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 8.0 - 60).alias("x"))
    return x.withColumn("rounded", numeric.round_half_away(F.col("x")))


@_query("select doc_id, x, round_even(x, 0)::double + 0 as rounded from (select doc_id, (n_chars % 1000)::double / 8 - 60 as x from documents)")
def round_half_even(spark, sf):
    x = b.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 8.0 - 60).alias("x"))
    return x.withColumn("rounded", numeric.round_half_even(F.col("x")))


@_query(f"""select doc_id, greatest(-0.5::double, least(0.5::double, x)) as clamped, {o.r9('sign(x) * pow(abs(x), 0.5::double)')} as powered
    from (select doc_id, (n_chars % 2001)::double / 1000 - 1 as x from documents)""")
def clamp_signpow(spark, sf):
    x = b.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 2001) / 1000.0 - 1).alias("x"))
    return x.select("doc_id", numeric.clamp(F.col("x"), -0.5, 0.5).alias("clamped"),
                    numeric.round9(numeric.signed_power(F.col("x"), 0.5)).alias("powered"))


@_query(f"select doc_id, raw, {_RATING} as interest from (select doc_id, {_RAW_RATING} as raw, try_cast(trim({_RAW_RATING}) as double) as v from documents)")
def parse_interest(spark, sf):
    raw = b.table(spark, sf, "documents").select("doc_id", F.expr(_RAW_RATING).alias("raw"))
    return raw.withColumn("interest", numeric.parse_rating(F.col("raw")))


@_query(o.sql("select reviewer_id, topic, interest, interest * 10 as affinity from interests"))
def affinity(spark, sf):
    return ratings.with_affinity(b.interests(spark, sf))


@_query(o.sql("select round_id, reviewer_id, paper, sem from tf_v"))
def sem_signal(spark, sf):
    q = ranking.quantile(_scored(spark, sf), K, "sim")
    return q.select(*K, PAPER, bidding.sem_signal(F.col("q"), PARAMS).alias("sem"))


@_query(o.sql("select round_id, reviewer_id, paper, value from tf_v"))
def blend(spark, sf):
    return _bids(spark, sf).select(*K, PAPER, "value")


@_query(o.sql("select round_id, reviewer_id, paper, tau, v_min, v_max, bid from tf_bids"))
def bid_map(spark, sf):
    return _bids(spark, sf).select(*K, PAPER, "tau", "v_min", "v_max", "bid")


@_query(o.sql("""select round_id, f as positive_frac, greatest(150, cast(ceil(3.0::double * f * n_subs) as bigint)) as topn from pools
    cross join (values (0.1::double), (0.5::double), (1.0::double)) v(f)"""))
def auto_topn(spark, sf):
    pools = tfidf.pool_sizes(b.submissions(spark, sf))
    sized = [pools.select(ROUND, F.lit(f).alias("positive_frac"), numeric.shortlist_size(F.col("n_subs"), f, 150, 3).alias("topn"))
             for f in (0.1, 0.5, 1.0)]
    return sized[0].unionByName(sized[1]).unionByName(sized[2])


# ---- aggregations ----

@_query(o.sql("select distinct topic from tags"))
def distinct_topics(spark, sf):
    return subs_source.distinct_topics(b.submissions(spark, sf), "topics").orderBy("topic")


@_query(o.sql("select round_id, paper, term, tf from sub_tf"))
def term_freq(spark, sf):
    arrays = tfidf.term_arrays(_sub_texts(spark, sf), [ROUND, PAPER], "text", default_stop_words())
    return tfidf.postings(arrays, [ROUND, PAPER])


@_query(o.sql(f"select round_id, term, df, {o.r9('idf')} as idf from vocab"))
def vocabulary(spark, sf):
    return _base(spark, sf)[1].vocabulary.select(ROUND, "term", "df", numeric.round9(F.col("idf")).alias("idf"))


@_query(o.sql("""select round_id, term, row_number() over (partition by round_id order by substr(md5(term), 1, 3), term) - 1 as term_id from vocab"""))
def term_ids(spark, sf):
    """The vocabulary's dictionary: ids without gaps in each round."""
    return _base(spark, sf)[1].vocabulary.select(ROUND, "term", "term_id")


@_query(o.sql(f"select round_id, paper, term, {o.r9('w / norm')} as w from sub_w join sub_norm using (round_id, paper)"))
def tfidf_weights(spark, sf):
    _, sparse = _base(spark, sf)
    return blocks.weights(sparse.blocks, sparse.answered).withColumn("w", numeric.round9(F.col("w")))


@_query(o.sql("select round_id, reviewer_id, paper, sim from scored"))
def topk_mean(spark, sf):
    return _scored(spark, sf).select(*K, PAPER, "sim")


@_query(o.sql("select round_id, reviewer_id, paper, topic_base from topic_bases"))
def topic_base(spark, sf):
    return pipelines.pool_with_topics(_prep(spark, sf), OPTIONS).select(*K, PAPER, "topic_base")


@_query(o.sql(f"select * from ({_PLACED_TERMS}) where place <= 40"))
def top_terms(spark, sf):
    return pipelines.paper_top_terms(*_base(spark, sf))


@_query(o.sql(f"""select round_id, reviewer_id, count(*) as n_scored, {o.r9('sum(bid)::double / count(*)')} as mean_bid,
    count(*) filter (bid > 0) as want, count(*) filter (bid = 0) as neutral, count(*) filter (bid < 0) as avoid,
    count(*) filter (bid >= 15) as strong_pos, count(*) filter (bid <= -15) as strong_neg, 15 as strong_cut,
    'abstract+topics' as mode from tf_bids group by round_id, reviewer_id"""))
def report_summary(spark, sf):
    mode = subs_source.input_mode(b.raw_submissions(spark, sf).columns)
    return reports.report_summary(_bids(spark, sf), PARAMS.bid_max, mode)


@_query(o.sql("""select round_id, reviewer_id, bid, n, cast(floor(50 * n::double / max(n) over (partition by round_id, reviewer_id)) as int) as bar
    from (select round_id, reviewer_id, bid, count(*) as n from tf_bids group by round_id, reviewer_id, bid)"""))
def report_histogram(spark, sf):
    return reports.report_histogram(_bids(spark, sf))


@_query(o.sql(f"""select round_id, reviewer_id, {o.r9('share')} as achieved, abs(share - 0.1::double) > 0.1::double as off_target from (
    select round_id, reviewer_id, (count(*) filter (bid > 0))::double / count(*) as share from tf_bids group by round_id, reviewer_id)"""))
def achieved_fraction(spark, sf):
    return reports.achieved_fraction(_bids(spark, sf), OPTIONS.positive_frac)


@_query(o.sql("""select round_id, reviewer_id, 'too few papers' as reason, count(distinct sha256(text)) as n
    from (select round_id, cast(floor(sqrt(paper_key)) as bigint) as reviewer_id, text from papers) group by round_id, reviewer_id
    having count(distinct sha256(text)) < 5"""))
def set_aside(spark, sf):
    """Who gets no bids when reviewers hold 1, 3, 5, ... papers; the list comes with the bids."""
    shares = b.papers(spark, sf).withColumn("reviewer_id", F.floor(F.sqrt("paper_key")))
    return run_bids("tfidf", b.submissions(spark, sf), shares, None).set_aside


def _line(part: int, at: str, text: str) -> str:
    return f"select round_id, reviewer_id, {part} as part, {at} as spot, {text} as line"


_HEAD = """'Reviewer bidding report' || chr(10) || repeat('=', 60) || chr(10) || 'mode            : abstract+topics' || chr(10)
    || printf('papers scored   : %d', count(*)) || chr(10) || printf('mean bid        : %+.2f', sum(bid)::double / count(*)) || chr(10)
    || printf('want (>0)       : %d', count(*) filter (bid > 0)) || chr(10) || printf('neutral (=0)    : %d', count(*) filter (bid = 0)) || chr(10)
    || printf('avoid (<0)      : %d', count(*) filter (bid < 0)) || chr(10) || printf('strong + (>=+15) : %d', count(*) filter (bid >= 15)) || chr(10)
    || printf('strong - (<=-15) : %d', count(*) filter (bid <= -15)) || chr(10) || chr(10) || 'distribution (bid: count)'"""
_BAR = "printf('  %+3d | %-50s %d', bid, repeat('#', cast(floor(50 * n::double / max(n) over (partition by round_id, reviewer_id)) as int)), n)"
_SHOWN = "printf('  %+3d  %s', bid, substr(title, 1, 78))"


def _end(part: int, order: str) -> str:
    cut = f"""select round_id, reviewer_id, bid, paper, title from (select *, row_number() over (partition by round_id, reviewer_id order by {order}) as place
        from tf_bids) join subs using (round_id, paper) where place <= 10"""
    return _line(part, "row_number() over (partition by round_id, reviewer_id order by bid desc, paper)", _SHOWN) + f" from ({cut})"


@_query(o.sql(f"""select round_id, reviewer_id, string_agg(line, chr(10) order by part, spot) as report from (
    {_line(0, '0', _HEAD)} from tf_bids group by round_id, reviewer_id
    union all {_line(1, '-bid', _BAR)} from (select round_id, reviewer_id, bid, count(*) as n from tf_bids group by round_id, reviewer_id, bid)
    union all {_line(2, '0', "chr(10) || 'top 10 (highest bids)'")} from (select distinct round_id, reviewer_id from tf_bids)
    union all {_end(3, 'bid desc, paper')}
    union all {_line(4, '0', "chr(10) || 'bottom 10 (lowest bids)'")} from (select distinct round_id, reviewer_id from tf_bids)
    union all {_end(5, 'bid, paper desc')}) group by round_id, reviewer_id"""))
def report_texts(spark, sf):
    """The text report of every reviewer and round."""
    titles = b.submissions(spark, sf).select(ROUND, PAPER, "title")
    mode = subs_source.input_mode(b.raw_submissions(spark, sf).columns)
    return reports.report_texts(_bids(spark, sf), titles, [ROUND, PAPER], PARAMS.bid_max, mode)


# ---- joins ----

_BEST = """select round_id, reviewer_id, paper, paper_key, sim, place from (select *, row_number() over (
    partition by round_id, reviewer_id, paper order by sim desc, paper_key) as place from cosines) where place <= 3"""


def _best_pairs(spark, sf) -> DataFrame:
    prep, s = _base(spark, sf)
    return similarity.best_pairs(similarity.sparse_tops(s.sub_rows, s.paper_rows, prep.rounds, prep.roster, OPTIONS))


@_query(o.sql("select round_id, reviewer_id, paper, paper_key, sim from cosines"))
def tfidf_cosine(spark, sf):
    """Cosines of all pairs of a submission and a paper that share a term."""
    prep, s = _base(spark, sf)
    return similarity.sparse_pairs(s.sub_rows, s.paper_rows, prep.rounds, prep.roster, OPTIONS)


@_query(o.sql("select round_id, reviewer_id, paper, paper_key, sim from emb_cos"))
def embedding_cosine(spark, sf):
    """Cosines of all pairs of a submission's and a paper's vector."""
    sub_vectors, paper_vectors, subs = b.vectors(spark, sf)
    prep = prepare(subs, paper_vectors)
    own = paper_vectors.join(prep.roster.select(*K), K, "left_semi")
    return similarity.dense_pairs(sub_vectors, own, prep.rounds, prep.roster, OPTIONS)


@_query(o.sql("select round_id, reviewer_id, paper, tag_no, topic, affinity from tag_affinity"))
def topic_affinity_join(spark, sf):
    prep = _prep(spark, sf)
    pool = similarity.pool_rows(prep.submissions.select(ROUND, PAPER, "topics"), prep.roster, prep.rounds, OPTIONS)
    return topics.topic_affinity_join(pool, topics.rating_maps(prep.interests), [*K, PAPER])


@_query(o.sql("select round_id, reviewer_id, paper, paper_key from pairs"))
def candidate_pairs(spark, sf):
    return rerank.candidate_pairs(_short(spark, sf), *_sides(spark, sf, rerank.COLUMN_OVERLAP)).select(*K, PAPER, PAPER_KEY)


@_query(o.sql("select round_id, reviewer_id, paper, case when is_candidate then 'shortlist' else 'rest' end as side from short"))
def candidate_split(spark, sf):
    short = _short(spark, sf)
    return short.select(*K, PAPER, F.when(F.col("is_candidate"), "shortlist").otherwise("rest").alias("side"))


# ---- windows, sorts, limits ----

@_query(o.sql("select round_id, reviewer_id, paper, sim, q from tf_q"))
def quantile_rank(spark, sf):
    return ranking.quantile(_scored(spark, sf), K, "sim").select(*K, PAPER, "sim", "q")


@_query(o.sql("select round_id, reviewer_id, paper, sim, q from tf_q"))
def quantile_rank_bucketed(spark, sf):
    """The same with values tied more than 20 times looked up by broadcast."""
    return ranking.quantile(_scored(spark, sf), K, "sim", tie_limit=20).select(*K, PAPER, "sim", "q")


@_query(o.sql("select round_id, reviewer_id, tau, v_min, v_max from tf_t"))
def threshold(spark, sf):
    counts = ranking.value_counts(_bids(spark, sf), K, "value")
    return ranking.threshold_table(counts, K, "value", OPTIONS.positive_frac)


@_query(o.sql("select round_id, reviewer_id, paper, sim from short where is_candidate"))
def shortlist(spark, sf):
    return _short(spark, sf).filter("is_candidate").select(*K, PAPER, "sim")


@_query(o.sql(_BEST))
def topk_per_group(spark, sf):
    return _best_pairs(spark, sf)


@_query(o.sql("""select round_id, reviewer_id, section, place, paper, bid, substr(title, 1, 78) as title from (
    select round_id, reviewer_id, paper, bid, 'top' as section, row_number() over (partition by round_id, reviewer_id order by bid desc, paper) as place from tf_bids
    union all select round_id, reviewer_id, paper, bid, 'bottom', row_number() over (partition by round_id, reviewer_id order by bid, paper desc) from tf_bids)
    join subs using (round_id, paper) where place <= 10"""))
def report_extremes(spark, sf):
    titles = b.submissions(spark, sf).select(ROUND, PAPER, "title")
    return reports.report_extremes(_bids(spark, sf), titles, [ROUND, PAPER]).select(*K, "section", "place", PAPER, "bid", "title")


# ---- set operations and hooks ----

@_query(o.sql("select round_id, reviewer_id, paper, is_candidate, sim as band from bands"))
def rerank_bands(spark, sf):
    means = rerank.pair_means(_scored_pairs(spark, sf))
    return rerank.rerank_bands(_short(spark, sf), means).select(*K, PAPER, "is_candidate", F.col("sim").alias("band"))


@_query(o.sql(f"""select word, count(*) as n_docs from (select distinct paper, unnest({o.tokens('text')}) as word from sub_texts)
    cross join stop where list_contains(words, word) group by word"""))
def stop_words_query(spark, sf):
    """How many texts hold each word of the united stop list."""
    words = _sub_texts(spark, sf).select(PAPER, F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n_docs")).join(stop_words(spark), "word", "left_semi")


@_query(o.sql("select round_id, reviewer_id, paper, paper_key, pair_sim from pair_scores"))
def pair_score(spark, sf):
    return _scored_pairs(spark, sf).select(*K, PAPER, PAPER_KEY, "pair_sim")


def _token_model():
    """The default pair score as a Python batch model; local functions travel to tasks by value."""
    def load():
        import functools
        import re

        @functools.lru_cache(1024)  # a text stands in many pairs of its cell
        def words(text: str) -> set[str]:
            return {w for w in re.split(r"\W+", text.replace("-\n", "").replace("\n", " ").lower()) if re.fullmatch("[a-z]{2,}", w)}

        def predict(papers, subs):
            pairs = [(words(a), words(b)) for a, b in zip(papers, subs)]
            shared = [len(a & b) for a, b in pairs]
            return [n / (len(a) + len(b) - n or 1) for n, (a, b) in zip(shared, pairs)]

        return predict

    return load


@_query(o.sql("select round_id, reviewer_id, paper, paper_key, pair_sim from pair_scores"))
def pair_score_model(spark, sf):
    """Pairs scored by a model in Python, batch by batch."""
    return _scored_pairs(spark, sf, rerank.BatchScorer(_token_model())).select(*K, PAPER, PAPER_KEY, "pair_sim")


# ---- pipelines, each from the tables to the bids ----

_BIDS = "round_id, reviewer_id, paper, sim, q, sem, topic_base, value, bid"


@_query(o.sql(f"select {_BIDS} from tf_bids"))
def bids_tfidf_query(spark, sf):
    return bids_tfidf(b.submissions(spark, sf), b.papers(spark, sf), b.interests(spark, sf)).select(*_BIDS.split(", "))


@_query(o.sql(f"select {_BIDS} from em_bids"))
def bids_embedding_query(spark, sf):
    sub_vectors, paper_vectors, subs = b.vectors(spark, sf)
    return bids_embedding(subs, paper_vectors, None, (sub_vectors, paper_vectors)).select(*_BIDS.split(", "))


@_query(o.sql(f"select {_BIDS} from le_bids"))
def bids_from_texts_query(spark, sf):
    """From texts over cache and embedder to bids; the cache holds half the submissions already."""
    return bids_from_texts(b.submissions(spark, sf), b.papers(spark, sf), b.interests(spark, sf), _half_cache(spark, sf), _letter_model()).select(*_BIDS.split(", "))


@_query(o.sql(f"select {_BIDS} from rr_bids"))
def bids_rerank_query(spark, sf):
    return bids_rerank(b.submissions(spark, sf), b.papers(spark, sf), b.interests(spark, sf)).select(*_BIDS.split(", "))


@_query(o.sql("""select 'tfidf' as method, round_id, reviewer_id, paper, sim from scored
    union all select 'rerank', round_id, reviewer_id, paper, sim from bands"""))
def semantic_scores_query(spark, sf):
    prep, sparse = _base(spark, sf)
    scored = semantic_scores(prep, RunOptions(method="tfidf"), sparse=sparse)
    bands = semantic_scores(prep, RunOptions(method="rerank"), sparse=sparse, scored=scored)
    one = lambda m, df: df.select(F.lit(m).alias("method"), *K, PAPER, "sim")
    return one("tfidf", scored).unionByName(one("rerank", bands))


def _named() -> dict[str, tuple[Query, str | None]]:
    return {name.removesuffix("_query"): pair for name, pair in _REGISTRY.items()}


def _optional(name: str):
    """A module of the optional part, or None where its files are gone; errors inside it are not hidden."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as error:
        if error.name and (name + ".").startswith(error.name + "."):
            return None
        raise


_llm = _optional("revmatch.llm.queries")
_pipeline = _optional("corpus_pipeline") if _llm else None


def entry(spark: SparkSession) -> DataFrame:
    return bids_tfidf_query(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    found = {name: fn for name, (fn, _) in _named().items()}
    return found | (_llm.QUERIES if _llm else {}) | ({"pipeline": _pipeline.run} if _pipeline else {})


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, sql) in _named().items() if sql} | (_llm.SQL if _llm else {})
    return found | ({"pipeline": _pipeline.ORACLE_SQL} if _pipeline and _pipeline.ORACLE_SQL else {})
