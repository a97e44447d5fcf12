import contextlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revmatch import RunOptions, ScoringParams, bids_embedding, bids_rerank, bids_tfidf, prepare, run_bids, semantic_scores
from revmatch.operators import reports, rerank, similarity, tfidf
from revmatch.plans import pipelines
from revmatch.plans.pipelines import PoolTooSmall, TooFewPapers
from revmatch.schemas import K
from revmatch.session import materialize

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
STOP = ["the"]


def make_text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def fixture(spark):
    """Two rounds; one reviewer holds most papers; a third of the submissions are copies of one text."""
    rnd = random.Random(7)
    copy = make_text(rnd, 8)
    subs = [("big" if i % 5 else "small", i, make_text(rnd, 2), copy if i % 3 == 0 else make_text(rnd, rnd.randint(0, 9)), ["x"] if i % 2 else [])
            for i in range(90)]
    papers = [(r, who, who * 100 + j, make_text(rnd, rnd.randint(1, 30)))
              for r in ("big", "small") for who, many in ((1, 17), (2, 5), (3, 4)) for j in range(many)]
    ratings = [(1, "x", 2), (2, "x", -1)]
    return (subs, papers,
            spark.createDataFrame(subs, "round_id string, paper bigint, title string, abstract string, topics array<string>"),
            spark.createDataFrame(papers, "round_id string, reviewer_id bigint, paper_key bigint, text string"),
            spark.createDataFrame(ratings, "reviewer_id bigint, topic string, interest int"))


def grams(text):
    words = [w for w in re.findall(r"\w+", text.lower()) if re.fullmatch("[a-z]{2,}", w) and w not in STOP]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def brute_cosines(subs, papers, round_id):
    """Dense matrices, as a plain statement of the formula."""
    docs = {p: grams(f"{t}. {a}") for r, p, t, a, _ in subs if r == round_id}
    df = Counter(t for d in docs.values() for t in d)
    n = len(docs)
    vocab = sorted(t for t, c in df.items() if 2 <= c <= 0.3 * n)
    idf = np.array([math.log((1 + n) / (1 + df[t])) + 1 for t in vocab])

    def vector(counts):
        v = np.array([1 + math.log(counts[t]) if counts[t] else 0.0 for t in vocab]) * idf
        return v / np.linalg.norm(v) if v.any() else v

    own = {(who, key): vector(grams(text)) for r, who, key, text in papers if r == round_id and who != 3}
    return {(p, k): float(vector(d) @ v) for p, d in docs.items() for k, v in own.items()}


def brute_sims(subs, papers, round_id):
    cos = brute_cosines(subs, papers, round_id)
    sims = {}
    for (p, (who, _)), value in cos.items():
        sims.setdefault((who, p), []).append(value)
    return {key: sum(sorted(v)[-3:]) / 3 for key, v in sims.items()}


@pytest.mark.parametrize("options", [RunOptions(), RunOptions(cell_submissions=7, cell_papers=3)])
def test_sparse_similarity_equals_dense_matrices(spark, fixture, options):
    """Small cells split the large reviewer's papers over many tasks; the result is the same."""
    subs, papers, s, p, i = fixture
    scored = semantic_scores(prepare(s, p, i, options), options, stop_words=STOP)
    for round_id in ("big", "small"):
        got = {(r.reviewer_id, r.paper): r.sim for r in scored.filter(F.col("round_id") == round_id).collect()}
        want = brute_sims(subs, papers, round_id)
        assert got.keys() == want.keys()
        assert got == pytest.approx(want, abs=2e-9)


def test_bids_do_not_depend_on_partitioning(spark, fixture):
    _, _, s, p, i = fixture
    key = lambda df: sorted((r.round_id, r.reviewer_id, r.paper, r.bid) for r in df.collect())
    one = key(bids_tfidf(s, p, i, stop_words=STOP))
    two = key(bids_tfidf(s.orderBy(F.rand(1)).repartition(5), p.repartition(3), i, stop_words=STOP,
                         options=RunOptions(cell_submissions=11, cell_papers=2)))
    assert one == two
    assert len(one) == 180
    assert all(-20 <= b <= 20 for *_, b in one)


def test_rerank_scores_sit_above_the_rest(spark, fixture):
    subs, papers, s, p, i = fixture
    options = RunOptions(method="rerank", rerank_topn=10, pair_cell=4)
    scored = semantic_scores(prepare(s, p, i), options, stop_words=STOP)
    rows = scored.filter("round_id = 'big' and reviewer_id = 1").collect()
    chosen = [r for r in rows if r.is_candidate]
    assert len(chosen) == 10 and len(rows) == 72
    assert min(r.sim for r in chosen) > 1 > max(r.sim for r in rows if not r.is_candidate)
    texts = {p_: set(re.findall("[a-z]{2,}", f"{t}. {a}")) for r, p_, t, a, _ in subs}
    own = [set(text.split()) for r, who, _, text in papers if r == "big" and who == 1]
    for r in chosen:
        a = texts[r.paper]
        best = sorted((len(a & b) / len(a | b) for b in own if len(b) > 0), reverse=True)[:3]
        assert r.pair_mean == pytest.approx(sum(best) / 3, abs=2e-9)


def test_python_pair_scorer_gives_the_same_bids_as_columns(spark, fixture):
    _, _, s, p, i = fixture

    def load():
        def predict(a, b):
            import re
            cut = lambda t: set(re.findall("[a-z]{2,}", t))
            return [len(cut(x) & cut(y)) / max(1, len(cut(x) | cut(y))) for x, y in zip(a, b)]
        return predict

    key = lambda df: sorted((r.round_id, r.reviewer_id, r.paper, r.bid) for r in df.collect())
    options = RunOptions(rerank_topn=9)
    assert key(bids_rerank(s, p, i, options=options, stop_words=STOP)) == key(
        bids_rerank(s, p, i, options=options, stop_words=STOP, scorer=rerank.BatchScorer(load, batch=3)))


def test_candidate_texts_do_not_grow_with_the_reviewers(spark):
    """The same 64 papers held by 2 or by 16 reviewers who all shortlist the same submissions: as many texts are shuffled."""
    subs = spark.createDataFrame([("r", k, f"text {k} " * 50) for k in range(40)], "round_id string, paper bigint, sub_side string")
    sizes, pairs = {}, {}
    for n in (2, 16):
        papers = spark.createDataFrame([("r", k % n, k, "own words") for k in range(64)], "round_id string, reviewer_id int, paper_key int, paper_side string")
        roster = papers.groupBy(*K).agg(F.count("*").alias("n_papers"))
        rounds = spark.createDataFrame([("r", 40, 64, n)], "round_id string, n_subs bigint, n_papers bigint, n_reviewers bigint")
        short = spark.createDataFrame([("r", w, k, k < 10) for w in range(n) for k in range(40)], "round_id string, reviewer_id int, paper bigint, is_candidate boolean")
        cells = similarity.paper_cells(papers, rounds, roster, 64, 64)
        left = rerank.candidate_texts(short, subs, cells, rounds)
        sizes[n] = left.agg(F.sum(F.length("sub_side"))).first()[0]
        found = rerank.candidate_pairs(short, subs, papers, rounds, roster, RunOptions(pair_cell=64))
        pairs[n] = sorted((r.paper, r.paper_key) for r in found.collect())
    assert sizes[2] == sizes[16] and pairs[2] == pairs[16] == [(k, p) for k in range(10) for p in range(64)]


@pytest.mark.parametrize("cells", [(256, 1024), (3, 2)])
def test_dense_similarity_with_zero_and_scaled_vectors(spark, cells):
    rnd = np.random.default_rng(1)
    subs = {i: rnd.normal(size=4) for i in range(10)}
    subs[3] = np.zeros(4)
    subs[4] = subs[5] * 7
    papers = {(1, j): rnd.normal(size=4) for j in range(8)} | {(2, 50 + j): rnd.normal(size=4) for j in range(5)}
    vec = lambda v: [float(x) for x in v]
    sv = spark.createDataFrame([("r", i, vec(v)) for i, v in subs.items()], "round_id string, paper bigint, vec array<double>")
    pv = spark.createDataFrame([("r", w, k, vec(v)) for (w, k), v in papers.items()],
                               "round_id string, reviewer_id bigint, paper_key bigint, vec array<double>")
    options = RunOptions(method="embedding", cell_submissions=cells[0], cell_papers=cells[1])
    prep = prepare(sv.select("round_id", "paper"), pv, None, options)
    got = {(r.reviewer_id, r.paper): r.sim for r in semantic_scores(prep, options, vectors=(sv, pv)).collect()}
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    for who in (1, 2):
        own = [unit(v) for (w, _), v in papers.items() if w == who]
        for i, v in subs.items():
            best = sorted((float(unit(v) @ o) for o in own), reverse=True)[:3]
            assert got[who, i] == pytest.approx(sum(best) / 3, abs=2e-9)
    assert got[1, 4] == got[1, 5]
    assert bids_embedding(sv.select("round_id", "paper"), pv, None, (sv, pv), options=options).count() == 20


def test_guards(spark, fixture):
    _, _, s, p, i = fixture
    prep = prepare(s, p, i)
    assert {(r.reviewer_id, r.accepted) for r in prep.guard.collect()} == {(1, True), (2, True), (3, False)}
    with pytest.raises(TooFewPapers):
        prepare(s, p, i, RunOptions(strict=True))
    few = s.filter("paper < 6").withColumn("round_id", F.lit("small"))
    kept = p.filter("reviewer_id < 3")
    with pytest.raises(PoolTooSmall):
        prepare(few, kept, i, RunOptions(strict=True))
    assert bids_tfidf(few, kept, i, stop_words=STOP).count() == 0
    with pytest.raises(ValueError):
        semantic_scores(prep, RunOptions(method="embedding"))


def test_run_result_tells_what_was_set_aside_and_the_share(spark, fixture):
    _, _, s, p, i = fixture
    few = s.unionByName(s.filter("paper < 6").withColumn("round_id", F.lit("tiny")))
    run = run_bids("tfidf", few, p.unionByName(p.filter("round_id = 'big'").withColumn("round_id", F.lit("tiny"))), i, stop_words=STOP)
    bids = run.bids.collect()
    assert Counter((r.round_id, r.reviewer_id, r.reason, r.n) for r in run.set_aside.collect()) == Counter(
        {("big", 3, "too few papers", 4): 1, ("small", 3, "too few papers", 4): 1, ("tiny", 3, "too few papers", 4): 1, ("tiny", None, "too few submissions", 6): 1})
    positive = sum(r.bid > 0 for r in bids)
    assert run.achieved() == {"bids": len(bids), "positive": positive, "share": positive / len(bids), "off_target": abs(positive / len(bids) - 0.1) > 0.1}


def test_report_texts_are_written_per_pool(spark, tmp_path):
    rows = [(r, w, k, (k * 7 + w) % 41 - 20) for r in ("a", "b") for w in (1, 2) for k in range(60)]
    bids = spark.createDataFrame(rows, "round_id string, reviewer_id bigint, paper bigint, bid int")
    titles = spark.createDataFrame([(r, k, f"title {k}") for r in ("a", "b") for k in range(60)], "round_id string, paper bigint, title string")
    texts = reports.report_texts(bids, titles, ["round_id", "paper"], 20, "title-only")
    assert "SinglePartition" not in plan_of(texts)
    reports.write_report_texts(texts, str(tmp_path / "out"))
    for r in ("a", "b"):
        for w in (1, 2):
            got = "\n".join(x.value for x in spark.read.text(str(tmp_path / "out" / f"round_id={r}" / f"reviewer_id={w}")).collect())
            assert got == reports.report_text(bids, titles, ["round_id", "paper"], r, w, 20, "title-only")


def test_report_text(spark):
    rows = [("r", 1, i, b) for i, b in enumerate([20, 15, 1, 0, -3, -20] * 4)]
    bids = spark.createDataFrame(rows, "round_id string, reviewer_id bigint, paper bigint, bid int")
    titles = spark.createDataFrame([("r", i, f"title {i} " + "x" * 100) for i in range(24)], "round_id string, paper bigint, title string")
    text = reports.report_text(bids, titles, ["round_id", "paper"], "r", 1, 20, "abstract")
    lines = text.split("\n")
    assert lines[2:10] == [
        "mode            : abstract", "papers scored   : 24", "mean bid        : +2.17", "want (>0)       : 12",
        "neutral (=0)    : 4", "avoid (<0)      : 8", "strong + (>=+15) : 8", "strong - (<=-15) : 4"]
    assert lines[12] == "  +20 | " + "#" * 50 + " 4"
    top = lines[lines.index("top 10 (highest bids)") + 1:][:10]
    bottom = lines[lines.index("bottom 10 (lowest bids)") + 1:]
    assert [x.split()[2] for x in top] == ["0", "6", "12", "18", "1", "7", "13", "19", "2", "8"]
    assert [x.split()[2] for x in bottom] == ["15", "21", "4", "10", "16", "22", "5", "11", "17", "23"]
    assert len(top[0]) == 2 + 3 + 2 + 78


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans_have_no_single_partition_or_cartesian_step(spark, fixture):
    _, _, s, p, i = fixture
    options = RunOptions()
    prep = prepare(s, p, i, options)
    sparse = pipelines.sparse_side(prep, STOP)
    packed = [materialize(t, "packed") for t in (sparse.sub_rows, sparse.paper_rows)]
    tops = similarity.sparse_tops(*packed, prep.rounds, prep.roster, options)
    plan = plan_of(tops)
    whole = plan_of(similarity.topk_mean(tops, pipelines.pool_with_topics(prep, options, fitted=True)))
    for text in (plan, whole, plan_of(similarity.best_pairs(tops)), plan_of(bids_tfidf(s, p, i, ScoringParams(), stop_words=STOP))):
        assert "SinglePartition" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # One exchange a side, of packed rows: no term travels as text, no product travels.
    tree = plan[plan.index("== Physical Plan =="):plan.index("\n\n")]
    assert len(re.findall(r"(?<!Broadcast)Exchange", tree)) == 2
    assert "term#" not in plan


@pytest.mark.parametrize("options", [RunOptions(), RunOptions(cell_submissions=7, cell_papers=3)])
def test_every_cosine_equals_the_dense_matrices(spark, fixture, options):
    """With room for all papers, the cells' tops are all pairs that share a term; the three best are cut from them with ties by key."""
    subs, papers, s, p, i = fixture
    prep = prepare(s, p, i, options)
    sparse = pipelines.sparse_side(prep, STOP)
    tops = similarity.sparse_tops(sparse.sub_rows, sparse.paper_rows, prep.rounds, prep.roster, options, 1000)
    every = {(r.round_id, r.reviewer_id, r.paper, r.paper_key): r.sim for r in similarity.best_pairs(tops, 1000).collect()}
    for round_id in ("big", "small"):
        want = {k: v for k, v in brute_cosines(subs, papers, round_id).items() if v > 0}
        got = {(sub, (who, key)): v for (r, who, sub, key), v in every.items() if r == round_id}
        assert got == pytest.approx(want, abs=2e-9)
    best = {}
    for (r, who, sub, key), v in every.items():
        best.setdefault((r, who, sub), []).append((-v, key))
    three = similarity.sparse_tops(sparse.sub_rows, sparse.paper_rows, prep.rounds, prep.roster, options)
    got = {(r.round_id, r.reviewer_id, r.paper, r.place): (-r.sim, r.paper_key) for r in similarity.best_pairs(three).collect()}
    assert got == {(*k, n + 1): e for k, v in best.items() for n, e in enumerate(sorted(v)[:3])}


def test_term_ids_have_no_gaps_and_do_not_depend_on_partitioning(spark):
    words = [(r, f"w{k}") for r, n in (("a", 9000), ("b", 3), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(words, "round_id string, term string")

    def ids_of(vocab):
        numbered = tfidf.number_terms(vocab)
        return {(r.round_id, r.term): r.term_id for r in tfidf.with_term_ids(numbered, tfidf.range_starts(numbered)).collect()}

    ids = ids_of(df.repartition(3))
    assert ids == ids_of(df.orderBy(F.rand(2)).repartition(7, "term"))
    for r, n in (("a", 9000), ("b", 3), ("c", 1)):
        assert sorted(v for (x, _), v in ids.items() if x == r) == list(range(n))


def test_whole_registry_has_twins_and_names():
    import __spark_entry__ as entry

    own = set(entry._named())  # without the optional subpackage's
    assert own <= set(entry.queries()) and own <= set(entry.oracle_sql()) <= set(entry.queries())
    assert {"bids_tfidf", "bids_embedding", "bids_rerank", "topic_template", "semantic_scores"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["bids_tfidf", "bids_rerank", "profile", "scan_interests", "report_extremes"])
def test_queries_match_twins_on_small_tables(spark, sf_dir, name):
    import __spark_entry__ as entry
    from tests.check_oracle import connect, frames_equal

    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert frames_equal(got, connect(sf_dir).execute(entry.oracle_sql()[name]).df()) == ""


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 1000
    assert set(K) <= set(df.columns)
