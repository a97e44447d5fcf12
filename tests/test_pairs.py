"""Pair queries return every pair, not the best of them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from revmatch import RunOptions, prepare
from revmatch.operators import rerank, similarity
from revmatch.plans import pipelines
from revmatch.schemas import K
from tests.test_pipelines import STOP, brute_cosines, fixture  # noqa: F401


@pytest.mark.parametrize("options", [RunOptions(), RunOptions(cell_submissions=7, cell_papers=3)])
def test_sparse_pairs_are_all_that_share_a_term(spark, fixture, options):  # noqa: F811
    subs, papers, s, p, i = fixture
    prep = prepare(s, p, i, options)
    sparse = pipelines.sparse_side(prep, STOP)
    rows = similarity.sparse_pairs(sparse.sub_rows, sparse.paper_rows, prep.rounds, prep.roster, options).collect()
    for round_id in ("big", "small"):
        want = {k: v for k, v in brute_cosines(subs, papers, round_id).items() if v > 0}
        got = [((r.paper, (r.reviewer_id, r.paper_key)), r.sim) for r in rows if r.round_id == round_id]
        assert len(got) == len(want) and dict(got) == pytest.approx(want, abs=2e-9)


def per_group(rows):
    return Counter((r.round_id, r.reviewer_id, r.paper) for r in rows)


def test_tfidf_cosine_has_more_than_three_papers_a_reviewer(spark, sf_dir):
    import __spark_entry__ as entry
    from tests.check_oracle import connect, frames_equal

    got = entry.queries()["tfidf_cosine"](spark, sf_dir)
    assert max(per_group(got.collect()).values()) > 3
    assert frames_equal(got.toPandas(), connect(sf_dir).execute(entry.oracle_sql()["tfidf_cosine"]).df()) == ""


def test_embedding_cosine_has_every_paper_of_every_reviewer(spark, sf_dir):
    import __spark_entry__ as entry
    from tests.check_oracle import connect, frames_equal

    got = entry.queries()["embedding_cosine"](spark, sf_dir)
    assert set(per_group(got.collect()).values()) == {5}
    assert frames_equal(got.toPandas(), connect(sf_dir).execute(entry.oracle_sql()["embedding_cosine"]).df()) == ""


def test_a_text_reaches_a_python_scorer_once_per_cell(spark):
    """All pairs of 30 submissions and 2 x 20 papers: texts of a cell are the same objects in all their pairs."""
    def load():
        seen = {"sub": set(), "paper": set()}

        def predict(papers, subs):
            seen["sub"].update(map(id, subs))
            seen["paper"].update(map(id, papers))
            return [1e-3 * len(seen["sub"]) + 1e-6 * len(seen["paper"])] * len(subs)
        return predict

    subs = spark.createDataFrame([("r", k, f"text {k}") for k in range(30)], "round_id string, paper bigint, sub_side string")
    papers = spark.createDataFrame([("r", k % 2, k, f"own {k}") for k in range(40)], "round_id string, reviewer_id int, paper_key int, paper_side string")
    roster = papers.groupBy(*K).agg(F.count("*").alias("n_papers"))
    rounds = spark.createDataFrame([("r", 30, 40, 2)], "round_id string, n_subs bigint, n_papers bigint, n_reviewers bigint")
    short = spark.createDataFrame([("r", w, k, k < 20 or w == 1) for w in range(2) for k in range(30)],
                                  "round_id string, reviewer_id int, paper bigint, is_candidate boolean")
    rows = rerank.scored_pairs(short, subs, papers, rounds, roster, RunOptions(), rerank.BatchScorer(load)).collect()
    assert {(r.reviewer_id, r.paper, r.paper_key) for r in rows} == {(k % 2, s, k) for k in range(40) for s in range(30) if s < 20 or k % 2}
    assert len(rows) == 20 * 20 + 30 * 20 and max(r.pair_sim for r in rows) == 0.03004


def test_topic_affinity_join_needs_no_terms(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_KEPT", {})
    monkeypatch.setattr(pipelines, "sparse_side", None)
    assert entry.queries()["topic_affinity_join"](spark, sf_dir).count() == 2 * entry.queries()["topic_base"](spark, sf_dir).count() > 0


def test_cells_score_like_native_columns(spark):
    """Overlap of token sets, with empty texts, null texts, repeated words and more words than one product takes."""
    many = " ".join("".join(chr(97 + int(c)) for c in f"{k:05d}") for k in range(20000))
    texts = ["alpha beta beta", "", None, "beta gamma delta", many, many[:60000] + " alpha", "x 7"]
    subs = spark.createDataFrame([("r", k, t) for k, t in enumerate(texts)], "round_id string, paper bigint, text string")
    papers = spark.createDataFrame([("r", k % 2, k, t) for k, t in enumerate(texts * 2)], "round_id string, reviewer_id int, paper_key int, text string")
    roster = papers.groupBy(*K).agg(F.count("*").alias("n_papers"))
    rounds = spark.createDataFrame([("r", 7, 14, 2)], "round_id string, n_subs bigint, n_papers bigint, n_reviewers bigint")
    short = spark.createDataFrame([("r", w, k, True) for w in range(2) for k in range(7)], "round_id string, reviewer_id int, paper bigint, is_candidate boolean")
    found = []
    for scorer in (rerank.TOKEN_OVERLAP, rerank.COLUMN_OVERLAP):
        sides = (rerank.side_features(subs, ["round_id", "paper"], "text", "sub_side", scorer),
                 rerank.side_features(papers, [*K, "paper_key"], "text", "paper_side", scorer))
        pairs = rerank.scored_pairs(short, *sides, rounds, roster, RunOptions(), scorer)
        found.append(sorted((r.reviewer_id, r.paper, r.paper_key, r.n_papers, r.pair_sim) for r in pairs.collect()))
    assert found[0] == found[1] and len(found[0]) == 7 * 14 and {r[4] for r in found[0]} >= {0.0, 1.0, 0.25}


def test_scored_pairs_are_not_joined_text_by_text(spark, sf_dir):
    import __spark_entry__ as entry
    from tests.test_pipelines import plan_of

    plan = plan_of(entry.queries()["pair_score"](spark, sf_dir))
    assert "array_intersect" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_semantic_scores_makes_the_sparse_scores_once(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry
    from tests.check_oracle import connect, frames_equal

    made, plain = [], pipelines._tfidf_scores
    monkeypatch.setattr(pipelines, "_tfidf_scores", lambda *a: made.append(1) or plain(*a))
    got = entry.queries()["semantic_scores"](spark, sf_dir).toPandas()
    assert len(made) == 1
    assert frames_equal(got, connect(sf_dir).execute(entry.oracle_sql()["semantic_scores"]).df()) == ""
