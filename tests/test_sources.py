import numpy as np
import pytest
from pyspark.sql import functions as F

from revmatch.operators.topics import rating_maps, with_topic_base
from revmatch.sources import papers, ratings, submissions, vector_cache


def test_csv_scan_keeps_quoted_breaks_and_extra_columns(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        'extra,paper,title,preference,topics,abstract\n'
        'x,1,"A ""quoted"", title",,"a; b ;;a","line one\nline two"\n'
        'y,2,  spaced ,5,,\n', encoding="utf-8")
    df = submissions.scan_submissions(spark, str(tmp_path / "in.csv"), "r1").orderBy("paper")
    got = [(r.round_id, r.paper, r.title, r.abstract, r.topics, r.preference) for r in df.collect()]
    assert got == [("r1", 1, 'A "quoted", title', "line one\nline two", ["a", "b", "a"], None),
                   ("r1", 2, "  spaced ", "", [], "5")]


def test_csv_scan_without_optional_columns_and_its_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("paper,title,preference\n7,T,\n")
    row = submissions.scan_submissions(spark, str(tmp_path / "a.csv"), "r").first()
    assert (row.abstract, row.topics) == ("", [])
    (tmp_path / "b.csv").write_text("paper,title\n7,T\n")
    (tmp_path / "c.csv").write_text("paper,title,preference\n")
    for name in ("b", "c"):
        with pytest.raises(submissions.MissingInput):
            submissions.scan_submissions(spark, str(tmp_path / f"{name}.csv"), "r")
    assert submissions.input_mode(["paper", "abstract", "topics"]) == "abstract+topics"
    assert submissions.input_mode(["topics"]) == "topics"
    assert submissions.input_mode(["paper"]) == "title-only"


def test_topics_column_lookup(spark):
    assert submissions.resolve_topics_column(["a", " Topics "]) == " Topics "
    assert submissions.resolve_topics_column(list("abcdef")) == "e"
    with pytest.raises(submissions.MissingInput):
        submissions.resolve_topics_column(list("abcd"))


def test_template_is_sorted_distinct_and_not_overwritten(spark, tmp_path):
    raw = spark.createDataFrame([("b; a",), ("a;é;B",), (None,)], "Topics string")
    assert [tuple(r) for r in submissions.topic_template(raw).collect()] == [("B", 0), ("a", 0), ("b", 0), ("é", 0)]
    out = str(tmp_path / "template")
    submissions.write_topic_template(raw, out)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        submissions.write_topic_template(raw, out)
    submissions.write_topic_template(raw, out, force=True)
    with pytest.raises(submissions.MissingInput):
        submissions.topic_template(spark.createDataFrame([(" ; ",)], "topics string"))


def test_ratings_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "# scale\n  # indented\ninterest,topic,note\n2,a,x\n,b,\n-9, c ,\n1,,blank topic\n-1,a,last wins\n2,\"d, e\",\n")
    got = {r.topic: r.interest for r in ratings.scan_interests(spark, str(tmp_path / "r.csv"), 3).collect()}
    assert got == {"a": -1, "b": 0, "c": -2, "d, e": 2}
    (tmp_path / "bad.csv").write_text("topic,rating\na,1\n")
    (tmp_path / "none.csv").write_text("topic,interest\n ,1\n")
    for name in ("bad", "none"):
        with pytest.raises(submissions.MissingInput):
            ratings.scan_interests(spark, str(tmp_path / f"{name}.csv"), 3)


def test_paper_files(spark, tmp_path):
    for name, content in {"b.pdf": b"%PDF one", "a.PDF": b"%PDF one", "c.pdf": b"%PDF two", "d.pdf": b"no", "e.txt": b"%PDF x"}.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.pdf").write_bytes(b"%PDF three")
    found = sorted(r.path.rsplit("/", 1)[1] for r in papers.scan_paper_files(spark, str(tmp_path)).collect())
    assert found == ["a.PDF", "c.pdf"]


def test_leading_pages_and_guard(spark):
    pages = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 3, "d"), (1, 2, None), (2, 5, "z")], "paper_key bigint, page int, text string")
    # a paper without an early page keeps its place, with empty text
    assert sorted(tuple(r) for r in papers.leading_pages(pages, ["paper_key"]).collect()) == [(1, "ab"), (2, "")]
    own = spark.createDataFrame([("r", 1, f"t{i % 4}") for i in range(9)] + [("r", 2, f"u{i}") for i in range(5)],
                                "round_id string, reviewer_id bigint, sha string")
    assert {(r.reviewer_id, r.n_papers, r.accepted) for r in papers.papers_guard(own, "sha").collect()} == {(1, 4, False), (2, 5, True)}


def test_topic_base(spark):
    maps = rating_maps(spark.createDataFrame([(1, "a", 2), (1, "b", -1), (1, "low", -2)], "reviewer_id bigint, topic string, interest int"))
    rows = [(1, ["low", "unknown"]), (1, ["a", "a", "b"]), (1, []), (1, ["A"]), (2, ["a"])]
    df = spark.createDataFrame([(r, t, i) for i, (r, t) in enumerate(rows)], "reviewer_id bigint, topics array<string>, i int")
    out = with_topic_base(df.join(maps, "reviewer_id", "left")).orderBy("i")
    assert [r.topic_base for r in out.collect()] == pytest.approx([-4, 16, 0, 0, 0])


def test_embedder_runs_for_misses_only_and_once_per_text(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def load():
        import uuid

        def encode(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return np.array([[len(t), 1.0] for t in texts])
        return encode

    def encoded():
        lines = [line for f in calls.iterdir() for line in f.read_text().split("\n")]
        for f in calls.iterdir():
            f.write_text("")
        return sorted(x for x in lines if x)

    cache = vector_cache.VectorCache(spark, str(tmp_path / "cache"), "m1")
    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa")], "id bigint, text string")
    out = {r.id: r.vec for r in vector_cache.embed_missing(texts, cache, load).collect()}
    assert out == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0]}
    assert encoded() == ["aa", "b"]
    more = texts.union(spark.createDataFrame([(4, "cccc")], texts.schema))
    assert vector_cache.embed_missing(more, cache, load).count() == 4
    assert encoded() == ["cccc"]
    assert vector_cache.embed_missing(more, cache, load).count() == 4
    assert encoded() == []
    other = vector_cache.VectorCache(spark, str(tmp_path / "cache"), "m2")
    assert other.missing(texts).count() == 2


def test_scored_output_drops_abstract(spark):
    raw = spark.createDataFrame([(1, "T", "old", "long", "x")], "paper bigint, title string, preference string, abstract string, extra string")
    bids = spark.createDataFrame([("r", 9, 1, -3)], "round_id string, reviewer_id bigint, paper bigint, bid int")
    out = submissions.scored_output(raw, bids, ["paper"])
    assert out.columns == ["round_id", "reviewer_id", "paper", "title", "preference", "extra"]
    assert tuple(out.first()) == ("r", 9, 1, "T", -3, "x")
    assert out.select(F.col("preference")).first()[0] == -3


def test_wide_rating_files(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("# x\n" + ",".join(f"c{i}" for i in range(17)) + ",topic,interest\n" + "," * 17 + "a,2\n")
    got = ratings.scan_interests(spark, str(path), 1).collect()
    assert [(r["topic"], r["interest"]) for r in got] == [("a", 2)]


def test_cache_with_repeated_keys(spark, tmp_path):
    cache = vector_cache.VectorCache(spark, str(tmp_path / "cache"), "m")
    rows = spark.createDataFrame([("k", [1.0, 2.0]), ("k", [1.0, 2.0])], "text_sha string, vec array<float>")
    cache.append(rows)
    cache.append(rows)
    assert cache.read().count() == 1


def test_papers_of_one_text_count_once_and_papers_without_early_pages_stay(spark):

    rows = [("r", 1, k, "same") for k in range(5)] + [("r", 1, 9, ""), ("r", 1, 10, None)]
    own = spark.createDataFrame(rows, "round_id string, reviewer_id bigint, paper_key bigint, text string")
    assert sorted(r["paper_key"] for r in papers.distinct_papers(own, ["round_id", "reviewer_id"], "paper_key", "text").collect()) == [0, 9, 10]
    pages = spark.createDataFrame([(1, 0, "a"), (1, 7, "z"), (2, 5, "late")], "paper_key bigint, page int, text string")
    assert {(r["paper_key"], r["text"]) for r in papers.leading_pages(pages, ["paper_key"]).collect()} == {(1, "a"), (2, "")}


def test_cache_runs_are_read_when_finished_only(spark, tmp_path):
    """A run that died is not read and is written anew; a finished one repeated adds nothing; compaction keeps one vector per key."""
    cache = vector_cache.VectorCache(spark, str(tmp_path / "cache"), "a/b c=1")
    rows = lambda *keys: spark.createDataFrame([(k, [float(len(k))]) for k in keys], "text_sha string, vec array<float>")
    real = cache._finish
    cache._finish = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        cache.append(rows("x", "half"), "run1")
    cache._finish = real
    assert cache.read().count() == 0 and cache.missing(spark.createDataFrame([("t",)], "text string")).count() == 1
    for _ in range(3):
        cache.append(rows("x", "y"), "run1")
    assert sorted(r.text_sha for r in cache._rows().collect()) == ["x", "y"]
    cache.append(rows("y", "zz"), "run2")
    cache.append(rows(), "run3")
    assert cache._rows().count() == 4 and cache.read().count() == 3
    cache.compact()
    assert sorted((r.text_sha, r.vec) for r in cache._rows().collect()) == [("x", [1.0]), ("y", [1.0]), ("zz", [2.0])]
    assert cache.runs().count() == 1
    cache.append(rows("new"))
    assert cache.read().count() == 4


def test_encoder_sees_a_batch_and_not_a_whole_partition(spark):
    """No more than one batch of texts is alive as Python strings while the model runs."""
    def load():
        import gc

        def encode(texts):
            held = sum(isinstance(x, list) and len(x) > 3 and all(isinstance(t, str) and t.startswith("long ") for t in x) for x in gc.get_objects())
            return [[float(len(texts)), float(held)] for _ in texts]
        return encode

    texts = spark.range(50).selectExpr("cast(id as string) as text_sha", "concat('long ', id) as text").coalesce(1)
    rows = vector_cache.embed(texts, load, 3).collect()
    assert len(rows) == 50 and {r.vec[1] for r in rows} == {0.0} and sorted(r.vec[0] for r in rows)[:2] == [2.0, 2.0]
