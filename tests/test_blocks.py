"""Term blocks against plain counting: vocabulary, weights and packed rows, for any cutting into blocks and buckets."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from revmatch.functions import text
from revmatch.operators import blocks, tfidf
from revmatch.schemas import PAPER, ROUND
from tests.test_pipelines import STOP, fixture, grams  # noqa: F401


def tables(spark, texts):
    df = spark.createDataFrame(texts, "round_id string, paper bigint, text string").repartition(3)
    side = blocks.gather(df, "text", STOP)
    pools = tfidf.pool_sizes(df)
    numbered = tfidf.number_terms(tfidf.vocabulary(blocks.counts(side, 2), pools).withColumn("shared", F.length("term") % 2 == 0))
    vocab = tfidf.with_term_ids(numbered, tfidf.range_starts(numbered))
    return side, vocab, blocks.answers(side, vocab)


def plain(texts):
    """Weights of every text in the vocabulary of its round, and lengths of what stands under one id."""
    sizes, df = Counter(r for r, _, _ in texts), Counter()
    for r, _, t in texts:
        df.update((r, term) for term in grams(t))
    idf = {k: math.log((1 + sizes[k[0]]) / (1 + n)) + 1 for k, n in df.items() if 2 <= n <= 0.3 * sizes[k[0]]}
    found = defaultdict(list)
    for r, p, t in texts:
        found[r, p] += [(term, (1 + math.log(n)) * idf[r, term]) for term, n in grams(t).items() if (r, term) in idf]
    return idf, {k: (math.sqrt(sum(w * w for _, w in v)), sorted(v)) for k, v in found.items() if v}


@pytest.mark.parametrize("words, terms", [(1 << 20, 1 << 19), (20, 30)])
@pytest.mark.parametrize("twice", [False, True])
def test_blocks_give_the_plain_weights(spark, fixture, monkeypatch, words, terms, twice):  # noqa: F811
    monkeypatch.setattr(blocks, "BLOCK_WORDS", words)
    monkeypatch.setattr(blocks, "BUCKET_TERMS", terms)
    texts = [(r, p, f"{t}. {a}") for r, p, t, a, _ in fixture[0]] + [("empty", 1000, ""), ("big", 1001, "")]
    if twice:
        texts += [("big", 1, "alpha beta gamma delta"), ("big", None, "sigma tau"), ("big", None, "alpha tau tau")]
    side, vocab, answered = tables(spark, texts)
    idf, want = plain(texts)
    assert (side.repeated is not None) == twice and (side.blocks.count() > 20) == (words == 20)
    assert {(v.round_id, v.term): v.idf for v in vocab.collect()} == pytest.approx(idf)
    rows = blocks.weights(side, answered).collect()
    got = defaultdict(list)
    for x in rows:
        got[x[ROUND], x[PAPER]].append((x.term, x.w))
    assert set(got) == set(want)
    for k, (norm, v) in want.items():
        assert [t for t, _ in sorted(got[k])] == [t for t, _ in v]
        assert [w for _, w in sorted(got[k])] == pytest.approx([w / norm for _, w in v], abs=1e-9)
    ids = {(v.round_id, v.term): v.term_id for v in vocab.filter("shared").collect()}
    packed = blocks.packed(side, answered).collect()
    assert len(packed) == len(want)
    for x in packed:
        norm, v = want[x[ROUND], x[PAPER]]
        mine = sorted((ids[x[ROUND], t], w) for t, w in v if (x[ROUND], t) in ids)
        assert x.norm == pytest.approx(norm, abs=1e-9) and x.ids == [i for i, _ in mine] and x.ws == pytest.approx([w for _, w in mine])


def test_a_blocks_distinct_terms_travel_once(spark):
    """400 copies of a text ask for the terms of one."""
    one, many = (blocks.gather(spark.createDataFrame([("r", k, "alpha beta gamma") for k in range(n)], "round_id string, paper bigint, text string").coalesce(1), "text", STOP)
                 for n in (1, 400))
    assert one.messages.count() == many.messages.count() <= 5
    assert {(r.term, r.df) for r in blocks.counts(many, 2).collect()} == {(t, 400) for t in ("alpha", "beta", "gamma", "alpha beta", "beta gamma")}


def test_words_cut_by_bytes_are_the_tokens(spark):
    """Neighbours of a word beyond ASCII, broken words, capitals that become ASCII, texts side by side, null and empty ones."""
    odd = ["Alpha beta-\ngamma\ndelta", "café naïve 中word word٣ —dash— it’s", "KELVIN Kelvin İstanbul straße STRASSE", "a bb c1c d_d e9 the ffoo9",
           "x", "", None, "open", "end́  space \U0001d400bold \U0001f600face abª ²two", "tail-\n", "the and of", "ü", "near\U0001d400 \U00020000 two"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, text string").coalesce(1)
    stop = ["the", "and", "of"]
    want = {r.k: r.w for r in df.select("k", text.drop_stop_words(text.tokens(F.col("text")), stop).alias("w")).collect()}
    rows = df.select("k", F.concat(text.word_text(F.col("text")), F.lit("\n")).alias("t")).toArrow()
    for part in (rows, rows.slice(3, 6)):
        got = dict(zip(part["k"].to_pylist(), blocks._words(stop)(part["t"].combine_chunks()).to_pylist()))
        assert got == {k: want[k] or [] for k in got} and len(got) == part.num_rows


def test_vocabulary_meets_its_messages_without_text(spark):
    """What the vocabulary sends back to the buckets are numbers: a term's text travels with its block and its row only."""
    side = blocks.gather(spark.createDataFrame([("r", k, "alpha beta gamma") for k in range(8)], "round_id string, paper bigint, text string"), "text", STOP)
    rows = blocks.counts(side, 2).collect()
    assert len({(r.bucket, r.spot) for r in rows}) == len(rows) == 5
    vocab = spark.createDataFrame([(r.round_id, r.bucket, r.spot, 1.0, True, k) for k, r in enumerate(rows)],
                                  "round_id string, bucket int, spot int, idf double, shared boolean, term_id long")
    assert {tuple(x.ids) for x in blocks.packed(side, blocks.answers(side, vocab)).collect()} == {(0, 1, 2, 3, 4)}
