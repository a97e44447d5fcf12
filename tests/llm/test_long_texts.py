"""Texts of millions of characters through every operator that reads whole texts."""

import zlib

import numpy as np
import pytest

from revmatch.llm import counts, decontaminate, extract, lm, merkle, packing, passages, pii, quality, simhash, toxicity
from revmatch.llm.tokens import encoder, vocabulary_path

N = 1_000_000
RUNS = {
    "spaces": " " * N, "lines inside": "x" + "\n" * N + "y", "tabs": "a b" + "\t" * 100_000 + " c", "three million": "word" + " " * 3 * N + "word",
    "mixed": "one" + " \n\t" * 40_000 + "two <|endoftext|>" + "\n " * 30_000 + "!", "wide": "é" + "　" * 20_000 + " é",
    "end": "last words" + "\n" * 150_000, "separators": "a" + "\x1c" * 12_000 + "b"}


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", RUNS)
def test_ids_of_long_white_space(plain, name):
    got = np.frombuffer(encoder(vocabulary_path()).ids(RUNS[name]), "<u4")
    assert got.tolist() == plain.encode(RUNS[name], add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(3000)]
    long = " ".join(words[k] for k in rng.integers(0, 3000, N))  # 5 MB
    rows = [(1, long), (2, "start" + " " * N + "end"), (3, "x" * N), (4, "line of some words\n" * 60_000), (5, "a short text"), (6, "\n" * N)]
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("work, rows", [
    (lm.score, 6), (pii.find, 6), (simhash.digest, 6), (quality.digest, 6), (merkle.verify, 6), (passages.digest, None), (counts.recount, 6)])
def test_whole_texts(docs, work, rows):
    found = work(docs).collect()
    assert rows is None or len(found) == rows


def test_packing_of_long_texts(docs, plain):
    got = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packing.pack(docs).collect())
    for r in docs.collect():
        ids = np.array(plain.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        mine = [p for p in got if p[0] == r["doc_id"]]
        assert sum(p[2] for p in mine) == len(ids) and {p[4] for p in mine} == {len(ids)}
        for _, start, length, crc, _ in mine[:200]:
            assert zlib.crc32(ids[start:start + length].tobytes()) == crc


def test_other_operators_on_long_texts(spark, docs):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.scores(docs, labels).count() == 6
    items = spark.createDataFrame([(1, "What is the capital of a land with 12 towns and 3 rivers near it?")], "item_id long, text string")
    decontaminate.find(docs, items).collect()
    page = "<html><body><article><p>" + "long paragraph of words " * 40_000 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert extract.extract(pages).first()["n_chars"] == len("long paragraph of words " * 40_000) - 1
