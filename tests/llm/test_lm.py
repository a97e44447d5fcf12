import math
import zlib
from collections import Counter

import numpy as np
import pytest

from revmatch.llm import lm
from revmatch.llm.common import table
from tests.llm.helpers import awkward, nothing, words


def plain_model(docs, weights):
    """The same model with dictionaries."""
    one, two, tokens = Counter(), Counter(), {}
    for i, text in docs:
        w = [x.lower() for x in words(text)] + ["</s>"]
        tokens.setdefault((i, text), w)
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            one.update(w)
            one["<s>"] += 1
            two.update(zip(["<s>", *w], w))
    begins = one.pop("<s>", 0)
    n, v = sum(one.values()), len(one)
    one["<s>"] = begins
    out = {}
    for key, w in tokens.items():
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            mix = weights[min(int(math.log2(one[a] + 1)), lm.BUCKETS - 1)]
            score += math.log10(mix[0] * (two[a, b] / one[a] if one[a] else 0) + mix[1] * one[b] / max(n, 1) + mix[2] / (v + 1))
        out[key] = (len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out


@pytest.fixture
def weights(monkeypatch):
    kept, learn = {}, lm.learn

    def keep(*args, **more):
        kept["w"] = learn(*args, **more)
        return kept["w"]

    monkeypatch.setattr(lm, "learn", keep)
    return kept


def agree(docs, got, weights):
    want = plain_model(docs, weights["w"])
    by_key = {}
    for r in got:
        by_key.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(docs)
    for (i, text), (n_tokens, known, n, base, score) in want.items():
        assert any(r["n_tokens"] == n_tokens and r["n_known"] == known and r["train_tokens"] == n and math.isclose(r["base_score"], base, rel_tol=1e-9)
                   and math.isclose(r["score"], score, rel_tol=1e-9) for r in by_key[i]), (i, text and text[:40])
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2)


def test_whole_table_against_dictionaries(spark, sf_dir, weights):
    docs = table(spark, sf_dir, "documents")
    got = lm.score(docs).collect()
    agree([(r["doc_id"], r["text"]) for r in docs.collect()], got, weights)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_many_batches_and_ranges(spark, sf_dir, weights, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(60)
    whole = sorted((r["doc_id"], r["score"]) for r in lm.score(docs).collect())
    monkeypatch.setattr("revmatch.llm.batches.RANGE", 5000)
    many = sorted((r["doc_id"], r["score"]) for r in lm.score(docs.repartition(7)).collect())
    assert np.allclose([x[1] for x in whole], [x[1] for x in many], rtol=1e-9)


def test_awkward_rows(spark, weights):
    docs = awkward(spark)
    agree([(r["doc_id"], r["text"]) for r in docs.collect()], lm.score(docs).collect(), weights)
    assert lm.score(nothing(docs)).collect() == []


def test_em_prefers_the_likelier_component():
    good = (0 * lm.CELLS + lm.CELLS // 2 + 40) * lm.CELLS + lm.CELLS // 2  # the bigram is 1,000 times likelier than the rest
    w = lm.learn(np.array([good + 5 * lm.CELLS * lm.CELLS]), np.array([100.0]))
    assert w[5, 0] > 0.95 and np.allclose(w.sum(1), 1)
