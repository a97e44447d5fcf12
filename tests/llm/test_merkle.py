"""Merkle manifest against plain hashing, and what tampering does to a proof."""

import hashlib
import zlib

from revmatch.llm import merkle
from revmatch.llm.common import table
from revmatch.llm.queries import SQL
from tests.check_oracle import connect
from tests.llm.helpers import awkward, nothing

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def plain_hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, more=0):
    values = (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])
    return plain_hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(low):
    """Per lowest node, the runs it stands in on the way up (nodes of the run, own place), and the top."""
    ways, level, owners = [[] for _ in low], list(low), [[k] for k in range(len(low))]
    while len(level) > 1:
        for run in range(0, len(level), 2):
            for place, node in enumerate(range(run, min(run + 2, len(level)))):
                for k in owners[node]:
                    ways[k].append((level[run:run + 2], place))
        owners = [sum(owners[k:k + 2], []) for k in range(0, len(level), 2)]
        level = [plain_hash(*level[k:k + 2]) for k in range(0, len(level), 2)]
    return ways, level[0]


def plain_manifest(rows):
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    langs = sorted({r["lang"] for r in rows}, key=key)
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (key(r["doc_id"]), plain_leaf(r)))
        trees.append((mine, *plain_tree([plain_leaf(r) for r in mine])))
    above, root = plain_tree([top for _, _, top in trees])
    out = []
    for (mine, ways, top), more in zip(trees, above):
        for r, way in zip(mine, ways):
            tried = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = plain_leaf(r, 1 if tried else 0)
            siblings = []
            for run, place in way + more:
                siblings += [h for k, h in enumerate(run) if k != place]
                now = plain_hash(*[now if k == place else h for k, h in enumerate(run)])
            out.append((r["doc_id"], plain_leaf(r), top, root, plain_hash(*siblings), now, now == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def many(spark, sizes):
    rows = [(7 * k % 1009 if k % 50 else None, f"text {k} ü" if k % 11 else None, lang, None if k % 13 == 0 else "s", None if k % 17 == 0 else k)
            for lang, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def test_trees_of_all_shapes(spark):
    docs = many(spark, {None: 1, "": 2, "a": 3, "b": 8, "é": 37, "z": 130, "Z": 5})
    want = plain_manifest(docs.collect())
    assert got(merkle.verify(docs, steps=2)) == want
    assert got(merkle.verify(docs, few=0, steps=3)) == want
    assert got(merkle.verify(docs.repartition(7))) == want


def test_many_languages(spark):
    docs = many(spark, {f"l{k}": 1 + k % 3 for k in range(90)})
    assert got(merkle.verify(docs, steps=2)) == plain_manifest(docs.collect())


def test_long_jump_lands_on_few_nodes(spark):
    """Paths of more than 32 steps: many trees of which one is deep."""
    docs = many(spark, {"deep": 300, **{f"l{k:05d}": 1 for k in range(70)}})
    real = merkle.math.log2
    try:
        merkle.math.log2 = lambda n: 20 if n > 1 else 0  # as if there were a million of each
        assert got(merkle.verify(docs)) == plain_manifest(docs.collect())
    finally:
        merkle.math.log2 = real


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = plain_manifest(docs.collect())
    assert got(merkle.verify(docs)) == want
    assert sorted((tuple(r) for r in connect(sf_dir).execute(f"select {', '.join(COLUMNS)} from ({SQL['op12_manifest']})").fetchall()), key=str) == want
    assert sum(not r[-1] for r in want) > 10 and sum(r[-1] for r in want) > 100


def test_tampering_is_seen(spark):
    """Exactly the rows tampered with do not verify; where n_chars is null nothing was changed."""
    rows = many(spark, {"a": 200, "b": 30}).collect()
    seen = {(r["doc_id"], r["leaf"]): r["verified"] for r in merkle.verify(many(spark, {"a": 200, "b": 30})).collect()}
    for r in rows:
        tried = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
        assert seen[r["doc_id"], plain_leaf(r)] is (not tried)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert got(merkle.verify(docs)) == plain_manifest(docs.collect())
    assert got(merkle.verify(nothing(docs))) == [] and merkle.verify(nothing(docs)).columns == COLUMNS
    long = spark.createDataFrame([(1, "é" * 3_000_000, "en", "s", 1)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert got(merkle.verify(long)) == plain_manifest(long.collect())
