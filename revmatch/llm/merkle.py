"""Merkle manifest of a dataset with inclusion proofs found by pointer jumping.

A leaf is the hash of a document's columns. The leaves of a language, by rising ``doc_id``, make a binary tree; the trees'
subroots, by language, make the tree above them. ``H`` is the lowercase hex sha256 of its inputs one after another,
digests as hex text; a node without a sibling is hashed alone.

Every node holds a pointer to its parent and the segment of siblings on the way there. One self-join lets each node take
over the pointer and the segment of the node it points to, so the distance doubles: 1, 2, 4, ... until all leaves point past the
root and hold their whole proof. A pointer over ``d`` levels lands on a level that ``d`` divides, so only those inner nodes go
on; they are few after two rounds, and broadcast once a count shows it. A node is met by at most 2^d pointers, 65,536
up to ``d`` = 16. Leaves are never written in between: their chain of joins is one job.

Places in a language come from a range sort over many tasks and a table of where its runs start. Subtrees of 1,024
neighbours are hashed in one task each, ten levels a round.

Results: a null column enters a leaf as ``-``; a null ``doc_id`` stands before all others and is never tampered with;
rows alike in all columns are leaves of their own beside one another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmatch.llm.common import ID, TEXT, placed, written

#: Levels hashed in one round; a task's subtree has two to this power leaves.
STEPS = 10
#: Inner nodes that may be broadcast, each with a segment of at most 33 bytes a level.
FEW = 50_000
#: Documents whose tampering is tried: those whose crc32 of the id this divides.
TAMPERED = 7

_ENTRY = 33  # side of the sibling (0 left, 1 right, 2 none), then its digest
_NODE = ["tree", "level", "pos"]
_UP = ["up_tree", "up_level", "up_pos"]
_ABOVE = -1  # the tree over the subroots
_SCHEMA = "tree long, level int, pos long, digest binary, entry binary, size long, doc_id long, other binary, part long"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, digest`` and ``other``: the digest of the row tampered with, null where that is not tried."""
    columns = docs.select(F.col(ID).cast("long").alias(ID), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                          F.col("n_chars").cast("long").alias("n_chars"), F.col(TEXT).cast("string").alias(TEXT))

    def leaf(n_chars: Column) -> Column:
        fields = (F.col(ID), F.col("source"), F.col("lang"), n_chars, F.col(TEXT))
        return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))

    tried = F.crc32(F.col(ID).cast("string")) % TAMPERED == 0
    return columns.select(ID, "lang", leaf(F.col("n_chars")).alias("digest"),
                          F.when(tried, leaf(F.col("n_chars") + 1)).alias("other"))


def _subtrees(base: int, steps: int):
    """Hash the levels above a run of neighbours: every node with its sibling's entry, and the top node without one."""
    left, right, alone, width = b"\0", b"\1", b"\2" + bytes(32), 1 << steps

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        tree, size, at = table["tree"][0].as_py(), table["size"][0].as_py(), table["pos"][0].as_py() // width * width
        nodes, level = table["digest"].to_pylist(), base
        n = len(nodes)
        out: dict[str, list] = {"level": [], "pos": [], "digest": [], "entry": [], "size": []}

        def emit(entries: list) -> None:
            out["level"] += [level] * len(nodes)
            out["pos"] += range(at, at + len(nodes))
            out["digest"] += nodes
            out["entry"] += entries
            out["size"] += [size] * len(nodes)

        while level < base + steps and size > 1:
            emit([alone if k ^ 1 >= len(nodes) else (left if k & 1 else right) + nodes[k ^ 1] for k in range(len(nodes))])
            named = [h.hex() for h in nodes]
            nodes = [hashlib.sha256("".join(named[k:k + 2]).encode()).digest() for k in range(0, len(named), 2)]
            level, at, size = level + 1, at >> 1, (size + 1) >> 1
        emit([None] * len(nodes))
        more = len(out["pos"]) - n
        kept = {c: pa.concat_arrays([table[c].chunk(0) if table[c].num_chunks else pa.nulls(0, table.schema.field(c).type), pa.nulls(more, table.schema.field(c).type)])
                for c in ("doc_id", "other", "part")}
        return pa.table({
            "tree": pa.array([tree] * len(out["pos"]), pa.int64()), "level": pa.array(out["level"], pa.int32()), "pos": pa.array(out["pos"], pa.int64()),
            "digest": pa.array(out["digest"], pa.binary()), "entry": pa.array(out["entry"], pa.binary()), "size": pa.array(out["size"], pa.int64()), **kept})

    return build


def _forest(start: DataFrame, largest: int, steps: int) -> list[DataFrame]:
    """All nodes of trees whose lowest nodes are ``start``; a node without an entry is the top of its tree (``size`` 1)."""
    tables, base, now = [], 0, start
    while True:
        made = written(now.groupBy("tree", F.shiftright("pos", steps).alias("run")).applyInArrow(_subtrees(base, steps), _SCHEMA), "nodes")
        tables.append(made.filter("entry is not null or size = 1"))
        largest, base = -(-largest >> steps), base + steps
        if largest <= 1:
            return tables
        now = made.filter("entry is null and size > 1")


def _nodes(tables: list[DataFrame], top: Column, segment: Column) -> DataFrame:
    """Nodes with pointer and segment; ``top`` tells where the top node of a tree points, over no distance."""
    nodes = tables[0]
    for t in tables[1:]:
        nodes = nodes.unionByName(t)
    inner = F.col("entry").isNotNull()
    up = F.when(inner, F.struct(F.col("tree").alias("t"), (F.col("level") + 1).alias("l"), F.shiftright("pos", 1).alias("p"))).otherwise(top)
    return nodes.withColumn("up", up).select(*_NODE, "digest", segment.alias("seg"), F.col("up.t").alias("up_tree"), F.col("up.l").alias("up_level"),
                                            F.col("up.p").alias("up_pos"), "doc_id", "other", "part")


def _jump(rows: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Each row takes over the pointer and the segment of the node it points to; rows past the root stay as they are."""
    ahead = targets.select(*[F.col(c).alias(f"to_{c}") for c in _NODE], F.col("seg").alias("more"), *[F.col(c).alias(f"next_{c}") for c in _UP])
    met = [F.col(f"up_{c}") == F.col(f"to_{c}") for c in _NODE]
    joined = rows.join(F.broadcast(ahead) if few else ahead, met, "left")
    kept = [c for c in rows.columns if c not in (*_UP, "seg")]
    return joined.select(*kept, F.concat("seg", F.coalesce("more", F.lit(b""))).alias("seg"), *[F.col(f"next_{c}").alias(c) for c in _UP])


def proofs(docs: DataFrame, few: int = FEW, steps: int = STEPS) -> DataFrame | None:
    """``doc_id, tree, leaf, other, subroot, root, path``: the path holds an entry of 33 bytes for every level; None without rows."""
    spark = docs.sparkSession
    # the digests are written before the sort, whose sampling would otherwise read and hash every text once more
    rows, runs = placed(written(leaves(docs), "digests"), [ID, "digest"], "leaves", ["lang"])
    runs = written(runs, "runs")
    found, starts = placed(runs.groupBy("lang").agg(F.sum("rows").alias("n")), ["lang"], "trees")
    trees = written(found.join(starts.drop("rows"), "part").select("lang", "n", (F.col("at") - F.col("first") + F.col("before")).alias("tree")), "trees")
    facts = trees.agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("trees")).first()
    if not facts["trees"]:
        return None
    same = lambda a, b, *names: [a[c].eqNullSafe(b[c]) for c in names]
    starts = runs.join(trees, same(runs, trees, "lang")).select(runs["lang"], "part", "first", "before", "n", "tree")
    low = rows.join(starts, same(rows, starts, "lang", "part")).select(
        "tree", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "digest", F.col("n").alias("size"), ID, "other", rows["part"])
    lower = _forest(low, facts["largest"], steps)
    nothing = F.lit(None)
    subroots = _nodes(lower, nothing.cast("struct<t:long,l:int,p:long>"), F.col("entry")).filter("seg is null").select("tree", F.col("digest").alias("subroot"))
    upper = _forest(subroots.select(
        F.lit(_ABOVE).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"), F.lit(facts["trees"]).cast("long").alias("size"),
        nothing.cast("long").alias(ID), nothing.cast("binary").alias("other"), nothing.cast("long").alias("part")), facts["trees"], steps)
    segment = F.coalesce("entry", F.lit(b""))
    first_above = F.struct(F.lit(_ABOVE).cast("long").alias("t"), F.lit(0).alias("l"), F.col("tree").alias("p"))
    nodes = _nodes(lower, first_above, segment)
    above = _nodes(upper, nothing.cast("struct<t:long,l:int,p:long>"), segment).filter(f"tree = {_ABOVE}")
    root = above.filter("up_level is null").first()["digest"]

    way = nodes.filter("level = 0")
    inner = nodes.filter("level > 0").unionByName(above).drop("doc_id", "other", "part", "digest")
    levels = lambda n: max(0, math.ceil(math.log2(n)))
    length, distance = levels(facts["largest"]) + 1 + levels(facts["trees"]), 1
    while distance < length:
        small = inner.count() <= few
        if distance > 16:  # pointers so long land on few nodes, each met by many rows
            met = way.select(*[F.col(f"up_{c}").alias(c) for c in _NODE]).unionByName(inner.select(*[F.col(f"up_{c}").alias(c) for c in _NODE])).distinct()
            way, small = _jump(way, inner.join(met, _NODE, "left_semi"), True), False
        else:
            way = _jump(way, inner, small)
        distance *= 2
        if distance < length:
            inner = written(_jump(inner.filter(f"tree = {_ABOVE} or level % {distance} = 0"), inner, small), "jump")
    tops = starts.select("tree", "part").join(subroots, "tree")
    return way.join(tops, ["tree", "part"]).select(
        ID, "tree", F.col("digest").alias("leaf"), "other", "subroot", F.lit(root).alias("root"), F.col("seg").alias("path"))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def entries(path: Column) -> Column:
    """The entries of a path, from the leaf up."""
    count = (F.octet_length(path) / _ENTRY).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.substring(path, i * _ENTRY + 1, F.lit(_ENTRY)))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf (hex text) and the entries of its path."""
    def step(now: Column, entry: Column) -> Column:
        side, sibling = F.hex(F.substring(entry, 1, 1)), _hex(F.substring(entry, 2, 32))
        return F.sha2(F.when(side == "00", F.concat(sibling, now)).when(side == "01", F.concat(now, sibling)).otherwise(now), 256)
    return F.aggregate(steps, leaf, step)


def siblings_digest(steps: Column) -> Column:
    """H of the siblings of a path, nodes without one left out."""
    told = F.filter(steps, lambda e: F.hex(F.substring(e, 1, 1)) != "02")
    return F.sha2(F.array_join(F.transform(told, lambda e: _hex(F.substring(e, 2, 32))), ""), 256)


def verify(docs: DataFrame, few: int = FEW, steps: int = STEPS) -> DataFrame:
    """Leaf, subroot, root and digest of the proof of every row, and the root recomputed after tampering with some."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = proofs(docs, few, steps)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    told = found.select(ID, *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], _hex(F.coalesce("other", "leaf")).alias("tried"), entries(F.col("path")).alias("steps"))
    folded = told.select(ID, "leaf", "subroot", "root", siblings_digest(F.col("steps")).alias("proof_sha256"), fold(F.col("tried"), F.col("steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
