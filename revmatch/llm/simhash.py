"""Near-duplicate groups by SimHash fingerprints and pivot distance tables.

Every text becomes a 64-bit fingerprint; equal fingerprints are one entry from there on. Two fingerprints that differ
in at most ``distance`` bits agree in at least ``blocks - distance`` of ``blocks`` bit blocks, so hash partitioning by each
choice of that many blocks brings every such pair together. Inside a partition each fingerprint has a row of
Hamming distances to fixed reference fingerprints (the pivot table); a pair whose rows differ anywhere by more than
``distance`` cannot be close and is discarded, the rest are verified bit by bit. Only a spanning forest of the verified
links leaves a task. A key with more than ``LIMIT`` fingerprints is not compared: its members go on to the next, finer
level, and at the last level a key fixes 52 of 64 bits and so holds 4,096 fingerprints at most.

Cases: null and empty texts have fingerprint zero and link like any other; a null id takes part but names a group
only if the group has no other id; equal rows are in one group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.llm.common import ID, TEXT, components, texts, written
from revmatch.llm.text import LOWER, mix, text_bytes

LIMIT, PIVOTS = 1024, 24
#: (blocks, blocks that must agree) of each level, for 3 differing bits.
LEVELS = ((5, 2), (8, 5), (16, 13))
REFERENCES = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    words = text.translate(LOWER.tobytes()).split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    hashes = np.array([digest(joined[s:e], seed) for s, e in spans], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k:k + 8192].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``row_key`` (a hash of id and text) and ``fp``, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in text_bytes(b.column(2))], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=[ID, "row_key", "fp"])

    return texts(docs).select(ID, row_key().alias("row_key"), TEXT).mapInArrow(run, f"{ID} long, row_key long, fp long")


def row_key():
    return F.xxhash64(F.col(ID).cast("long"), F.coalesce(F.col(TEXT).cast("string"), F.lit("")))


def masks(blocks: int, keep: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    block = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(block, keep)]


def close_pairs(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links between rows of equal key; rows are sorted by key."""
    table = np.bitwise_count(fp[:, None] ^ REFERENCES[None]).astype(np.int8)
    label, lag, at = np.arange(len(fp)), 1, np.arange(len(fp))
    left, right, waiting = [], [], 0
    while True:
        at = at[at + lag < len(fp)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        near = at
        for p in range(PIVOTS):
            near = near[np.abs(table[near, p] - table[near + lag, p]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= distance]
        near = near[label[near] != label[near + lag]]
        if len(near):
            left.append(near), right.append(near + lag)
            waiting += len(near)
        if waiting > 1 << 16:
            label, left, right, waiting = merge(label, left, right), [], [], 0
        lag += 1
    if waiting:
        label = merge(label, left, right)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return moved, label[moved]


def merge(label: np.ndarray, left: list, right: list) -> np.ndarray:
    """Labels after joining ``left`` and ``right`` indices; a label is the smallest index of its group."""
    i, j = np.concatenate(left), np.concatenate(right)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (jumped := new[new] != new).any():
            new = np.where(jumped, new[new], new)
        if (new == label).all():
            return label
        label = new


def _compare(distance: int, limit: int):
    """Over rows (table, key, fp) that are sorted by table and key: links ``(a, b)``, or ``(a, null)`` for members of keys too large."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last key's rows so far
        over = None  # a key known to be too large

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal over
            if not len(rows):
                return
            change = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
            size = np.diff(np.append(change, len(rows)))
            group = np.repeat(np.arange(len(change)), size)
            big = np.repeat(size > limit, size)
            if over is not None:
                big |= (rows[:, 0] == over[0]) & (rows[:, 1] == over[1])
            small = ~big & np.repeat(size > 1, size)
            fp = rows[small, 2]
            i, j = close_pairs(group[small], fp.view(np.uint64), distance)
            yield pa.record_batch([pa.array(fp[i]), pa.array(fp[j])], schema=schema)
            if big.any():
                yield pa.record_batch([pa.array(rows[big, 2]), pa.nulls(int(big.sum()), pa.int64())], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([np.asarray(c, np.int64) for c in b.columns], 1)
            held.append(rows)
            rows = np.concatenate(held)
            tail = (rows[:, :2] == rows[-1, :2]).all(1)
            yield from flush(rows[~tail])
            rest = rows[tail]
            if len(rest) > limit:
                over = tuple(rest[0, :2])
                yield from flush(rest)
                rest = rest[:0]
            held = [rest]
        if held:
            yield from flush(np.concatenate(held))

    return run


def links(fps: DataFrame, distance: int = 3, limit: int = LIMIT, levels=LEVELS) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``fps(fp)``: enough of them to keep every component whole."""
    found, todo = None, fps.select("fp")
    for n, (blocks, keep) in enumerate(levels):
        if blocks - keep != distance:
            raise ValueError("a level must leave as many blocks open as bits may differ")
        keys = todo.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks, keep)])).alias("table", "key"))
        cap = limit if n + 1 < len(levels) else 1 << 62
        run = (keys.select(F.col("table").cast("long").alias("table"), "key", "fp").repartition("table", "key")
               .sortWithinPartitions("table", "key").mapInArrow(_compare(distance, cap), "a long, b long"))
        out = written(run, f"simhash-{n}")
        sure = out.filter("b is not null")
        found = sure if found is None else found.unionByName(sure)
        todo = out.filter("b is null").select(F.col("a").alias("fp")).distinct()
        if n + 1 < len(levels) and todo.isEmpty():
            break
    return found


def groups(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id``, ``row_key``, ``fp``, ``root`` (smallest fingerprint of the group) and ``component_id`` of every row."""
    rows = written(fingerprints(docs, size), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min(ID).alias("low")), "distinct-fingerprints")
    roots = components(links(fps, distance)).withColumnRenamed("node", "fp")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(named.join(lowest, "root").select("fp", "root", "component_id"), "fingerprint-groups")
    return rows.join(named, "fp").select(ID, "row_key", "fp", "root", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select(ID, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without the copies: of each group the row with the smallest id stays (one row, if it is repeated)."""
    kept = groups(docs).filter(F.col(ID).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row_key").alias("__row_key"))
    out = docs.withColumn("__row_key", row_key()).join(kept.select("__row_key"), "__row_key", "left_semi")
    return out.dropDuplicates(["__row_key"]).select(*docs.columns)
