"""Packing of documents into fixed-length sequences: first-fit decreasing with a tournament tree.

A document is its ids and an end id. Whole windows of ``length`` ids become sequences of their own; what is left of each
document is dealt into random groups of about ``GROUP`` pieces, and inside a group pieces go, longest first, into the
first sequence with room, found in a tree whose nodes hold the largest free space below them. A sixteenth of the
documents have their rest cut into powers of two, which fill the gaps that the others leave; a sequence that ends at a
power of two is not padded. Groups take pieces of numbers only, never texts.

Cases: null and empty texts are one end id; equal rows are packed one by one; an empty table gives an empty result; a
null id stays null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.llm.common import ID, texts, written
from revmatch.llm.text import blocks, buffer, mix
from revmatch.llm.tokens import encoder, vocabulary_path

LENGTH, GROUP, CUT_EVERY = 1024, 20000, 16
_PIECE = f"{ID} long, start long, length long, ids_crc32 long, doc_tokens long"
_ORDER = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def piece_lengths(total: int, length: int, cut: bool) -> list[int]:
    whole, rest = divmod(total, length)
    out = [length] * whole
    if cut:
        out += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    elif rest:
        out.append(rest)
    return out


def _cut(path: str, length: int, with_ids: bool):
    """Pieces of each text; a piece that fills a sequence has its ``sequence_id`` already, the others a random ``salt``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path).ids, TaskContext.get().partitionId()
        row = made = 0
        for part in _parts(batches):
            rows: list[tuple] = []
            ids_of: list[bytes] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encode(text) + b"\0\0\0\0"
                total, at = len(ids) // 4, 0
                salt = int(mix(np.array([(task << 36) + row], np.uint64))[0] >> np.uint64(2))
                row += 1
                for n in piece_lengths(total, length, salt % CUT_EVERY == 0):
                    piece = ids[4 * at:4 * (at + n)]
                    own = None
                    if n == length:
                        own, made = (1 << 62) + (task << 40) + made, made + 1
                    rows.append((doc, at, n, zlib.crc32(piece), total, own, salt))
                    if with_ids:
                        ids_of.append(piece)
                    at += n
            yield _batch(rows, ids_of if with_ids else None)

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``BLOCK`` bytes of text, so that few texts and ids are Python objects at a time."""
    for b in batches:
        for i, j in blocks(buffer(b.column(1))[1]):
            yield b.slice(i, j - i)


def _batch(rows: list[tuple], ids: list[bytes] | None) -> pa.RecordBatch:
    names = [ID, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "salt"]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    if ids is not None:
        names, columns = [*names, "ids"], [*columns, pa.array(ids, pa.binary())]
    return pa.record_batch(columns, names=names)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the given order, by first fit. ``free`` is a tournament: node k's children are
    2k and 2k+1, each node holds the largest free space of the bins below it."""
    leaves = 1 << max(len(lengths) - 1, 0).bit_length()
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= n
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def _pack(length: int):
    def run(group: pa.Table) -> pa.Table:
        number = group.column("group")[0].as_py()
        size = group.column("length").to_numpy()
        order = np.lexsort((group.column("ids_crc32").to_numpy(), group.column("start").to_numpy(), group.column("salt").to_numpy(), -size))
        group = group.take(pa.array(order))
        bins, offsets = first_fit(size[order].tolist(), length)
        group = group.drop_columns(["group", "salt", "sequence_id"])
        return group.append_column("sequence_id", pa.array((number << 32) + np.array(bins, np.int64))).append_column("offset", pa.array(np.array(offsets, np.int64)))

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from, its checksum (and its ``ids`` if wanted), and its place."""
    more = ", ids binary" if with_ids else ""
    pieces = written(texts(docs).mapInArrow(_cut(path or vocabulary_path(), length, with_ids), f"{_PIECE}, sequence_id long, salt long{more}"), "pieces")
    rest = pieces.filter("sequence_id is null")
    groups = max(1, -(-rest.count() // group))
    names = [*_ORDER, *(["ids"] if with_ids else [])]
    packed = (rest.withColumn("group", F.pmod(F.xxhash64("salt"), F.lit(groups))).groupBy("group")
              .applyInArrow(_pack(length), f"{_PIECE}{more}, sequence_id long, offset long"))
    return pieces.filter("sequence_id is not null").withColumn("offset", F.lit(0).cast("long")).select(*names).unionByName(packed.select(*names))
