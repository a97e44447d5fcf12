"""Term weights of many texts without a row per term.

Texts of a round are gathered into blocks of about a million words. A block's distinct terms travel once, packed, to the
bucket their hash names; there they are counted, and from there what the vocabulary knows of them comes back. Counting inside
texts and weighting run in the block, so neither a text's terms nor their weights are shuffled as rows. A block and a
bucket are bounded by their terms; a very frequent term is one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmatch.functions.text import word_text
from revmatch.schemas import PAPER, ROUND
from revmatch.session import materialize

BLOCK_WORDS = 1 << 20
BUCKET_TERMS = 1 << 21


@dataclass(frozen=True)
class TermBlocks:
    blocks: DataFrame    # round_id, block, papers, and packed: words of the block, texts' lengths, codes of their words
    messages: DataFrame  # round_id, block, bucket, and packed: the block's distinct terms of the bucket, texts that hold them
    buckets: int
    count: int           # of blocks
    repeated: DataFrame | None  # round_id, paper of texts that share them; None where every text has its own


def _packing() -> SimpleNamespace:
    """Arrays as compressed bytes; local functions, so tasks need no import."""

    def pack(values: np.ndarray) -> bytes:
        raw = values.tobytes()
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    def unpack(data: bytes, kind) -> np.ndarray:
        size = int.from_bytes(data[:8], "little")
        return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), kind)

    def pack_texts(texts: pa.Array) -> dict[str, bytes]:
        """A string array without nulls as its letters and lengths."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        return {"letters": pack(letters), "lengths": pack(np.diff(offsets))}

    def unpack_texts(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
        """The texts of all rows in one array, and where each row's start."""
        letters = [unpack(x, np.uint8) for x in rows["letters"].to_pylist()]
        lengths = [unpack(x, np.int32) for x in rows["lengths"].to_pylist()]
        none = np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lengths])]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([none, *lengths]), dtype=np.int64)])
        joined = np.concatenate([none.astype(np.uint8), *letters])
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(joined.tobytes()))
        return texts, starts

    return SimpleNamespace(pack=pack, unpack=unpack, pack_texts=pack_texts, unpack_texts=unpack_texts)


def _block_terms(buckets: int):
    """Terms of a block: distinct unigrams and bigrams in the order of bucket and words, and ``(text, term, count)`` sorted by text."""
    tools = _packing()

    def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct values, rising, and which of them each value is; value and place are sorted as one number where they fit."""
        bits = max(len(values) - 1, 1).bit_length()
        if not len(values) or int(values.max()) >> (63 - bits):
            return np.unique(values, return_inverse=True)
        both = np.sort(values << bits | np.arange(len(values)))
        rising, which = both >> bits, np.empty(len(values), np.int64)
        new = np.append(True, rising[1:] != rising[:-1])
        which[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
        return rising[new], which

    def hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A hash of each word, and 0 behind the last."""
        starts = np.cumsum(lengths) - lengths
        powers = np.cumprod(np.full(lengths.max(initial=0), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(starts, lengths)], starts) if len(starts) else np.zeros(0, np.uint64)
        return np.append((sums ^ (sums >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), np.uint64(0))

    def terms_of(block: dict):
        words, _ = tools.unpack_texts(pa.table({c: [block[c]] for c in ("letters", "lengths")}))
        sizes, codes = tools.unpack(block["sizes"], np.int32), tools.unpack(block["codes"], np.int32).astype(np.int64)
        text, width = np.repeat(np.arange(len(sizes)), sizes), max(len(words), 1)
        inside = np.flatnonzero(text[1:] == text[:-1])
        # every word of the block is a term, then every bigram
        pairs, pair = distinct(codes[inside] * width + codes[inside + 1])
        one, two = np.concatenate([np.arange(len(words)), pairs // width]), np.concatenate([np.full(len(words), -1), pairs % width])
        term = np.concatenate([codes, len(words) + pair])
        digests = hashes(tools.unpack(block["letters"], np.uint8).astype(np.uint64), tools.unpack(block["lengths"], np.int32).astype(np.int64))
        mixed = digests[one] * np.uint64(0x9E3779B97F4A7C15) + (digests[two] ^ (digests[two] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = (((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        found, counts = np.unique(np.concatenate([text, text[inside]]) * max(len(one), 1) + place[term], return_counts=True)

        def named() -> pa.Array:
            first, second = words.take(pa.array(one[order])), words.take(pa.array(np.maximum(two[order], 0)))
            both = pc.binary_join_element_wise(first, second, pa.scalar(" ", pa.large_string()))
            return pc.if_else(pa.array(two[order] < 0), first, both).cast(pa.string())

        return named, bucket[order], found // max(len(one), 1), found % max(len(one), 1), counts

    return terms_of


def _words(stop: list[str]):
    """Words of texts made by ``word_text``, each with a line end behind it, without stop words; a local function, so tasks need no import."""
    kinds = np.zeros(256, np.uint8)
    for letters, kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", 2)):
        kinds[list(letters)] = kind

    def words_of(texts: pa.Array) -> pa.ListArray:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        kind = kinds[letters]
        edges = np.flatnonzero(np.diff((kind > 0).view(np.int8), prepend=np.int8(0)))
        start, end = edges[::2], edges[1::2]
        good = end - start > 1
        good[np.searchsorted(start, np.flatnonzero(kind == 2), "right") - 1] = False
        start, end = start[good], end[good]
        inside = np.zeros(len(letters) + 1, np.int8)
        inside[start], inside[end] = 1, -1
        spans = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(spans), pa.py_buffer(letters[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]))
        kept = ~pc.is_in(words, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(kept)])[np.searchsorted(start, offsets - offsets[0])] if len(texts) else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.filter(pa.array(kept)))

    return words_of


def gather(texts: DataFrame, text: str, stop: Sequence[str]) -> TermBlocks:
    """Blocks of the texts (round_id, paper, text) and what they ask the buckets; both written."""
    cleaned = texts.filter(F.col(ROUND).isNotNull()).select(ROUND, PAPER, F.concat(word_text(F.col(text)), F.lit("\n")).alias("text"))
    kind = cleaned.schema[PAPER].dataType.simpleString()
    room, tools, words_of, names = BLOCK_WORDS, _packing(), _words(list(stop)), (ROUND, PAPER)

    def lengths_of(rows: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in rows["words"].chunks)]).astype(np.int32)

    def block(number: int, value: str, rows: pa.Table) -> pa.RecordBatch:
        coded = pa.concat_arrays([c.flatten() for c in rows["words"].chunks] or [pa.array([], pa.string())]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        papers = rows[names[1]].to_pylist()
        return pa.RecordBatch.from_arrays([
            pa.array([value], pa.string()), pa.array([number], pa.int64()), pa.array([papers], pa.list_(rows.schema.field(names[1]).type)), pa.array([len(codes)], pa.int64()),
            *(pa.array([x], pa.binary()) for x in (*tools.pack_texts(coded.dictionary).values(), tools.pack(lengths_of(rows)), tools.pack(codes)))],
            [names[0], "block", "papers", "n_words", "letters", "lengths", "sizes", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 33, {}
        for batch in batches:
            for value in pc.unique(batch.column(0)).to_pylist():
                some = batch.filter(pc.equal(batch.column(0), value))
                more = pa.table({names[0]: some.column(0), names[1]: some.column(1), "words": words_of(some.column(2))})
                held = pa.concat_tables([waiting[value], more]) if value in waiting else more
                ends = np.cumsum(lengths_of(held), dtype=np.int64)
                start = 0
                while start < len(ends) and ends[-1] - (ends[start - 1] if start else 0) >= room:
                    end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + room)) + 1
                    yield block(number, value, held.slice(start, end - start))
                    number, start = number + 1, end
                waiting[value] = held.slice(start)
        for value, held in waiting.items():
            if held.num_rows:
                yield block(number, value, held)
                number += 1

    schema = f"{ROUND} string, block long, papers array<{kind}>, n_words long, letters binary, lengths binary, sizes binary, codes binary"
    blocks = materialize(cleaned.mapInArrow(run, schema), "blocks")
    total, count = blocks.agg(F.sum("n_words"), F.count("*")).first()
    buckets = max(16, -(-2 * (total or 0) // BUCKET_TERMS))
    terms_of = _block_terms(buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                named, bucket, _, term, _ = terms_of(row)
                terms, holders = named(), np.bincount(term, minlength=len(bucket)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = [{names[0]: row[names[0]], "block": row["block"], "bucket": int(bucket[a]), **tools.pack_texts(terms.slice(a, b - a)), "holders": tools.pack(holders[a:b])}
                         for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
                if parts:
                    yield pa.RecordBatch.from_pylist(parts, pa.schema([(names[0], pa.string()), ("block", pa.int64()), ("bucket", pa.int32()),
                                                                       ("letters", pa.binary()), ("lengths", pa.binary()), ("holders", pa.binary())]))

    # blocks are dealt evenly: they are few and heavy, and a file may hold many
    asked = blocks.select(ROUND, "block", "letters", "lengths", "sizes", "codes").repartition(_tasks(blocks, count), "block").mapInArrow(
        ask, f"{ROUND} string, block long, bucket int, letters binary, lengths binary, holders binary")
    twice = blocks.select(ROUND, F.explode("papers").alias(PAPER)).groupBy(ROUND, PAPER).agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = materialize(twice.drop("_n"), "repeated")
    return TermBlocks(blocks, materialize(asked, "asked"), buckets, count, None if repeated.isEmpty() else repeated)


def _tasks(df: DataFrame, groups: int) -> int:
    """Tasks for so many groups of bounded size, between one and 16 times the shuffle partitions; stated, so that small bytes are not merged."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(groups, 16 * partitions))


def counts(side: TermBlocks, min_df: int) -> DataFrame:
    """In how many texts of the round each term stands: ``round_id, term, df, bucket, spot``, terms in fewer than ``min_df`` left out.

    ``spot`` is the term's place among the bucket's terms in the order of the blocks; by it, not by its text, the vocabulary finds back to it.
    """
    tools, name = _packing(), ROUND

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        coded = tools.unpack_texts(rows)[0].dictionary_encode()
        holders = np.concatenate([tools.unpack(x, np.int32) for x in rows["holders"].to_pylist()])
        df = np.bincount(coded.indices.to_numpy(zero_copy_only=False), holders, len(coded.dictionary)).astype(np.int64)
        kept = np.flatnonzero(df >= min_df)
        return pa.table({name: pa.array([rows[name][0].as_py()] * len(kept), pa.string()), "term": coded.dictionary.take(pa.array(kept)).cast(pa.string()),
                         "df": df[kept], "bucket": pa.array(np.full(len(kept), rows["bucket"][0].as_py(), np.int32)), "spot": pa.array(kept.astype(np.int32))})

    key = [ROUND, "bucket"]
    return side.messages.repartition(_tasks(side.messages, side.buckets), *key).groupBy(*key).applyInArrow(
        count, f"{ROUND} string, term string, df long, bucket int, spot int")


def answers(side: TermBlocks, vocab: DataFrame) -> DataFrame:
    """What the vocabulary (round_id, bucket, spot, idf, shared, term_id) knows of the terms of each message, in their order."""
    tools, name, key = _packing(), ROUND, [ROUND, "bucket"]

    def answer(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        terms, starts = tools.unpack_texts(rows)
        coded, spot = terms.dictionary_encode(), known["spot"].to_numpy()
        at, idf, ids = coded.indices.to_numpy(zero_copy_only=False), np.zeros(len(coded.dictionary)), np.full(len(coded.dictionary), -1)
        idf[spot], ids[spot] = known["idf"].to_numpy(), np.where(known["shared"].to_numpy(), known["term_id"].to_numpy(), -1)
        idf, ids = idf[at], ids[at]
        cuts = list(zip(starts[:-1], starts[1:]))
        return pa.table({name: rows[name], "block": rows["block"], "bucket": rows["bucket"],
                         "idf": pa.array([tools.pack(idf[a:b]) for a, b in cuts], pa.binary()), "ids": pa.array([tools.pack(ids[a:b]) for a, b in cuts], pa.binary())})

    n = _tasks(vocab, side.buckets)
    known = vocab.select(*key, "spot", "idf", "shared", "term_id").repartition(n, *key).groupBy(*key)
    return side.messages.drop("holders").repartition(n, *key).groupBy(*key).cogroup(known).applyInArrow(
        answer, f"{ROUND} string, block long, bucket int, idf binary, ids binary")


def _filled(side: TermBlocks, answered: DataFrame, emit, schema: str) -> DataFrame:
    """Every block with its answers: ``emit(papers, named, text, term, weight, ids, squares)`` makes its rows."""
    tools, terms_of, name, key = _packing(), _block_terms(side.buckets), ROUND, [ROUND, "block"]

    def fill(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        parts = []
        for row in blocks.to_pylist():  # one
            named, _, text, term, count = terms_of(row)
            replies = replies.sort_by("bucket")
            idf, ids = (np.concatenate([np.zeros(0, kind), *(tools.unpack(x, kind) for x in replies[c].to_pylist())]) for c, kind in (("idf", np.float64), ("ids", np.int64)))
            kept = np.flatnonzero(idf[term] > 0)
            text, term, count = text[kept], term[kept], count[kept]
            weight = (1 + np.log(np.arange(1, count.max(initial=0) + 1, dtype=np.float64)))[count - 1] * idf[term]
            # squares are added as integers, as everywhere
            sums = np.concatenate([[0], np.cumsum(np.floor(weight * weight * 1e10 + 0.5).astype(np.int64))])
            first = np.flatnonzero(np.diff(text, prepend=-1))
            rows, ends = text[first], np.append(first[1:], len(text))[:len(first)]
            table = emit(named, rows, first, ends, term, weight, ids[term])
            papers = blocks["papers"].combine_chunks().flatten().take(pa.array(rows))
            parts.append(pa.table({name: pa.array([row[name]] * len(rows), pa.string()), "paper": papers, "squares": sums[ends] - sums[first], **table}))
        return pa.concat_tables(parts)

    n = _tasks(side.blocks, side.count)
    return side.blocks.drop("n_words").repartition(n, *key).groupBy(*key).cogroup(answered.repartition(n, *key).groupBy(*key)).applyInArrow(fill, schema)


def _kind(side: TermBlocks) -> str:
    return side.blocks.schema["papers"].dataType.elementType.simpleString()


def _length(squares: Column) -> Column:
    return F.sqrt(squares / F.lit(1e10))


def packed(side: TermBlocks, answered: DataFrame) -> DataFrame:
    """One compressed sparse row per text: ``norm`` over all its terms, and ``ids`` (rising) and ``ws`` of those that papers share."""

    def emit(named, rows, first, ends, term, weight, ids):
        shared = np.flatnonzero(ids >= 0)
        cuts = np.searchsorted(shared, np.append(first, len(ids))).astype(np.int32)
        entry = pa.StructArray.from_arrays([pa.array(ids[shared]), pa.array(weight[shared])], ["term_id", "w"])
        return {"entries": pa.ListArray.from_arrays(pa.array(cuts), entry)}

    rows = _filled(side, answered, emit, f"{ROUND} string, {PAPER} {_kind(side)}, squares long, entries array<struct<term_id: long, w: double>>")
    if side.repeated is not None:  # texts under one id make one row
        rows = rows.groupBy(ROUND, PAPER).agg(F.sum("squares").alias("squares"), F.flatten(F.collect_list("entries")).alias("entries"))
    rows = rows.withColumn("entries", F.sort_array("entries"))
    return rows.select(ROUND, PAPER, _length(F.col("squares")).alias("norm"), F.col("entries.term_id").alias("ids"), F.col("entries.w").alias("ws"))


def weights(side: TermBlocks, answered: DataFrame) -> DataFrame:
    """Unit-length weights, one row per text and term of the vocabulary. Only the lengths of texts under one id are put together."""

    def lengths(named, rows, first, ends, term, weight, ids):
        return {}

    def terms(named, rows, first, ends, term, weight, ids):
        used, at = np.unique(term, return_inverse=True)
        spelt = named().take(pa.array(used)).take(pa.array(at))
        entry = pa.StructArray.from_arrays([spelt, pa.array(weight)], ["term", "w"])
        return {"entries": pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), entry)}

    doc = f"{ROUND} string, {PAPER} {_kind(side)}, squares long"
    if side.repeated is not None:
        answered = materialize(answered, "answered")
    rows = _filled(side, answered, terms, f"{doc}, entries array<struct<term: string, w: double>>")
    if side.repeated is not None:
        same = lambda a, b: (a[ROUND] == b[ROUND]) & a[PAPER].eqNullSafe(b[PAPER])
        each = _filled(side, answered, lengths, doc).alias("e")
        each = each.join(side.repeated.alias("t"), same(_of("e"), _of("t")), "left_semi")
        sums = materialize(each.groupBy(ROUND, PAPER).agg(F.sum("squares").alias("together")), "together")
        rows = rows.alias("r").join(sums.alias("s"), same(_of("r"), _of("s")), "left").select("r.*", "together")
        rows = rows.withColumn("squares", F.coalesce("together", "squares"))
    each = rows.select(ROUND, PAPER, _length(F.col("squares")).alias("_norm"), F.explode("entries").alias("_e"))
    return each.select(ROUND, PAPER, "_e.term", (F.col("_e.w") / F.col("_norm")).alias("w"))


def _of(alias: str) -> dict[str, Column]:
    return {c: F.col(f"{alias}.{c}") for c in (ROUND, PAPER)}
