"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words inside a sentence) and units after numbers turn into typed
placeholders, other words into lower case without outer punctuation. Windows of ``WINDOW`` template words of all documents
are looked up in a hash table of the benchmark's windows, and beside them windows of the words' own values without regard to case,
placeholders or not, so an exact or case-changed copy of an item hits wherever it stands. Hits on one diagonal (same shift between document and item) form
an alignment, which counts only if its slots are consistent: a value of the item always stands where the document has one and
the same value, so a re-parameterised question is caught and a chance meeting of placeholders is not. A document holds an item
if the alignment covers half of the item's words, or ``LONG`` words.

The table is built from the benchmark in blocks of ``BLOCK_CHARS`` characters (a bound on what is sent to workers);
each block is one pass over the documents, so a benchmark of any size is searched whole.

Cases: null and empty texts and items match nothing; items of fewer than ``LEAST`` words have no template
and match by their own words only; equal items are searched once and all reported; equal documents get equal rows; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.llm.common import ID, TEXT, texts
from revmatch.llm.text import Words, blocks, buffer, chain, lut, span_hashes

WINDOW, LEAST, LONG, SHARE = 8, 5, 13, 0.5
BLOCK_CHARS = 16_000_000
# Units and number words that the templates know.
UNITS = """km m cm mm mi mile miles ft foot feet inch inches yd yards kg g mg lb lbs oz l ml litre litres liter liters gal h hr hrs hour hours
min mins minute minutes s sec secs second seconds day days week weeks month months year years mph kph kmh percent % usd eur dollar dollars
euro euros cent cents degree degrees celsius fahrenheit watt watts kw kwh volt volts hz khz mhz ghz byte bytes kb mb gb tb""".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER, _LOWER, _DIGIT, _STOP = np.zeros(256, bool), np.zeros(256, bool), lut("0123456789"), lut(".!?:")
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:] = True
_KINDS = chain([np.arange(1, 4, dtype=np.uint64)])  # hashes of the placeholders: number, name, unit


#: Lower case of letters of two bytes (Latin, Greek, Cyrillic and others), which are as long.
_FOLD = np.array([ord(x) if len(x := chr(c).lower()) == 1 and 0x80 <= ord(x) < 0x800 else c for c in range(0x800)])


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with letters of two bytes in lower case."""
    at = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0))
    if not len(at):
        return data
    code = _FOLD[(data[at] & 0x1F).astype(int) << 6 | data[at + 1] & 0x3F]
    data = data.copy()
    data[at], data[at + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
    return data


def _known(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return np.sort(span_hashes(w.data, w.start, w.end, lower=True))


_UNITS, _NUMBERS = _known(UNITS), _known(NUMBERS)


def templates(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: template hash, hash of its own value, and kind (0 plain, 1 number, 2 name, 3 unit)."""
    start, end, data = w.start.copy(), w.end.copy(), w.data
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    solid = _LETTER | _DIGIT
    for _ in range(3):
        start += (end - start > 1) & ~solid[data[start]]
        end -= (end - start > 1) & ~solid[data[end - 1]]
    value = span_hashes(folded(data), start, end, lower=True)
    count = lambda mask: np.concatenate(([0], np.cumsum(mask[data])))
    letters, digits, large = count(_LETTER), count(_DIGIT), count(_UPPER)
    n_letters = letters[end] - letters[start]
    number = (digits[end] - digits[start] > 0) & (n_letters == 0) | np.isin(value, _NUMBERS)
    follows = np.zeros(len(start), bool)
    follows[1:] = w.doc[1:] == w.doc[:-1]
    after_number = np.zeros(len(start), bool)
    after_number[1:] = number[:-1] & follows[1:]
    unit = after_number & ~number & np.isin(value, _UNITS)
    begins = np.ones(len(start), bool)
    begins[1:] = ~follows[1:] | _STOP[data[w.end[:-1] - 1]]
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    begins[1:] |= breaks[w.start[1:]] > breaks[w.end[:-1]]
    name = ~number & ~unit & ~begins & _UPPER[data[start]] & (large[end] - large[start] == 1) & (n_letters >= 2)
    kind = np.where(number, 1, np.where(name, 2, np.where(unit, 3, 0))).astype(np.int8)
    return np.where(kind > 0, _KINDS[np.maximum(kind, 1) - 1], value), value, kind


class Index:
    """Windows of a block of benchmark items, sorted by hash."""

    def __init__(self, ids: np.ndarray, column):
        data, offsets = buffer(column)
        w = Words(data, offsets, hashes=False)
        self.template, self.value, self.kind = templates(w)
        self.ids, self.first, self.count = ids, w.first[:-1], w.count
        self.sizes = [WINDOW, *sorted(set(w.count[(w.count > 0) & (w.count < WINDOW)].tolist()))]
        found: tuple[list, list] = ([], [])  # (hash, place) of templates and of own values
        plain = np.concatenate(([0], np.cumsum(self.kind == 0)))
        for size in self.sizes:
            at = np.arange(len(w.start) - size + 1) if len(w.start) >= size else np.zeros(0, int)
            at = at[w.doc[at] == w.doc[at + size - 1]]
            if size < WINDOW:
                at = at[w.count[w.doc[at]] == size]
            found[1].append((self._hash(self.value, at, size), at))
            if size >= LEAST:
                at = at[plain[at + size] - plain[at] >= 3]  # mostly placeholders: says nothing
                found[0].append((self._hash(self.template, at, size), at))
        self.tables = []
        for parts in found:
            key, at = map(np.concatenate, zip(*parts))
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], at[order]))
        self.doc = w.doc

    @staticmethod
    def _hash(template: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return chain([template[at + k] for k in range(size)])

    def search(self, w: Words) -> Iterator[tuple[int, int, int, int, bool]]:
        """``(document, item, windows, words covered, slots differ)`` for each alignment that counts."""
        template, value, kind = templates(w)
        parts = []
        for size in self.sizes:
            last = len(template) - size + 1
            if last <= 0:
                continue
            at = np.flatnonzero(w.doc[:last] == w.doc[size - 1:])
            for own, ((keys, places), words) in enumerate(zip(self.tables, (template, value))):
                if not len(keys) or size < LEAST and not own:
                    continue
                key = self._hash(words, at, size)
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                hit = np.flatnonzero(high > low)
                times = high[hit] - low[hit]
                entry = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                parts.append((np.repeat(at[hit], times), places[entry], np.full(len(entry), size), np.full(len(entry), own)))
        if not sum(len(x[0]) for x in parts):
            return
        spot, place, size, own = map(np.concatenate, zip(*parts))
        item = self.doc[place]
        shift = spot - place
        order = np.lexsort((spot, shift, item, w.doc[spot]))
        spot, item, size, shift, own = (x[order] for x in (spot, item, size, shift, own))
        doc = w.doc[spot]
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])))
        best: dict[tuple[int, int], tuple[int, int, bool]] = {}
        for a, b in zip(cut, np.append(cut[1:], len(doc))):
            for hits in (slice(None), own[a:b] == 1, own[a:b] == 0):  # together, or what either kind of window says alone
                at, wide = spot[a:b][hits], size[a:b][hits]
                if not len(at):
                    continue
                words = np.unique((at[:, None] + np.arange(wide.max())[None])[np.arange(wide.max())[None] < wide[:, None]])
                theirs, ours = value[words], self.value[words - shift[a]]
                slots = kind[words] > 0
                pairs = set(zip(ours[slots].tolist(), theirs[slots].tolist()))
                steady = len(pairs) == len({p[0] for p in pairs})
                covered = len(words)
                if steady and (covered >= LONG or covered >= SHARE * self.count[item[a]]):
                    new = (len(np.unique(at)), covered, bool((theirs[slots] != ours[slots]).any()))
                    spot_key = (int(doc[a]), int(item[a]))
                    best[spot_key] = max(best.get(spot_key, new), new, key=lambda x: (x[1], x[0], not x[2]))
                    break
        for (d, i), found in best.items():
            yield d, i, *found


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """One index per block of the benchmark. A block is bounded, and the driver holds one at a time."""
    items = texts(benchmark.select(F.col("item_id").alias(ID), TEXT)).groupBy(TEXT).agg(F.min(ID).alias(ID))
    total = items.agg(F.sum(F.length(TEXT))).first()[0] or 0
    count = -(-total // block_chars)
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64(TEXT), F.lit(count)) == k).orderBy(ID, TEXT).select(ID, TEXT).toArrow()
        yield Index(np.array([-1 if v is None else v for v in rows.column(0).to_pylist()]), rows.column(1))


def _find(index: Index):
    schema = pa.schema([(ID, pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_words", pa.int64()), ("reparameterised", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer(b.column(1))
            for i, j in blocks(offsets):
                w = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], hashes=False)
                rows = list(index.search(w))
                if rows:
                    d, it, windows, words, differs = zip(*rows)
                    yield pa.record_batch([b.column(0).take(pa.array([i + x for x in d])), pa.array(index.ids[list(it)]), pa.array(windows, pa.int64()),
                                           pa.array(words, pa.int64()), pa.array(differs)], schema=schema)

    return run


def find(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item that it holds. Of equal items the smallest id is named."""
    schema = f"{ID} long, item_id long, n_windows long, n_words long, reparameterised boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, block_chars):
        out = out.unionByName(texts(docs).mapInArrow(_find(index), schema))
    return out.withColumn("item_id", F.when(F.col("item_id") >= 0, F.col("item_id")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows, all columns as they are, whose text holds no benchmark item."""
    at = docs.columns.index(TEXT)

    def dropping(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = buffer(b.column(at))
                clean = np.ones(b.num_rows, bool)
                for i, j in blocks(offsets):
                    w = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], hashes=False)
                    for d, *_ in index.search(w):
                        clean[i + d] = False
                yield b.filter(pa.array(clean))
        return run

    for index in indexes(benchmark, block_chars):
        docs = docs.mapInArrow(dropping(index), docs.schema)
    return docs
