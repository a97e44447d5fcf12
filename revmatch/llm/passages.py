"""Passages that repeat across documents, by MinHash banding of paragraphs.

Paragraphs are of two kinds: whole lines of at least ``LINE`` words, of any length, and windows of ``SIZE`` words from an anchor,
which catch passages inside longer lines. Anchors are the places whose three-word hash is the smallest of some
``REACH`` places around, so they depend on the words alone, and every passage of ``SIZE + REACH - 1`` words (51) holds the same
paragraphs wherever it stands, be it in the middle of a line. Each paragraph has ``BANDS`` MinHash bands over its own
five-word shingles; lines and windows do not meet in a band. Bands of the whole corpus meet in hash ranges, which answer each batch of documents which of its
paragraphs are shared, or collide with one of other documents; only those leave their batch. Colliding paragraphs that are not equal are joined by band,
verified by exact Jaccard similarity, and linked; a component of links is one passage.

Lines are decided first: the first document (smallest id) with a line of the passage keeps it and the others lose it. A window is kept by the
first document that has it outside the lines it loses, and lost by the documents after that one. So a lost window goes back to
ever earlier documents until one still holds its words; where a component joins different contents, one of them stays in the place of the others.
A window across two shared lines names no keeper.

Contents that meet only contents of the very same documents are compared as well, if a chain of such meetings inside their document
reaches a content that meets other documents; otherwise they have no part in any link between documents.

A band with more than ``LIMIT`` different paragraphs is split by bands of more rows, and those groups are compared whole, in
blocks of one lag, inside one task whose memory holds just that group's shingles.

Cases: null, empty and short texts (no line of ``LINE`` words and under ``SIZE`` words) have no paragraphs; a paragraph repeated inside one document counts once
and is lost at all its places; equal rows (id and text) are one document; a null id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revmatch.llm.batches import gather, grow, hash_ranges, range_count, shrink, unpack
from revmatch.llm.common import ID, TEXT, components, texts, written
from revmatch.llm.simhash import merge, row_key
from revmatch.llm.text import Words, blocks, buffer, chain, mix, runs

SIZE, REACH, SHINGLE, SIMILAR = 30, 22, 5, 0.8
#: Shortest line that is a paragraph: documents that share fewer words in a row lose nothing.
LINE = 25
SHINGLES = SIZE - SHINGLE + 1
#: Bands of so many rows: 98 of 100 pairs at similarity 0.8 share one, 99.99 of 100 at 0.93 (one word at an end differs).
BANDS, ROWS = 4, 2
MORE_BANDS, MORE_ROWS, LIMIT = 12, 4, 256
#: A passage with more than this part of all places is looked up by broadcast.
HOT = 1000
_SEEDS = mix(np.arange(1, BANDS * ROWS + MORE_BANDS * MORE_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def slide(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each run of ``size`` values."""
    out, width = values, 1
    while 2 * width <= size:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[:len(out) - (size - width)], out[size - width:]) if width < size else out


def anchors(w: Words) -> np.ndarray:
    """First words of the paragraphs of every document."""
    n = len(w.start)
    if n < SIZE:
        return np.zeros(0, np.int64)
    last = n - SIZE + 1
    valid = w.doc[:last] == w.doc[SIZE - 1:]
    key = np.where(valid, chain([w.hash[k:k + last] for k in range(3)]), _TOP)
    chosen = np.zeros(last, bool)
    fits = np.maximum(w.count - SIZE + 1, 0)  # places a document offers
    if last >= REACH:
        low = slide(key, REACH, np.minimum)
        inside = valid[:len(low)] & valid[REACH - 1:] & (w.doc[:len(low)] == w.doc[REACH - 1:REACH - 1 + len(low)])
        low = np.concatenate([np.zeros(REACH - 1, np.uint64), np.where(inside, low, np.uint64(0)), np.zeros(REACH - 1, np.uint64)])
        chosen = valid & (slide(low, REACH, np.maximum)[:last] == key)
    few = np.flatnonzero((fits > 0) & (fits < REACH))  # shorter documents: their smallest place
    if len(few):
        edges = np.stack([w.first[few], w.first[few] + fits[few]], 1).ravel()
        smallest = np.minimum.reduceat(np.append(key, _TOP), edges)[::2]
        at = np.repeat(np.arange(len(few)), fits[few])
        place = np.repeat(w.first[few] - np.concatenate(([0], np.cumsum(fits[few])[:-1])), fits[few]) + np.arange(fits[few].sum())
        chosen[place[key[place] == smallest[at]]] = True
    return np.flatnonzero(chosen)


def lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of every line of at least ``LINE`` words."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.concatenate(([0], np.cumsum(w.data == 10, dtype=np.int32)))
    begin = np.flatnonzero(np.append(True, (w.doc[1:] != w.doc[:-1]) | (breaks[w.start[1:]] > breaks[w.end[:-1]])))
    size = np.diff(np.append(begin, len(w.start)))
    return begin[size >= LINE], size[size >= LINE]


class Paragraphs:
    """The distinct paragraphs of each document of a block: first word, words, content hash and band keys; and all places where they stand."""

    def __init__(self, w: Words, banded: bool = True):
        window, (line, size) = anchors(w), lines(w)
        at, size = np.concatenate([window, line]), np.concatenate([np.full(len(window), SIZE), size])
        whole = np.arange(len(at)) >= len(window)
        content = np.zeros(0, np.uint64)
        if len(at):
            content = np.concatenate([chain([w.hash[window + k] for k in range(SIZE)]), runs(w.hash, line, size[whole])])
        _, first, same = np.unique(chain([content, w.doc[at].astype(np.uint64)]) if len(at) else content, return_index=True, return_inverse=True)
        order = np.argsort(first)
        kept = first[order]
        self.words, self.at, self.size, self.content = w, at[kept], size[kept], content[kept]
        self.every, self.which, self.whole = at, np.argsort(order)[same], whole[kept]  # all places, repeats too, and the distinct paragraph of each
        self.keys = [np.zeros(0, np.uint64)] * BANDS
        if not len(at) or not banded:
            return
        self.shingle = chain([w.hash[k:len(w.hash) - SHINGLE + 1 + k] for k in range(SHINGLE)])
        whole = self.whole
        edges = np.stack([self.at[whole], self.at[whole] + self.size[whole] - SHINGLE + 1], 1).ravel()
        rows = []
        for seed in _SEEDS[:BANDS * ROWS]:
            mixed = mix(self.shingle * seed)
            row = np.empty(len(kept), np.uint64)
            row[~whole] = slide(mixed, SHINGLES, np.minimum)[self.at[~whole]] if not whole.all() else 0
            row[whole] = np.minimum.reduceat(np.append(mixed, _TOP), edges)[::2] if len(edges) else 0
            rows.append(row)
        self.keys = [chain([*rows[b * ROWS:(b + 1) * ROWS], (b + BANDS * whole).astype(np.uint64)]) for b in range(BANDS)]

    def short(self, which: np.ndarray) -> list[bytes]:
        """Four bytes of the hash of every word: what travels of a paragraph, half as long as its shingles."""
        word = (self.words.hash >> np.uint64(32)).astype(np.uint32)
        return [word[a:a + n].tobytes() for a, n in zip(self.at[which], self.size[which])]


def ordered(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    """The order by key, then content; only where a key repeats are contents compared."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeats = np.append(False, same) | np.append(same, False) if len(key) else same
    again = order[repeats]
    order[repeats] = again[np.lexsort((content[again], key[again]))]
    return order


def _blocks(packed: bytes, banded: bool = True) -> Iterator[tuple[int, pa.Table, Paragraphs]]:
    docs = unpack(packed)
    data, offsets = buffer(docs.column(0))
    for i, j in blocks(offsets):
        yield i, docs, Paragraphs(Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), banded)


def _entries(packed: bytes) -> tuple[np.ndarray, ...]:
    """Distinct (band key, content) of a batch in order, in how many of its documents each is, and the sum of those documents' tags;
    then the band keys of all its paragraphs, block by block and band by band, and the entry of each."""
    parts, tags = [], None
    for first, docs, p in _blocks(packed):
        if tags is None:
            tags = mix(docs.column(2).to_numpy().view(np.uint64)) >> np.uint64(32)
        parts.append((np.concatenate(p.keys), np.tile(p.content, BANDS), np.tile(tags[first + p.words.doc[p.at]], BANDS)))
    key, content, tag = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64),) * 3
    if not len(key):
        return key, content, key.astype(np.int64), tag, key, key.astype(np.int64)
    every, order, entry = key, ordered(key, content), np.empty(len(key), np.int64)
    key, content, tag = key[order], content[order], tag[order]
    first = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
    entry[order], new = np.cumsum(first) - 1, np.flatnonzero(first)
    return key[new], content[new], np.diff(np.append(new, len(key))), np.add.reduceat(tag, new), every, entry


_SENT = "batch long, range long, keys binary, contents binary, counts binary"


def _send(ranges: int):
    names = [c.split()[0] for c in _SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, packed in zip(b.column(0), b.column(2)):  # not to_pylist(): one batch of documents is held at a time
                number = number.as_py()
                key, content, count, tag = _entries(packed.as_py())[:4]
                cut = np.searchsorted(hash_ranges(key, ranges), np.arange(ranges + 1, dtype=np.uint64))
                rows = []
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    s = slice(cut[r], cut[r + 1])
                    # inside a band 40 bits of the content and 24 of the documents' tags tell entries apart
                    both = content[s] >> np.uint64(24) << np.uint64(24) | tag[s] & np.uint64(0xFFFFFF)
                    rows.append((number, r, shrink(np.diff(key[s] >> np.uint64(8), prepend=np.uint64(0))), shrink(both), shrink(count[s].astype(np.uint32))))
                for k in range(0, len(rows), 64):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 64]), [pa.int64()] * 2 + [pa.binary()] * 3)], names=names)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """For each batch's entries of a hash range: 1 if the content stands in several documents, 2 if its band holds a content of
    other documents, 4 if its band holds several contents, all of the very same documents."""
    parts = [(np.cumsum(grow(k, np.uint64), dtype=np.uint64), grow(c, np.uint64), grow(n, np.uint32))
             for k, c, n in zip(*(group.column(x).to_pylist() for x in ("keys", "contents", "counts")))]
    sizes = [len(p[0]) for p in parts]
    key, both, count = (np.concatenate(c) for c in zip(*parts))
    content, tag = both >> np.uint64(24), both & np.uint64(0xFFFFFF)
    order = ordered(key, content)
    k, c = key[order], content[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = np.flatnonzero(new_key | np.append(True, c[1:] != c[:-1]))
    entry, band = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(k)))), np.cumsum(new_key) - 1
    documents = np.add.reduceat(count[order].astype(np.int64), new)
    who = np.add.reduceat(tag[order], new) % np.uint64(1 << 24) * np.uint64(0x9E3779B97F4A7C15) + documents.astype(np.uint64)
    begins = np.flatnonzero(new_key[new])
    differ = np.minimum.reduceat(who, begins) != np.maximum.reduceat(who, begins)
    flags = np.empty(len(key), np.uint8)
    many = np.diff(np.append(begins, len(new))) > 1
    flags[order] = (documents[entry] > 1) + 2 * differ[band] + 4 * (many & ~differ)[band]
    back = [shrink(f) if f.any() else None for f in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.table([group.column("batch").combine_chunks(), group.column("range").combine_chunks(), pa.array(back, pa.binary()), pa.array(sizes, pa.int64())],
                    names=["batch", "range", "flags", "size"])


_FOUND = f"content long, row_key long, {ID} long, start long, stop long, kind byte, line long, bands array<long>, short binary"
#: Kinds of paragraphs found: a window, a line, a window that touches several flagged lines.
_WINDOW, _LINE, _ACROSS = 0, 1, 2


def _reached(flags: np.ndarray, keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which paragraphs meet other documents in a band, themselves or over paragraphs of their own document."""
    active = ((flags & 2) > 0).any(1)
    which, band = np.nonzero(flags & 4)
    if not active.any() or not len(which):
        return active
    _, meeting = np.unique(chain([keys[which, band], doc[which].astype(np.uint64)]), return_inverse=True)
    while True:
        live = np.zeros(meeting.max() + 1, bool)
        live[meeting[active[which]]] = True
        new = which[live[meeting] & ~active[which]]
        if not len(new):
            return active
        active[new] = True


def _touched(at: np.ndarray, size: np.ndarray, whole: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of every place, and for windows the content of the flagged line they touch (``True`` in the mask: none, or several)."""
    order = np.flatnonzero(whole)[np.argsort(at[whole])]
    begin, end = at[order], at[order] + size[order]
    first, last = np.searchsorted(end, at, "right"), np.searchsorted(begin, at + size, "left")
    touches = np.where(whole, 0, last - first)
    line = np.append(content[order], np.uint64(0))[np.minimum(first, len(order))]
    return np.where(whole, _LINE, np.where(touches > 1, _ACROSS, _WINDOW)).astype(np.int8), np.ma.MaskedArray(line, touches != 1)


def _report(group: pa.Table) -> pa.Table:
    """The flagged paragraphs of a batch: where they are, and the bands and shingles of those to compare."""
    packed = next(v for v in group.column("docs").to_pylist() if v is not None)
    rows = sorted((r, f, n) for r, f, n in zip(*(group.column(x).to_pylist() for x in ("range", "flags", "size"))) if r is not None)
    flags = np.concatenate([grow(f, np.uint8) if f is not None else np.zeros(n, np.uint8) for _, f, n in rows]) if rows else np.zeros(0, np.uint8)
    every, entry = _entries(packed)[4:]
    out: list[pa.Table] = []
    seen, done = np.zeros(0, np.uint64), 0
    for first, docs, p in _blocks(packed, banded=False):
        if not len(p.at):
            continue
        w, part = p.words, slice(done, done + BANDS * len(p.at))
        done = part.stop
        keys, mine = (np.ascontiguousarray(x.reshape(BANDS, -1).T) for x in (every[part], flags[entry[part]]))
        reached = _reached(mine, keys, w.doc[p.at])
        which = np.flatnonzero((mine & 3).any(1) | reached)
        if not len(which):
            continue
        points = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
        collide = ((mine[which] & 2) > 0) | ((mine[which] & 4) > 0) & reached[which][:, None]
        fresh = collide.any(1) & ~np.isin(p.content[which], seen)
        fresh[fresh] = np.isin(np.flatnonzero(fresh), np.flatnonzero(fresh)[np.unique(p.content[which][fresh], return_index=True)[1]])
        seen = np.concatenate([seen, p.content[which][fresh]])
        keys = keys[which].view(np.int64)
        payload = iter(p.short(which[fresh]))
        bands = [keys[i][collide[i]].tolist() if f else None for i, f in enumerate(fresh)]
        # a paragraph is compared once but lost wherever its document repeats it
        place = np.full(len(p.at), -1)
        place[which] = np.arange(len(which))
        spot = np.flatnonzero(place[p.which] >= 0)
        at, of = p.every[spot], place[p.which[spot]]
        carries = fresh[of] & (at == p.at[which[of]])
        bands, payload = [bands[k] if f else None for k, f in zip(of, carries)], [next(payload) if f else None for f in carries]
        begin, doc = points[w.offsets[w.doc[at]]], pa.array(first + w.doc[at])
        kind, line = _touched(at, p.size[which[of]], p.whole[which[of]], p.content[which[of]])
        out.append(pa.table([pa.array(p.content[which[of]].view(np.int64)), docs.column(2).take(doc).combine_chunks(), docs.column(1).take(doc).combine_chunks(),
                             pa.array(points[w.start[at]] - begin), pa.array(points[w.end[at + p.size[which[of]] - 1]] - begin),
                             pa.array(kind), pa.array(line.data.view(np.int64), mask=line.mask), pa.array(bands, pa.list_(pa.int64())), pa.array(payload, pa.binary())],
                            names=[c.split()[0] for c in _FOUND.split(", ")]))
    if out:
        return pa.concat_tables(out)
    kinds = [pa.int64()] * 5 + [pa.int8(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.table([pa.array([], t) for t in kinds], names=[c.split()[0] for c in _FOUND.split(", ")])


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact similarity of rows of shingles, repeats not counted."""
    def distinct(x):
        x = np.sort(x, 1)
        return x, np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], 1)

    (x, fx), (y, fy) = distinct(a), distinct(b)
    both = np.concatenate([np.where(fx, x, _TOP), np.where(fy, y, _TOP)], 1)
    both.sort(1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _TOP)).sum(1)
    return common / (fx.sum(1) + fy.sum(1) - common)


class _Shingles:
    """Shingles of paragraphs of any length, one after the other."""

    def __init__(self, values: np.ndarray, size: np.ndarray):
        self.values, self.size, self.first = values, size, np.concatenate(([0], np.cumsum(size)))

    @staticmethod
    def of(raw: list[bytes]) -> _Shingles:
        return _Shingles(np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64))

    @staticmethod
    def of_words(raw: list[bytes]) -> _Shingles:
        """Of paragraphs given by the short hashes of their words; two shingles are told apart by 4 bytes a word."""
        word, size = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64), np.array([len(x) // 4 for x in raw], np.int64)
        if not len(word):
            return _Shingles(word, size)
        starts = np.ones(len(word), bool)
        last = np.cumsum(size)
        for k in range(1, SHINGLE):
            starts[last - k] = False
        n = len(word) - SHINGLE + 1
        return _Shingles(chain([word[k:k + n] for k in range(SHINGLE)])[starts[:n]], size - SHINGLE + 1)

    def take(self, which: np.ndarray) -> _Shingles:
        size = self.size[which]
        at = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return _Shingles(self.values[at], size)

    def minima(self, seed: np.uint64) -> np.ndarray:
        return np.minimum.reduceat(mix(self.values * seed), self.first[:-1])

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs have an exact similarity of at least ``SIMILAR``."""
        out = np.zeros(len(a), bool)
        usual = (self.size[a] == SHINGLES) & (self.size[b] == SHINGLES)
        if usual.any():
            rows = np.arange(SHINGLES)[None]
            out[usual] = jaccard(self.values[self.first[a[usual]][:, None] + rows], self.values[self.first[b[usual]][:, None] + rows]) >= SIMILAR
        other = np.flatnonzero(~usual)
        total = np.cumsum(self.size[a[other]] + self.size[b[other]])
        for part in np.split(other, np.flatnonzero(np.diff(total // (1 << 20))) + 1):
            if len(part):
                out[part] = self._overlap(a[part], b[part]) >= SIMILAR
        return out

    def _overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact similarity of pairs of any length, repeats not counted."""
        pair, value = [], []
        for which in (a, b):
            x = self.take(which)
            owner = np.repeat(np.arange(len(which)), x.size)
            order = np.lexsort((x.values, owner))
            owner, x = owner[order], x.values[order]
            first = np.append(True, (owner[1:] != owner[:-1]) | (x[1:] != x[:-1]))
            pair.append(owner[first]), value.append(x[first])
        pair, value = np.concatenate(pair), np.concatenate(value)
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=len(a))
        return common / (np.bincount(pair, minlength=len(a)) - common)

    def __len__(self) -> int:
        return len(self.size)


def _compare(limit: int):
    """Over rows (band, content, short) sorted by band: links of similar contents; ``(a, null)`` for members of bands too large."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(band: np.ndarray, content: np.ndarray, sh: _Shingles) -> Iterator[pa.RecordBatch]:
        change = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        size = np.diff(np.append(change, len(band)))
        big = np.repeat(size > limit, size)
        if big.any():
            yield pa.record_batch([pa.array(content[big]), pa.nulls(int(big.sum()), pa.int64())], schema=schema)
        keep = np.flatnonzero(~big & np.repeat(size > 1, size))
        group, content, sh = np.repeat(np.arange(len(size)), size)[keep], content[keep], sh.take(keep)
        root, lag, at = np.arange(len(keep)), 1, np.arange(len(keep))
        while len(at):
            at = at[at + lag < len(keep)]
            at = at[group[at] == group[at + lag]]
            near = at[root[at] != root[at + lag]]
            for k in range(0, len(near), 4096):
                part = near[k:k + 4096]
                part = part[sh.similar(part, part + lag)]
                if len(part):
                    root = merge(root, [part], [part + lag])
            lag += 1
        moved = np.flatnonzero(root != np.arange(len(keep)))
        if len(moved):
            yield pa.record_batch([pa.array(content[moved]), pa.array(content[root[moved]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, None  # ``over``: a band known to be too large, of which nothing is held
        for b in batches:
            if over is not None:
                rest = pa.array(np.asarray(b.column(0), np.int64) != over)
                gone = b.column(1).filter(pc.invert(rest))
                if len(gone):
                    yield pa.record_batch([gone, pa.nulls(len(gone), pa.int64())], schema=schema)
                b = b.filter(rest)
            if not b.num_rows:
                continue
            now = [np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64), np.array([*b.column(2).to_pylist(), None], object)[:-1]]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if (np.diff(now[0]) >= 0).all() else int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1
            if cut:
                yield from compared(now[0][:cut], now[1][:cut], _Shingles.of_words(now[2][:cut].tolist()))
            held = [x[cut:] for x in now]
            over = None
            if len(held[0]) > limit:
                over = held[0][0]
                yield pa.record_batch([pa.array(held[1]), pa.nulls(len(held[1]), pa.int64())], schema=schema)
                held = None
        if held is not None and len(held[0]):
            yield from compared(held[0], held[1], _Shingles.of_words(held[2].tolist()))

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, short, bands of more rows)"""
    for b in batches:
        if b.num_rows:
            sh = _Shingles.of_words(b.column(1).to_pylist())
            rows = [sh.minima(s) for s in _SEEDS[BANDS * ROWS:]]
            keys = [chain([*rows[k * MORE_ROWS:(k + 1) * MORE_ROWS], np.full(b.num_rows, k, np.uint64)]) for k in range(MORE_BANDS)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.stack(keys, 1).view(np.int64).tolist(), pa.list_(pa.int64()))], names=["content", "short", "bands"])


def links(contents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links ``(a, b)`` of similar contents. ``contents``: content, short, bands."""
    def level(rows: DataFrame, most: int, name: str) -> DataFrame:
        spread = rows.select(F.explode("bands").alias("band"), "content", "short").repartition("band").sortWithinPartitions("band")
        return written(spread.mapInArrow(_compare(most), "a long, b long"), name)

    first = level(contents, limit, "passages-links")
    sure, over = first.filter("b is not null"), first.filter("b is null").select(F.col("a").alias("content")).distinct()
    if over.isEmpty():
        return sure
    again = contents.join(over, "content", "left_semi").select("content", "short").mapInArrow(_finer, "content long, short binary, bands array<long>")
    return sure.unionByName(level(again, 1 << 62, "passages-more-links"))


def repeats(docs: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id``, ``start``, ``stop`` (code points) and ``keeper`` (id of the document that keeps the passage) of every
    paragraph that its document shall lose."""
    rows = texts(docs).select(F.lit(False).alias("apart"), TEXT, ID, row_key().alias("row_key"))
    batches = written(rows.mapInArrow(gather, "batch long, apart boolean, docs binary"), "passages-batches")
    ranges = range_count(docs.agg(F.sum(F.octet_length(TEXT))).first()[0])
    back = batches.mapInArrow(_send(ranges), _SENT).groupBy("range").applyInArrow(_answer, "batch long, range long, flags binary, size long")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    met = (batches.select("batch", null("long", "range"), null("binary", "flags"), null("long", "size"), "docs")
           .unionByName(back.withColumn("docs", F.lit(None).cast("binary"))).groupBy("batch"))
    found = written(met.applyInArrow(_report, _FOUND), "passages-found")
    compare = found.filter("short is not null").groupBy("content").agg(F.first("short").alias("short"), F.array_distinct(F.flatten(F.collect_set("bands"))).alias("bands"))
    roots = components(links(written(compare, "passages-compare"))).withColumnRenamed("node", "content")
    members = found.select("content", "row_key", ID, "start", "stop", "kind", "line").join(roots, "content", "left").withColumn("passage", F.coalesce("root", "content"))
    members = written(members.withColumn("content", F.expr(f"if(kind = {_LINE}, content, null)")).drop("root"), "passages-members")
    keepers = written(_keepers(members), "passages-keepers")
    # passages that are more than a thousandth of all places are a thousand at most, so that none is gathered in one task
    total = keepers.agg(F.sum("places")).first()[0] or 0
    often = F.broadcast(keepers.filter(F.col("places") * HOT > total))
    seldom = members.join(often, "passage", "left_anti").join(keepers.filter(F.col("places") * HOT <= total), "passage")
    return (members.join(often, "passage").unionByName(seldom)
            .filter(F.struct(F.col(ID).alias("keeper"), F.col("row_key").alias("keeper_key")) > F.struct("keeper", "keeper_key")).select("row_key", ID, "start", "stop", "keeper"))


def _keepers(members: DataFrame) -> DataFrame:
    """``passage``, ``keeper``, ``keeper_key`` and ``places`` of every passage of several documents that somebody keeps."""
    who = F.struct(F.col(ID).alias("keeper"), F.col("row_key").alias("keeper_key"))
    ends = [F.min("row_key").alias("low"), F.max("row_key").alias("high"), F.count(F.lit(1)).alias("places")]
    first = members.groupBy("passage", "line").agg(F.min(F.when(F.col("kind") != _ACROSS, who)).alias("k"), *ends)
    lines = members.filter(F.col("kind") == _LINE)
    lost = (lines.groupBy("passage").agg(F.min(who).alias("k"), *ends).filter("low <> high")
            .join(lines.select("passage", F.col("content").alias("line")).distinct(), "passage").select("line", F.col("k.keeper_key").alias("stays")))
    # all documents with a line have the windows in it: the one that keeps the line is the first of them, or has another line of the passage
    inside = first.filter("line is not null").join(lost, "line", "left").withColumn("k", F.expr("if(stays is null or stays = k.keeper_key, k, null)"))
    every = first.filter("line is null").unionByName(inside.drop("stays"))
    return (every.groupBy("passage").agg(F.min("k").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("places").alias("places"))
            .filter("low <> high and k is not null").select("passage", "k.*", "places"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def find(docs: DataFrame) -> DataFrame:
    """One row per document that loses passages: spans (``start:stop`` in code points, comma-joined), how many characters,
    and the ids of the documents that keep them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_merged(v) for v in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([",".join(f"{s}:{e}" for s, e in v) for v in spans], pa.string()),
                                   pa.array([sum(e - s for s, e in v) for v in spans], pa.int64()), b.column(3)],
                                  names=["row_key", ID, "spans", "n_chars_removed", "keepers"])

    gathered = repeats(docs).groupBy("row_key", ID).agg(F.collect_list(F.struct("start", "stop")).alias("spans"), F.sort_array(F.collect_set("keeper")).alias("keepers"))
    return gathered.mapInArrow(run, f"row_key long, {ID} long, spans string, n_chars_removed long, keepers array<long>")


def remove(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, without the passages that another document keeps."""
    lost = find(docs).select(F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans"))
    at = docs.columns.index(TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                for span in reversed(spans.split(",") if spans else []):
                    s, e = map(int, span.split(":"))
                    text = text[:s] + text[e:]
                new.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type)).select(list(range(b.num_columns - 1)))

    return docs.withColumn("__row_key", row_key()).join(lost, "__row_key", "left").select(*docs.columns, "__spans").mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    return find(docs).drop("row_key")
