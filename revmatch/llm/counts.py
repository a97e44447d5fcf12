"""Token counts that follow edits.

Every document has a segment tree over its segments: stretches that begin and end where the pre-tokenizer cuts in any context
(before a single space, and around a single newline, between other characters). A leaf is a segment's number of tokens, an inner
node the sum of its children. An edit re-encodes only the segments that it touches and the neighbours whose cut could
depend on it, and puts the new sums on the paths above them; the rest of the text is not encoded again.

Cases: null and empty texts have no segments and no tokens; edits that overlap an earlier one are skipped; edits outside the text are
cut to it; equal rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revmatch.llm.common import ID, TEXT, texts
from revmatch.llm.pii import KINDS, base_spans
from revmatch.llm.tokens import Encoder, encoder, vocabulary_path

#: An edit: start, stop (code points) and what stands there instead.
Edit = tuple[int, int, str]
_CUT = re.compile(r"(?<=\S)(?: |\n)(?=\S)")


class Tree:
    """Segment tree of a text. ``ends``: where segments end; ``sums``: node k has children 2k and 2k+1, node 1 is the text."""

    def __init__(self, encode: Encoder, text: str):
        self.encode, self.text = encode, text
        lengths, counts = segments(encode, text)
        self.ends = np.cumsum(np.array(lengths, np.int64))
        self.leaves = 1 << max(len(counts) - 1, 0).bit_length()
        self.sums = np.zeros(2 * self.leaves, np.int64)
        self.sums[self.leaves:self.leaves + len(counts)] = counts
        width = self.leaves
        while width > 1:
            self.sums[width // 2:width] = self.sums[width:2 * width].reshape(-1, 2).sum(1)
            width //= 2
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1])

    def _put(self, low: int, high: int, total: int) -> None:
        """Segments ``low`` to ``high`` have become one stretch of ``total`` tokens."""
        self.sums[self.leaves + low] = total
        self.sums[self.leaves + low + 1:self.leaves + high] = 0
        a, b = self.leaves + low, self.leaves + high - 1
        while a > 1:
            a, b = a // 2, b // 2
            pairs = self.sums[2 * a:2 * b + 2]
            self.sums[a:b + 1] = pairs[0::2] + pairs[1::2]

    def apply(self, edits: list[Edit]) -> str:
        """Apply edits (positions of the text as it was) and return the new text; ``tokens`` follows."""
        text, ends, size = self.text, self.ends, len(self.text)
        regions: list[list] = []  # first and last segment, edits
        done = 0
        for start, stop, new in sorted(edits):
            start, stop = max(0, min(start, size)), max(0, min(stop, size))
            if start < done or stop < start:
                continue
            done = max(stop, start)
            low = min(int(np.searchsorted(ends, start, "right")), max(len(ends) - 1, 0))
            high = int(np.searchsorted(ends, stop, "left")) + 1
            while low > 0 and start < ends[low - 1] + 2:  # the cut before the region must not depend on what changes
                low -= 1
            while high < len(ends) and stop > ends[high - 1] - 2:
                high += 1
            if regions and low < regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], high)
                regions[-1][2].append((start, stop, new))
            else:
                regions.append([low, max(low + 1, min(high, len(ends))), [(start, stop, new)]])
        out, at = [], 0
        for low, high, changes in regions:
            begin, finish = (int(ends[low - 1]) if low else 0), (int(ends[high - 1]) if len(ends) else 0)
            piece, p = [], begin
            for start, stop, new in changes:
                piece += [text[p:start], new]
                p = stop
            piece = "".join([*piece, text[p:finish]])
            self._put(low, high, len(self.encode.ids(piece)) // 4)
            self.encoded += len(piece)
            out += [text[at:begin], piece]
            at = finish
        return "".join([*out, text[at:]])


def segments(encode: Encoder, text: str) -> tuple[list[int], list[int]]:
    """Lengths (code points) and token counts of a text's segments."""
    if not text:
        return [], []
    lengths: list[int] = []
    counts: list[int] = []
    first, rest, line_end = encode.first, encode.rest, len(encode.newline) // 4
    if encode.regular(text):
        for k, line in enumerate(text.split("\n")):
            if k:
                lengths.append(1)
                counts.append(line_end)
            parts = line.split(" ")
            lengths.append(len(parts[0]))
            counts.append(len(first[parts[0]]) // 4)
            lengths += [len(p) + 1 for p in parts[1:]]
            counts += [len(rest[p]) // 4 for p in parts[1:]]
        return lengths, counts
    at = 0
    for m in _CUT.finditer(text):
        cuts = (m.start(),) if m[0] == " " else (m.start(), m.end())
        for cut in cuts:
            lengths.append(cut - at)
            counts.append(len(first[text[at:cut]]) // 4)
            at = cut
    lengths.append(len(text) - at)
    counts.append(len(first[text[at:]]) // 4)
    return lengths, counts


def cleaning_edits(text: str) -> list[Edit]:
    """The edits of a usual clean-up: a line equal to an earlier one goes, personal data gives way to its kind."""
    edits: list[Edit] = []
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        if line in seen and not line.isspace() and line:
            edits.append((at - 1, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    edits += [(s, e, f"<{KINDS[k].upper()}>") for k, s, e in base_spans(text)]
    return edits


def recount(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = cleaning_edits, path: str | None = None, with_text: bool = False) -> DataFrame:
    """Token counts of every document before and after its edits, how many edits there were, and how many characters were
    encoded again for them (of ``n_chars``); the new text if wanted."""
    vocabulary = path or vocabulary_path()
    names = [ID, "n_chars", "n_segments", "n_edits", "tokens_before", "tokens_after", "n_chars_encoded_again", *(["text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            rows, changed = [], []
            for text in b.column(1).to_pylist():
                tree, edits = Tree(encode, text), edits_of(text)
                before = tree.tokens
                new = tree.apply(edits) if edits else text
                rows.append((len(text), len(tree.ends), len(edits), before, tree.tokens, tree.encoded))
                if with_text:
                    changed.append(new)
            if rows:
                columns = [b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))]
                yield pa.record_batch([*columns, pa.array(changed, pa.string())] if with_text else columns, names=names)

    schema = ", ".join(f"{n} {'string' if n == TEXT else 'long'}" for n in names)
    return texts(docs).mapInArrow(run, schema)
