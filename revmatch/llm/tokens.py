"""Token ids of a public byte-level BPE vocabulary, fast on whole texts.

A text whose white space comes one character at a time splits at spaces and newlines into parts that the pre-tokenizer
never joins, so the ids of a part (with its leading space) can be kept from one text to the next. Any other text goes to the tokenizer whole.
Ids are those of ``tokenizers`` on the JSON file of the vocabulary (the rank file has the same merges): its added tokens, such as
``<|endoftext|>``, are matched in plain text too and have ids of their own. None holds white space, so none crosses a part.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
from array import array
from functools import lru_cache

#: White space (Unicode's) in runs of more characters than this is cut out by hand: the pattern's engine overflows on some 10^6.
LONG = 10_000
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)
#: Parts kept at most per kind; then the store starts anew, so a worker's memory is bounded.
KEPT = 600_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the JSON file beside a rank file, with their ids."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    for t in found:
        if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]):
            raise ValueError(f"added token {t} is not matched as plain text within a part")
    return {t["content"]: t["id"] for t in found}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class _Parts(dict):
    def __init__(self, encode, before: str, marks: dict[str, bytes]):
        self.encode, self.before, self.marks = encode, before, marks

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        # the one mark behind a letter is a piece of its own, as white space or the end follows
        if part[-1:] in self.marks and part[-2:-1].isalpha():
            ids = self[part[:-1]] + self.marks[part[-1]]
        else:
            ids = packed(self.encode(self.before + part))
        if len(part) < 64:
            self[part] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.added, self.json, self.tokenizer = added_tokens(path), os.path.splitext(path)[0] + ".json", None
        self.core = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.special = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        marks = {m: packed(self.ordinary(m)) for m in ",.;:!?" if not any(m in t for t in self.added)}
        self.first, self.rest = _Parts(self.ordinary, "", marks), _Parts(self.ordinary, " ", marks)
        self.newline = packed(self.ordinary("\n"))

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text as it is, without the parts kept.

        The pre-tokenizer makes one piece of a run of white space, without its last character where other text
        follows. A long run is cut there and given to ``tokenizers`` alone, which keeps pure white space in one piece.
        """
        if len(text) < LONG:
            return self._pieces(text)
        out, at = [], 0
        for run in _RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self._pieces(text[at:run.start()])
            out += self._whole().encode(text[run.start():end], add_special_tokens=False).ids
            at = end
        return out + self._pieces(text[at:])

    def _whole(self):
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.json)
        return self.tokenizer

    def _pieces(self, text: str) -> list[int]:
        if self.special.search(text):
            return self.core.encode(text, allowed_special="all")
        return self.core.encode_ordinary(text)

    @staticmethod
    def regular(text: str) -> bool:
        """White space comes one character at a time, and none at the ends: it is one character less than there are words."""
        words = text.split()
        return not text or len(text) - sum(map(len, words)) == len(words) - 1

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.regular(text):
            return packed(self.ordinary(text))
        out, first, rest = [], self.first, self.rest.__getitem__
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            parts = line.split(" ")
            out.append(first[parts[0]])
            out.extend(map(rest, parts[1:]))
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)
