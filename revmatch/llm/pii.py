"""Personal data by a semi-Markov conditional random field.

Plain patterns find the base spans of four kinds. Around digits and at-signs a semi-Markov CRF then looks at whole candidate
spans of at most ``MAX_CHARS`` characters (numbers: ``MAX_TOKENS`` tokens): features of the span as one piece (digits, groups, separators, checksum, shape,
neighbours, a cue word before) score each kind, and dynamic programming over the candidates of a window chooses
boundaries and kinds jointly. Its spans that overlap no base span are added: numbers broken over a line, phones without
a plus, addresses written with (at) and (dot).

The CRF is trained by maximum likelihood on at most ``SAMPLE`` different windows of the corpus, a fixed share for each kind and those
of smallest hash in all texts, labelled by the base patterns, each also in altered
forms (line breaks, other separators, spelt-out signs). Texts are worked on whole and where they lie; nothing is shuffled.
All searches are linear in the text.

Cases: null and empty texts have no spans; equal texts get equal spans; offsets count code points; without any base span
in the sample nothing is added; an empty table gives an empty result; other columns are ignored (kept by ``redact``).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revmatch.llm.common import ID, TEXT, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE, EPOCHS, MAX_TOKENS, MAX_CHARS, REACH = 600, 5, 22, 72, 48
#: First weight of each kind: a span of a shape never seen needs evidence.
START = -3.0
# Numbers that are no personal data, as counter-examples beside those of the corpus.
OTHERS = """
on 2024-01-15 we|the 15.01.2024 at|1999-12-31 23:59:59 log|from 2019-2020 to|see 978-3-16-148410-0 for|about 1 234 567 people
at 10.30 - 11.45 daily|version 3.2.1.12 of|build 10.0.19041 is|pages 100-110, 200-210|section 1.2.3.4 says|costs 12 000 000.50 now
2021 03 04 05 06|id 1234567 row|sum (1000) 2000-3000|table (12) 345-678 and|3.14159265 is pi|order 20240115 came|the score 21-19 21-17
""".strip().replace("\n", "|").split("|")
Span = tuple[int, int, int]  # kind, start, end

# The base patterns of the contract.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|AT) ?[)\]}]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_CUE = re.compile(r"([^\W\d_]{2,12})\W{0,3}\Z")
# Words that announce personal data.
CUES = {"phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card",
        "mastercard": "card", "credit": "card", "mail": "email", "email": "email", "contact": "email", "ip": "ip", "host": "ip", "address": "ip"}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(g := x.lstrip("0")) <= 3 and int(g or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers; triggers closer than ``REACH`` share one."""
    out: list[tuple[int, int]] = []
    low = high = -1
    for m in _TRIGGER.finditer(text):
        if high >= 0 and m.start() - high <= REACH:
            high = m.end()
            continue
        if high >= 0:
            out.append((max(0, low - REACH), min(len(text), high + REACH)))
        low, high = m.start(), m.end()
    if high >= 0:
        out.append((max(0, low - REACH), min(len(text), high + REACH)))
    return out


def _group_shape(sizes: list[int]) -> str:
    return "-".join(map(str, sizes)) if len(sizes) <= 5 else "many"


def candidates(text: str) -> list[tuple[int, int, int, tuple[str, ...]]]:
    """``(start, end, kind, features)`` of every span of a window that could be of a kind at all."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    out = []
    for i, (start, _, first) in enumerate(tokens):
        head = first[0]
        if head.isspace() or not (head.isalnum() or head in "+("):
            continue
        if head.isdigit() or head in "+(":
            groups: list[str] = []
            separators: set[str] = set()
            for j in range(i, min(i + MAX_TOKENS, len(tokens))):
                _, end, token = tokens[j]
                if end - start > MAX_CHARS:
                    break
                if token.isascii() and token.isdigit():
                    groups.append(token)
                    digits = "".join(groups)
                    n = len(digits)
                    if n > 19:
                        break
                    plain = separators <= {" ", "-", "\n", "."}
                    if head.isdigit() and 13 <= n <= 19 and plain and (len(groups) > 1 or j == i):
                        out.append((start, end, 2, _features(text, start, end, 2, (f"n{n}", f"luhn{luhn(digits)}", "g" + _group_shape([len(g) for g in groups]), *("s" + s for s in sorted(separators))))))
                    if 7 <= n <= 15 and (len(groups) > 1 or head == "+"):
                        shape = (f"n{n}", f"plus{head == '+'}", f"brackets{'(' in separators or head == '('}", "g" + _group_shape([len(g) for g in groups]),
                                 *("s" + s for s in sorted(separators)))
                        out.append((start, end, 3, _features(text, start, end, 3, shape)))
                    if head.isdigit() and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and "." in separators:
                        out.append((start, end, 1, _features(text, start, end, 1, ("parts", *("s" + s for s in sorted(separators))))))
                elif token in ("+", "(", ")", ".", "-", "/", "[", "]") or (token.isspace() and len(token) <= 2):
                    if token == "+" and j > i:
                        break
                    separators.add("\n" if "\n" in token else token.strip() or " ")
                else:
                    break
        if head.isalnum():
            signs = dots = 0
            spelt = False
            for j in range(i, len(tokens)):  # an address ends by its characters: spelt-out signs are many tokens
                _, end, token = tokens[j]
                if end - start > MAX_CHARS:
                    break
                low = token.lower()
                near = j and j + 1 < len(tokens) and tokens[j - 1][2] in ("(", "[", "{") and tokens[j + 1][2] in (")", "]", "}")
                if token == "@" or (low == "at" and near):
                    signs, spelt = signs + 1, spelt or token != "@"
                    if signs > 1:
                        break
                elif token == "." or (low == "dot" and near):
                    dots += signs
                    spelt |= low == "dot"
                elif token.isspace():
                    beside = {tokens[j - 1][2], tokens[j + 1][2] if j + 1 < len(tokens) else ""}
                    if not beside & {"(", "[", "{", ")", "]", "}", "@"} or "\n" in token:
                        break
                elif not (token.isalnum() or token in "_%+-()[]{}"):
                    break
                if signs == 1 and dots and token.isascii() and token.isalpha() and low not in ("at", "dot") and 2 <= len(token) <= 10:
                    ends = j + 1 == len(tokens) or not (tokens[j + 1][2] in (".", "-", "_") and j + 2 < len(tokens) and tokens[j + 2][2].isalnum())
                    out.append((start, end, 0, _features(text, start, end, 0, (f"spelt{spelt}", f"ends{ends}"))))
    return out


def _side(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "@.-+_()\"'=,;:" else "other"


def _features(text: str, start: int, end: int, kind: int, shape: tuple[str, ...]) -> tuple[str, ...]:
    before = text[max(0, start - 16):start]
    cue = _CUE.search(before)
    known = CUES.get(cue[1].lower()) if cue else None
    name = KINDS[kind]
    return (name, *(f"{name}|{s}" for s in shape), f"{name}|<{_side(before[-1:])}",
            f"{name}|>{_side(text[end:end + 1])}{_side(text[end + 1:end + 2])}", f"{name}|cue{known == name}")


class Model:
    """Weights of features and of pairs of kinds in a row (``none`` before the first)."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def lattice(self, found: list) -> tuple[list, list[int], list[float]]:
        """Candidates by end, the places where spans start or end, and scores."""
        found = sorted(found, key=lambda c: (c[1], c[0], c[2]))
        places = sorted({0, *(c[0] for c in found), *(c[1] for c in found)})
        return found, places, [self.score(c[3]) for c in found]

    def decode(self, found: list) -> list[Span]:
        """The best set of non-overlapping spans; the state at a place is the kind of the last span."""
        found, places, scores = self.lattice(found)
        none, get = len(KINDS), self.weights.get
        best = {places[0]: {none: (0.0, None)}}
        k = 0
        for p, q in zip(places, places[1:]):
            state = {s: (v, ("skip", p)) for s, (v, _) in best[p].items()}
            while k < len(found) and found[k][1] == q:
                start, _, kind, _ = found[k]
                for s, (v, _) in best[start].items():
                    total = v + scores[k] + get(f"pair{s}{kind}", 0.0)
                    if kind not in state or total > state[kind][0]:
                        state[kind] = (total, (k, start, s))
                k += 1
            best[q] = state
        spans, p = [], places[-1]
        s = max(best[p], key=lambda x: best[p][x][0])
        while (step := best[p][s][1]) is not None:
            if step[0] == "skip":
                p = step[1]
            else:
                c = found[step[0]]
                spans.append((c[2], c[0], c[1]))
                p, s = step[1], step[2]
        return spans[::-1]

    def gradient(self, found: list, gold: set[Span]) -> dict[str, float]:
        """Observed less expected features of a window, by forward and backward sums over all segmentations."""
        found, places, scores = self.lattice(found)
        n, none = len(KINDS) + 1, len(KINDS)
        pair = np.array([[self.weights.get(f"pair{s}{k}", 0.0) for k in range(n - 1)] for s in range(n)])
        index = {p: i for i, p in enumerate(places)}
        forward = np.full((len(places), n), -np.inf)
        forward[0, none] = 0
        ends: list[list[int]] = [[] for _ in places]
        for k, c in enumerate(found):
            ends[index[c[1]]].append(k)
        for i in range(1, len(places)):
            forward[i] = forward[i - 1]
            for k in ends[i]:
                start, kind = index[found[k][0]], found[k][2]
                forward[i, kind] = np.logaddexp(forward[i, kind], np.logaddexp.reduce(forward[start] + pair[:, kind]) + scores[k])
        backward = np.full((len(places), n), -np.inf)
        backward[-1] = 0
        starts: list[list[int]] = [[] for _ in places]
        for k, c in enumerate(found):
            starts[index[c[0]]].append(k)
        for i in range(len(places) - 2, -1, -1):
            backward[i] = backward[i + 1]
            for k in starts[i]:
                end, kind = index[found[k][1]], found[k][2]
                backward[i] = np.logaddexp(backward[i], pair[:, kind] + scores[k] + backward[end, kind])
        total = np.logaddexp.reduce(forward[-1])
        out: dict[str, float] = {}
        last = none
        for c in sorted(found, key=lambda c: c[0]):
            if (c[2], c[0], c[1]) in gold:
                for f in (*c[3], f"pair{last}{c[2]}"):
                    out[f] = out.get(f, 0.0) + 1
                last = c[2]
        for k, c in enumerate(found):
            each = np.exp(forward[index[c[0]]] + pair[:, c[2]] + scores[k] + backward[index[c[1]], c[2]] - total)
            p = float(each.sum())
            if p > 1e-6:
                for f in c[3]:
                    out[f] = out.get(f, 0.0) - p
                for s in np.flatnonzero(each > 1e-6):
                    f = f"pair{s}{c[2]}"
                    out[f] = out.get(f, 0.0) - float(each[s])
        return out


def altered(window: str, spans: list[Span]) -> list[tuple[str, set[Span]]]:
    """The window with its spans written in other ways, and where they are then."""
    def rewrite(change, after: str = "") -> tuple[str, set[Span]]:
        out, at, gold = [], 0, set()
        for kind, start, end in sorted(spans, key=lambda s: s[1]):
            if start < at:
                continue
            out.append(window[at:start])
            new = change(kind, window[start:end])
            begin = sum(map(len, out))
            gold.add((kind, begin, begin + len(new)))
            out += [new, after]
            at = end
        return "".join([*out, window[at:]]), gold

    def broken(kind: int, s: str) -> str:
        if kind == 2:
            digits = re.sub(r"\D", "", s)
            return digits[:6] + "\n" + digits[6:]
        return s.replace(" ", "\n", 1) if kind == 3 and s.count(" ") == 1 else "\n".join(s.rsplit(" ", 1)) if kind == 3 else s

    def spelt(kind: int, s: str) -> str:
        if kind == 0:
            return s.replace("@", " (at) ").replace(".", " (dot) ")
        if kind == 2:
            digits = re.sub(r"\D", "", s)
            return ".".join(digits[k:k + 4] for k in range(0, len(digits), 4))
        return s.replace(".", "[.]") if kind == 1 else s.removeprefix("+")

    def bracketed(kind: int, s: str) -> str:
        if kind == 2:
            digits = re.sub(r"\D", "", s)
            return "-".join(digits[k:k + 4] for k in range(0, len(digits), 4))
        return s.replace("@", "[at]") if kind == 0 else re.sub(r"^\+\d+ ", "", s) if kind == 3 else s

    return [*(rewrite(c) for c in (lambda k, s: s, broken, spelt, bracketed)), rewrite(spelt, "."), rewrite(bracketed, ".")]


def fit(examples: list[tuple[str, set[Span]]], epochs: int = EPOCHS, rate: float = 0.4, decay: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad, in a fixed order."""
    model, squares = Model(dict.fromkeys(KINDS, START)), {}
    ready = [(found, gold) for text, gold in examples if (found := candidates(text))]
    for _ in range(epochs):
        for found, gold in ready:
            for f, g in model.gradient(found, gold).items():
                g -= decay * model.weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / squares[f] ** 0.5
    return model


def chosen_windows(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The different windows of smallest hash: an eighth of ``sample`` with base spans of each kind, half of it without any.
    Tasks go through all texts and hand on only their smallest; a window of several kinds counts for each."""
    room = {kind: max(1, sample // (2 * len(KINDS))) for kind in range(len(KINDS))} | {-1: max(1, sample // 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict[int, str]] = {kind: {} for kind in room}
        for b in batches:
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                for low, high in windows(text):
                    if high - low <= 600:
                        window = text[low:high]
                        h = int.from_bytes(hashlib.blake2b(window.encode(), digest_size=8).digest(), "big", signed=True)
                        for kind in {k for k, s, e in spans if s >= low and e <= high} or {-1}:
                            least[kind][h] = window
            for kind, found in least.items():
                if len(found) > room[kind]:
                    least[kind] = {h: found[h] for h in heapq.nsmallest(room[kind], found)}
        rows = [(kind, h, window) for kind, found in least.items() for h, window in found.items()]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string()))], names=["kind", "h", "window"])

    found = texts(docs).select(TEXT).filter(F.col(TEXT).rlike("[0-9@]")).mapInArrow(run, "kind int, h long, window string").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h", "window"))
    most = F.element_at(F.create_map(*(F.lit(x) for pair in room.items() for x in pair)), F.col("kind"))
    rows = found.withColumn("place", place).filter(F.col("place") <= most).collect()
    return list(dict.fromkeys(r["window"] for r in sorted(rows, key=lambda r: (r["kind"] < 0, r["h"], r["window"]))))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the chosen windows."""
    examples = []
    for window in chosen_windows(docs, sample):
        spans = base_spans(window)
        examples += altered(window, spans) if spans else [(window, set())]
    examples += [(text, set()) for text in OTHERS] * 3
    return fit(examples) if any(gold for _, gold in examples) else Model()


def spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans."""
    base = base_spans(text)
    added: list[Span] = []
    if model.weights:
        taken = np.sort(np.array([(s, e) for _, s, e in base] or [(-1, -1)]), axis=0)
        starts, reach = taken[:, 0], np.maximum.accumulate(taken[:, 1])
        for low, high in windows(text):
            found = candidates(text[low:high])
            if found:
                for kind, s, e in model.decode(found):
                    s, e = s + low, e + low
                    before = int(np.searchsorted(starts, e, "left"))  # base spans that start before the end
                    if not (before and reach[before - 1] > s) and (not added or added[-1][2] <= s):
                        added.append((kind, s, e))
    return base, added


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(found))


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Counts of base spans, their checksum, all spans, and the number added, per document."""
    model = train(docs, sample)
    names = [ID, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = spans(text, model)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)))
            if rows:
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    schema = f"{ID} long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return texts(docs).mapInArrow(run, schema)


def redacted(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The same rows and columns with every span replaced by its kind; ``n_chars``, where there is one, follows the text."""
    model = train(docs, sample)
    at = docs.columns.index(TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if t is None else redacted(t, [x for part in spans(t, model) for x in part]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(TEXT)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
