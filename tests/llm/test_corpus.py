"""Operators that compare documents with one another, packing, and the pipeline."""

import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from revmatch.llm import decontaminate, packing, passages, pii, simhash, toxicity
from revmatch.llm.common import components, table
from revmatch.llm.text import BLOCK
from revmatch.llm.tokens import encoder, vocabulary_path
from tests.llm.helpers import awkward, nothing, words


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(1, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n in got} and all(n in got for n, r in want.items() if n != r)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- SimHash ----

def plain_fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    size = min(3, len(w))
    ones, n = [0] * 64, len(w) - size + 1
    for k in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(w[k:k + size]), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > n)


def check_simhash(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in texts]
    distinct = sorted(set(prints))
    arr = np.array(distinct, np.uint64)
    pairs = [(distinct[i], distinct[int(j)]) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1:]) <= 3) + i + 1]
    root = roots(pairs, distinct)
    low = {}
    for (i, _), p in zip(texts, prints):
        if i is not None:
            low[root[p]] = min(i, low.get(root[p], i))
    want = Counter((i, f"{p:016x}", low.get(root[p])) for (i, _), p in zip(texts, prints))
    assert Counter(tuple(r) for r in simhash.digest(docs).select("doc_id", "fingerprint", "component_id").collect()) == want
    return len(set(root.values()))


def test_simhash_against_all_pairs(spark, sf_dir):
    check_simhash(table(spark, sf_dir, "documents"))
    check_simhash(awkward(spark))
    assert simhash.digest(nothing(awkward(spark))).collect() == []


def test_simhash_keeps_one_of_each_group(spark):
    docs = awkward(spark)
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema and kept.count() == check_simhash(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 8 not in ids and ids.count(5) == 1


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_simhash_links_lose_nothing_in_hot_keys(spark, limit):
    rng = np.random.default_rng(4)
    base = int(rng.integers(1 << 62))
    found = {base}
    for _ in range(150):  # a chain of near fingerprints, and loners
        x = sorted(found)[int(rng.integers(len(found)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            x ^= 1 << int(b)
        found.add(x)
    found |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    arr = np.array(sorted(found), np.uint64)
    signed = arr.view(np.int64).tolist()
    pairs = [(signed[i], signed[int(j)]) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1:]) <= 3) + i + 1]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit=limit).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 * 64 for a, b in got)
    assert roots([tuple(r) for r in got], signed) == roots(pairs, signed)


# ---- decontamination ----

def test_decontaminate_finds_every_passage(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()}
    assert want <= got and len(got - want) <= 1
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items, block_chars=3000).collect()}
    assert blocks == got


def test_decontaminate_slots(spark):
    docs = spark.createDataFrame([
        (1, "x y. Anna bought 12 apples and 3 pears for her friend Tom in the old market of town yesterday. more"), (2, "nothing of the kind in here at all"),
        (3, None), (4, ""), (4, "and so Anna Bought 12 Apples"), (None, "Carl said that Zoe bought 7 apples and 8 pears for her friend Max in the old market of town yesterday")],
        "doc_id long, text string")
    items = spark.createDataFrame([
        (7, "Berta bought 44 apples and 9 pears for her friend Carl in the old market of town yesterday."),
        (8, "Berta bought 44 apples and 44 pears for her friend Carl in the old market of town yesterday."), (9, None), (10, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.find(docs, items).collect()}
    assert got == {(1, 7): True, (None, 7): True}
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()] == [2, 3, 4, 4]
    assert decontaminate.find(nothing(docs), items).collect() == [] and decontaminate.find(docs, nothing(items)).collect() == []
    assert decontaminate.find(awkward(spark), items).collect() == []


def test_decontaminate_copies_in_any_case_and_place(spark):
    items = ["Berlin hat viele schöne Parks", "Der Ärger Im Haus Der Familie Über Den Hund Der Nachbarn", "Was Bob Smith Here", "Rome fell",
             "12 13 14 Anna 15 16 17 18 Bob", "Marie asked why Paul and Anna left the town so soon after Easter"]
    rows, want = [], set()
    for k, item in enumerate(items):
        for c, copy in enumerate((item, item.lower(), item.upper())):
            for p, text in enumerate((copy, f"and then {copy} again", f"Yes.\n{copy}\nNo.")):
                rows.append((100 * k + 10 * c + p, text))
                want.add((rows[-1][0], k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.find(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and not any(r["reparameterised"] for r in got)
    assert decontaminate.keep_clean(docs, benchmark).collect() == []


# ---- repeated passages ----

def check_passages(docs, least=51):
    texts = {(r["doc_id"], r["text"]): words(r["text"]) for r in docs.collect()}
    where = defaultdict(set)
    for key, w in texts.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k:k + least])].add(key)
    got = passages.digest(docs).collect()
    losing = {r["doc_id"] for r in got}
    for holders in where.values():
        if len({k[0] for k in holders}) > 1:
            assert {k[0] for k in holders} - {min(k[0] for k in holders)} <= losing
    short = defaultdict(set)
    for key, w in texts.items():
        for k in range(len(w) - 24):
            short[tuple(w[k:k + 25])].add(key)
    sharing = {k[0] for holders in short.values() if len(holders) > 1 for k in holders}
    assert losing <= sharing and all(set(r["keepers"]) <= sharing for r in got)


def test_passages(spark, sf_dir):
    check_passages(table(spark, sf_dir, "documents"))
    assert passages.digest(awkward(spark)).collect() == []
    assert passages.digest(nothing(awkward(spark))).collect() == []


@pytest.mark.parametrize("limit", [2, 256])
def test_passages_inside_lines_and_near_ones(spark, limit, monkeypatch):
    monkeypatch.setattr(passages, "LIMIT", limit)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, common = some(52), some(12)
    rows = [(k, f"{some(40)} {passage} {some(30)}") for k in (3, 9)] + [(20 + k, f"{some(25)} {common} {some(25)}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(passages.links, "__defaults__", (limit,))
    got = passages.find(docs).collect()
    assert [(r["doc_id"], r["keepers"]) for r in got] == [(9, [3])]
    start, stop = map(int, got[0]["spans"].split(":"))
    assert rows[1][1][start:stop] in passage
    out = {r["doc_id"]: r["text"] for r in passages.remove(docs).collect()}
    assert len(out) == len(rows) and out[3] == rows[0][1] and out[9] == rows[1][1][:start] + rows[1][1][stop:]


def test_passages_are_lost_wherever_a_document_repeats_them(spark):
    rng = np.random.default_rng(10)
    some = lambda n: " ".join(str(x) for x in rng.integers(0, 10**6, n))
    passage = some(52)
    rows = [(1, f"{some(40)}\n{passage}\n{some(40)}"), (2, f"{some(40)}\n{passage}\n{some(40)}\n{passage}\n{some(9)} {passage} {some(40)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.find(docs).collect()
    assert [(r["doc_id"], len(r["spans"].split(","))) for r in got] == [(2, 3)]
    gone = {rows[1][1][int(s):int(e)] for s, e in (x.split(":") for x in got[0]["spans"].split(","))}
    left = {r["doc_id"]: r["text"] for r in passages.remove(docs).collect()}
    assert left[1] == rows[0][1] and not any(x in left[2] for x in gone)


def test_passages_edited_and_short_lines(spark):
    rng = np.random.default_rng(11)
    some = lambda n: [str(x) for x in rng.integers(0, 10**6, n)]
    rows, kinds = [], [(50, 1), (60, 1), (70, 1), (100, 2), (300, 5), (27, 0), (40, 0)]
    for kind, (n, edits) in enumerate(kinds):
        for k in range(40):
            a = some(n)
            b = list(a)
            for e in range(edits):
                b[(e + 1) * n // (edits + 1)] = "edited"
            for side, line in enumerate((a, b)):
                rows.append((2 * (100 * kind + k) + side, "\n".join(map(" ".join, (some(28), line, some(33))))))
    got = {r["doc_id"]: r["keepers"] for r in passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(k % 2 and v == [k - 1] for k, v in got.items())
    for kind, (n, edits) in enumerate(kinds):
        found = sum(2 * (100 * kind + k) + 1 in got for k in range(40))
        assert found == 40 if not edits else found >= 37, (n, edits, found)


def similar(a, b):
    x, y = ({tuple(w[k:k + passages.SHINGLE]) for k in range(len(w) - passages.SHINGLE + 1)} for w in (a, b))
    return len(x & y) / len(x | y) >= passages.SIMILAR


def changed(a, places):
    return [f"new{w}" if k in places else w for k, w in enumerate(a)]


def test_passages_linked_over_a_third_text(spark):
    """Lines of several documents and chains inside one document, against components of all pairs."""
    rng = np.random.default_rng(13)
    some = lambda n: [str(x) for x in rng.integers(0, 10**6, n)]
    rows, held = [], {}
    for case in range(60):
        c = some(98)
        b = changed(c, {25, 75})
        a = changed(b, {10, 50})
        assert similar(a, b) and similar(b, c) and not similar(a, c)
        for side, text in enumerate(([c], [b, a])):
            held[2 * case + side] = text
            rows.append((2 * case + side, "\n".join(map(" ".join, [some(30), *text, some(30)]))))
    lines = [(d, k) for d, v in held.items() for k in range(len(v))]
    root = {x: x for x in lines}
    for x in lines:  # lines are in order of documents, so the smallest is the root
        for y in lines:
            if x < y and similar(held[x[0]][x[1]], held[y[0]][y[1]]):
                low, high = sorted((root[x], root[y]))
                root = {k: low if v == high else v for k, v in root.items()}
    want = {x for x in lines if root[x][0] != x[0]}
    assert len(want) == 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in passages.remove(docs).collect()}
    gone = {x for x in lines if " ".join(held[x[0]][x[1]]) not in left[x[0]]}
    assert gone <= want and len(gone) >= 0.95 * len(want), len(gone)


def test_passages_stay_in_some_document(spark):
    """What is lost for an equal content stays with a document before, word by word; else the keeper has another content of the component."""
    rng = np.random.default_rng(14)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, edited = [], {}
    for case in range(20):
        c = some(200)
        b = changed(c, {40, 80, 120, 160})
        inside = [*some(20), *b[30:140], *some(20)]
        after = [*some(40), *b[60:180], *some(9)]
        for side, text in enumerate(([c], [b], [inside], [after], [b[:100], b[100:]])):
            rows.append((10 * case + side, "\n".join(map(" ".join, [some(30), *text, some(30)]))))
        edited[case] = {b[k] for k in (40, 80, 120)}
    docs, texts = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    lost = passages.repeats(docs).collect()
    left = {r["doc_id"]: set(r["text"].split()) for r in passages.remove(docs).collect()}
    kept, near, around = set().union(*left.values()), set(), 0
    for r in lost:
        assert r["keeper"] < r["doc_id"]
        part = texts[r["doc_id"]][r["start"]:r["stop"]].split()
        if " ".join(part) not in texts[r["keeper"]]:  # lost for another content of its component
            near |= set(part)
        assert r["keeper"] % 10 != 1  # the second text loses its line, so it keeps nothing
    for doc, text in texts.items():
        words_of = set(text.split())
        if doc % 10 == 1:
            assert not words_of & edited[doc // 10] & left[doc]
        else:
            assert words_of - kept <= near
            around += sum(not w.startswith("new") for w in words_of - kept)
    stay = sum(len(v & kept) for v in edited.values())
    assert stay >= 40 and around <= 40, (stay, around)  # of 60 changed words; the others are lost with windows that have a similar one in the first text


def test_hot_bands_and_hot_passages(spark, monkeypatch):
    rng = np.random.default_rng(15)
    some = lambda n: " ".join(str(x) for x in rng.integers(0, 10**6, n))
    passage = some(60)
    rows = [(k, f"{some(30)}\n{passage}\n{some(30)}") for k in range(300)]
    rows += [(k, "\n".join([some(30), *[" ".join(changed(passage.split(), {59}))] * 2])) for k in range(300, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    take = lambda: sorted((r["doc_id"], r["spans"], r["keepers"]) for r in passages.find(docs).collect())
    usual = take()
    assert [r[0] for r in usual] == list(range(1, 320))
    monkeypatch.setattr(passages, "HOT", 1)
    assert take() == usual


def test_reached_paragraphs():
    keys = np.array([[1, 9], [1, 5], [6, 5], [7, 8], [1, 8]], np.uint64)
    flags = np.array([[4, 2], [4, 4], [0, 4], [0, 4], [4, 4]], np.uint8)
    assert passages._reached(flags, keys, np.zeros(5, int)).tolist() == [True] * 5
    assert passages._reached(flags, keys, np.array([0, 0, 0, 1, 1])).tolist() == [True, True, True, False, False]


def test_anchors_depend_on_the_words_around(spark):
    from revmatch.llm.text import Words

    rng = np.random.default_rng(2)
    for _ in range(30):
        passage = [str(x) for x in rng.integers(0, 10**6, 51)]
        ends = set()
        for _ in range(2):
            front, back = ([str(x) for x in rng.integers(0, 10**6, int(rng.integers(0, 60)))] for _ in range(2))
            data = " ".join([*front, *passage, *back]).encode()
            p = passages.Paragraphs(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
            inside = {int(c) for a, c in zip(p.at, p.content) if len(front) <= a <= len(front) + 51 - passages.SIZE}
            assert inside
            ends.add(frozenset(inside))
        assert set.intersection(*map(set, ends))


def test_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, (200, passages.SHINGLES)).astype(np.uint64), rng.integers(0, 30, (200, passages.SHINGLES)).astype(np.uint64)
    want = [len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in zip(a.tolist(), b.tolist())]
    assert np.allclose(passages.jaccard(a, b), want)


def test_shingles_of_short_hashes():
    rng = np.random.default_rng(16)
    words_of = [rng.integers(0, 9, n).astype(np.uint32) for n in (30, 25, 61, 30)]
    got = passages._Shingles.of_words([w.tobytes() for w in words_of])
    assert got.size.tolist() == [26, 21, 57, 26]
    seen = {}
    for k, w in enumerate(words_of):
        for i, value in enumerate(got.values[got.first[k]:got.first[k + 1]].tolist()):
            assert seen.setdefault(value, tuple(w[i:i + 5])) == tuple(w[i:i + 5])
    assert len(set(seen.values())) == len(seen) and len(passages._Shingles.of_words([])) == 0


def test_overlap_of_any_length():
    rng = np.random.default_rng(4)
    raw = [rng.integers(0, 40, int(n)).astype(np.uint64) for n in rng.integers(1, 90, 60)]
    a, b = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    want = [len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in ((raw[i].tolist(), raw[j].tolist()) for i, j in zip(a, b))]
    rows = passages._Shingles.of([x.tobytes() for x in raw])
    assert np.allclose(rows._overlap(a, b), want)
    assert rows.similar(a, b).tolist() == [w >= passages.SIMILAR for w in want]


# ---- packing ----

def check_packing(docs, got):
    encode = encoder(vocabulary_path()).ids
    ids = Counter((r["doc_id"], encode(r["text"] or "") + b"\0\0\0\0") for r in docs.collect())
    pieces = defaultdict(Counter)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"], r["ids_crc32"]] += 1
    for (i, data), times in ids.items():  # every id lies in one piece
        total, own = len(data) // 4, pieces[i, len(data) // 4]
        covered = np.zeros(total, int)
        for (s, n, crc), k in own.items():
            if zlib.crc32(data[4 * s:4 * (s + n)]) == crc:
                covered[s:s + n] += k
        assert (covered == times).all()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding, sum(r["length"] for r in got)


def test_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    padding, tokens = check_packing(docs, packing.pack(docs).collect())
    assert padding < 0.02 * tokens
    check_packing(docs, packing.pack(docs.repartition(5), group=40).collect())
    check_packing(awkward(spark), packing.pack(awkward(spark)).collect())
    assert packing.pack(nothing(docs)).collect() == []
    with_ids = packing.pack(awkward(spark), with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(6)
    for _ in range(50):
        sizes = sorted(rng.integers(1, 100, int(rng.integers(1, 80))).tolist(), reverse=True)
        bins: list[int] = []
        want = []
        for n in sizes:
            k = next((k for k, free in enumerate(bins) if free >= n), len(bins))
            if k == len(bins):
                bins.append(100)
            want.append((k, 100 - bins[k]))
            bins[k] -= n
        assert list(zip(*packing.first_fit(sizes, 100))) == want
    assert packing.first_fit([], 100) == ([], [])


def test_packing_holds_few_texts_at_a_time(monkeypatch):
    """One Arrow batch of 6 MB goes out in parts, each with the ids of about a megabyte of text."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    texts = ["the quick brown fox " * 300 for _ in range(1000)]
    batch = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    path = packing.vocabulary_path()
    out = list(packing._cut(path, 1024, True)(iter([batch, batch.slice(0, 0)])))
    plain = packing.encoder(path).ids(texts[0]) + b"\0\0\0\0"
    whole = pa.Table.from_batches(out)
    assert len(out) > 4 and max(len(b"".join(b.column("ids").to_pylist())) for b in out) <= 2 * BLOCK * len(plain) // len(texts[0])
    got = {}
    for r in whole.to_pylist():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert len(got) == 1000 and all(b"".join(ids for _, ids in sorted(v)) == plain for v in got.values())
    own = [x for x in whole.column("sequence_id").to_pylist() if x is not None]
    assert len(own) == len(set(own)) > 0


# ---- pipeline ----

def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rate = toxicity.scorer(docs, table(spark, sf_dir, "labels"))
    import pyarrow as pa

    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near-duplicates", "decontamination", "personal-data", "packing"]
    rows = docs.collect()
    scores = rate(pa.array([r["text"] for r in rows]))
    now = stage["toxicity"](spark, docs, sf_dir)
    assert now.schema == docs.schema and Counter(now.collect()) == Counter(r for r, s in zip(rows, scores) if s < toxicity.THRESHOLD)
    after = stage["near-duplicates"](spark, now, sf_dir)
    component = {r["doc_id"]: r["component_id"] for r in simhash.digest(now).collect()}
    assert {r["doc_id"] for r in after.collect()} == set(component.values()) and after.schema == docs.schema
    clean = stage["decontamination"](spark, after, sf_dir)
    hit = {r["doc_id"] for r in decontaminate.find(after, table(spark, sf_dir, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in after.collect()} - hit
    hidden = stage["personal-data"](spark, clean, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in hidden.collect()}
    model = pii.train(clean)
    assert hidden.columns == docs.columns and texts == {r["doc_id"]: pii.redacted(r["text"], sum(pii.spans(r["text"], model), [])) for r in clean.collect()}
    check_packing(hidden, stage["packing"](spark, hidden, sf_dir).collect())


def test_pipeline_run_and_awkward_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing(docs), sf_dir).count() == 0
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0


def test_entries_of_a_batch_are_found_without_a_search():
    """Order by key, then content, as by sorting both; every paragraph's band key leads to its own entry, and the second pass makes no bands."""
    rng = np.random.default_rng(7)
    for n, top in ((0, 2), (1, 2), (500, 40), (500, 1 << 60)):
        key, content = rng.integers(0, top, n, dtype=np.uint64), rng.integers(0, 5, n, dtype=np.uint64)
        order = passages.ordered(key, content)
        assert sorted(order.tolist()) == list(range(n))
        best = np.lexsort((content, key))
        assert (key[order] == key[best]).all() and (content[order] == content[best]).all()
    from revmatch.llm.text import Words

    data = " ".join(f"w{k % 90}" for k in range(400)).encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    full, bare = passages.Paragraphs(w), passages.Paragraphs(w, banded=False)
    assert (full.content == bare.content).all() and len(full.keys[0]) == len(full.at) and not len(bare.keys[0])
