"""Operators that work on each row: quality, toxicity, personal data, extraction, counts."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from revmatch.llm import counts, extract, pii, quality, toxicity
from revmatch.llm.common import table
from revmatch.llm.tokens import encoder, vocabulary_path
from tests.llm.helpers import awkward, nothing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality ----

def plain_quality(text):
    text = text or ""
    w, seen, repeated_lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    twice = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated_lines, len(twice), failed


def check_quality(docs):
    want = Counter((r["doc_id"], *plain_quality(r["text"])) for r in docs.collect())
    got = quality.digest(docs).collect()
    assert want == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    return got


def test_quality_counts(spark, sf_dir):
    check_quality(awkward(spark))
    assert quality.digest(nothing(awkward(spark))).collect() == []


def test_quality_agrees_with_labels(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    got = check_quality(table(spark, sf_dir, "documents"))
    good = [r["kept"] for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in got if labels.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_quality_is_more_than_all_must_pass(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.1"), "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir.replace("0.001", "0.1"), "labels").collect()}
    got = quality.judge(docs).collect()
    accused = lambda r: any(r[x] == 0 for x in quality.RULES)
    assert any(r["kept"] and accused(r) for r in got) and not any(r["base_failed"] and r["kept"] for r in got)
    known = [(labels[r["doc_id"]] == 1, r["kept"], not r["base_failed"] and not accused(r)) for r in got if labels.get(r["doc_id"]) is not None]
    assert sum(a == b for a, b, _ in known) > sum(a == c for a, _, c in known)
    assert all(r["kept"] for r in got if not r["base_failed"] and not accused(r))


def test_quality_em_weighs_rules_by_what_the_others_say():
    """A rule that accuses good documents as often as bad ones does not decide; two that agree do."""
    rng = np.random.default_rng(5)
    good = rng.random(30000) < 0.9
    votes = np.full((30000, 4), np.nan)
    for k in range(3):
        votes[rng.random(30000) < np.where(good, 0.002, 0.7), k] = 0
        votes[np.isnan(votes[:, k]) & (rng.random(30000) < 0.8), k] = 1
    votes[:, 3] = np.where(rng.random(30000) < 0.02, 0, 1)
    patterns, of, n = np.unique(np.nan_to_num(votes, nan=-1), axis=0, return_inverse=True, return_counts=True)
    post, _, _ = quality.fit(np.where(patterns < 0, np.nan, patterns), n.astype(float))
    post = post[of.ravel()]
    assert (post[(votes == [1, 1, 1, 0]).all(1)] > 0.5).all() and (post[(votes[:, :2] == 0).all(1)] < 0.5).all()
    assert ((post > 0.5) == good).mean() > 0.97


def test_quality_em_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    votes = np.full((20000, 4), np.nan)
    for k, right in enumerate((0.95, 0.9, 0.85, 0.9)):
        bad_vote = ~good & (rng.random(20000) < right) | good & (rng.random(20000) < 0.001)
        votes[bad_vote, k] = 0
        votes[~bad_vote & (rng.random(20000) < 0.5), k] = 1
    patterns, of, n = np.unique(np.nan_to_num(votes, nan=-1), axis=0, return_inverse=True, return_counts=True)
    post, share, acc = quality.fit(np.where(patterns < 0, np.nan, patterns), n.astype(float))
    assert ((post[of] > 0.5) == good).mean() > 0.98 and abs(share - 0.8) < 0.03 and acc.shape == (4, 2)


# ---- toxicity ----

def test_toxicity_held_out(spark, sf_dir):
    docs, labels = table(spark, sf_dir.replace("0.001", "0.01"), "documents"), table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    got = toxicity.scores(docs, labels).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    right = [r["predicted"] == toxic[r["doc_id"]] for r in held]
    assert sum(right) > 0.9 * len(right)  # a few hundred labels in four languages


def test_toxicity_ignores_held_out_labels_and_other_columns(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    as_map = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    assert as_map(toxicity.scores(docs, labels)) == as_map(toxicity.scores(docs.selectExpr("doc_id", "text", "'x' as lang"), flipped))


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    assert len(toxicity.scores(docs, labels).collect()) == docs.count()
    assert {r["score"] for r in toxicity.scores(docs, nothing(labels)).collect()} == {0.0}
    assert toxicity.scores(nothing(docs), labels).collect() == []
    assert toxicity.keep_clean(docs, nothing(labels)).schema == docs.schema


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = toxicity.boost(x, y, trees=60)
    m = toxicity.margins(x, model)
    assert ((m > 0) == y).mean() > 0.97
    at, p = toxicity.isotonic(m, y)
    assert (np.diff(p) >= 0).all() and (np.diff(at) >= 0).all()


# ---- personal data ----

def plain_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in re.sub(r"\D", "", m[0])][::-1]
        if 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans_fuzzed():
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice("1234567890..@@ab-+ ()\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


def check_pii(docs):
    texts = docs.collect()
    got = pii.find(docs).collect()
    digest = lambda t: hashlib.sha256(pii.listed(plain_spans(t or "")).encode()).hexdigest()
    assert Counter((r["doc_id"], digest(r["text"])) for r in texts) == Counter((r["doc_id"], r["base_sha256"]) for r in got)
    for r in got:
        assert len([x for x in r["spans"].split(",") if x]) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]


def test_pii(spark, sf_dir):
    check_pii(table(spark, sf_dir, "documents"))
    check_pii(awkward(spark))
    assert pii.find(nothing(awkward(spark))).collect() == []


def test_pii_finds_altered_forms(spark, sf_dir):
    model = pii.train(table(spark, sf_dir.replace("0.001", "0.01"), "documents"))
    found = lambda t: pii.listed(pii.spans(t, model)[1])
    assert found("+1 (377)\n555-0271") == "phone:0:17"
    assert found("so john.doe (at) mail7.example.com wrote") == "email:3:34"
    assert found("on 2024-01-15 we met 12 times, room 101") == ""
    assert found('token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"') == ""


def test_pii_recall_of_altered_forms(spark, sf_dir):
    """Every altered form of base spans in windows that training has not seen, and what is added where nothing is."""
    docs = table(spark, sf_dir.replace("0.001", "0.1"), "documents")
    known = set(pii.chosen_windows(docs))
    model = pii.train(docs)
    unseen = list(dict.fromkeys(w for r in docs.select("text").filter("text rlike '[0-9@]'").collect()
                                for a, b in pii.windows(r["text"] or "") if b - a <= 600 and (w := r["text"][a:b]) not in known))
    right, every, wrong, plain = Counter(), Counter(), 0, 0
    for window in unseen[:3000]:
        base = pii.base_spans(window)
        if not base:
            plain, wrong = plain + 1, wrong + len(pii.spans(window, model)[1])
            continue
        for form, (text, gold) in enumerate(pii.altered(window, base)):
            found = {x for part in pii.spans(text, model) for x in part}
            for span in gold:
                every[form, span[0]] += 1
                right[form, span[0]] += span in found
    assert {k for _, k in every} == set(range(4)) and all(right[k] >= 0.9 * every[k] for k in every), {k: (right[k], every[k]) for k in every}
    assert wrong <= 0.02 * plain, (wrong, plain)


def test_pii_gradient_is_that_of_the_likelihood():
    text, gold = "call +1 (377) 555-0271 or a@b.org", {(3, 5, 22), (0, 26, 33)}
    found = pii.candidates(text)
    model = pii.Model({f: 0.1 * (k % 7 - 3) for k, f in enumerate(sorted({f for c in found for f in c[3]}))})

    def log_likelihood(m):
        spans = sorted(found, key=lambda c: c[1])

        def walk(at, last):  # every segmentation, one by one
            yield 0.0, ()
            for c in spans:
                if c[0] >= at:
                    s = m.score(c[3]) + m.weights.get(f"pair{last}{c[2]}", 0.0)
                    for rest, chosen in walk(c[1], c[2]):
                        yield s + rest, ((c[2], c[0], c[1]), *chosen)
        everything = list(walk(0, len(pii.KINDS)))
        total = np.logaddexp.reduce([s for s, _ in everything])
        return next(s for s, chosen in everything if set(chosen) == gold) - total

    gradient = model.gradient(found, gold)
    for f in list(gradient)[:12]:
        up, down = pii.Model(dict(model.weights)), pii.Model(dict(model.weights))
        up.weights[f] = up.weights.get(f, 0) + 1e-5
        down.weights[f] = down.weights.get(f, 0) - 1e-5
        assert abs((log_likelihood(up) - log_likelihood(down)) / 2e-5 - gradient[f]) < 1e-4


def test_redact(spark):
    docs = awkward(spark)
    got = pii.redact(docs)
    assert got.schema == docs.schema
    text = next(r for r in got.collect() if r["doc_id"] == 9)
    assert text["text"] == "mail <EMAIL> or <PHONE> or <IP>" and text["n_chars"] == len(text["text"])


def test_pii_windows_are_different_and_of_every_kind(spark):
    rows = [f"text {k} mail a{k}@b.org" for k in range(300)] + ["the footer of all, mail us@site.org"] * 3000
    rows += [f"plain text number {k}" for k in range(13000)] + ["host 10.1.2.3 here", "call +1 (555) 555-0100 now", "card 4111 1111 1111 1111 paid"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = pii.chosen_windows(docs)
    assert len(got) == len(set(got)) and got == pii.chosen_windows(docs.repartition(7))
    kinds = Counter(k for w in got for k in {k for k, _, _ in pii.base_spans(w)})
    assert kinds == {0: 75, 1: 1, 2: 1, 3: 1} and got == pii.chosen_windows(docs.unionByName(docs))


# ---- extraction ----

def test_extract_articles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_extract_other_layouts(spark):
    page = """<body><div class="page"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div><main><article class="post">
        <header><h1>Title &amp; more</h1></header><p>First para, and so on.</p><div class="ad-box">Buy now!</div><p>Second <a href=x>linked</a> para
        of   text.<ul><li>one</li></ul><form><label>Mail</label></form><section id="comments"><article><p>Nice one, I like it.</p></article></section>
        </article></main><aside>Side text</aside><footer>foot</footer></div>"""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>unclosed <b>text <!-- never ends"), (4, "u", "plain text only, of some words."),
                                   (5, "u", "<script>var a = '<p>';</script>"), (6, "u", "<a href=\"x>broken quote</a><p>Text after it.")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    assert got[1] == "Title & more\nFirst para, and so on.\nSecond linked para of text.\none"
    assert got[2] == "" and got[3] == "" and got[5] == ""
    assert extract.extract(nothing(pages)).collect() == []


@pytest.mark.parametrize("opening", ["<div class='content has-sidebar'>", "<div class='with-comments'>", "<div class='post tags-x'>", "<main class='no-sidebar'>",
                                     "<div class='side'>", "<div id='register'>", "<div class='layout-more'>"])
@pytest.mark.parametrize("article", ["<article>", "<article class='post'>"])
def test_extract_layout_wrappers(opening, article):
    tag = opening[1:5].strip()
    page = f"""<body><nav>Home</nav>{opening}{article}<div class='post-header'><h1>The heading</h1></div><div class='header'><h2>Below</h2></div>
        <p>A first sentence, of some words.</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p></article>
        <div class='sidebar'>Links</div><div id='comments'><article><p>Nice one.</p></article></div></{tag}><footer>foot</footer></body>"""
    assert extract.main_text(page, extract.PLAIN) == "The heading\nBelow\nA first sentence, of some words.\nSo x=1 here."


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(2, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda labels: sum(abs(o) for o, c in zip(odds, labels) if (o > 0) != c) + sum(c for i, j, c in edges if labels[i] != labels[j])
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(extract.min_cut(odds, edges)) - best) < 1e-9


# ---- token counts ----

PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "é", ".", ", ", "!", " ", "　", "\x1c", "日本", "<|endoftext|>", " b", " c d"]


def test_counts_follow_edits():
    encode, rng = encoder(vocabulary_path()), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        tree = counts.Tree(encode, text)
        assert tree.tokens == len(encode.ordinary(text))
        edits, done, out, at = [], 0, [], 0
        for _ in range(rng.randint(1, 3)):
            a = rng.randint(done, len(text))
            b = rng.randint(a, min(len(text), a + 6))
            edits.append((a, b, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 3)))))
            done = b
        new = tree.apply(edits)
        for s, e, x in sorted(edits):
            out += [text[at:s], x]
            at = e
        assert new == "".join([*out, text[at:]]) and tree.tokens == len(encode.ordinary(new)) == tree.sums[tree.leaves:].sum()


def test_ids_are_those_of_the_json_vocabulary():
    from tokenizers import Tokenizer

    plain, encode, rng = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), encoder(vocabulary_path()), random.Random(6)
    some = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|><|endoftext|> c", "x <|endoftext|", "<|ENDOFTEXT|> <| endoftext|>"]
    some += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for text in some:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == want
        assert counts.Tree(encode, text).tokens == len(want)
    assert 50256 in np.frombuffer(encode.ids(some[0]), "<u4")


def test_counts_of_a_table(spark, sf_dir):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    size = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    for docs in (table(spark, sf_dir, "documents"), awkward(spark)):
        texts = Counter((r["doc_id"], size(r["text"] or "")) for r in docs.collect())
        got = counts.recount(docs, with_text=True).collect()
        assert Counter((r["doc_id"], r["tokens_before"]) for r in got) == texts
        assert all(r["tokens_after"] == size(r["text"]) for r in got if r["n_edits"])
    assert counts.recount(nothing(awkward(spark))).collect() == []


@pytest.mark.parametrize("text", ["a@" * 20000, "1" * 50000, "1." * 20000, "+1 " * 20000, "<" * 50000, "&" * 50000])
def test_long_awkward_texts_end(text):
    pii.base_spans(text)
    extract.main_text(text, extract.PLAIN)
    counts.cleaning_edits(text)


# ---- token ids ----

def test_a_mark_behind_a_word_asks_the_tokenizer_nothing():
    """Ids of parts that end in one mark are put together from their word's, and are those of ``tokenizers`` on the whole text."""
    from tokenizers import Tokenizer

    from revmatch.llm import tokens

    fast, asked = tokens.Encoder(vocabulary_path()), []
    for parts in (fast.first, fast.rest):
        parts.encode = lambda t: asked.append(t) or fast.ordinary(t)
    whole = Tokenizer.from_file(fast.json)
    texts = ["zebra zebra, zebra. zebra; zebra: zebra! zebra?", "Hi, you. e1, é. 中, ²: ٣; x́, don't, we'll. 's, '. ., a!? b", "ok<|endoftext|>, a.\n.b\nc, d", "a\tb. c\x1cd, e", "", ", a", "a  b,", "a, "]
    for t in texts:
        assert np.frombuffer(fast.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert sum("zebra" in t for t in asked) == 2  # at the start of a line and behind a space
    assert [fast.regular(t) for t in ["", "a b", "a\tb\nc", " a", "a ", "a  b", "a 　b", "\n"]] == [True] * 3 + [False] * 5
