"""Language model, toxicity and URL trees: formulas by brute force, held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_data import prose
from pyspark.sql import functions as F

from varimill.llm import quality_model, toxicity, url_filter


def folded(text):
    raw = bytearray((text or "").encode())
    for i, b in enumerate(raw):
        if 48 <= b <= 57:
            raw[i] = 48
        elif b in (9, 10, 11, 12, 13):
            raw[i] = 32
    out = bytearray()
    for i, b in enumerate(raw):
        if b != 32 or i == 0 or raw[i - 1] != 32:
            out.append(b)
    return b"    " + bytes(out), len(out)


class KneserNey:
    """Modified Kneser-Ney written from its definition."""

    def __init__(self, texts, order=5):
        self.order = order
        top = Counter()
        for text in texts:
            raw, n = folded(text)
            for i in range(len(raw) - n, len(raw)):
                top[raw[i - order + 1 : i + 1]] += 1
        self.levels = {order: top}
        for size in range(order - 1, 0, -1):
            level = Counter()
            for gram in self.levels[size + 1]:
                level[gram[1:]] += 1
            self.levels[size] = level
        self.cut, self.total, self.left = {}, {}, {}
        for size, level in self.levels.items():
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            usual = {1: 0.5, 2: 1.0, 3: 1.5}
            d = {}
            for i in (1, 2, 3):
                raw = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else usual[i]
                d[i] = max(min(raw, i - 0.05), 0.05)
            total, left = Counter(), defaultdict(float)
            for gram, c in level.items():
                total[gram[:-1]] += c
                left[gram[:-1]] += min(d[min(c, 3)], c)
            self.cut[size], self.total[size], self.left[size] = d, total, left

    def p(self, gram):
        if not gram:
            return 1 / 256
        size, context = len(gram), gram[:-1]
        lower = self.p(gram[1:])
        total = self.total[size].get(context)
        if not total:
            return lower
        c = self.levels[size].get(gram, 0)
        own = max(c - min(self.cut[size][min(c, 3)], c), 0) / total if c else 0
        return own + self.left[size][context] / total * lower

    def bits(self, text):
        raw, n = folded(text)
        return -sum(math.log2(self.p(raw[i - 4 : i + 1])) for i in range(len(raw) - n, len(raw))), n


@pytest.mark.parametrize("shard_rows", [10**6, 60])
def test_bits_equal_brute_force(docs_of, shard_rows):
    rng = random.Random(1)
    texts = {"en": [prose(rng, 40) for _ in range(12)] + ["a 12\n\n b"], None: ["zz é zz", "qé zz qé"]}
    rows = [(i, t, lang, "s", 0) for lang in texts for i, t in enumerate(texts[lang])]
    model = quality_model.kneser_ney(quality_model.count_ngrams(docs_of(rows)))
    other = ["tar lo 99  x", "", None, "ZZZZ", prose(rng, 20), "é" * 30]
    asked = [(i, t, lang, "s", 0) for lang in ("en", None, "xx") for i, t in enumerate(other)]
    got = quality_model.score(docs_of(asked), model, shard_rows=shard_rows).collect()
    plain = {lang: KneserNey(texts[lang]) for lang in texts}
    assert len(got) == len(asked)
    for r in got:
        if r.lang == "xx":
            assert r.bits == pytest.approx(8 * r.n_bytes)
            continue
        bits, n = plain[r.lang].bits(r.text)
        assert r.n_bytes == n and r.bits == pytest.approx(bits, rel=2e-4, abs=1e-3)


def test_probabilities_sum_to_one():
    model = KneserNey(["abracadabra abra", "cadabra"])
    for context in (b"", b"a", b"abra", b"zzzz", b"   a"):
        assert sum(model.p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_junk_goes_and_prose_stays(spark, docs_of):
    rng = random.Random(2)
    good = [(i, prose(rng, 60), "en", "s", 0) for i in range(150)]
    junk = [(1000 + i, prose(rng, 60).upper().replace(" ", "## "), "en", "s", 0) for i in range(30)]
    rest = [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (2002, "anything", "xx", "s", 0)]
    trusted = spark.range(100).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r for r in quality_model.classify(docs_of(good + junk + rest), trusted).collect()}
    assert sum(got[i].kept for i in range(150)) >= 148
    assert not any(got[1000 + i].kept for i in range(30))
    assert not got[2000].kept and not got[2001].kept and got[2002].kept
    assert got[2002].threshold is None and got[2000].perplexity is None


def letters():
    text = "idiot idiots the moron clown slow worthless people talk about things " * 20
    counts = np.zeros((27, 27, 27))
    code = [toxicity._letter(c) for c in text]
    for a, b, c in zip(code, code[1:], code[2:], strict=False):
        counts[a, b, c] += 1
    return toxicity.letter_model(counts)


@pytest.mark.parametrize(
    "token, word",
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("idiooooot", "idiot"), ("c1own", "clown"), ("i d i o t", "idiot"),
     ("w0rth1e$s", "worthless"), ("i.d.i.o.t", "idiot"), ("people", "people")],
)
def test_hidden_words_are_restored(token, word):
    assert toxicity.restore(token, letters()) == word


HIDDEN = (
    "i.d.i.o.t i-d-i-o-t s-t-u-p-i-d i_d_i_o_t m*o*r*o*n st-upid $tupid 1diot @sshole idi0+ $tup1d! (1diot) 1diot!! idi0+!! "
    "l0ser€ stup|d idiot€ m.0.r.0.n"
).split(" ") + [
    "1 d 1 0 t", "such a m o r o n", "$ t u p i d", "i d i o t !", "i\td\ti\to\tt", "m-0-r-0-n", "i d i o t", "you m.o.r.o.n, go",
]


def test_hidden_spellings_reach_the_score(docs_of):
    insults = ["idiot", "moron", "stupid", "asshole", "loser"]
    counts = np.zeros((27, 27, 27))
    code = [toxicity._letter(c) for c in "idiot idiots the moron stupid asshole loser people talk about such things " * 20]
    for a, b, c in zip(code, code[1:], code[2:], strict=False):
        counts[a, b, c] += 1
    known = toxicity.letter_model(counts)
    hashes = np.unique(np.concatenate([h for part in toxicity.text_words(pa.array(insults), known, {}) for h in part]))
    model = toxicity.ToxicModel(known, hashes, np.full(len(hashes), math.log(0.1)), math.log(0.95))
    clean = ["the people talk!", "3 p.m. at 5th a.b.c 1 2 3 4", "| a | b | 12 |", "x", "", None, "!!! $$$ ... - -", "well-known 10.5 it's"]
    texts = [f"the {h} talk" for h in HIDDEN] + HIDDEN + clean
    got = toxicity.score(docs_of([(i, t, "en", "s", 0) for i, t in enumerate(texts)]), model).collect()
    assert {texts[r.doc_id] for r in got if not r.predicted} == set(clean)


def toxic_rows(n, seed, hide=False):
    rng = random.Random(seed)
    insults = ["idiot", "moron", "clown"]
    hidden = ["1d10t", "m0r0n", "i d i o t"]
    rows = []
    for i in range(n):
        words = prose(rng, 40).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(hidden if hide else insults))
        rows.append((i, " ".join(words), "en", "s", 0, int(toxic)))
    return rows


def test_toxic_texts_are_found_held_out(spark, docs_of):
    plain, hidden = toxic_rows(400, 1), toxic_rows(80, 2, hide=True)
    labels = spark.createDataFrame([(r[0], r[5]) for r in plain], "doc_id long, toxic int")
    docs = docs_of([r[:5] for r in plain])
    model = toxicity.fit(docs, labels)
    assert 3 <= len(model.words) <= 6
    scored = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {r[0]: r[5] for r in plain}
    assert all(r.predicted == truth[r.doc_id] for r in scored if r.held)
    again = toxicity.score(docs_of([r[:5] for r in hidden]), model).collect()
    assert sum(r.predicted == hidden[r.doc_id][5] for r in again) >= 0.95 * len(hidden)


def test_insults_that_come_together_all_get_a_weight(spark, docs_of):
    rng = random.Random(5)
    insults = ["idiot", "moron", "clown", "scum", "trash", "loser", "stupid", "pathetic"]
    rows = []
    for i in range(400):
        words = prose(rng, 40).split(" ") + (rng.sample(insults, 6) if i % 4 == 0 else [])
        rows.append((i, " ".join(words), "en", "s", 0))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    alone = [(1000 + i, f"tar lo {word} ne", "en", "s", 0) for i, word in enumerate(insults)]
    got = toxicity.score(docs_of(alone), model).collect()
    assert all(r.predicted == 1 and r.n_marks == 1 for r in got)


def test_labels_of_the_held_out_fold_change_nothing(spark, docs_of):
    rows = toxic_rows(200, 3)
    docs = docs_of([r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int")
    held = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (a.words == b.words).all() and (a.clear == b.clear).all() and a.base == b.base


URLS = [
    ("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://www.example.org/en/19?x", "www.example.org", "/en/19", "example.org/en/1", "block"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://org/x", "org", "/x", "org/", "allow"),
    ("http://a.org", "a.org", "", None, None),
    ("x://a.com/fr/?q=http://b.org/", "a.com", "/fr/", "com/fr/", "allow"),
    ("http://a.com?u=/de/", "a.com", "", None, None),
    ("http://a.com/de/#x", "a.com", "/de/", "com/de/", "block"),
    ("http://a.com/De/", "a.com", "/De/", None, None),
    ("no scheme.org/", "", "", None, None),
    ("://b.org/a", "b.org", "/a", "org/", "allow"),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://", "", "", None, None),
    ("http://É.com/fr/é", "É.com", "/fr/é", "com/fr/", "allow"),
]


def test_url_rules_and_verdicts(spark):
    rows = [(i, u[0], "x") for i, u in enumerate(URLS)] + [(99, URLS[0][0], "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(frame).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_lexical_signs_held_out(spark):
    rng = random.Random(1)

    def url(bad):
        name = "".join(rng.choice("0123456789x") if bad else rng.choice("abcdef") for _ in range(12))
        return f"http://{name}.net/{'?a=1&b=2&c=3' if bad else 'page.html'}"

    def frame(n):
        return spark.createDataFrame([(url(i % 3 == 0), int(i % 3 == 0)) for i in range(n)], "url string, label int")

    got = url_filter.judge(frame(200), rules=(), labelled=frame(400)).collect()
    assert sum((r.verdict == "block") == (r.label == 1) for r in got) >= 0.97 * len(got)


@pytest.mark.parametrize("labels", [[], [0], [1]])
def test_few_labels_give_a_constant_verdict(spark, labels):
    labelled = spark.createDataFrame([("http://a.b/", x) for x in labels], "url string, label int")
    urls = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    got = url_filter.judge(urls, rules=(), labelled=labelled).first()
    assert got.verdict == ("block" if labels == [1] else "allow")


@pytest.mark.parametrize("few", [10**6, 1])
def test_endings_count_all_labelled_urls(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "BROADCAST", few)
    urls = [(f"http://h{i}.t{i % 60}/p{i}.e{i % 40}", int(i % 60 < 20)) for i in range(1200)]
    labelled = url_filter.split_url(spark.createDataFrame(urls, "url string, label int"))
    model = url_filter.fit(labelled, size=50)
    assert model.constant == pytest.approx(1 / 3)
    for name, of, size in (("host_ending", "t", 60), ("path_ending", ".e", 40)):
        got = {r[0]: r[1] for r in getattr(model, f"{name}s").collect()}
        assert len(got) == size
        for k in range(size):
            marks = [y for i, (_, y) in enumerate(urls) if i % size == k]
            assert got[f"{of}{k}"] == pytest.approx((sum(marks) + 10 / 3) / (len(marks) + 10))
    scored = model.block_score(url_filter.lexical_features(labelled)).collect()
    assert len(scored) == len(urls) and all((r.block_score >= 0.5) == (r.label == 1) for r in scored)


def test_entropy(spark):
    frame = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "t string")
    got = [r[0] for r in frame.select(url_filter._entropy(F.col("t"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 2.0])
