"""Restored words, toxicity scores, leaks and URL rules against plain enumeration."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from llm_data import VOCABULARY, edited, prose

from varimill.llm import decontaminate, toxicity, url_filter
from varimill.llm.words import Words, texts


def _model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 40, (27, 27, 27)).astype(float) ** 2
    return toxicity.letter_model(counts)


def _readings(token, model):
    """Every way through the lattice of a token: (log weight, word)."""
    steps, before = [], ""
    for c in token.lower():
        choices = [(c, toxicity._SAME)] if c.isalpha() else []
        choices += [(x, toxicity._ALIKE) for x in toxicity.LOOKALIKES.get(c, "")]
        dropped = toxicity._REPEAT if c == before else toxicity._SKIP if c in toxicity._FILLER else None
        if not choices and dropped is None:
            choices = [(c, toxicity._SAME)]
        if dropped is not None:
            choices.append(("", dropped))
        steps.append(choices)
        before = c
    for path in itertools.product(*steps):
        word = "".join(x for x, _ in path)
        total, a, b = sum(w for _, w in path), 26, 26
        for x in [*word, "\0"]:
            letter = ord(x) - 97 if "a" <= x <= "z" else 26
            total += model[a, b, letter]
            a, b = b, letter
        yield total, word


def test_the_likeliest_reading_of_all_is_found():
    rng = random.Random(2)
    for seed in range(3):
        model = _model(seed)
        for _ in range(150):
            token = "".join(rng.choices("abeiost1340@$!|.-_é", k=rng.randint(1, 8)))
            token += token[-1] * rng.randrange(3)
            readings = list(_readings(token, model))
            best = max(total for total, _ in readings)
            word = toxicity.restore(token, model)
            assert max(total for total, w in readings if w == word) > best - 1e-9


def _corpus(rng, n):
    insults = ["idiot", "moron", "stupid", "clown"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(VOCABULARY, k=30) + (rng.sample(insults, 2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_scores_join_the_weights_of_words(spark):
    rows, labels = _corpus(random.Random(3), 400)
    rows += [(1000, None), (1001, ""), (1002, "idiot idiot idiot " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.words) >= 4
    weight = dict(zip(model.words.tolist(), model.clear.tolist()))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text in rows:
        words = sorted(set(re.findall(r"[^\W_]+", (text or "").lower())))
        data, offsets = texts(pa.array([" ".join(words)]))
        hashes = set(Words(data, offsets).hashes().tolist())
        clear = np.exp(model.base + sum(weight.get(h, 0.0) for h in hashes))
        assert abs(got[i].score - (1 - clear)) < 1e-9
        assert got[i].n_marks == sum(h in weight for h in hashes)


def test_the_model_does_not_depend_on_partitions(spark):
    rows, labels = _corpus(random.Random(4), 300)
    rows += [(2000, None), (2001, ""), (2002, "é 1"), (2003, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, seven = (toxicity.fit(docs.repartition(n), marks.repartition(n), sample=150) for n in (1, 7))
    assert (one.letters == seven.letters).all() and (one.words == seven.words).all()
    assert (one.clear == seven.clear).all() and one.base == seven.base


def _plain_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _apart(item, words):
    """Least edits between an item and any stretch of a text."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(words):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def test_leaks_against_every_stretch_of_every_text(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(12, 45))) for i in range(25)]
    rows = []
    for i in range(120):
        body = prose(rng, rng.randint(5, 60))
        if i % 3 == 0:
            _, item = rng.choice(items)
            body += " " + edited(rng, item, rng.randrange(6)) + " " + prose(rng, 8)
        rows.append((i, body))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.with_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, x["item_id"]): x["edits"] for r in found for x in r.leaks}
    want = {}
    for i, body in rows:
        for k, item in items:
            words = _plain_words(item)
            edits = _apart(words, _plain_words(body))
            if edits <= int(decontaminate.TOLERANCE * len(words)):
                want[i, k] = edits
    assert got.keys() <= want.keys() and all(got[key] >= want[key] for key in got)
    assert {key for key, edits in want.items() if not edits} <= got.keys()
    assert len(want) >= 25 and len(got) >= 0.9 * len(want)


def test_rules_of_random_urls(spark):
    rng = random.Random(6)
    hosts = ["a.org", "ORG", "example.org", "x.Example.org", "notexample.org", "b.com", "com", "com.net", "", "é.com", "a.b.c.com."]
    paths = ["/es/", "/es", "/en/1", "/en/12/x", "/fr/", "/FR/", "/de/x?y=/fr/", "#/fr/", "?/de/", "", "/", "/de/#a"]
    urls = [rng.choice(["http://", "x://", "://", "", "http:/"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(600)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, url in enumerate(urls):
        rest = url.partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [
            r for r in url_filter.RULES if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)
        ]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name)
        assert rule is None or got[i].verdict == rule.verdict
