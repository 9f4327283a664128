"""Variant groups against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_data import SCHEMA
from pyspark.sql import functions as F

from varimill.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(counts, times=5):
    out = []
    forms = {}
    for word, n in counts.items():
        near = sorted((-counts[w], w) for w in counts if _near(word, w))
        form = near[0][1] if near and -near[0][0] >= times * n else None
        forms[word] = form
        out.append([word, form, None, n, len(near), counts[form] if form else None])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row[2] = root
    return sorted(map(tuple, out))


def _words(rng, n, letters, low, high):
    words = set()
    while len(words) < n:
        word = "".join(rng.choices(letters, k=rng.randint(low, high)))
        words.add(word)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(word))
            words.add(rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]]))
    return {w: rng.choice([5, 6, 7, 30, 160, 900]) for w in words}


OPTIONS = [{}, {"broadcast_edges": -1, "salts": 3}, {"levels": 5}, {"levels": 8, "broadcast_edges": -1}]


@pytest.mark.parametrize("options", OPTIONS)
def test_equals_a_comparison_of_all(spark, options):
    rng = random.Random(3)
    counts = _words(rng, 120, "abé", 2, 9) | _words(rng, 60, "abcdefghÿ", 6, 12)
    counts |= {"a" * n: 5 * n for n in range(1, 12)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    made = spelling.group_variants(words, **options)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted(_plain(counts), key=str)


def test_long_words(spark):
    base = "".join(random.Random(1).choices("abcdef", k=400))
    counts = {base: 1000, base[:-1]: 100, base[:63]: 50, base[:64]: 500, base[:65]: 7, base[:200] + "x" + base[201:]: 9, "y" + base: 5, "b" * 64: 5, "b" * 65: 25}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted((tuple(r) for r in spelling.group_variants(words).collect()), key=str) == sorted(_plain(counts), key=str)


def _vocabulary(rows, every):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def test_words_of_documents(spark):
    rng = random.Random(9)
    stems = ["Wörter", "letters", "ÀÉÎÕÜ×ÿ", "spellinG", "x", "Another", "abcdef"]
    rows = [(i % 50, " ".join(rng.choices(stems, k=40)) + "ı9Ł", "en", "s", 0) for i in range(60)]
    rows += [(None, "Wörter Wörter letters", None, None, None), (None, None, None, None, None), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("run", "word", "n", "node")})
    for every in (3, 199):
        words = spelling.vocabulary(spelling.with_slips(spelling.runs(docs), every))
        assert {r["word"]: r["n"] for r in words.collect()} == _vocabulary(rows, every)
        made = spelling.group_variants(words).collect()
        assert sorted((tuple(r) for r in made), key=str) == sorted(_plain(_vocabulary(rows, every)), key=str)


def test_no_words(spark):
    for rows in ([], [(None, None, None, None, None)], [(1, "", "en", "s", 0)]):
        words = spelling.vocabulary(spelling.runs(spark.createDataFrame(rows, SCHEMA)))
        assert spelling.group_variants(words).count() == 0
