"""Jaccard join, substring dedup and components against brute force."""

import random

import numpy as np
import pytest
from llm_data import WORD, corpus, edited, prose

from varimill.llm import graph, jaccard_join, substring_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, len(s), least[find(i)]) for i, (key, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(docs_of, seed):
    rows = corpus(seed)
    got = jaccard_join.join_classes(docs_of(rows)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == classes(rows)


def test_blocks_lose_no_link(docs_of, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 120)
    got = jaccard_join.join_classes(docs_of(rows)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == classes(rows)


def test_similar_sets_always_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        drop, add = rng.integers(0, n // 5 + 1, 2)
        b = np.concatenate([a[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= 80 * (len(a) + len(b) - inter) and inter < max(len(a), len(b)):
            keys = [jaccard_join.sketch_keys(s, 80) for s in (a, b)]
            assert len(np.intersect1d(*keys))


def test_bit_sketches_bound_the_difference_and_fold():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    b = np.concatenate([a[20:], rng.integers(0, 2**64, 9, dtype=np.uint64)])
    x, y = jaccard_join.bit_sketch(a, 8), jaccard_join.bit_sketch(b, 8)
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    wide = jaccard_join.bit_sketch(a, 9)
    assert (wide[: len(wide) // 2] ^ wide[len(wide) // 2 :] == x).all()


def test_keep_one_keeps_one_of_each_class(docs_of, rows):
    kept = jaccard_join.keep_one(docs_of(rows + [rows[0], (None, "some text", "en", "s", 1)]))
    ids = [r.doc_id for r in kept.collect()]
    expected = {c for _, _, c in classes(rows)}
    assert sorted(i for i in ids if i is not None) == sorted(expected) and ids.count(None) == 1


def removed(rows, window=13):
    first, out = {}, []
    for key, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            owner = first.setdefault(tuple(words[i : i + window]), key)
            if owner < key:
                covered[i : i + window] = [True] * window
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out.append((key, len(words), sum(covered), " ".join(kept)))
    return out


@pytest.mark.parametrize("buckets", [1, 7])
def test_repeats_equal_brute_force(docs_of, buckets):
    rng = random.Random(3)
    rows = corpus(3)
    passage = prose(rng, 13)
    rows += [(1000 + i, f"{prose(rng, i)} {passage} {prose(rng, 3)}", "en", "s", 0) for i in range(20)]
    rows += [(2000, edited(rng, rows[-1][1], 1), "en", "s", 0)]
    got = substring_dedup.remove_repeats(docs_of(rows), buckets=buckets).collect()
    assert sorted(map(tuple, got)) == removed(rows)
    assert sum(r.n_removed for r in got) > 0


def test_repeated_ids_are_not_smaller_than_each_other(docs_of):
    text = prose(random.Random(4), 40)
    rows = [(1, text, "en", "s", 0), (1, text + " more", "en", "s", 0), (2, "x " + text, "en", "s", 0)]
    rows += [(None, text, "en", "s", 0)]
    got = substring_dedup.remove_repeats(docs_of(rows), buckets=2).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [
        (0, 40, 0), (1, 40, 0), (1, 41, 0), (2, 41, 40)
    ]


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 100), (7, 7), (200, 200)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_classes_of_repeated_ids_each_keep_one(spark):
    """Two texts that share nothing, on rows of the same id: neither is lost."""
    a, b = ("one two three four five six seven " * 3).strip(), ("red green blue white black grey pink " * 3).strip()
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    kept = sorted(tuple(r) for r in jaccard_join.keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, b)])
