"""Packing and the ids it packs, against the tokenizer and against the rules of packing."""

import random

import numpy as np
import public_tokenizers
import pytest
from llm_data import SCHEMA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from varimill.llm import packing
from varimill.llm.byte_pairs import BytePairs, PairSpec

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", " ", "\n", "\t", "\r", "\xa0", "\x1c", "\x85", "é", "中", "'s", "'", "!", "1", "²", "​",
       "᠎", "😀", "\0", "<|endoftext|>", "́", " the"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return BytePairs(PairSpec.load(PATH))


def test_ids_are_the_tokenizers(codec, tokenizer):
    assert codec.merging is not None
    rng = random.Random(5)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(16))) for _ in range(4000)]
    letters = "abcdefghijklmnopqrstuvwxyzABC0123456789'.,-éßжя中"
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(4000)]
    texts += ["ab" * 3000, " " * 5000 + "x", "word " * 200_000]
    for text in texts:
        assert codec.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.encode(None).tolist() == codec.encode("").tolist() == []


def test_other_tokenizers_are_not_merged_quickly():
    assert not PairSpec.load(public_tokenizers.path("word_bpe_49k.json")).quick


def test_classes_hold_their_pieces():
    for capacity in (1, 2, 7, 64, 1024):
        for n in range(capacity):
            classes = packing.harmonic_classes(n, capacity)
            assert sum(capacity // k for k in classes) == n
            assert all(k > 1 for k in classes)


def _check(pieces, want, capacity):
    """Each id in exactly one piece; sequences without gaps, within the capacity."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) // 4 > 0
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    got = []
    for (doc, total), parts in by_doc.items():
        parts.sort(key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist()
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:i]) for i in range(len(parts))]
        assert total == len(ids)
        got.append((doc, ids))
    assert sorted(got) == sorted(want)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return by_sequence


@pytest.mark.parametrize("capacity", [8, 100, 1024])
def test_packs_every_id_once_and_tightly(spark, docs_of, rows, tokenizer, capacity):
    want = [
        (r[0], [*(tokenizer.encode(r[1], add_special_tokens=False).ids if r[1] else []), 0])
        for i, r in enumerate(rows)
        if r[0] is not None and all(r[0] != s[0] for s in rows[:i])
    ]
    seen = set()
    docs = docs_of([r for r in rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))])
    pieces = packing.pack(docs, PATH, capacity=capacity).collect()
    by_sequence = _check(pieces, want, capacity)
    for parts in by_sequence.values():
        n = sum(p["length"] for p in parts)
        # Full but for less than a token a piece, or a power of two.
        assert n > capacity - len(parts) or n & (n - 1) == 0


def test_sequences_and_padding(spark, docs_of):
    docs = docs_of([(i, "some words " * (i * 7 % 50), "en", "s", 0) for i in range(40)])
    pieces = packing.pack(docs, PATH, capacity=64)
    rows = pieces.collect()
    report = packing.padding_report(spark.createDataFrame(rows, pieces.schema), 64).first()
    tokens = sum(r["length"] for r in rows)
    assert (report["n_tokens"], report["n_pieces"]) == (tokens, len(rows))
    assert report["n_padding"] <= 0.05 * tokens
    made = {r["sequence_id"]: r for r in packing.sequences(spark.createDataFrame(rows, pieces.schema), 64).collect()}
    assert len(made) == report["n_sequences"]
    assert sum(r["padded"] - r["length"] for r in made.values()) == report["n_padding"]
    for p in rows:
        held = made[p["sequence_id"]]
        assert held["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])] == p["ids"]
        assert p["offset"] in held["piece_offsets"]


def test_odd_rows(spark):
    nulls, row = (None, None, None, None, None), (1, "some text", "en", "s", 3)
    for rows, n_tokens in (([], 0), ([nulls, nulls], 2), ([row, row], 6), ([(2, "", "en", None, 0), nulls], 2)):
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("ids", "start", "offset", "length")})
        pieces = packing.pack(docs, PATH).collect()
        assert sum(p["length"] for p in pieces) == n_tokens


def test_a_text_of_many_sequences(spark, tokenizer):
    text = "Ein langer Text, word after word.\n" * 40_000
    pieces = packing.pack(spark.createDataFrame([(7, text)], "doc_id long, text string"), PATH).collect()
    _check(pieces, [(7, [*tokenizer.encode(text, add_special_tokens=False).ids, 0])], 1024)
