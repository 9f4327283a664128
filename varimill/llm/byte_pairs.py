"""Exact ids of a byte-level pair vocabulary, given as a tokenizer's JSON file.

Merging by the rule list of the file and merging whatever neighbours make the token of
least rank give the same ids if each token, spelled out in bytes, merges back to
itself: neighbours that make a token by another rule than its own then never stand
side by side. ``load`` tests that for the whole vocabulary, and that the tokenizer
cuts texts by the usual byte-level pattern; then the quicker merging is used for texts
of well-known characters. Any other text, one that holds an added token, and all
texts under another kind of tokenizer are encoded by the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import numpy as np

from varimill.llm.frames import process_cache

# Fixed value: the pattern by which byte-level tokenizers cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 2000  # characters without a space that are left to the tokenizer
# Characters that all pattern engines class alike: Latin, Greek, Cyrillic, common marks
# and ideographs.
_KNOWN = re.compile("[\0-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԓ‐-‧‰-⁞€、-】一-龥]*")
_RUN = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such a file: visible ones for themselves,
    the others in order from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class PairSpec:
    """A tokenizer as plain data that can be sent to executors."""

    name: str
    spec: str
    quick: bool

    @classmethod
    def load(cls, path: str) -> PairSpec:
        with open(path, encoding="utf-8") as file:
            spec = file.read()
        return cls(path, spec, _mergeable(json.loads(spec)))


def _mergeable(told: dict) -> bool:
    from tokenizers import Tokenizer

    model, cutter = told["model"], told.get("pre_tokenizer") or {}
    usual = (
        model.get("type") == "BPE"
        and cutter.get("type") == "ByteLevel"
        and cutter.get("use_regex", True)
        and not cutter.get("add_prefix_space", True)
        and not any(told.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(
            model.get(k)
            for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
    )
    if not usual:
        return False
    letters, vocabulary = _byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    ordered = all(x < y for x, y in zip(made, made[1:])) and all(i >= 0 for i in made)
    spelled = all(c in letters for token in vocabulary for c in token) and all(c in vocabulary for c in letters)
    # Bytes come before all that merging makes.
    first = spelled and max(vocabulary[c] for c in letters) < min(made, default=1 << 31)
    if not (ordered and first and len(made) + len(letters) == len(vocabulary)):
        return False
    bare = Tokenizer.from_str(json.dumps(told | {"pre_tokenizer": None, "added_tokens": [], "post_processor": None}))
    tokens = list(vocabulary)
    encoded = bare.encode_batch(tokens, add_special_tokens=False)
    return all(e.ids == [vocabulary[t]] for t, e in zip(tokens, encoded, strict=True))


class BytePairs:
    """Encodes texts."""

    def __init__(self, spec: PairSpec) -> None:
        # One task, one thread.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.spec)
        told = json.loads(spec.spec)
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        self.merging = None
        if spec.quick:
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items()}
            self.merging = tiktoken.Encoding(spec.name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """The ids; null is empty."""
        if not text:
            return np.zeros(0, "<u4")
        if (
            self.merging is None
            or not _KNOWN.fullmatch(text)
            or any(a in text for a in self.added)
            or (len(text) > LONG_RUN and _RUN.search(text))
        ):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.merging.encode_ordinary(text), "<u4")


def byte_pairs(spec: PairSpec) -> BytePairs:
    """The encoder of this process for a tokenizer."""
    cache = process_cache("byte_pairs")
    if spec.name not in cache:
        cache[spec.name] = BytePairs(spec)
    return cache[spec.name]
