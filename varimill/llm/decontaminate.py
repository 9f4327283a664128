"""Documents that hold a benchmark item, also with some words changed.

Texts are sequences of words (letters and digits, lower case). The CGK random
walk turns edit distance into Hamming distance: it reads the current word at each
step and moves on or stays by a random bit of step and word, so that sequences a
few edits apart fall back into step. Bit sampling keeps the words at a few
random steps as a signature; repetitions with new randomness reach the recall
wanted, and their number is estimated by editing the items themselves.

Windows start at every ``stride``-th word of a document. Each item is indexed from
its first words on, and again from places along its whole length, ``stride`` words
at each, so that every occurrence meets a window in step at every place and edits
that lie close together spoil few places only. Windows are dropped at the first sampled step whose word
no item has there. What is left is verified by the exact edit distance to the
item, anywhere in the stretch of the document around the window.

Items are the query set; they are sent to all tasks in blocks of bounded size
(items and characters), each of which is matched with every text. Null texts and items without words
match nothing. Documents are not shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import map_arrays
from varimill.llm.words import PUNCTUATION, Words, chunks, mix

TOLERANCE = 0.1  # of an item's words may be edited
RECALL = 0.95
SAMPLES = 4  # steps in a signature
STRIDE = 8
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8_000_000  # of items in a block, on average
SEED = 11
_RANGES = (1, 2, 4, 8, 16, 32)  # first steps of a walk that signatures are drawn from
_LEAKS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())])
)


def words_of(column: pa.Array) -> list[np.ndarray]:
    found: list[np.ndarray] = []
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets, lower=True, between=PUNCTUATION)
        found += np.split(words.hashes(), words.first[1:-1])
    return found


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least number of words to change, drop or add to make ``item`` a stretch of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        # Words of the text that are passed over cost one each: a running minimum.
        row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - steps) + steps
    return int(row.min())


def sampled_steps(reach: int, repetition: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, reach, repetition])
    return np.sort(rng.choice(reach, min(SAMPLES, reach), replace=False))


def _salt(repetition: int) -> np.uint64:
    return np.random.default_rng([SEED, repetition]).integers(0, 2**64, dtype=np.uint64)


def _signature(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(total * np.uint64(0x9FB21C651E98DF25) + word)


def _walk(words: np.ndarray, coins: np.ndarray, starts: np.ndarray, steps: np.ndarray, allowed=None):
    """Signatures of the walks from ``starts``: (which starts are left, signature)."""
    left, at = np.arange(len(starts)), starts.astype(np.int64)
    total = np.zeros(len(starts), np.uint64)
    last = len(words) - 1
    take = 0
    for step in range(int(steps[-1]) + 1):
        here = np.minimum(at, last)
        if step == steps[take]:
            word = words[here]
            if allowed is not None:
                live = allowed[take][word & np.uint64(0xFFFF)]
                left, at, total, word, here = left[live], at[live], total[live], word[live], here[live]
            total = _signature(total, word)
            take += 1
        at = at + (coins[here] >> np.uint64(step) & np.uint64(1)).astype(np.int64)
    return left, total


@dataclass(frozen=True)
class ItemIndex:
    """Signatures of a block of items for every repetition and range."""

    ids: list[int | None]
    items: list[np.ndarray]
    stride: int
    repetitions: int
    tolerance: float
    # (repetition, steps, words allowed at each step, signatures, item, words left out)
    tables: list[tuple]

    @classmethod
    def build(cls, ids: list[int | None], items: list[np.ndarray], tolerance: float, recall: float) -> ItemIndex:
        pairs = [(i, w) for i, w in zip(ids, items, strict=True) if len(w)]
        ids, items = [p[0] for p in pairs], [p[1] for p in pairs]
        stride = max(1, min([STRIDE, *(len(w) // 2 for w in items)]))
        repetitions = _repetitions(items, tolerance, recall)
        cut = [
            (k, v, w[v:])
            for k, w in enumerate(items)
            for v in _places(len(w), stride, int(tolerance * len(w)))
        ]
        tables = []
        for reach, more in zip(_RANGES, [*_RANGES[1:], math.inf], strict=True):
            mine = [c for c in cut if reach <= len(c[2]) < more]
            if not mine:
                continue
            flat = np.concatenate([c[2][:reach] for c in mine])  # a walk gets no further
            starts = np.arange(len(mine)) * reach
            owner, left_out = np.array([c[0] for c in mine]), np.array([c[1] for c in mine])
            for repetition in range(repetitions):
                steps, coins = sampled_steps(reach, repetition), mix(flat ^ _salt(repetition))
                allowed = []
                for take in range(len(steps)):
                    table = np.zeros(1 << 16, bool)
                    place = _place(flat, coins, starts, int(steps[take]))
                    table[flat[place] & np.uint64(0xFFFF)] = True
                    allowed.append(table)
                _, total = _walk(flat, coins, starts, steps)
                order = np.argsort(total, kind="stable")
                tables.append((repetition, steps, allowed, total[order], owner[order], left_out[order]))
        return cls(ids, items, stride, repetitions, tolerance, tables)

    def find(self, words: Words, hashes: np.ndarray) -> list[list[tuple[int | None, int]]]:
        """(item id, edits) of the items in each text of a chunk."""
        n = len(words.offsets) - 1
        found: list[dict[int, int]] = [{} for _ in range(n)]
        if not len(hashes) or not self.items:
            return [[] for _ in found]
        place = np.arange(len(hashes)) - words.first[words.row]
        starts = np.flatnonzero(place % self.stride == 0)
        vocabulary = [frozenset(i.tolist()) for i in self.items]
        # What lies behind the last word of a text belongs to another; verification sees to that.
        tried = [np.zeros((0, 3), np.int64)]
        repetition, coins = -1, hashes
        for number, steps, allowed, known, owner, left_out in sorted(self.tables, key=lambda t: t[0]):
            if number != repetition:
                repetition, coins = number, mix(hashes ^ _salt(number))
            left, total = _walk(hashes, coins, starts, steps, allowed)
            low, high = np.searchsorted(known, total), np.searchsorted(known, total, "right")
            size = high - low
            at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at_start = starts[np.repeat(left, size)]
            tried.append(np.stack([words.row[at_start], owner[at], at_start - left_out[at]], 1))
        for row, k, start in np.unique(np.concatenate(tried), axis=0).tolist():
            item = self.items[k]
            edits = int(self.tolerance * len(item))
            if found[row].get(k, edits + 1) == 0:
                continue
            first, end = words.first[row], words.first[row + 1]
            exact = hashes[max(start, first) : min(start + len(item), end)]
            if len(exact) == len(item) and (exact == item).all():
                found[row][k] = 0
                continue
            text = hashes[max(start - 2 * edits, first) : min(start + len(item) + 2 * edits, end)]
            # Each edit takes at most one of the item's different words away.
            if edits and len(vocabulary[k].intersection(text.tolist())) >= len(vocabulary[k]) - edits:
                distance = edit_distance(item, text)
                if distance <= min(edits, found[row].get(k, edits)):
                    found[row][k] = distance
        return [[(self.ids[k], d) for k, d in sorted(f.items())] for f in found]


def _places(n: int, stride: int, edits: int) -> list[int]:
    """Words of an item of ``n`` to start from: its first ones, then ``stride`` in a row
    at places that walks of the longest range cover the item from, one at its end."""
    reach = _RANGES[-1]
    end = n - reach - stride + 1
    more = [*range(stride + reach // 2, end, stride + reach // 2), end] if end > 0 else []
    return sorted({*range(min(stride + edits, n)), *(p + v for p in more for v in range(stride))})


def _place(words: np.ndarray, coins: np.ndarray, starts: np.ndarray, step: int) -> np.ndarray:
    at = starts.astype(np.int64)
    for j in range(step):
        at = at + (coins[np.minimum(at, len(words) - 1)] >> np.uint64(j) & np.uint64(1)).astype(np.int64)
    return np.minimum(at, len(words) - 1)


def _repetitions(items: list[np.ndarray], tolerance: float, recall: float) -> int:
    """Repetitions that reach the recall for items with as many edits as allowed."""
    rng = np.random.default_rng(SEED)
    hits = trials = 0
    for item in items[:64]:
        edited = list(item)
        for _ in range(int(tolerance * len(item))):
            at = int(rng.integers(0, len(edited)))
            kind = rng.integers(0, 3)
            if kind == 0:
                edited[at] = np.uint64(rng.integers(0, 2**63))
            elif kind == 1 and len(edited) > 1:
                del edited[at]
            else:
                edited.insert(at, np.uint64(rng.integers(0, 2**63)))
        other = np.array(edited, np.uint64)
        reach = max(r for r in _RANGES if r <= len(item))
        for repetition in range(32):
            steps, salt = sampled_steps(reach, repetition), _salt(repetition)
            a, b = (_walk(w, mix(w ^ salt), np.zeros(1), steps)[1][0] for w in (item, other))
            hits += a == b
            trials += 1
    rate = min(max(hits / trials, 0.05), 0.95) if trials else 0.5
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - rate)))


def with_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    tolerance: float = TOLERANCE,
    recall: float = RECALL,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Add ``leaks``: the items each text holds, with their edits. A column of this
    name is replaced."""
    queries = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("t"))
    total, chars = queries.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, math.ceil(total / block_items), math.ceil(chars / BLOCK_CHARS))
    found = docs.drop("leaks")
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).orderBy("id", "t").toArrow()
        column = rows.column("t").combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        index = ItemIndex.build(rows.column("id").to_pylist(), words_of(column), tolerance, recall)
        found = _matched(found, index, text, block > 0)
    return found


def _matched(docs: DataFrame, index: ItemIndex, text: str, more: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def make(column: pa.Array, *before: pa.Array) -> list[pa.Array]:
        leaks: list[list[dict]] = []
        for _, _, data, offsets in chunks(column):
            words = Words(data, offsets, lower=True, between=PUNCTUATION)
            found = sent.value.find(words, words.hashes())
            leaks += [[{"item_id": i, "edits": d} for i, d in f] for f in found]
        if before:
            leaks = [a + b for a, b in zip(before[0].to_pylist(), leaks, strict=True)]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))
        return [pa.array(leaks, kind)]

    return map_arrays(docs, [text] + ["leaks"] * more, [T.StructField("leaks", _LEAKS)], make)
