"""Toxicity of texts whose insults may be spelled to hide them.

Noisy channel: a suspicious token (look-alike characters beside letters, letters
repeated, letters joined by filler marks, single letters in a row) is read as a
lattice of the letters it may stand for; Viterbi search under a character trigram
model picks the likeliest word, with and without look-alikes at its ends. Tokens
of plain letters stand for themselves. The restored text is scored:
each word seen often enough in labelled texts has a probability of marking a
toxic one, and a document's score joins those of its words as a noisy or.

The character model counts all texts. Word weights are fitted on at most
``SAMPLE`` labelled texts outside the held-out fold, and the one bound among their
parameters that decides how insults in company are treated is chosen by
cross-validation on the training folds; language, source and id are no inputs. Null
and empty texts get the score of texts without any weighted word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import key_filter, map_arrays, maybe_in, stored
from varimill.llm.words import PUNCTUATION, Words, chunks

FOLDS = 5
SAMPLE = 20_000  # labelled texts that word weights are fitted on, at most
LEAST_TOXIC = 3  # toxic texts that a word must occur in
PRIOR = 2.0
CHANCE = 2.0  # log odds against a word that is toxic by chance, beside their number
RESIDUE = 4.0  # log likelihood ratio of a word in texts that stronger words do not mark
STRONG = (2.0, 3.0, 5.0, 8.0, 12.0, 1e9)  # log likelihood ratios against even odds that may spare a word this test

# Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
_FILLER = frozenset(".-_*'~^ \t\r\n")
_SAME, _ALIKE, _REPEAT, _SKIP = -0.05, -1.0, -0.7, -1.0  # log weights of the channel
_LETTERS = 27  # a-z and one for all others and word ends
_OTHER = 26

_ALPHA = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_ODD = np.isin(np.arange(256), [*b"0123456789@$!|+"])
_JOINT = np.isin(np.arange(256), [*b".-_*'~^"])
_MARKS = "#*%&=<>()[]{}\"',;:.?~^_-"  # around a token; stand for no letter
_RIM = _MARKS + "".join(LOOKALIKES)
_PLAIN = re.compile(r"(?:([a-z])(?!\1\1))+")
_ONE = r"(?:[^\W_]|[@$!|+€£])"  # a letter or a look-alike
_SPACED = re.compile(rf"(?<!\w)(?:{_ONE}[\s.\-_*'~^]){{2,}}{_ONE}(?!\w)")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each letter follows two others, over all texts: 27^3 numbers."""
    code = np.full(256, _OTHER, np.int64)
    code[97:123] = code[65:91] = np.arange(26)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                # Each text with two word ends before and one behind it, so that what
                # it adds does not depend on its neighbours.
                sizes = np.diff(offsets)
                row = np.repeat(np.arange(len(sizes)), sizes)
                c = np.full(len(data) + 3 * len(sizes), _OTHER, np.int64)
                c[np.arange(len(data)) + 3 * row + 2] = code[data]
                first = offsets[:-1] + 3 * np.arange(len(sizes))
                inside = np.ones(len(c), bool)
                inside[first] = inside[first + 1] = False
                at = np.flatnonzero(inside)
                triple = (c[at - 2] * _LETTERS + c[at - 1]) * _LETTERS + c[at]
                total += np.bincount(triple, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["triple", "n"])

    rows = docs.select(text).mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # at most 27^3 rows
    counts = np.zeros(_LETTERS**3)
    counts[table["triple"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    return counts.reshape(_LETTERS, _LETTERS, _LETTERS)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others, smoothed by shorter contexts."""
    one = counts.sum((0, 1)) + 1
    p1 = one / one.sum()
    two = counts.sum(0)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * p2) / (counts.sum(2, keepdims=True) + 5))


def _letter(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else _OTHER


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a token, in lower case."""
    paths = {(_OTHER, _OTHER): (0.0, "")}
    before = ""
    for c in token.lower():
        choices = [(c, _SAME)] if c.isalpha() else []
        choices += [(x, _ALIKE) for x in LOOKALIKES.get(c, "")]
        dropped = _REPEAT if c == before else _SKIP if c in _FILLER else None
        if not choices and dropped is None:
            choices = [(c, _SAME)]
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (weight, word) in paths.items():
            steps = [((b, _letter(x)), weight + w + model[a, b, _letter(x)], word + x) for x, w in choices]
            if dropped is not None:
                steps.append(((a, b), weight + dropped, word))
            for state, total, spelled in steps:
                if state not in reached or total > reached[state][0]:
                    reached[state] = (total, spelled)
        paths, before = reached, c
    ends = ((w + model[a, b, _OTHER], word) for (a, b), (w, word) in paths.items())
    return max(ends)[1]


def _odd_marks(data: np.ndarray) -> np.ndarray:
    """Bytes of look-alikes, those of two or three bytes included."""
    odd = _ODD[data]
    for mark in (m.encode() for m in LOOKALIKES if not m.isascii()):
        n = len(data) - len(mark) + 1
        if n > 0:
            at = np.flatnonzero(np.logical_and.reduce([data[i : n + i] == b for i, b in enumerate(mark)]))
            for i in range(len(mark)):
                odd[at + i] = True
    return odd


def _suspicious(words: Words) -> np.ndarray:
    """Which tokens between spaces may hide a word: a look-alike next to a letter, a
    filler between letters or look-alikes, or a letter three times."""
    data = words.data
    n = len(data)
    if not len(words):
        return np.zeros(0, bool)
    odd = _odd_marks(data)
    alpha = _ALPHA[data] & ~odd

    def count(flags: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(flags, out=sums[1 : len(flags) + 1])
        return sums[np.maximum(end, words.start)] - sums[words.start]

    beside = (odd[:-1] & alpha[1:]) | (alpha[:-1] & odd[1:])
    same = alpha[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    # The first and the last letter or look-alike of each token, and fillers between.
    core = np.append(np.flatnonzero(alpha | odd), n)
    low = np.maximum(core[np.searchsorted(core, words.start)], words.start)
    high = core[np.maximum(np.searchsorted(core, words.end) - 1, 0)]
    joints = np.concatenate([[0], np.cumsum(_JOINT[data])])
    joined = (high > low) & (joints[np.clip(high, 0, n)] > joints[np.clip(low, 0, n)])
    hidden = (count(beside, words.end - 1) > 0) | (count(same, words.end - 2) > 0) | joined
    return hidden & (count(alpha, words.end) > 0)


def _rims(token: str, strip: Callable[[str, str], str], end: int) -> list[str]:
    """A token with all look-alikes at one end, without the outermost kind, and without any."""
    outer = token[end : end + 1 or None]
    return [token, strip(token, outer), strip(token, _RIM)] if outer and outer in LOOKALIKES else [token]


def _readings(token: str, model: np.ndarray) -> str:
    """Words that a token may stand for. A mark such as '!' at either end may be a
    letter or none, so it is read both ways."""
    inner = token.lower().strip(_MARKS)
    forms = {b for a in _rims(inner, str.lstrip, 0) for b in _rims(a, str.rstrip, -1)}
    forms.discard("")
    return " ".join(sorted({f if _PLAIN.fullmatch(f) else restore(f, model) for f in forms}))


def _spaced_readings(run: str, model: np.ndarray) -> str:
    """Words behind characters in a row; the first or last may be a word or mark of its own."""
    forms = {run[a : len(run) - b] for a in (0, 2) for b in (0, 2)}
    kept = (f for f in forms if len(f) >= 5 and any(c.isalpha() for c in f))
    return " ".join(sorted({restore(f, model) for f in kept}))


def _hidden(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, cache: dict[str, str]) -> list[list[str]]:
    """Words restored from the suspicious tokens of each text."""
    found: list[list[str]] = [[] for _ in offsets[1:]]
    words = Words(data, offsets)
    odd = np.flatnonzero(_suspicious(words))
    row, start, end = words.row[odd].tolist(), words.start[odd].tolist(), words.end[odd].tolist()
    for r, a, b in zip(row, start, end, strict=True):
        token = data[a:b].tobytes().decode()
        known = cache.get(token)
        if known is None:
            known = _readings(token, model)
            if len(cache) < 200_000:
                cache[token] = known
        found[r].append(known)
    # Single letters or look-alikes in a row: three tokens of one, one after the other.
    size, first = words.end - words.start, data[words.start]
    bytes_of = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    single = (size == bytes_of) & (_ALPHA[first] | _ODD[first])
    n = len(single)
    three = single[: n - 2] & single[1 : n - 1] & single[2:] if n > 2 else np.zeros(0, bool)
    for r in np.unique(words.row[: max(0, n - 2)][three]):
        text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
        for run in set(_SPACED.findall(text)):
            found[r].append(_spaced_readings(run, model))
    return found


def text_words(column: pa.Array, model: np.ndarray, cache: dict[str, str]) -> Iterator[list[np.ndarray]]:
    """For each chunk, the hashes of the distinct words of every text, restored ones included."""
    for _, _, data, offsets in chunks(column):
        plain = Words(data, offsets, lower=True, between=PUNCTUATION)
        hashes = np.split(plain.hashes(), plain.first[1:-1])
        hidden = _hidden(data, offsets, model, cache)
        at = [i for i, h in enumerate(hidden) if h]
        if at:
            joined = [" ".join(hidden[i]) for i in at]
            for _, _, more, bounds in chunks(pa.array(joined), 1 << 62):
                extra = Words(more, bounds, lower=True, between=PUNCTUATION)
                for i, h in zip(at, np.split(extra.hashes(), extra.first[1:-1]), strict=True):
                    hashes[i] = np.concatenate([hashes[i], h])
        yield hashes


@dataclass(frozen=True)
class ToxicModel:
    """Letter model, sorted word hashes, log(1 - weight) of each, and that of every text."""

    letters: np.ndarray
    words: np.ndarray
    clear: np.ndarray
    base: float


def _labelled_words(texts: DataFrame, letters: np.ndarray, wanted: np.ndarray | None) -> DataFrame:
    """``word``, ``n`` and ``n_toxic``: in how many labelled texts a word occurs."""
    sent = texts.sparkSession.sparkContext.broadcast((letters, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wanted = sent.value
        cache: dict[str, str] = {}
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            row, words, marks = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for part in text_words(batch.column(0), model, cache):
                for hashes in part:
                    own = np.unique(hashes)
                    own = own if wanted is None else own[np.isin(own, wanted)]
                    words.append(own)
                    marks.append(np.full(len(own), toxic[row]))
                    row += 1
            distinct, at = np.unique(np.concatenate(words), return_inverse=True)
            n_toxic = np.bincount(at, np.concatenate(marks), len(distinct)).astype(np.int64)
            n = np.bincount(at, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(n), pa.array(n_toxic)], ["word", "n", "n_toxic"]
            )

    counted = texts.select("text", "toxic").mapInArrow(run, "word long, n long, n_toxic long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
) -> ToxicModel:
    """Fit on ``labels`` (``doc_id``, ``toxic`` 0/1); the held-out fold is left out."""
    letters = letter_model(letter_counts(docs, text))
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    if total > sample:
        share = int(sample / total * (1 << 30))
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        usable = usable.where(place < share).orderBy(place, "doc_id").limit(sample)
    chosen = stored(usable, "labelled")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = maybe_in(texts, "doc_id", key_filter(chosen, "doc_id")).join(chosen, "doc_id")
    texts = stored(texts, "examples")
    n, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        rate = 0.5 / (n + 1) if n else 0.0
        return ToxicModel(letters, np.zeros(0, np.uint64), np.zeros(0), float(np.log1p(-min(rate, 0.49))))
    marked = _labelled_words(texts.where("toxic = 1"), letters, None).where(F.col("n") >= LEAST_TOXIC)
    # All words of so many toxic texts: a number that the sample bounds.
    wanted = marked.select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64)
    table = _labelled_words(texts, letters, np.sort(wanted)).toPandas()
    words, seen, toxic = (table[c].to_numpy(np.int64) for c in ("word", "n", "n_toxic"))
    tested = len(words)
    good = np.flatnonzero(_promising(seen, toxic, n, n_toxic, tested)[0])
    words = np.sort(words[good].view(np.uint64))
    held = _held_words(texts, letters, words).toPandas().sort_values("doc_id", kind="stable")
    examples = _Examples.of(held, len(words))
    strong = _chosen_strong(examples, tested)
    kept, clear, base = _weighted(examples, tested, strong)
    return ToxicModel(letters, words[kept], clear, base)


def _promising(seen: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int, tested: int):
    """Which words mark toxic texts, with their weights and log likelihood ratios."""
    rate = (n_toxic + 0.5) / (n + 1)
    share = (toxic + PRIOR * rate) / (seen + PRIOR)
    # Among so many words some are toxic by chance: a word's log likelihood ratio
    # must stand above what the most extreme of them would reach.
    clean, any_ = seen - toxic, np.maximum(seen, 1)
    ratio = toxic * np.log(np.maximum(toxic, 1) / any_ / rate)
    ratio += clean * np.log(np.maximum(clean, 1) / any_ / (1 - rate))
    weight = (share - rate) / (1 - rate)
    good = (toxic >= LEAST_TOXIC) & (weight > 0.05) & (ratio > np.log(tested + 1) + CHANCE)
    return good, weight, ratio


@dataclass(frozen=True)
class _Examples:
    """Labelled texts and the words that each has, as pairs of places."""

    toxic: np.ndarray
    fold: np.ndarray
    text: np.ndarray
    word: np.ndarray
    n_words: int

    @classmethod
    def of(cls, held, n_words: int) -> _Examples:
        sizes = [len(x) for x in held["places"]]
        word = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in held["places"])])
        text = np.repeat(np.arange(len(sizes)), sizes)
        return cls(held["toxic"].to_numpy() == 1, held["fold"].to_numpy(), text, word.astype(np.int64), n_words)

    def only(self, chosen: np.ndarray) -> _Examples:
        place = np.cumsum(chosen) - 1
        pairs = chosen[self.text]
        return _Examples(self.toxic[chosen], self.fold[chosen], place[self.text[pairs]], self.word[pairs], self.n_words)


def _weighted(examples: _Examples, tested: int, strong_from: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(places of the words that count, log(1 - weight) of each, that of every text)."""
    is_toxic = examples.toxic
    n, n_toxic = len(is_toxic), int(is_toxic.sum())
    rate = (n_toxic + 0.5) / (n + 1)
    seen = np.bincount(examples.word, minlength=examples.n_words)
    toxic = np.bincount(examples.word[is_toxic[examples.text]], minlength=examples.n_words)
    good, weight, ratio = _promising(seen, toxic, n, n_toxic, tested)
    clean = seen - toxic
    # A word that comes along with stronger ones must also mark texts of its own,
    # unless next to no clean text has it: insults come together.
    any_ = np.maximum(seen, 1)
    odds = toxic * np.log(np.maximum(2 * toxic, 1) / any_) + clean * np.log(np.maximum(2 * clean, 1) / any_)
    strong = (toxic > clean) & (odds > strong_from)
    order = np.argsort(examples.word, kind="stable")
    texts = np.split(examples.text[order], np.cumsum(seen)[:-1]) if examples.n_words else []
    explained, kept = np.zeros(n, bool), []
    for place in np.argsort(-ratio, kind="stable").tolist():
        if not good[place]:
            continue
        at = texts[place]
        own = int((is_toxic[at] & ~explained[at]).sum())
        share = own / max(own + clean[place], 1)
        alone = own * np.log(max(share, 1e-9) / rate) + clean[place] * np.log((1 - share + 1e-9) / (1 - rate))
        if strong[place] or (own >= LEAST_TOXIC and share > rate and alone > RESIDUE):
            kept.append(place)
            explained[at] = True
    kept = np.sort(np.array(kept, np.int64))
    base = ((is_toxic & ~explained).sum() + 0.5) / ((~explained).sum() + 1)
    return kept, np.log1p(-np.minimum(weight[kept], 0.999)), float(np.log1p(-min(base, 0.49)))


def _chosen_strong(examples: _Examples, tested: int) -> float:
    """The bound under which the fewest texts of a training fold are predicted wrong
    from the others; of equals that with the least log loss."""
    losses = []
    for strong_from in STRONG:
        wrong, loss = 0, 0.0
        for fold in np.unique(examples.fold):
            inside = examples.fold == fold
            kept, clear, base = _weighted(examples.only(~inside), tested, strong_from)
            weights = np.zeros(examples.n_words)
            weights[kept] = clear
            total = base + np.bincount(examples.text, weights[examples.word], len(examples.toxic))[inside]
            score = np.clip(-np.expm1(total), 1e-4, 1 - 1e-4)
            wrong += int(((score >= 0.5) != examples.toxic[inside]).sum())
            loss -= float(np.where(examples.toxic[inside], np.log(score), np.log1p(-score)).sum())
        losses.append((wrong, round(loss, 6)))
    return STRONG[losses.index(min(losses))]


def _held_words(texts: DataFrame, letters: np.ndarray, words: np.ndarray) -> DataFrame:
    """For each text of the sample its id, fold, label and which of the words it has."""
    sent = texts.sparkSession.sparkContext.broadcast((letters, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = sent.value
        cache: dict[str, str] = {}
        for batch in batches:
            places: list[list[int]] = []
            for part in text_words(batch.column(0), model, cache):
                places += [np.flatnonzero(np.isin(words, hashes)).tolist() for hashes in part]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(places, pa.list_(pa.int64()))], ["doc_id", "fold", "toxic", "places"]
            )

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = texts.select("text", "doc_id", fold, F.col("toxic").cast("int"))
    return rows.mapInArrow(run, "doc_id long, fold int, toxic int, places array<long>")


def _scored(docs: DataFrame, model: ToxicModel, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, str] = {}

    def make(column: pa.Array) -> list[pa.Array]:
        model = sent.value
        known = np.zeros(1 << 16, bool)
        known[model.words & np.uint64(0xFFFF)] = True
        scores, marks = [], []
        for part in text_words(column, model.letters, cache):
            sizes = np.cumsum([len(h) for h in part])
            hashes = np.concatenate(part)
            at = np.flatnonzero(known[hashes & np.uint64(0xFFFF)])
            total, count = np.full(len(part), model.base), np.zeros(len(part), np.int64)
            if len(at):
                place = np.minimum(np.searchsorted(model.words, hashes[at]), len(model.words) - 1)
                hit = model.words[place] == hashes[at]
                row = np.searchsorted(sizes, at[hit], "right")
                pairs = np.unique(np.stack([row, place[hit]], 1), axis=0)
                total += np.bincount(pairs[:, 0], model.clear[pairs[:, 1]], len(part))
                count += np.bincount(pairs[:, 0], minlength=len(part))
            scores.append(-np.expm1(total))
            marks.append(count)
        empty = [np.zeros(0)]
        return [pa.array(np.concatenate(scores or empty)), pa.array(np.concatenate(marks or empty).astype(np.int64))]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_marks", T.LongType())]
    return map_arrays(docs, [text], fields, make)


def score(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``n_marks`` (weighted words) and ``predicted`` to every
    row; columns of these names are replaced. No shuffle."""
    rows = _scored(docs.drop("predicted"), model, text)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
