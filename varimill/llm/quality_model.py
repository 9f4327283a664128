"""Quality by perplexity under a language model of trusted text.

The model is an interpolated modified Kneser-Ney n-gram model over bytes (digits
folded, runs of white space as one space), one per language, from the texts
labelled good. Counts, continuation counts, discounts and context weights are
DataFrame aggregations and windows over the distinct n-grams, spread by n-gram.

Scoring joins the count table to the texts in shards: the table is dealt by the
last byte of the context into shards of at most ``SHARD_ROWS`` rows, each of
which is sent to all tasks and adds its part to every document's sum, so texts
are not shuffled and what is sent at once is bounded. A document's score is its
bits per byte, drawn to its language's mean by ``PULL`` bytes' weight, as short
texts vary. Documents above a threshold, set from quantiles of held-out trusted
documents of the language, are rejected.

Null and empty texts have no score and are rejected. A language without trusted
text has no threshold; its documents are kept. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import arrow_schema, give_back, key_filter, map_arrays, maybe_in, stored
from varimill.llm.words import chunks, mix

ORDER = 5
SHARD_ROWS = 4_000_000
SCORED_BYTES = 1 << 17  # of text scored at once: some twenty numbers are held for each
PULL = 60
FOLDS = 5  # one in so many trusted documents sets thresholds instead of counts
QUANTILE = 0.95
SPREADS = 4.0  # distances from the median to the quantile that are added to it
LEAST_SPREAD = 0.05  # bits per byte
MAX_LANGUAGES = 10_000  # up to which the thresholds are broadcast
TAKEN = ("bits", "n_bytes", "score", "perplexity", "threshold", "kept", "_m_lang", "_mean")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[[0x09, 0x0B, 0x0C, 0x0D, 0x0A]] = 0x20


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of each text with ORDER - 1 spaces in front; offsets of the texts."""
    folded = _FOLD[data]
    kept = np.ones(len(folded), bool)
    kept[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20)
    starts = offsets[:-1][offsets[:-1] < len(data)]
    kept[starts] = True
    sums = np.concatenate([[0], np.cumsum(kept)])
    sizes = sums[offsets[1:]] - sums[offsets[:-1]]
    pad = ORDER - 1
    begin = np.cumsum(sizes + pad) - sizes
    out = np.full(int(sizes.sum()) + pad * len(sizes), 0x20, np.uint8)
    place = np.arange(int(sizes.sum())) + np.repeat(pad * (np.arange(len(sizes)) + 1), sizes)
    out[place] = folded[kept]
    return out, np.concatenate([begin, begin[-1:] + sizes[-1:]]), sizes


def _grams(symbols: np.ndarray) -> np.ndarray:
    """For every place the ORDER bytes that end there, as one number."""
    gram = np.zeros(len(symbols), np.int64)
    for back in range(ORDER):
        gram[ORDER - 1 :] |= symbols[ORDER - 1 - back : len(symbols) - back].astype(np.int64) << (8 * back)
    return gram


def _language_key(language: str | None) -> np.uint64:
    raw = b"\0" if language is None else b"\1" + language.encode()
    key = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for b in raw:
            key = mix(key + np.uint64(b + 1))
    return key[0]


def count_ngrams(texts: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` over the texts, counted per task before the shuffle."""
    schema = T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("gram", T.LongType()),
            T.StructField("n", T.LongType()),
        ]
    )
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def rows(lang: str | None) -> pa.RecordBatch:
            grams, n = merged(held.pop(lang))
            lang_column = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(grams), np.int64)))
            return pa.RecordBatch.from_arrays([lang_column, pa.array(grams), pa.array(n)], schema=out)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for low, high, data, offsets in chunks(batch.column(1)):
                symbols, begin, sizes = _symbols(data, offsets)
                grams = _grams(symbols)
                for lang in set(langs[low:high]):
                    mine = np.flatnonzero(langs[low:high] == lang)
                    taken = [grams[begin[i] : begin[i] + sizes[i]] for i in mine]
                    found = np.unique(np.concatenate(taken), return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append(found)
                    if len(parts) >= 8:
                        held[lang] = [merged(parts)]
                        if len(held[lang][0][0]) > 2_000_000:  # keeps a task's memory bounded
                            yield rows(lang)
        for lang in list(held):
            yield rows(lang)
        give_back()

    counted = texts.select("lang", "text").mapInArrow(run, schema)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """The three discounts of modified Kneser-Ney per language, from counts of counts."""
    n1, n2, n3, n4 = (F.sum((F.col("n") == i).cast("long")).cast("double") for i in (1, 2, 3, 4))
    counts = level.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def discount(i: int, usual: float) -> Column:
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        return F.greatest(F.least(F.coalesce(raw, F.lit(usual)), F.lit(i - 0.05)), F.lit(0.05))

    return counts.select(
        F.col("lang").alias("d_lang"),
        discount(1, 0.5).alias("d1"),
        discount(2, 1.0).alias("d2"),
        discount(3, 1.5).alias("d3"),
    )


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang``, ``size``, ``gram``, ``p``, ``weight``: interpolated probability of
    the last byte after the others, and the weight that the n-gram as a context
    leaves to shorter ones. Either may be null.
    """
    levels = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << 8 * size) - 1).alias("gram")
        levels[size] = levels[size + 1].groupBy("lang", shorter).agg(F.count("*").alias("n"))
    below, rows = None, []
    for size in range(1, ORDER + 1):
        level = levels[size]
        same = Window.partitionBy("lang", F.shiftright("gram", 8))
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        taken = level.join(_discounts(level), F.col("lang").eqNullSafe(F.col("d_lang")))
        taken = taken.withColumn("cut", F.least(discount, F.col("n").cast("double")))
        taken = taken.withColumn("total", F.sum("n").over(same)).select(
            "lang",
            "gram",
            ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"),
            (F.sum("cut").over(same) / F.col("total")).alias("left"),
        )
        if below is None:
            level = taken.withColumn("p", F.col("own") + F.col("left") / 256)
        else:
            suffix = F.col("gram").bitwiseAND((1 << 8 * (size - 1)) - 1)
            level = taken.join(
                below.select(F.col("lang").alias("b_lang"), F.col("gram").alias("b_gram"), F.col("p").alias("b_p")),
                F.col("lang").eqNullSafe(F.col("b_lang")) & (suffix == F.col("b_gram")),
            ).withColumn("p", F.col("own") + F.col("left") * F.col("b_p"))
        level = stored(level.select("lang", "gram", "p", "left"), "levels")
        rows.append(level.select("lang", F.lit(size).alias("size"), "gram", "p", F.lit(None).cast("double").alias("weight")))
        contexts = level.groupBy("lang", F.shiftright("gram", 8).alias("gram")).agg(F.first("left").alias("weight"))
        rows.append(contexts.select("lang", F.lit(size - 1).alias("size"), "gram", F.lit(None).cast("double").alias("p"), "weight"))
        below = level
    table = rows[0]
    for more in rows[1:]:
        table = table.unionByName(more)
    return table.groupBy("lang", "size", "gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight"))


class _Table:
    """Key to value without a search: two hashed places a key, the rest sorted."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.slots: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        for turn in range(2):
            bits = np.uint64(max(8, int(len(keys)).bit_length()))
            place = self._place(keys, turn, bits)
            known = np.zeros(1 << int(bits), np.uint64)
            held = np.zeros((1 << int(bits), values.shape[1]), np.float32)
            known[place], held[place] = keys, values
            left = known[place] != keys
            keys, values = keys[left], values[left]
            self.slots.append((bits, known, held))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    @staticmethod
    def _place(keys: np.ndarray, turn: int, bits: np.uint64) -> np.ndarray:
        return (keys << np.uint64(20 * turn)) >> (np.uint64(64) - bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, NaN where there is none."""
        out = np.full((len(keys), self.values.shape[1]), np.nan, np.float32)
        left = np.arange(len(keys), dtype=np.int32)
        for turn, (bits, known, held) in enumerate(self.slots):
            place = self._place(keys[left], turn, bits)
            hit = known[place] == keys[left]
            out[left[hit]] = held[place[hit]]
            left = left[~hit]
        if len(self.keys) and len(left):
            at = np.minimum(np.searchsorted(self.keys, keys[left]), len(self.keys) - 1)
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
        return out


def _keys(language: np.uint64 | np.ndarray, size: int, gram: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(gram.astype(np.uint64) + language + np.uint64(size << 56))


def _bits(table: _Table, language: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each n-gram, backing off where it was not seen."""
    bits, left = np.zeros(len(gram)), np.arange(len(gram))
    for size in range(ORDER, 0, -1):
        shorter = gram[left] & ((1 << 8 * size) - 1)
        p = table.get(_keys(language[left], size, shorter))[:, 0]
        hit = ~np.isnan(p)
        bits[left[hit]] -= np.log2(p[hit])
        left, shorter = left[~hit], shorter[~hit]
        if not len(left):
            return bits
        weight = table.get(_keys(language[left], size - 1, shorter >> 8))[:, 1]
        bits[left] -= np.log2(np.where(np.isnan(weight), 1.0, np.maximum(weight, 1e-6)))
    bits[left] += 8.0
    return bits


def _shards(model: DataFrame, shard_rows: int) -> list[list[int]]:
    """Context bytes by shard. A gram goes with its last byte but one, a context
    with its last; what has neither goes everywhere."""
    counts = {r["at"]: r["n"] for r in model.groupBy("at").agg(F.count("*").alias("n")).collect()}
    shards: list[list[int]] = [[]]
    room = shard_rows
    for byte in range(256):
        n = counts.get(byte, 0)
        if n > room and shards[-1]:
            shards.append([])
            room = shard_rows
        shards[-1].append(byte)
        room -= n
    return shards


def score(docs: DataFrame, model: DataFrame, text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``bits`` (of the whole text) and ``n_bytes`` to every row; wants ``lang``."""
    spark = docs.sparkSession
    by_use = [
        (F.when(F.col("size") > 1, F.shiftright("gram", 8).bitwiseAND(255)), "p"),
        (F.when(F.col("size") > 0, F.col("gram").bitwiseAND(255)), "weight"),
    ]
    uses = None
    for at, value in by_use:
        part = model.where(f"{value} is not null").select(
            "lang", "size", "gram", at.alias("at"), *(F.col(v) if v == value else F.lit(None).cast("double").alias(v) for v in ("p", "weight"))
        )
        uses = part if uses is None else uses.unionByName(part)
    uses = stored(uses, "model")
    scored = docs
    for number, shard in enumerate(_shards(uses, shard_rows)):
        chosen = uses.where(F.col("at").isNull() | F.col("at").isin(shard))
        rows = chosen.groupBy("lang", "size", "gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight")).toArrow()
        language = {x: _language_key(x) for x in rows.column("lang").unique().to_pylist()}
        codes = rows.column("lang").combine_chunks().dictionary_encode(null_encoding="encode")
        of = np.array([language[x] for x in codes.dictionary.to_pylist()], np.uint64)
        code = codes.indices.to_numpy(zero_copy_only=False)
        size = rows.column("size").to_numpy().astype(np.uint64)
        gram = rows.column("gram").to_numpy().astype(np.uint64)
        keys = mix(gram + of[code] + (size << np.uint64(56))) if len(gram) else gram
        values = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("p", "weight")], 1)
        sent = spark.sparkContext.broadcast((keys, values.astype(np.float32)))
        scored = _scored(scored, sent, np.isin(np.arange(256), shard), text, number > 0)
    return scored


def _scored(docs: DataFrame, sent, mine: np.ndarray, text: str, more: bool) -> DataFrame:
    def make(langs: pa.Array, column: pa.Array, *before: pa.Array) -> list[pa.Array]:
        if "table" not in made:
            made["table"] = _Table(*sent.value)
        bits, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        keys: dict[str | None, np.uint64] = {}
        for x in langs.unique().to_pylist():
            keys[x] = _language_key(x)
        of = np.array([keys[x] for x in langs.to_pylist()], np.uint64)
        for low, high, data, offsets in chunks(column, SCORED_BYTES):
            symbols, begin, n = _symbols(data, offsets)
            grams = _grams(symbols)
            row = np.repeat(np.arange(high - low), n)
            at = np.arange(len(row)) + np.repeat((ORDER - 1) * (np.arange(high - low) + 1), n)
            gram = grams[at]
            chosen = mine[gram >> 8 & 255]
            found = _bits(made["table"], of[low:high][row[chosen]], gram[chosen])
            bits.append(np.bincount(row[chosen], found, minlength=high - low))
            sizes.append(n)
        total = np.concatenate(bits)
        if before:
            total = total + before[0].to_numpy(zero_copy_only=False)
        return [pa.array(total), pa.array(np.concatenate(sizes), pa.int64())]

    made: dict[str, _Table] = {}
    fields = [T.StructField("bits", T.DoubleType()), T.StructField("n_bytes", T.LongType())]
    return map_arrays(docs, ["lang", text] + ["bits"] * more, fields, make)


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with ``score`` (bits per byte), ``perplexity`` (per byte),
    ``threshold`` and ``kept``; without the text unless asked for. Columns with a
    name in ``TAKEN`` are replaced.

    ``trusted`` has the ids of good documents in the column ``doc_id``. Only
    texts that may be trusted are shuffled, to be joined with these ids.
    """
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    trusted = trusted.select("doc_id").where("doc_id is not null").distinct()
    counted_ids = stored(trusted.where(~held_out), "trusted")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), "lang", F.col(text).alias("text"))
    near = maybe_in(texts, "doc_id", key_filter(counted_ids, "doc_id"))
    counts = stored(count_ngrams(near.join(counted_ids, "doc_id")), "counts")
    rows = docs.drop(*TAKEN)
    scored = score(rows, kneser_ney(counts), text)
    scored = stored(scored if keep_text else scored.drop(text), "scores")
    raw = F.try_divide("bits", "n_bytes")
    judged = scored.select(F.col(doc_id).cast("long").alias("doc_id"), "lang", "bits", "n_bytes")
    judged = judged.where("n_bytes > 0").join(trusted.where(held_out), "doc_id", "left_semi")
    pulled = (F.col("bits") + PULL * F.col("_mean")) / (F.col("n_bytes") + PULL)
    means = judged.groupBy("lang").agg((F.sum("bits") / F.sum("n_bytes")).alias("_mean"))
    limits = judged.join(means.withColumnRenamed("lang", "_m_lang"), F.col("lang").eqNullSafe(F.col("_m_lang")))
    limits = limits.groupBy("lang", "_mean").agg(
        F.percentile_approx(pulled, F.array(F.lit(0.5), F.lit(QUANTILE)), 10_000).alias("q")
    )
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))
    limits = stored(
        limits.select(
            F.col("lang").alias("_m_lang"), "_mean", (F.col("q")[1] + SPREADS * spread).alias("threshold")
        ),
        "limits",
    )
    if limits.count() <= MAX_LANGUAGES:
        limits = F.broadcast(limits)
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("_m_lang")), "left")
    value = F.when(F.col("n_bytes") > 0, F.coalesce(pulled, raw))
    joined = joined.withColumn("score", value).withColumn("perplexity", F.pow(F.lit(2.0), raw))
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True))
    return joined.withColumn("kept", kept).drop("bits", "n_bytes", "_m_lang", "_mean")
