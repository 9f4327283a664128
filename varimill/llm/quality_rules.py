"""Quality rules with thresholds that follow the data.

Per-document statistics feed quantile sketches (KLL) per language and source.
Sketches merge, so a source with few documents takes its language's sketch, and
a language with few the one of all documents. The thresholds read off them are
joined back to the documents.

Null texts count as empty; null languages and sources are groups of their own.
Sketches hold exact values for small groups and are randomized for large ones:
a threshold may move within the sketch's rank error (about 0.3 %) between runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill.llm.frames import map_arrays, stored
from varimill.llm.words import _SPACE, Words, chunks, mix

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
MIN_WORDS = 50
MIN_GROUP = 100  # documents a group needs for thresholds of its own
SKETCH_K = 800
SPREADS = 6.0  # quartile distances beyond a quartile that are still let pass
# Feature: least quartile distance, so that a feature which hardly varies keeps some room.
FEATURES = {
    "symbol_share": 0.005,
    "upper_share": 0.01,
    "word_length": 0.25,
    "dup_line_share": 0.07,
    "repeat_share": 0.07,
}
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _equal_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier one."""
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(ends, offsets[row + 1])
    ends -= (ends > starts) & (data[ends - 1] == 0x0A)
    first = np.searchsorted(words.start, starts)
    full = first < np.searchsorted(words.start, ends)
    starts, ends, row = starts[full], ends[full], row[full]
    line = object.__new__(Words)
    line.data, line.start, line.end = data, starts, ends
    key = mix(line.hashes() ^ mix(row.astype(np.uint64)))
    kept = np.unique(key, return_index=True)[1]
    lines = np.bincount(row, minlength=n)
    return lines, lines - np.bincount(row[kept], minlength=n)


def _repeated(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text: words in runs of three that occur twice or more in it."""
    at, window = words.windows(hashes, 3)
    key = mix(window ^ mix(words.row[at].astype(np.uint64)))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), bool)
    begins = at[counts[inverse] > 1]
    for i in range(3):
        covered[begins + i] = True
    return np.bincount(words.row[covered], minlength=len(words.offsets) - 1)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts in ``STATS`` to every row, in one pass without a shuffle."""

    def make(column: pa.Array) -> list[pa.Array]:
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in STATS]
        for _, _, data, offsets in chunks(column):
            words = Words(data, offsets)
            lines, equal = _equal_lines(words)
            found = (
                words.counts(),
                _per_text(_HEAD[data] & ~_SPACE[data], offsets),
                _per_text(_SYMBOL[data], offsets),
                equal,
                _repeated(words, words.hashes()),
                lines,
                _per_text(_UPPER[data], offsets),
            )
            for part, values in zip(parts, found, strict=True):
                part.append(values)
        return [pa.array(np.concatenate(p), pa.int64()) for p in parts]

    return map_arrays(docs, [text], [T.StructField(s, T.LongType()) for s in STATS], make)


def base_failed() -> Column:
    """Too short, or mostly repetition: no threshold is needed to see that."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": F.col("n_upper") / chars,
        "word_length": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
    }


def group_sketches(features: DataFrame) -> DataFrame:
    """One sketch per feature for each language and source; rows are combined on
    the map side, so a source with a third of all rows costs no more than another."""
    return features.groupBy("lang", "source").agg(
        F.count("*").alias("n"),
        *(F.kll_sketch_agg_double(F.col(f), F.lit(SKETCH_K)).alias(f) for f in FEATURES),
    )


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Lowest and highest value let pass per language, source and feature.

    The sketch is that of the smallest enclosing group with ``min_group``
    documents: source in language, language, all.
    """
    merged = [F.kll_merge_agg_double(F.col(f)).alias(f) for f in FEATURES]
    total = F.sum("n").alias("n")
    language = sketches.groupBy("lang").agg(total, *merged)
    whole = sketches.agg(total, *merged)
    chosen = sketches.select("lang", "source", "n", F.struct(*FEATURES).alias("own"))
    chosen = chosen.join(
        language.select(
            F.col("lang").alias("l"), F.col("n").alias("n_lang"), F.struct(*FEATURES).alias("of_lang")
        ),
        F.col("lang").eqNullSafe(F.col("l")),
    ).crossJoin(whole.select(F.struct(*FEATURES).alias("of_all")))  # one row by its making
    best = (
        F.when(F.col("n") >= min_group, F.col("own"))
        .when(F.col("n_lang") >= min_group, F.col("of_lang"))
        .otherwise(F.col("of_all"))
    )
    picked = chosen.select("lang", "source", best.alias("s"))
    bounds = []
    for name, least in FEATURES.items():
        sketch = F.col(f"s.{name}")
        low, mid, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.5, 0.75))
        below = F.greatest(mid - low, F.lit(least))
        above = F.greatest(high - mid, F.lit(least))
        bounds += [
            (low - SPREADS * below).alias(f"{name}_min"),
            (high + SPREADS * above).alias(f"{name}_max"),
        ]
    return picked.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *bounds)


def judge(
    docs: DataFrame, text: str = "text", min_group: int = MIN_GROUP, keep: list[str] | None = None
) -> DataFrame:
    """Statistics, ``base_failed``, ``broken_rules`` and ``kept`` for every row.

    Only documents that pass the base rules feed the sketches. ``keep`` names
    further columns to carry along. The statistics are stored once: texts are
    read in a single pass.
    """
    carried = ["lang", "source"] + [c for c in keep or [] if c not in ("lang", "source")]
    stats = text_statistics(docs.select(*carried, text), text).drop(*({text} - set(keep or [])))
    stats = stored(stats.withColumn("base_failed", base_failed()), "rules")
    passed = stats.where(~F.col("base_failed"))
    features = passed.select("lang", "source", *(c.alias(n) for n, c in _features().items()))
    limits = thresholds(group_sketches(features), min_group)
    joined = stats.join(
        limits,
        F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
        "left",
    )
    broken = F.array_compact(
        F.array(
            *(
                F.when(~value.between(F.col(f"{n}_min"), F.col(f"{n}_max")), F.lit(n))
                for n, value in _features().items()
            )
        )
    )
    rows = joined.withColumn("broken_rules", broken).drop("t_lang", "t_source")
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    return rows.drop(*(f"{n}_{side}" for n in FEATURES for side in ("min", "max")))
