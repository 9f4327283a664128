"""Second chance for dead letters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varimill.operators.scoring import FEATURES, Scorer, score
from varimill.schemas import MATRIX, REQUEST_JSON


def decode_dead_letters(letters: DataFrame) -> DataFrame:
    """Requests from dead letters: symbol from the key, features from the text.

    Features carry the decimals of the text. A missing or mistyped field is null,
    which scoring rejects. The sequence is the one stored with the letter, or
    the history in the text when only the text is known.
    """
    letters = letters.withColumn("request", F.from_json("payload", REQUEST_JSON))
    stored = F.col("sequence") if "sequence" in letters.columns else F.lit(None).cast(MATRIX)
    ts = F.col("ts") if "ts" in letters.columns else F.lit(None).cast("long")
    return letters.select(
        "symbol",
        ts.alias("ts"),
        *(F.col(f"request.{c}").alias(c) for c in FEATURES),
        "payload",
        F.coalesce(stored, F.col("request.history")).alias("sequence"),
    )


def replay(
    letters: DataFrame,
    scorer: Scorer | None = None,
    is_ready: Callable[[], bool] | None = None,
    ts_mode: Literal["original", "processing"] = "original",
    **score_options,
) -> DataFrame:
    """Score dead letters again; the result has the form ``score`` gives.

    Two attempts without pause or breaker; between them and before the first,
    ``is_ready`` is awaited. What fails again stays a dead letter. ``ts`` is the
    original day, or the time of the replay with ``ts_mode='processing'``;
    ``replayed_at`` always holds the latter, ``letter_ts`` the former.
    """
    requests = decode_dead_letters(letters)
    options = {"max_attempts": 2, "backoff_ms": 0, "breaker_threshold": None} | score_options
    scored = score(requests, scorer, is_ready=is_ready, **options)
    scored = scored.withColumn("replayed_at", F.current_timestamp()).withColumn("letter_ts", F.col("ts"))
    if ts_mode == "processing":
        scored = scored.withColumn("ts", F.unix_millis("replayed_at"))
    return scored
