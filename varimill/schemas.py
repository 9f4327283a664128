"""Record layouts. All are declared; none is inferred.

Times are epoch milliseconds in a long (``ts``); ``event_time`` is derived from
them where windows need a timestamp.
"""

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in cols])


MATRIX = T.ArrayType(T.ArrayType(_D))

# The six text columns of a daily tick file, in file order.
CSV_FIELDS = ("datetime", "bid", "ask", "volume", "spread", "symbol")
CSV_TICK = _struct(*((c, _S) for c in CSV_FIELDS))
# The same with the numbers read by the file reader itself.
CSV_TYPED_TICK = _struct(*((c, _D if 0 < i < 5 else _S) for i, c in enumerate(CSV_FIELDS)))

TICK = _struct(
    ("symbol", _S), ("ts", _L), ("bid", _D), ("ask", _D), ("volume", _D), ("spread", _D), ("seq", _L)
)

# Fixed value: Avro form of a tick on a topic (the sequence number is the topic offset).
TICK_AVRO = (
    '{"type":"record","name":"Tick","namespace":"domain","fields":['
    '{"name":"symbol","type":"string"},{"name":"timestamp","type":"long"},'
    '{"name":"bid","type":"double"},{"name":"ask","type":"double"},'
    '{"name":"volume","type":"double"},{"name":"spread","type":"double"}]}'
)

# What the ledger of an ingested tick table says of a daily file.
FILE_DAYS = T.ArrayType(_struct(("day", _S), ("ticks", _L), ("valid", _L)))
FILE_ENTRY = _struct(
    ("signature", _S), ("valid", _L), ("first_ts", _L), ("last_ts", _L), ("days", FILE_DAYS)
)
# A bar as far as one daily file knows it.
PARTIAL_BAR = _struct(
    ("symbol", _S),
    ("bar_end", _L),
    ("first_key", _L),
    ("first_bid", _D),
    ("last_key", _L),
    ("last_bid", _D),
    ("n_ticks", _L),
)
PARTIAL_ENTRY = _struct(("source_run", _L), ("days", T.ArrayType(_S)))
DAY_ENTRY = _struct(("source_run", _L))

BAR = _struct(("symbol", _S), ("ts", _L), ("log_return", _D))
DAILY_RV = _struct(("symbol", _S), ("ts", _L), ("rv_daily", _D))

# Field names of the scoring request and of its answer.
REQUEST_JSON = _struct(
    ("symbol", _S), ("rv_daily", _D), ("rv_weekly", _D), ("rv_monthly", _D), ("history", MATRIX)
)
RESPONSE_JSON = _struct(("symbol", _S), ("mamba", _D), ("lstm", _D), ("har", _D), ("device", _S))

REQUEST = _struct(
    ("symbol", _S),
    ("ts", _L),
    ("rv_daily", _D),
    ("rv_weekly", _D),
    ("rv_monthly", _D),
    ("is_first", _B),
    ("payload", _S),
    ("sequence", MATRIX),
)

# A request with its outcome, as stored.
SCORED = T.StructType(
    REQUEST.fields
    + _struct(
        ("status", _S),
        ("har_pred", _D),
        ("attempts", T.IntegerType()),
        ("mamba_pred", _D),
        ("lstm_pred", _D),
        ("error", _S),
        ("created_at", T.TimestampType()),
        ("outcome", _S),
    ).fields
)
# With what the store adds: the day of the letter a replay took, and the batch.
STORED = T.StructType(SCORED.fields + _struct(("letter_ts", _L), ("batch_id", _S)).fields)

DEAD_LETTER = _struct(
    ("symbol", _S), ("ts", _L), ("payload", _S), ("sequence", MATRIX), ("reason", _S)
)

# Columns of the predictions table.
PREDICTION = _struct(
    ("symbol", _S, False),
    ("ts", _L, False),
    ("rv_daily", _D, False),
    ("rv_weekly", _D, False),
    ("rv_monthly", _D, False),
    ("mamba_pred", _D),
    ("lstm_pred", _D),
    ("har_pred", _D, False),
)
PREDICTION_ROW = T.StructType(
    [T.StructField("id", _L, False)]
    + PREDICTION.fields
    + [T.StructField("created_at", T.TimestampType())]
)
SYMBOL_MAX_CHARS = 20

# Columns of the run metrics.
RUN_METRICS = _struct(
    ("run_timestamp", _S),
    ("parallelism", T.IntegerType()),
    ("input_partitions", T.IntegerType()),
    ("checkpoint_ms", _L),
    ("ml_enabled", _B),
    ("total_ticks", _L),
    ("elapsed_ms", _L),
    ("throughput_ticks_per_sec", _D),
)
