import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import varimill  # noqa: E402
from varimill.session import RECOMMENDED  # noqa: E402

cloudpickle.register_pickle_by_value(varimill)


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ticks_of(spark):
    """(symbol, ts, bid[, ask, volume, seq]) tuples to a tick frame."""
    from varimill.schemas import TICK

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            symbol, ts, bid = r[:3]
            ask = r[3] if len(r) > 3 else bid
            volume = r[4] if len(r) > 4 else 1.0
            seq = r[5] if len(r) > 5 else i
            full.append((symbol, ts, bid, ask, volume, 0.0, seq))
        return spark.createDataFrame(full, TICK)

    return make


@pytest.fixture
def daily_of(spark):
    from varimill.schemas import DAILY_RV

    return lambda rows: spark.createDataFrame(rows, DAILY_RV)
