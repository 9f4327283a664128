import pytest

from varimill.operators import ingest_counts, select_days
from varimill.sources import (
    dead_letters_from_records,
    day_names,
    kafka_options,
    read_ticks_csv,
)
from varimill.sinks import land_ticks, write_ticks_csv
from varimill.streaming import available_now

HEADER = "DateTime,Bid,Ask,Volume,Spread,Symbol\n"


def line(when="20240102 00:00:01.500", bid="1.5", symbol="A"):
    return f"{when},{bid},1.6,10,0.1,{symbol}\n"


def write(path, *lines, header=HEADER):
    path.write_text(header + "".join(lines))


def test_malformed_lines(spark, tmp_path):
    write(
        tmp_path / "2024-01-02.csv",
        line(),
        "\n",
        "20240102 00:00:02.000,1,2,3,4\n",
        "20240102 00:00:03.000,1.5,1.6,10,0.1,A,extra,fields\n",
        line(bid="abc"),
        line(bid=""),
        line(when="2024-01-02 00:00:00.000"),
        line(when="20240102 00:00:04.5"),
        line(when="20241302 00:00:04.500"),
        line(when="20240102 00:60:04.500"),
        line(when="1704153605000"),
        line(when=" 20240102 00:00:06.000 ", symbol="  B\t"),
        line(when="20240102 00:00:07.000", bid="NaN"),
        line(when="20240102 00:00:08.000", bid="-Infinity"),
        line(when="20240102 00:00:09.000", bid="1d"),
        line(when="20240102 00:00:10.000", bid="inf"),
        line(when="20240102 00:00:11.000", symbol="   "),
        line(when="20240102 00:00:12.000", bid='"1"'),
        line(when="20240102 00:00:13.000", symbol='"Q"'),
    )
    rows = read_ticks_csv(spark, str(tmp_path)).orderBy("ts").collect()
    start = 1704153600000
    assert [(r.ts - start, str(r.bid), r.symbol) for r in rows] == [
        (1500, "1.5", "A"),
        (3000, "1.5", "A"),
        (5000, "1.5", "A"),
        (6000, "1.5", "B"),
        (7000, "nan", "A"),
        (8000, "-inf", "A"),
        (9000, "1.0", "A"),
        (11000, "1.5", ""),
        (13000, "1.5", '"Q"'),
    ]


@pytest.mark.parametrize(
    "text, ms",
    [
        ("20240229 23:59:59.999", 1709251199999),
        ("20240231 00:00:00.000", 1709164800000),  # past the month: its last day
        ("20240102 24:00:00.000", 1704240000000),  # midnight of the next day
        ("20240102 24:00:00.001", None),
        ("20240100 00:00:00.000", None),
        ("0", 0),
        ("99999999999999999999", None),
    ],
)
def test_times(spark, text, ms):
    from varimill.functions import ts_sql

    df = spark.createDataFrame([(text,)], "t string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert df.selectExpr(f"{ts_sql('t')} AS ms").first().ms == ms
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_first_line_of_each_file_is_skipped_whatever_it_holds(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        write(tmp_path / f"{day}.csv", line(symbol=day), header=line(symbol="lost"))
    symbols = {r.symbol for r in read_ticks_csv(spark, str(tmp_path)).collect()}
    assert symbols == {"2024-01-01", "2024-01-02"}


@pytest.fixture
def days(tmp_path):
    names = ("2024-01-01.csv", "2024-01-02.csv", "2024-01-03.CSV", "2024-01-04.csv")
    for name in names:
        write(tmp_path / name, line(symbol=name[:10]), line(symbol=name[:10]))
    (tmp_path / "notes.txt").write_text("x\ny\n")
    (tmp_path / "nested").mkdir()
    write(tmp_path / "nested" / "2024-01-05.csv", line(symbol="nested"))
    return str(tmp_path)


@pytest.mark.parametrize(
    "options, kept",
    [
        ({}, "1234"),
        ({"from_date": "2024-01-02"}, "234"),
        ({"last_n": 2}, "34"),
        ({"from_date": "2024-01-02", "last_n": 9}, "234"),
        ({"from_date": "2024-01-03", "last_n": 1}, "4"),
        ({"from_date": "2025-01-01"}, ""),
    ],
)
def test_day_selection(spark, days, options, kept):
    df = read_ticks_csv(spark, days, **options)
    assert {r.symbol for r in df.collect()} == {f"2024-01-0{d}" for d in kept}


def test_empty_directory_gives_no_rows(spark, tmp_path):
    for options in ({}, {"last_n": 3}, {"from_date": "2024-01-01", "last_n": 3}):
        assert read_ticks_csv(spark, str(tmp_path), **options).count() == 0


def test_clock_text_reads_back_in_any_session_zone(spark):
    from varimill.functions import clock_text, day_name, ts_sql

    stamps = [1, 1704153601500, 1709251199999, 1520000000007, 86_399_999]
    df = spark.createDataFrame([(t,) for t in stamps], "ts long")
    for zone in ("UTC", "America/Sao_Paulo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            texts = df.select("ts", clock_text().alias("t"), day_name().alias("d"))
            rows = texts.selectExpr("*", f"{ts_sql('t')} AS back").collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r.back for r in rows] == stamps
        assert (rows[2].t, rows[2].d) == ("20240229 23:59:59.999", "2024-02-29")


def test_day_selection_prunes_files(spark, days):
    df = read_ticks_csv(spark, days, last_n=1)
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1


def test_day_names_are_sorted(spark, days):
    assert day_names(spark, days)[-2:] == ["2024-01-03.CSV", "2024-01-04.csv"]


def test_counts_per_file_and_total(spark, days):
    counts = {r.file_name: r.ticks for r in ingest_counts(read_ticks_csv(spark, days)).collect()}
    assert counts == {
        "2024-01-01.csv": 2,
        "2024-01-02.csv": 2,
        "2024-01-03.CSV": 2,
        "2024-01-04.csv": 2,
        None: 8,
    }


def test_select_days_on_any_column(spark):
    df = spark.createDataFrame([(d,) for d in "aabbcd"], "day string")
    assert sorted(r.day for r in select_days(df, "b", 2, "day").collect()) == ["c", "d"]
    assert select_days(df, None, 0, "day").count() == 6


def test_line_order_breaks_ties(spark, tmp_path):
    rows = [line(bid=str(i)) for i in range(1, 2001)]
    write(tmp_path / "2024-01-02.csv", *rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_ticks_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        by_seq = [r.bid for r in df.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert by_seq == [float(i) for i in range(1, 2001)]


def test_daily_files_round_trip(spark, tmp_path, ticks_of):
    day = 86_400_000
    ticks = ticks_of([("A", 5 * day + 1, 1.25), ("B", 6 * day, 0.1), ("A", 7 * day - 1, 3e-9)])
    write_ticks_csv(ticks, str(tmp_path / "out"))
    back = read_ticks_csv(spark, str(tmp_path / "out"), from_date="1970-01-07")
    rows = {(r.symbol, r.ts, r.bid, r.file_name) for r in back.collect()}
    assert rows == {("B", 6 * day, 0.1, "1970-01-07"), ("A", 7 * day - 1, 3e-9, "1970-01-07")}


def test_landed_stream_of_files_equals_the_batch_read(spark, tmp_path):
    rows = [line(when=f"20240102 00:00:{i % 60:02d}.000", bid=str(i)) for i in range(1, 900)]
    source = tmp_path / "in"
    source.mkdir()
    write(source / "2024-01-01.csv", line(bid="9"), "broken\n")
    write(source / "2024-01-02.csv", *rows, "broken\n", *rows)
    stream = read_ticks_csv(spark, str(source), from_date="2024-01-02", streaming=True)
    out = str(tmp_path / "out")
    available_now(stream, land_ticks(out), str(tmp_path / "checkpoint"))
    names = ["ts", "bid", "symbol"]
    landed = spark.read.parquet(out).orderBy("seq").select(*names).collect()
    batch = read_ticks_csv(spark, str(source), from_date="2024-01-02")
    assert landed == batch.orderBy("seq").select(*names).collect() and len(landed) == 2 * 899
    with pytest.raises(ValueError, match="last_n"):
        read_ticks_csv(spark, str(source), last_n=1, streaming=True)


def test_kafka_reads_are_bounded():
    assert kafka_options("h:1", "t", streaming=False)["endingOffsets"] == "latest"
    stream = kafka_options("h:1", "t", streaming=True)
    assert stream["startingOffsets"] == "earliest" and "endingOffsets" not in stream


def test_dead_letter_records(spark):
    records = spark.createDataFrame([(b"A", b"{}")], "key binary, value binary")
    row = dead_letters_from_records(records).first()
    assert (row.symbol, row.payload, row.ts, row.sequence) == ("A", "{}", None, None)
