"""Ledgers, and tables that follow their files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varimill import ledger
from varimill.config import PipelineConfig
from varimill.functions import day_name
from varimill.operators import daily_rv, log_return_bars, merged_bars, partial_bars, valid_ticks
from varimill.plans import bars_job, daily_job, day_counts, file_counts, forecast_job, ingest_job, refresh_daily_job, upkeep_job
from varimill.plans.ingest import changed_files
from varimill.schemas import FILE_ENTRY
from varimill.sinks import read_metrics, write_daily, write_ticks, write_ticks_csv
from varimill.sources import day_bound, list_files, read_daily, read_ticks

DAY = 86_400_000
START = 19_000 * DAY  # 2022-01-08
CONFIG = PipelineConfig()
HEAD = "DateTime,Bid,Ask,Volume,Spread,Symbol\n"


def line(ts, bid=1.5, symbol="a"):
    return f"{ts},{bid},{bid + 1},1,1,{symbol}\n"


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + "".join(lines))


def held(spark, table):
    return sorted((r.ts, r.bid) for r in read_ticks(spark, table).select("ts", "bid").collect())


NOTHING = T.StructType([])


def test_a_part_is_replaced_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])

    def run(rows, keys):
        number = ledger.next_run(spark, root)
        ledger.write_parts(spark.createDataFrame(rows, schema), root, number, "k")
        settled = spark.createDataFrame([(k, sum(r[0] == k for r in rows)) for k in keys], "key string, rows long")
        ledger.commit(settled, root, number)
        return number

    def read():
        return sorted(tuple(r) for r in ledger.read_parts(spark, root, schema).collect())

    assert read() == [] and not ledger.has_ledger(spark, root)
    assert run([("a", 1), ("a", 2), ("b/ =%", 3)], ["a", "b/ =%", "empty"]) == 1
    assert read() == [("a", 1), ("a", 2), ("b/ =%", 3)]
    run([("a", 9)], ["a"])
    assert read() == [("a", 9), ("b/ =%", 3)]
    run([], ["b/ =%"])
    assert read() == [("a", 9)]
    # A run without its ledger file does not count; its number is taken again.
    ledger.write_parts(spark.createDataFrame([("a", 7)], schema), root, 4, "k")
    assert read() == [("a", 9)] and ledger.next_run(spark, root) == 4
    assert ledger.remove_superseded(spark, root) == 2
    assert ledger.remove_superseded(spark, root) == 0
    assert read() == [("a", 9)]
    assert {(r.key, r.rows) for r in ledger.current(spark, root, NOTHING).collect()} == {("a", 1), ("b/ =%", 0), ("empty", 0)}
    assert ledger.entries_of(spark, root, 2, NOTHING).count() == 1
    assert ledger.entries_of(spark, root, 4, NOTHING) is None


def test_the_second_to_commit_a_number_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    settled = spark.createDataFrame([("a", 0)], "key string, rows long")
    ledger.commit(settled, root, 1)
    with pytest.raises(Exception, match="already exists"):
        ledger.commit(settled, root, 1)


def test_a_corrected_and_an_emptied_file_leave_nothing(spark, tmp_path):
    csv, table = tmp_path / "csv", str(tmp_path / "ticks")
    write(csv, "2022-01-08.csv", line(START + 1), line(START + DAY + 1))
    write(csv, "2022-01-09.csv", line(START + DAY + 5))
    assert ingest_job(spark, str(csv), table, CONFIG) == 1
    assert len(held(spark, table)) == 3
    assert ingest_job(spark, str(csv), table, CONFIG) is None  # nothing has changed
    write(csv, "2022-01-08.csv", line(START + 1, 2.5))
    assert [r.file_name for r in changed_files(spark, str(csv), table).collect()] == ["2022-01-08.csv"]
    assert ingest_job(spark, str(csv), table, CONFIG) == 2
    assert held(spark, table) == [(START + 1, 2.5), (START + DAY + 5, 1.5)]
    write(csv, "2022-01-08.csv")
    assert ingest_job(spark, str(csv), table, CONFIG) == 3
    assert held(spark, table) == [(START + DAY + 5, 1.5)]
    assert {(r.file_name, r.ticks) for r in file_counts(spark, table).collect()} == {
        ("2022-01-08.csv", 0), ("2022-01-09.csv", 1), (None, 1)
    }
    entry = ledger.current(spark, table, FILE_ENTRY).where("key = '2022-01-09.csv'").first()
    assert (entry.first_ts, entry.last_ts, entry.valid, [tuple(d) for d in entry.days]) == (
        START + DAY + 5, START + DAY + 5, 1, [("2022-01-09", 1, 1)]
    )


def test_only_changed_files_are_read(spark, tmp_path):
    csv, tables = tmp_path / "csv", [str(tmp_path / t) for t in ("ticks", "bars", "daily")]
    for d in range(3):
        write(csv, f"2022-01-0{d + 7}.csv", *(line(START + (d - 1) * DAY + i * 1000, 1 + i) for i in range(9)))
    assert upkeep_job(spark, str(csv), *tables, CONFIG) == ["2022-01-07", "2022-01-08", "2022-01-09"]
    assert upkeep_job(spark, str(csv), *tables, CONFIG) == []
    write(csv, "2022-01-08.csv", *(line(START + i * 1000, 2 + i * i) for i in range(9)))
    ingest_job(spark, str(csv), tables[0], CONFIG)
    # Runs hold the files that had changed and no others.
    parts = {p.parent.parent.parent.name: p for p in (tmp_path / "ticks").rglob("*.parquet") if "run_id=2" in str(p) and "_ledger" not in str(p)}
    assert len(parts) == 1
    assert bars_job(spark, tables[0], tables[1], CONFIG) == 2
    assert refresh_daily_job(spark, tables[1], tables[2], CONFIG) == ["2022-01-08"]
    whole = daily_rv(log_return_bars(valid_ticks(read_ticks(spark, tables[0]))))
    rounded = lambda df: sorted((r.symbol, r.ts, round(r.rv_daily, 12)) for r in df.collect())
    assert rounded(read_daily(spark, tables[2])) == rounded(whole)


def test_a_job_that_stopped_between_the_tables_goes_on(spark, tmp_path):
    csv, tables = tmp_path / "csv", [str(tmp_path / t) for t in ("ticks", "bars", "daily")]
    write(csv, "2022-01-08.csv", *(line(START + i * 1000, 1 + i) for i in range(9)))
    ingest_job(spark, str(csv), tables[0], CONFIG)
    assert bars_job(spark, *tables[:2], CONFIG) == 1
    # Stopped here: the days are still to be made.
    assert upkeep_job(spark, str(csv), *tables, CONFIG) == ["2022-01-08"]
    # A day that loses all its bars is made anew as well, and goes.
    write(csv, "2022-01-08.csv")
    assert upkeep_job(spark, str(csv), *tables, CONFIG) == ["2022-01-08"]
    assert read_daily(spark, tables[2]).count() == 0


def test_a_late_file_changes_the_day_it_brings_ticks_of(spark, tmp_path):
    csv, tables = tmp_path / "csv", [str(tmp_path / t) for t in ("ticks", "bars", "daily")]
    ticks = [line(START + i * 7000, 1 + i % 5 + i / 100) for i in range(200)]
    write(csv, "2022-01-08.csv", *ticks[::2])
    upkeep_job(spark, str(csv), *tables, CONFIG)
    write(csv, "2022-03-01.csv", *ticks[1::2])
    assert upkeep_job(spark, str(csv), *tables, CONFIG) == ["2022-01-08"]
    whole = daily_rv(log_return_bars(valid_ticks(read_ticks(spark, tables[0])))).collect()
    kept = read_daily(spark, tables[2]).collect()
    assert len(kept) == len(whole) == 1 and kept[0].rv_daily == pytest.approx(whole[0].rv_daily)
    assert {(r.day, r.ticks, r.files) for r in day_counts(spark, tables[0]).collect()} == {("2022-01-08", 200, 2)}


def test_days_are_chosen_without_a_look_at_the_ticks(spark, ticks_of, tmp_path):
    csv, table, plain = tmp_path / "csv", str(tmp_path / "ticks"), str(tmp_path / "plain")
    for d in range(4):
        write(csv, f"2022-01-0{d + 5}.csv", line(START + (d - 3) * DAY))
    ingest_job(spark, str(csv), table, CONFIG)
    write_ticks(ticks_of([("a", START + d * DAY, 1.0) for d in range(-3, 1)]), plain)
    for path in (table, plain):
        assert day_bound(spark, path) is None
        assert day_bound(spark, path, last_n=2) == "2022-01-07"
        assert day_bound(spark, path, "2022-01-08", 3) == "2022-01-08"
        assert day_bound(spark, path, "2023-01-01", 3) == "2023-01-01"
        assert read_ticks(spark, path, from_date="2022-01-07").count() == 2
    forecast_job(spark, table, str(tmp_path / "store"), config=PipelineConfig(last_n=2), metrics=str(tmp_path / "m"))
    assert [r.total_ticks for r in read_metrics(spark, str(tmp_path / "m")).collect()] == [2]


def test_choice_of_files(spark, tmp_path):
    csv, table = tmp_path / "csv", str(tmp_path / "ticks")
    for d in range(4):
        write(csv, f"2022-01-0{d + 5}.csv", line(START + (d - 3) * DAY))
    write(csv, "notes.txt")
    assert list_files(spark, str(csv)).count() == 4
    ingest_job(spark, str(csv), table, PipelineConfig(last_n=1))
    assert held(spark, table) == [(START, 1.5)]
    ingest_job(spark, str(csv), table, PipelineConfig(from_date="2022-01-07"))
    assert len(held(spark, table)) == 2


def test_a_day_without_value_goes_from_the_daily_table(spark, ticks_of, daily_of, tmp_path):
    ticks, daily = str(tmp_path / "ticks"), str(tmp_path / "daily")
    write_ticks(ticks_of([("a", START + d * DAY + i, 1.0 + i) for d in range(3) for i in range(3)]), ticks)
    daily_job(spark, ticks, daily, config=CONFIG)
    assert read_daily(spark, daily).count() == 3
    write_ticks(ticks_of([("a", START + i, 1.0 + i) for i in range(3)] + [("a", START + 2 * DAY, 1.0)]), ticks, "overwrite")
    daily_job(spark, ticks, daily, from_date="2022-01-10", config=CONFIG)
    assert [r.day for r in read_daily(spark, daily).orderBy("day").collect()] == ["2022-01-08", "2022-01-09"]
    daily_job(spark, ticks, daily, config=CONFIG)
    assert [r.day for r in read_daily(spark, daily).collect()] == ["2022-01-08"]
    write_daily(daily_of([]), daily)
    assert read_daily(spark, daily).count() == 0


def test_ingested_tables_are_no_stream(spark, tmp_path):
    csv, table = tmp_path / "csv", str(tmp_path / "ticks")
    write(csv, "2022-01-08.csv", line(START))
    ingest_job(spark, str(csv), table, CONFIG)
    with pytest.raises(ValueError, match="read in batch"):
        read_ticks(spark, table, streaming=True)


def test_partial_bars_merge_to_the_bars_of_all_ticks(spark, ticks_of):
    rows = [(s, START + i * 37_000, 1 + (i * 7919 % 101) / 10, 99.0, 1.0, i) for i in range(300) for s in ("a", "b")]
    ticks = ticks_of(rows + [("a", START, 5.0, 99.0, 1.0, 1000)])
    for parts in (1, 2, 7):
        dealt = ticks.withColumn("part", F.col("seq") % parts)
        made = merged_bars(partial_bars(dealt, by=("part",)))
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, log_return_bars(ticks).select(made.columns).collect()))


def test_directories_of_days(spark, ticks_of, tmp_path):
    csv, table = str(tmp_path / "csv"), str(tmp_path / "ticks")
    ticks = ticks_of([("a", START + d * DAY + i, 1.0) for d in range(3) for i in range(5)])
    write_ticks_csv(ticks, csv)
    ingest_job(spark, csv, table, CONFIG)
    assert read_ticks(spark, table).groupBy("day").count().count() == 3
    write_ticks_csv(ticks.where(day_name() == "2022-01-08").limit(2), csv, "overwrite", day="2022-01-08")
    ingest_job(spark, csv, table, CONFIG)
    assert read_ticks(spark, table).count() == 12
