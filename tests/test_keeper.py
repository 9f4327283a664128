"""Kept bars: every tick of a stream is in a bar, late, or invalid."""

import random

import pytest

from varimill.config import PipelineConfig
from varimill.operators import log_return_bars
from varimill.schemas import TICK
from varimill.streaming import available_now, batch_counts, corrected_bars, keep_bars, kept_bars, late_rows

BAR = 300_000
START = 19_000 * 86_400_000
DELAY = 3000


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def feed(write, ticks_of, batches):
    for number, rows in enumerate(batches):
        write(ticks_of(rows), number)


def test_nothing_is_lost_and_late_ticks_can_be_merged(spark, ticks_of, tmp_path):
    root = str(tmp_path / "kept")
    rng = random.Random(4)
    rows = [("ab"[i % 2], START + i * 20_000, 1 + rng.random(), 9.0, 1.0, i) for i in range(200)]
    rows[7] = (*rows[7][:2], -1.0, *rows[7][3:])
    batches = [rows[20:90], rows[100:150] + rows[:20], rows[150:] + rows[90:100]]
    feed(keep_bars(root), ticks_of, batches)
    counts = {r.batch_id: r for r in batch_counts(spark, root).collect()}
    assert [counts[i].ticks for i in range(3)] == [70, 70, 60]
    marks = [counts[i].mark for i in range(3)]
    assert marks == [rows[89][1] - DELAY, rows[149][1] - DELAY, rows[199][1] - DELAY]
    late = [r for n, b in enumerate(batches) if n for r in b if r[2] > 0 and r[1] // BAR * BAR + BAR <= marks[n - 1]]
    assert late and rows_of(late_rows(spark, root), "symbol", "ts", "seq") == sorted((r[0], r[1], r[5]) for r in late)
    in_time = [r for r in rows if r[2] > 0 and r not in late]
    columns = ("symbol", "ts", "log_return", "n_ticks")
    assert rows_of(kept_bars(spark, root, still_open=True), *columns) == rows_of(log_return_bars(ticks_of(in_time)), *columns)
    good = [r for r in rows if r[2] > 0]
    assert rows_of(corrected_bars(spark, root, still_open=True), *columns) == rows_of(log_return_bars(ticks_of(good)), *columns)
    assert all(r.ts <= marks[-1] for r in kept_bars(spark, root).collect())


def test_a_repeated_batch_counts_once(spark, ticks_of, tmp_path):
    root = str(tmp_path / "kept")
    write = keep_bars(root)
    first, second = [("a", START + i, 1.0 + i) for i in range(5)], [("a", START + BAR * 3 + i, 2.0) for i in range(5)]
    feed(write, ticks_of, [first, second])
    write(ticks_of(second), 1)
    write(ticks_of(first), 0)
    assert rows_of(batch_counts(spark, root), "batch_id", "ticks", "late") == [(0, 5, 0), (1, 5, 0)]
    assert rows_of(kept_bars(spark, root, still_open=True), "n_ticks") == [(5,), (5,)]


def test_more_micro_batches_than_progress_remembers_are_counted(spark, ticks_of, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "kept")
    rows = ticks_of([("a", START + i * 60_000, 1.0 + i % 7) for i in range(80)])
    rows.repartition(20).write.parquet(str(landing))
    stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(landing))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        query = available_now(stream, keep_bars(root), str(tmp_path / "checkpoint"), 1)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    counts = batch_counts(spark, root).collect()
    assert len(counts) > 10 > len(query.recentProgress) and sum(r.ticks for r in counts) == 80


@pytest.mark.parametrize("moved_by", ["valid", "all"])
def test_what_moves_time(spark, ticks_of, tmp_path, moved_by):
    root = str(tmp_path / "kept")
    far = ("a", START + 10**12, -1.0)
    feed(keep_bars(root, moved_by=moved_by), ticks_of, [[("a", START, 1.0), far], [("a", START + BAR * 4, 2.0)]])
    assert late_rows(spark, root).count() == (1 if moved_by == "all" else 0)
    with pytest.raises(ValueError, match="moved_by"):
        keep_bars(root, moved_by="some")


def test_the_slowest_source_sets_the_mark(spark, ticks_of, tmp_path):
    root = str(tmp_path / "kept")
    write = keep_bars(root, source="symbol", expected=("a", "b"))
    fast = [("a", START + i * BAR, 1.0 + i) for i in range(9)]
    slow = [("b", START + i * BAR, 1.0 + i) for i in range(9)]
    feed(write, ticks_of, [fast[:6], fast[6:] + slow[:2], slow[2:]])
    marks = [r.mark for r in batch_counts(spark, root).orderBy("batch_id").collect()]
    assert marks == [None, START + BAR - DELAY, START + 8 * BAR - DELAY]
    assert late_rows(spark, root).count() == 0


def test_an_empty_stream(spark, ticks_of, tmp_path):
    root = str(tmp_path / "kept")
    assert late_rows(spark, root).count() == kept_bars(spark, root).count() == batch_counts(spark, root).count() == 0
    keep_bars(root, PipelineConfig())(ticks_of([]), 0)
    assert rows_of(batch_counts(spark, root), "ticks", "mark") == [(0, None)]
    assert kept_bars(spark, root, still_open=True).count() == 0
