"""Daily tick files.

A directory holds one CSV file per day, named ``YYYY-MM-DD.csv``, or one
``day=YYYY-MM-DD`` subdirectory of CSV files per day, the layout Spark writes.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varimill.functions import number_sql, strip_sql, ts_sql
from varimill.schemas import CSV_FIELDS, CSV_TICK, CSV_TYPED_TICK, TICK

GLOB = "*.[cC][sS][vV]"
_DAY_DIR = re.compile(r"/day=([^/]+)/")


def _reader(spark: SparkSession, streaming: bool = False, typed: bool = False):
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(CSV_TYPED_TICK if typed else CSV_TICK)
        # The spellings of the numbers that are none.
        .options(nanValue="NaN", positiveInf="Infinity", negativeInf="-Infinity")
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", GLOB)
    )


def day_label(file: str) -> str:
    path = unquote(file)
    found = _DAY_DIR.search(path)
    return found.group(1) if found else path.rsplit("/", 1)[-1]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name`` (the name of the day), ``paths`` and ``signature`` of every daily
    file under ``path``; a change of name, size or time changes the signature.

    One listing; no file is opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", True)
    directory = F.regexp_extract("path", r"/day=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    label = F.when(directory != "", F.url_decode(directory)).otherwise(name)
    about = F.concat_ws("|", name, "length", F.unix_millis("modificationTime"))
    return (
        files.load(path)
        .select(label.alias("file_name"), "path", about.alias("about"))
        .groupBy("file_name")
        .agg(
            F.sort_array(F.collect_list("path")).alias("paths"),
            F.md5(F.concat_ws(",", F.sort_array(F.collect_list("about")))).alias("signature"),
        )
    )


def day_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the days under ``path``, oldest first.

    This is the file listing the driver holds anyway; no file is opened.
    """
    return _days_of(_reader(spark).csv(path))


def _days_of(df: DataFrame) -> list[str]:
    return sorted({day_label(f) for f in df.inputFiles()})


def read_csv_fields(
    spark: SparkSession,
    path: str,
    from_date: str | None = None,
    last_n: int = 0,
    streaming: bool = False,
    typed: bool = False,
    files: list[str] | None = None,
) -> DataFrame:
    """Fields of the lines, with ``file_name`` and the line order ``seq``.

    All are text; with ``typed`` the reader parses the four numbers, and one that
    does not parse is null.

    The first line of every file is skipped, blank lines too. ``from_date`` and
    ``last_n`` select days by name; both become one lower bound on the name, so
    the scan lists only the files it needs. A directory without a matching day
    gives no rows. ``files`` names the files under ``path`` that are read, if not all.

    On a stream, ``seq`` is only the start of the file split: Spark numbers no
    rows there. ``sinks.land_ticks`` completes it when it stores the batches.
    """
    if last_n and streaming:
        raise ValueError("last_n needs a closed set of files; use from_date on a stream")
    reader = _reader(spark, streaming, typed)
    df = reader.csv(path) if files is None else reader.option("basePath", path).csv(files)
    if last_n > 0:
        # The listing of this very frame; no other is made.
        newest = [n for n in _days_of(df) if n >= (from_date or "")][-last_n:]
        # Without any match the bound stays as it is and keeps nothing.
        from_date = newest[0] if newest else from_date
    by_directory = "day" in df.columns
    label = F.col("day").cast("string") if by_directory else F.col("_metadata.file_name")
    if from_date:
        df = df.where(label >= from_date)
    start = F.col("_metadata.file_block_start")
    return df.select(
        *CSV_FIELDS,
        label.alias("file_name"),
        (start if streaming else start + line_place()).alias("seq"),
    )


def line_place() -> Column:
    """The row's place in its task, so that split start plus place follows a file.

    A split is at least as many bytes as it has rows, and only the last split of
    a file shares a task with others; hence the sum grows along the file.
    """
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def ticks_from_fields(fields: DataFrame) -> DataFrame:
    """Typed ticks from six fields; a row that does not parse is dropped.

    Numbers may be text or parsed already.

    The symbol is trimmed; a blank one stays, a missing one does not. ``spread`` must parse although
    nothing reads it later. NaN and infinities are numbers here.
    """
    kept = [c for c in fields.columns if c not in CSV_FIELDS]
    stripped = fields.selectExpr(
        f"{strip_sql('symbol')} AS symbol",
        f"{strip_sql('datetime')} AS datetime",
        *("bid", "ask", "volume", "spread"),
        *kept,
    )
    typed = {"symbol": "symbol", "ts": ts_sql("datetime")}
    text = {name for name, kind in fields.dtypes if kind == "string"}
    typed |= {c: number_sql(c) if c in text else c for c in ("bid", "ask", "volume", "spread")}
    row = ", ".join(f"'{name}', {value}" for name, value in typed.items())
    rows = stripped.selectExpr(*kept, f"named_struct({row}) AS tick")
    # A filter on parsed columns would be pushed below the parsing and repeat it;
    # a generator of one row or none reads the finished struct.
    parsed = " AND ".join(f"tick.{c} IS NOT NULL" for c in typed)
    none = "slice(array(tick), 1, 0)"
    ticks = rows.selectExpr(
        *kept, f"inline(if({parsed}, array(tick), {none}))"
    )
    return ticks.select(*typed, *kept)


def read_ticks_csv(
    spark: SparkSession,
    path: str,
    from_date: str | None = None,
    last_n: int = 0,
    streaming: bool = False,
    files: list[str] | None = None,
) -> DataFrame:
    """Ticks of the selected daily files, with ``file_name`` for audit counts."""
    fields = read_csv_fields(spark, path, from_date, last_n, streaming, typed=True, files=files)
    return ticks_from_fields(fields).select(*TICK.names, "file_name")
