"""Readers of series and draw histories, and the sinks of results.

Row numbers follow the order of lines in a file: they are taken from Spark's ids of lines, which ascend within and over
the splits of one file.
"""

from __future__ import annotations

import os
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The date formats that are tried, in this order; each also with a time of day.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")


def parse_date(text: Column) -> Column:
    """The first format that fits, as a timestamp in the session's zone; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for day in DATE_FORMATS for f in (day, f"{day} HH:mm:ss")))


def _numbered(df: DataFrame) -> DataFrame:
    """With id, the 0-based number of the row in its file; of several files, those of one partition follow the other's.

    Rows are numbered in their partitions, and what stands in the partitions before is added (a row a partition).
    """
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    marked = df.withColumns({"__part": F.spark_partition_id(), "__line": in_part})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return marked.join(F.broadcast(starts), "__part").withColumn("id", F.col("__start") + F.col("__line")).drop("__part", "__line", "__start")


def read_series_csv(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """(series_id, pos, value) from the first column of a CSV file with a header; anything that is no number is an error."""
    table = spark.read.option("header", True).csv(path)
    name = series_id or os.path.splitext(os.path.basename(path))[0]
    return _numbered(table.select(F.col(f"`{table.columns[0]}`").cast("double").alias("value"))).select(F.lit(name).alias("series_id"), F.col("id").cast("long").alias("pos"), "value")


def from_values(spark: SparkSession, values: list[float], series_id: str = "series") -> DataFrame:
    return spark.createDataFrame([(series_id, i, float(v)) for i, v in enumerate(values)], "series_id string, pos long, value double")


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """(id, draw_date, numbers, game_name) by the file's suffix: csv, dat, xlsx, or db, sqlite, sqlite3."""
    suffix = os.path.splitext(path)[1].lower().lstrip(".")
    readers = {"csv": _draws_csv, "dat": _draws_dat, "xlsx": _draws_xlsx, "db": _draws_sqlite, "sqlite": _draws_sqlite, "sqlite3": _draws_sqlite}
    if suffix == "xls":
        raise ValueError("the binary .xls format is not supported; save the sheet as .xlsx")
    if suffix not in readers:
        raise ValueError(f"unsupported file type: {suffix or path}")
    return readers[suffix](spark, path).withColumn("game_name", F.lit(os.path.splitext(os.path.basename(path))[0]))


def _draws_csv(spark: SparkSession, path: str) -> DataFrame:
    """A date, then numbers; blank cells are passed over, other text is an error."""
    table = spark.read.option("header", True).csv(path)
    date, *rest = (F.col(f"`{c}`") for c in table.columns)
    numbers = F.array_compact(F.array(*(F.nullif(F.trim(c), F.lit("")).cast("int") for c in rest)))
    return _numbered(table.select(parse_date(F.trim(date)).alias("draw_date"), numbers.alias("numbers"))).select("id", "draw_date", "numbers")


def _draws_dat(spark: SparkSession, path: str) -> DataFrame:
    """Words parted by white space: a date (else the time of reading) and numbers; other words, blank lines and lines that
    begin with # are passed over. id is the number of the line."""
    lines = _numbered(spark.read.text(path)).withColumn("line", F.trim("value")).where("line <> '' and not startswith(line, '#')")
    words = F.split("line", r"\s+")
    date = parse_date(F.get(words, F.lit(0)))
    numbers = F.array_compact(F.transform(F.when(date.isNull(), words).otherwise(F.slice(words, 2, F.size(words))), lambda w: w.try_cast("int")))
    return lines.select("id", F.coalesce(date, F.current_timestamp()).alias("draw_date"), numbers.alias("numbers")).where(F.size("numbers") > 0)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteDraws(DataSource):
    """The table draws(id, date, numbers) of an SQLite file, read in ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_draws"

    def schema(self) -> str:
        return "id long, date string, numbers string"

    def reader(self, schema):
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 100_000))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Rows]:
        with self._open() as con:
            low, high = con.execute("SELECT min(rowid), max(rowid) FROM draws").fetchone()
        return [] if low is None else [_Rows(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        with self._open() as con:
            for a, b, c in con.execute("SELECT id, date, numbers FROM draws WHERE rowid >= ? AND rowid < ?", (part.low, part.high)):
                yield a, None if b is None else str(b), None if c is None else str(c)


def _draws_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """numbers holds numbers parted by commas or blanks."""
    spark.dataSource.register(SqliteDraws)
    numbers = F.array_compact(F.transform(F.split("numbers", "[, ]+"), lambda w: w.try_cast("int")))
    return spark.read.format("sqlite_draws").option("path", path).load().select("id", parse_date(F.col("date")).alias("draw_date"), numbers.alias("numbers")).orderBy("draw_date")


class XlsxRows(DataSource):
    """The rows of an .xlsx file's first sheet, as arrays of cell texts. One file is one partition."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return "row long, cells array<string>"

    def reader(self, schema):
        return _XlsxReader(self.options)


class _XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def read(self, _part) -> Iterator[tuple]:
        space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(self.path) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in item.iter(f"{space}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
            sheet = min((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
            for number, row in enumerate(ElementTree.fromstring(book.read(sheet)).iter(f"{space}row")):
                cells: list[str | None] = []
                for cell in row.iter(f"{space}c"):
                    column = 0
                    for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                        column = column * 26 + ord(letter) - 64
                    cells += [None] * (column - 1 - len(cells))
                    value = cell.find(f"{space}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{space}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                    cells.append(shared[int(text)] if cell.get("t") == "s" and text is not None else text)
                yield number, cells


def _draws_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first row is a header, the first column a date (text, or days since 1899-12-30); cells that are no whole numbers are
    passed over, and so are rows without any."""
    spark.dataSource.register(XlsxRows)
    rows = spark.read.format("xlsx_rows").option("path", path).load().where("row > 0")
    first = F.get("cells", F.lit(0))
    days = first.try_cast("double")
    date = F.coalesce(parse_date(first), F.timestamp_seconds((days - 25569) * 86400))
    number = lambda w: F.when(w.try_cast("double") == F.floor(w.try_cast("double")), w.try_cast("double").try_cast("int"))
    numbers = F.array_compact(F.transform(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), number))
    return rows.select((F.col("row") - 1).alias("id"), date.alias("draw_date"), numbers.alias("numbers")).where(F.size("numbers") > 0)


def date_range(draws: DataFrame) -> DataFrame:
    return draws.agg(F.min("draw_date").alias("first"), F.max("draw_date").alias("last"))


def as_series(draws: DataFrame) -> DataFrame:
    """(series_id, pos, number) for the draw analyses, in order of date and id."""
    ordered = draws.withColumn("pos", F.row_number().over(Window.partitionBy("game_name").orderBy("draw_date", "id")) - 1)
    return ordered.select(F.col("game_name").alias("series_id"), "pos", F.explode("numbers").alias("number"))


def write_results(results: DataFrame, path: str, form: str = "json", mode: str = "errorifexists") -> None:
    """Results as JSON lines or Parquet."""
    results.write.mode(mode).format(form).save(path)
