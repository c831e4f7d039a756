import sqlite3
import zipfile

import pytest

from driftwood.operators import draws
from driftwood.sources import files
from driftwood.streaming import running


def test_csv_and_dat(spark, tmp_path):
    csv = tmp_path / "history.csv"
    csv.write_text("date,num1,num2,num3\n2024-02-12,5,1,\n2024-02-05,2,3,4\n")
    got = files.read_draws(spark, str(csv)).orderBy("id").collect()
    assert [(r.id, r.numbers, r.game_name, r.draw_date.day) for r in got] == [(0, [5, 1], "history", 12), (1, [2, 3, 4], "history", 5)]
    dat = tmp_path / "a.dat"
    dat.write_text("# comment\n\n05/02/2024 1 2 x 3\n7 8\nnone\n")
    got = files.read_draws(spark, str(dat)).orderBy("id").collect()
    assert [(r.id, r.numbers) for r in got] == [(2, [1, 2, 3]), (3, [7, 8])]
    series = files.as_series(files.read_draws(spark, str(csv)))
    assert [(r.pos, r.number) for r in series.orderBy("pos", "number").collect()] == [(0, 2), (0, 3), (0, 4), (1, 1), (1, 5)]
    bad = tmp_path / "bad.csv"
    bad.write_text("date,n\n2024-01-01,x\n")
    with pytest.raises(Exception):
        files.read_draws(spark, str(bad)).collect()


def test_sqlite_and_xlsx(spark, tmp_path):
    db = str(tmp_path / "d.sqlite3")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE draws (id INTEGER, date TEXT, numbers TEXT)")
        con.executemany("INSERT INTO draws VALUES (?, ?, ?)", [(2, "2024-03-02", "4,5,6"), (1, "2024-03-01", "1 2 3")])
    assert [(r.id, r.numbers) for r in files.read_draws(spark, db).collect()] == [(1, [1, 2, 3]), (2, [4, 5, 6])]
    book = str(tmp_path / "b.xlsx")
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>date</t></si><si><t>2024-01-31</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c><c r="D2"><v>8</v></c><c r="E2"><v>1.5</v></c></row><row><c r="A3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    got = files.read_draws(spark, book).collect()
    assert [(r.id, r.numbers, r.draw_date.month) for r in got] == [(0, [7, 8], 1)]
    with pytest.raises(ValueError):
        files.read_draws(spark, "x.xls")
    with pytest.raises(ValueError):
        files.read_draws(spark, "x.txt")


def test_series_and_sinks(spark, tmp_path):
    csv = tmp_path / "s.csv"
    csv.write_text("v,other\n1.5,a\n2.5,b\n")
    got = files.read_series_csv(spark, str(csv))
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [("s", 0, 1.5), ("s", 1, 2.5)]
    files.write_results(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_dates(spark):
    texts = ["2024-02-01", "2024/02/01", "01-02-2024", "01/02/2024 10:30:00", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(files.parse_date(files.F.col("t")).alias("d")).collect()
    assert [r.d and (r.d.month, r.d.day) for r in got] == [(2, 1)] * 4 + [None, None]


def test_critical_path(spark):
    rows = [("g", i, n) for i in range(40) for n in [(i * 7 + k * 11) % 50 + 1 for k in range(5)]]
    series = spark.createDataFrame(rows, "series_id string, pos long, number int")
    best = draws.critical_path(series, 0.80).collect()
    assert len(best) == 1 and best[0].candidates == 1000 and len(best[0].numbers.split(",")) == 5
    assert draws.balanced_combination(28, 6) == [1, 2, 10, 11, 20, 21] and draws.prime_combination(1, 28, 5) == [1, 2, 3, 4, 5]


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([("s", i, float(i), f"2024-01-01 00:{i % 60:02d}:00") for i in range(100)], "series_id string, pos long, value double, t string").selectExpr("series_id", "value", "cast(t as timestamp) AS ts")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("stats", running.running_statistics(stream), "complete"), ("hist", running.running_histogram(stream, 0, 100, 4), "complete"), ("win", running.windowed_statistics(stream, "30 minutes"), "complete")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
    r = spark.table("stats").first()
    assert (r.n, r.mean, r.min, r.max) == (100, 49.5, 0.0, 99.0)
    assert running.chi_squared_of(spark.table("hist"), 4).first().chi_squared == 0
    assert spark.table("win").count() == 2


def test_rows_are_numbered_over_partitions(spark, tmp_path):
    (tmp_path / "long.csv").write_text("v\n" + "\n".join(map(str, range(5000))) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = files.read_series_csv(spark, str(tmp_path / "long.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.pos, r.value) for r in rows) == [(i, float(i)) for i in range(5000)]


def test_a_reset_starts_anew(spark, tmp_path):
    rows = [("s", i, float(i), i == 6) for i in range(10)] + [("t", 0, None, False), ("u", 1, 5.0, False)]
    data = spark.createDataFrame(rows, "series_id string, ts long, value double, reset boolean")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    running.resettable_statistics(stream).writeStream.outputMode("update").format("memory").queryName("since").trigger(availableNow=True).start().awaitTermination(60)
    got = {r.series_id: r for r in spark.table("since").collect()}
    assert (got["s"].n, got["s"].mean, got["s"].min, got["s"].max) == (3, 8.0, 7.0, 9.0) and abs(got["s"].std_dev - (2 / 3) ** 0.5) < 1e-12
    assert got["t"].n == 0 and got["t"].mean is None and got["u"].mean == 5.0
