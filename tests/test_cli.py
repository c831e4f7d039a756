import json
import math

import pytest

from driftwood import cli
from driftwood.functions import reports


def test_list_and_unknown(capsys):
    assert cli.main(["list"]) == 0
    assert "shapiro_wilk: Shapiro-Wilk" in capsys.readouterr().out
    assert cli.main(["analyze", "--file", "x.csv", "no_such"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["analyze"])


def test_series(spark, tmp_path, capsys):
    source = tmp_path / "waves.csv"
    source.write_text("value\n" + "".join(f"{math.sin(i / 3) + i % 7}\n" for i in range(200)))
    assert cli.main(["analyze", "--file", str(source), "chi_squared", "zscore", "finite_field"], spark) == 0
    got = {r["framework"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert {k: r["status"] for k, r in got.items()} == {"Chi-Squared Test": "ok", "Z-Score (Standard)": "ok", "Finite Field GF(p)": "insufficient_data"}
    assert all(r["series_id"] == "waves" for r in got.values())


def test_draws_to_a_folder(spark, tmp_path):
    source = tmp_path / "history.dat"
    source.write_text("".join(f"2024-01-{i + 1:02d} {' '.join(str((7 * i + 5 * j) % 28 + 1) for j in range(6))}\n" for i in range(28)))
    out = str(tmp_path / "told")
    assert cli.main(["draws", "--file", str(source), "--out", out, "--form", "parquet"], spark) == 0
    told = spark.read.parquet(out).collect()
    assert {r.section for r in told} == {*reports.SECTIONS, "critical_path"}
    assert all(json.loads(r.result) for r in told)


def test_reports_beside_the_caller(spark):
    spark.sparkContext.setLocalProperty("driftwood.test", "of the caller")
    told = reports.start(lambda: (spark.range(5).count(), spark.sparkContext.getLocalProperty("driftwood.test")))
    assert told.result(60) == (5, "of the caller") and told.done()
    spark.sparkContext.setLocalProperty("driftwood.test", None)
    with pytest.raises(ZeroDivisionError):
        reports.start(lambda: 1 // 0).result(60)
