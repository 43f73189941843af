"""Scan and cleaning of experiment CSVs."""

import math

import pytest
from pyspark.sql import functions as F

from rugosa.sources import experiments as ex
from rugosa.sources.sinks import read_metrics_csv, write_report

HEADER = "Vc   ,Fz,Ax,Ra,Rt,,,\r\n"


def _csv(tmp_path, lines, header=HEADER, name="runs.csv"):
    p = tmp_path / name
    p.write_text(header + "".join(lines))
    return str(p)


def test_trim_rename_and_project(spark, tmp_path):
    path = _csv(tmp_path, ["7.5,0.05,0.75,0.4,2.0,,,\r\n", "10,0.1,1,0.9,3.1,,,\r\n"])
    df = ex.load_experiments(spark, path)
    assert df.columns == ["Vc", "Fz", "ap", "Ra"]
    assert dict(df.dtypes) == {"Vc": "double", "Fz": "double", "ap": "double", "Ra": "double"}
    assert sorted(tuple(r) for r in df.collect()) == [(7.5, 0.05, 0.75, 0.4), (10.0, 0.1, 1.0, 0.9)]


def test_ap_wins_over_ax(spark, tmp_path):
    path = _csv(tmp_path, ["1,2,3,4,5\r\n"], header="Vc,Fz,Ax,ap,Ra\r\n")
    df = ex.load_experiments(spark, path)
    assert df.collect()[0].asDict() == {"Vc": 1.0, "Fz": 2.0, "ap": 4.0, "Ra": 5.0}


def test_missing_target_raises(spark, tmp_path):
    path = _csv(tmp_path, ["1,2,3\r\n"], header="Vc,Fz,ap\r\n")
    with pytest.raises(ValueError, match="Ra"):
        ex.load_experiments(spark, path)


@pytest.mark.parametrize("cell", ["abc", "", "True", "1_000", "0x1F", "1.0d", "NaN"])
def test_dirty_cells_drop_the_row(spark, tmp_path, cell):
    path = _csv(tmp_path, ["7.5,0.05,0.75,0.4,1,,,\r\n", f"10,{cell},1,0.9,1,,,\r\n"])
    df = ex.load_experiments(spark, path)
    assert df.count() == 1


def test_lenient_values(spark, tmp_path):
    path = _csv(tmp_path, [" 7.5 ,1e3,inf,0.5,1,,,\r\n"])
    row = ex.load_experiments(spark, path).collect()[0]
    assert row["Vc"] == 7.5 and row["Fz"] == 1000.0 and math.isinf(row["ap"])
    with pytest.raises(ValueError, match="non-finite"):
        ex.assert_finite(ex.load_experiments(spark, path), ["Vc", "Fz", "ap", "Ra"])


def test_metrics_csv_round_trip(spark, tmp_path):
    from rugosa.operators.metrics import calculate_metrics

    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 2.9), (4.0, 4.0)], "y double, p double")
    rep = calculate_metrics(df, "y", "p", "M")
    out = str(tmp_path / "metrics")
    write_report(rep, out)
    back = read_metrics_csv(spark, out).collect()[0].asDict()
    for k, v in rep.collect()[0].asDict().items():
        assert back[k] == pytest.approx(v, rel=1e-12) if isinstance(v, float) else back[k] == v
