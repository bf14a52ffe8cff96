"""S1-S4 on inline record files (time_48, sci, blank_param)."""

import os

import pytest

from wardflow.sources import readings as rd

REC_A = "Time,Parameter,Value\n00:00,RecordID,132595\n00:00,Age,54\n00:00,Weight,-1\n24:54,HR,72\n48:00,HR,1.999e+04\n"
REC_C = "Time,Parameter,Value\n00:00,RecordID,158102\n00:00,Gender,1\n01:00,,5\n02:00,Temp,37.5\n"


@pytest.fixture()
def data_root(tmp_path):
    for split, name, body in (("a", "132595.txt", REC_A), ("c", "158102.txt", REC_C)):
        d = tmp_path / f"set-{split}"
        d.mkdir()
        (d / name).write_text(body)
    (tmp_path / "set-b").mkdir()
    return str(tmp_path)


def test_read_readings(spark, data_root):
    df = rd.read_readings(spark, data_root, splits=("a", "c"))
    rows = df.collect()
    assert {r.record_id for r in rows} == {132595, 158102}
    assert all(r.parameter != "RecordID" for r in rows)
    hr = sorted((r.t, r.value) for r in rows if r.parameter == "HR")
    assert hr == [(1494, 72.0), (2880, 19990.0)]  # time_48 and sci
    blank = [r for r in rows if r.parameter is None]
    assert len(blank) == 1 and blank[0].split == "c"


def test_bad_split_and_missing_dir(spark, data_root, tmp_path):
    with pytest.raises(ValueError):
        rd.read_readings(spark, data_root, splits=("d",))
    with pytest.raises(FileNotFoundError):
        rd.read_readings(spark, str(tmp_path / "nowhere"), splits=("a",))


def test_outcomes_and_predictions_roundtrip(spark, tmp_path):
    p = tmp_path / "outcomes.txt"
    p.write_text("RecordID,SAPS-I,SOFA,Length_of_stay,Survival,In-hospital_death\n1,1,1,5,-1,0\n2,1,1,5,3,1\n")
    out = {r.record_id: r.label for r in rd.read_outcomes(spark, str(p)).collect()}
    assert out == {1: 0, 2: 1}
    pred = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9)], "record_id long, pred int, score double")
    path = rd.write_predictions(pred, str(tmp_path / "pred"))
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".csv"))
    assert "2,1,0.9" in text and "record_id" not in text
    assert sorted(tuple(r) for r in rd.read_predictions(spark, path).collect()) == [(1, 0, 0.1), (2, 1, 0.9)]


def test_compact_and_prune_by_split(spark, data_root, tmp_path):
    out = rd.compact_readings(rd.read_readings(spark, data_root, splits=("a", "c")), str(tmp_path / "compact"))
    back = spark.read.parquet(out).where("split = 'a'")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert {r.record_id for r in back.collect()} == {132595}
