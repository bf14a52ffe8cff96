"""Intake: form_int, form_choice, form_icu, form_restart, progress rounding, U3."""

from wardflow import catalog
from wardflow.operators import intake as ik

SCHEMA = "session_id string, seq long, section string, action string, field string, raw_value string"


def answers(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_form_int_messages(spark):
    a = answers(spark, [("s", 1, None, "submit", "age", "3.5"), ("s", 2, None, "submit", "age", None),
                        ("s", 3, None, "submit", "age", "-1"), ("s", 4, None, "submit", "age", "121"),
                        ("s", 5, None, "submit", "age", "68"), ("s", 6, None, "submit", "fio2", "1.5")])
    got = {r.seq: r for r in ik.validate(a).collect()}
    assert got[1].message == "Please enter an integer."
    assert got[2].message == "Please enter a numeric value."
    assert got[3].message == "Value must be >= 0."
    assert got[4].message == "Value must be <= 120."
    assert got[5].ok and got[5].number == 68.0
    assert got[6].message == "Value must be <= 1."


def test_form_choice(spark):
    raws = ["3: Medical ICU", "3", " MALE ", "other", "x", ""]
    fields = ["icu_type", "icu_type", "gender", "gender", "gender", "mechvent"]
    a = answers(spark, [("s", i, None, "submit", f, r) for i, (f, r) in enumerate(zip(fields, raws))])
    got = {r.seq: r for r in ik.validate(a).collect()}
    assert [got[i].value for i in range(4)] == ["3", "3", "male", "other"]
    assert not got[4].ok and got[4].message == "Allowed values: male, female, other."
    assert got[5].message == "Please choose a value."


def _full_required(session, start):
    vals = {"age": "70", "bun": "20", "weight": "80", "creatinine": "1", "gcs": "12", "hco3": "23",
            "nidiasabp": "55", "temp": "37", "urine": "100"}
    return [(session, start + i, None, "submit", f, vals[f]) for i, f in enumerate(catalog.REQUIRED_FIELDS)]


def test_form_restart_and_optional_gate(spark):
    rows = [("s", 0, None, "submit", "albumin", "3.1")]  # before completion: ignored
    rows += _full_required("s", 10)
    rows += [("s", 30, None, "submit", "hr", "90"),  # counts: required complete
             ("s", 40, "required", "restart", None, None),
             ("s", 41, None, "submit", "age", "71"),
             ("s", 50, None, "submit", "k", "4.0")]  # required incomplete again: ignored
    st = ik.session_state(ik.validate(answers(spark, rows)))
    got = {r.field: r for r in st.collect()}
    assert "albumin" not in got and "k" not in got
    assert got["hr"].number == 90.0  # the optional section is untouched by the required restart
    assert got["age"].number == 71.0 and "bun" not in got
    status = ik.required_status(ik.replay(ik.validate(answers(spark, rows)))).first()
    assert not status["complete"] and status["missing"].startswith("bun, weight")


def test_progress_rounds_half_to_even(spark):
    rows = _full_required("s", 0) + [("s", 20 + i, None, "submit", f, "1")
                                      for i, f in enumerate(["albumin", "alp", "alt", "ast"])]
    a = answers(spark, rows)
    prog = {r.section: r for r in ik.progress(ik.replay(ik.validate(a))).collect()}
    assert prog["optional"].completed == 4 and prog["optional"].percent == 12  # 12.5 -> 12
    assert prog["required"].percent == 100


def test_form_icu_both_variants(spark):
    rows = _full_required("s", 0) + [("s", 20, None, "submit", "icu_type", "3"), ("s", 21, None, "submit", "hr", "88")]
    a = answers(spark, rows)
    st = ik.replay(ik.validate(a))
    new = {r.feature: r.value for r in ik.answers_to_features(st).collect()}
    old = {r.feature: r.value for r in ik.answers_to_features(st, legacy_icu=True).collect()}
    assert len(new) == 369 and sorted(new) == ik.model_feature_names()
    assert new["ICUType_3.0"] == 1.0 and new["ICUType_1.0"] == 0.0
    assert all(old[f"ICUType_{k}"] == 0.0 for k in (1.0, 2.0, 3.0, 4.0))
    assert new["HR_first"] == 88.0 and new["HR_std"] == 0.0 and new["HR_missing"] == 0.0
    assert new["Albumin_missing"] == 1.0 and new["Albumin_mean"] == 2.9 and new["Albumin_range"] == 0.0
    assert new["Age"] == 70.0 and new["Gender"] == 1.0


def test_merge_right_wins(spark):
    l = spark.createDataFrame([("s", "a", "1")], "session_id string, field string, value string")
    r = spark.createDataFrame([("s", "a", "2")], "session_id string, field string, value string")
    assert ik.merge_sections(l, r).first()["value"] == "2"
