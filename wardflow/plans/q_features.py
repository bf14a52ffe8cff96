"""Registered queries: cleaning, features, imputation, encoding, scaling, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.functions.scalar import elapsed_hhmm, lehmer_sql, to_minutes
from wardflow.operators import features as fx
from wardflow.operators import sample as sm
from wardflow.operators import scale as sc
from wardflow.operators.ranks import exact_median
from wardflow.plans import sqltext as S
from wardflow.plans.registry import query, rounded, stable
from wardflow.sources import standins as SI


def _vital_long(spark, sf_dir, impute=True):
    readings = SI.event_readings(spark, sf_dir)
    records = SI.event_records(spark, sf_dir)
    return fx.vital_features(readings, SI.EVENT_VITALS, records=records, impute=impute)


@query("features_events", rounded(S.with_(*S.VITAL_CTES) + "SELECT record_id, feature, value FROM feat", ["value"]))
def features_events(spark, sf_dir):
    """A9 (vital part), flagship: cleaned cells -> ten aggregates over the spine -> median imputation."""
    return stable(_vital_long(spark, sf_dir, impute=True))


@query("clean_cells", S.with_(S.READINGS, S.CELLS) + "SELECT record_id, t, parameter, value FROM cells")
def clean_cells(spark, sf_dir):
    """R1 + P2 + P3: duplicate cells averaged, then the sentinel masked."""
    return fx.clean_cells(SI.event_readings(spark, sf_dir))


@query("vital_aggregates", rounded(S.with_(S.READINGS, S.CELLS, S.RECORDS, S.SPINE, S.AGG)
       + 'SELECT record_id, parameter, "mean", "median", "min", "max", "std", "first", "last", "missing", '
         '"delta", "range" FROM agg2', ["mean", "median", "std", "delta", "range"]))
def vital_aggregates(spark, sf_dir):
    """A1-A8 + P4 per (record, vital) before imputation."""
    cells = fx.clean_cells(SI.event_readings(spark, sf_dir))
    return stable(fx.vital_aggregates(cells, SI.event_records(spark, sf_dir), SI.EVENT_VITALS))


@query("feature_medians", rounded(S.with_(S.READINGS, S.CELLS, S.RECORDS, S.SPINE, S.AGG, S.LONG, S.MEDIANS)
       + "SELECT feature, m AS median FROM med", ["median"]))
def feature_medians(spark, sf_dir):
    """I1 statistics: exact median of every feature over the records (G1-based)."""
    return stable(exact_median(_vital_long(spark, sf_dir, impute=False), ["feature"], "value", alias="median"))


# --- whole feature table, per split -------------------------------------------------------

def split_records(spark, sf_dir):
    return SI.all_records(spark, sf_dir).withColumn("split", SI.split_of("record_id"))


def all_readings(spark, sf_dir, records):
    return SI.event_readings(spark, sf_dir).unionByName(SI.customer_descriptors(spark, sf_dir))


def feature_table_df(spark, sf_dir):
    records = split_records(spark, sf_dir)
    return fx.build_features(all_readings(spark, sf_dir, records), records, SI.EVENT_VITALS)


def feature_names():
    return catalog.feature_names(vitals=SI.EVENT_VITALS)


_BIO = ("Age", "Gender", "Height", "Weight")
_FULL = (
    S.READINGS,
    S.ALL_RECORDS,
    S.DESCRIPTOR_CELLS,
    """rsplit AS (SELECT record_id, """ + S.split_sql("record_id") + """ AS split FROM recs)""",
    """cells AS (
  SELECT record_id, t, parameter, nullif(avg(value), -1.0) AS value
  FROM (SELECT record_id, t, parameter, value FROM readings
        UNION ALL SELECT record_id, t, parameter, value FROM dcells)
  WHERE parameter IS NOT NULL GROUP BY record_id, t, parameter)""",
    S.SPINE,
    S.AGG,
    S.LONG,
    """lmed AS (SELECT s.split, l.feature, quantile_cont(l.value, 0.5) AS m
  FROM long l JOIN rsplit s USING (record_id) GROUP BY s.split, l.feature)""",
    """vfeat AS (SELECT l.record_id, s.split, l.feature, coalesce(l.value, lmed.m) AS value
  FROM long l JOIN rsplit s USING (record_id) LEFT JOIN lmed ON lmed.split = s.split AND lmed.feature = l.feature)""",
    """drows AS (SELECT c.record_id, s.split, c.t,
    max(CASE WHEN parameter = 'Age' THEN value END) AS "Age",
    max(CASE WHEN parameter = 'Gender' THEN value END) AS "Gender",
    max(CASE WHEN parameter = 'Height' THEN value END) AS "Height",
    max(CASE WHEN parameter = 'ICUType' THEN value END) AS "ICUType",
    max(CASE WHEN parameter = 'Weight' THEN value END) AS "Weight"
  FROM cells c JOIN rsplit s USING (record_id) GROUP BY c.record_id, s.split, c.t)""",
    """bmed AS (SELECT split, quantile_cont("Age", 0.5) AS am, quantile_cont("Height", 0.5) AS hm,
    quantile_cont("Weight", 0.5) AS wm FROM drows GROUP BY split)""",
    """gcnt AS (SELECT split, "Gender" AS g, count(*) AS n FROM drows WHERE "Gender" IS NOT NULL GROUP BY split, "Gender")""",
    """gmode AS (SELECT split, min(g) AS gm FROM (SELECT *, max(n) OVER (PARTITION BY split) AS mx FROM gcnt)
  WHERE n = mx GROUP BY split)""",
    """dfill AS (SELECT d.record_id, d.split, d.t, coalesce("Age", am) AS "Age", coalesce("Gender", gm) AS "Gender",
    coalesce("Height", hm) AS "Height", coalesce("Weight", wm) AS "Weight", "ICUType"
  FROM drows d LEFT JOIN bmed USING (split) LEFT JOIN gmode USING (split))""",
    """dfirst AS (SELECT DISTINCT ON (record_id) * FROM dfill ORDER BY record_id, t)""",
    """bio AS (SELECT r.record_id, r.split, f."Age", f."Gender", f."Height", f."Weight", f."ICUType"
  FROM rsplit r LEFT JOIN dfirst f ON f.record_id = r.record_id)""",
    """dfeat AS ("""
    + "\n  UNION ALL ".join(
        [f"""SELECT record_id, split, '{b}' AS feature, CAST("{b}" AS DOUBLE) AS value FROM bio""" for b in _BIO]
        + [f"""SELECT record_id, split, 'ICUType_{k}' AS feature, CASE WHEN "ICUType" = {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM bio"""
           for k in catalog.ICU_TYPES]
        + ["""SELECT record_id, split, 'ICUType_nan' AS feature, CASE WHEN "ICUType" IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM bio"""]
    )
    + ")",
    """ftab AS (SELECT record_id, split, feature, value FROM vfeat UNION ALL SELECT record_id, split, feature, value FROM dfeat)""",
)


@query("biometrics", S.with_(*_FULL) + 'SELECT record_id, split, "Age", "Gender", "Height", "Weight", "ICUType" FROM bio')
def biometrics(spark, sf_dir):
    """I2 + I3 + D1 + J3: per-split median/mode fill over time rows, then each record's first time row."""
    records = split_records(spark, sf_dir)
    cells = fx.clean_cells(all_readings(spark, sf_dir, records))
    rows = fx.descriptor_rows(cells, fx.DESCRIPTOR_NAMES).join(records, "record_id", "inner")
    first = fx.impute_biometrics(rows, records, group_cols=["split"])
    return first.select("record_id", "split", "Age", "Gender", "Height", "Weight", "ICUType")


_ONEHOT_COLS = [f"ICUType_{k}" for k in catalog.ICU_TYPES] + ["ICUType_nan"]


@query("icu_one_hot", S.with_(*_FULL) + "SELECT record_id, "
       + ", ".join(f"""CASE WHEN "ICUType" = {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS "ICUType_{k}\"""" for k in catalog.ICU_TYPES)
       + """, CASE WHEN "ICUType" IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS "ICUType_nan" FROM bio""")
def icu_one_hot(spark, sf_dir):
    """P11 + J2: one-hot of each record's first ICU type, with a NaN column."""
    return fx.icu_one_hot(biometrics(spark, sf_dir))


@query("feature_table", rounded(S.with_(*_FULL) + "SELECT record_id, split, feature, value FROM ftab", ["value"]))
def feature_table(spark, sf_dir):
    """The whole long feature table, imputed per split."""
    return stable(feature_table_df(spark, sf_dir))


def _matrix_sql():
    cols = ", ".join(f"""max(CASE WHEN feature = '{n}' THEN value END) AS "{n}\"""" for n in feature_names())
    return rounded(S.with_(*_FULL) + f"SELECT record_id, split, {cols} FROM ftab GROUP BY record_id, split",
                   feature_names())


@query("feature_matrix", _matrix_sql())
def feature_matrix(spark, sf_dir):
    """R2 + P10: one row per record, features as columns in fixed (sorted) order."""
    return stable(fx.to_matrix(feature_table_df(spark, sf_dir), feature_names(), id_cols=("record_id", "split")))


_SCALER = """stats AS (SELECT feature, avg(value) AS mean,
    CASE WHEN stddev_pop(value) IS NULL OR stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
  FROM ftab WHERE split = 'a' GROUP BY feature)"""


@query("scaler_stats", rounded(S.with_(*_FULL, _SCALER) + "SELECT feature, mean, scale FROM stats", ["mean", "scale"]))
def scaler_stats(spark, sf_dir):
    """I5 fit: mean and population std (0 -> 1) per feature on the training split."""
    ft = feature_table_df(spark, sf_dir)
    return stable(sc.fit_scaler(ft.where(F.col("split") == "a")))


@query("scaled_features", rounded(S.with_(*_FULL, _SCALER)
       + "SELECT f.record_id, f.split, f.feature, (f.value - s.mean) / s.scale AS value "
         "FROM ftab f LEFT JOIN stats s USING (feature)", ["value"]))
def scaled_features(spark, sf_dir):
    """I5 + I6: statistics fitted on split a, applied to every split."""
    ft = feature_table_df(spark, sf_dir).persist()
    return stable(sc.apply_scaler(ft, sc.fit_scaler(ft.where(F.col("split") == "a"))))


# --- labels: counts, weights, undersampling, alignment ---------------------------------

_OUTCOMES = """outc AS (SELECT user_id AS record_id,
    CAST(arg_max(event_type, (ts, event_id)) = 'error' AS INTEGER) AS label FROM events GROUP BY user_id)"""
_TOXIC = "tox AS (SELECT doc_id AS record_id, toxic AS label FROM labels)"


@query("class_balance", S.with_(_OUTCOMES) + "SELECT " + S.split_sql("record_id")
       + " AS split, label, count(*) AS n FROM outc GROUP BY ALL")
def class_balance(spark, sf_dir):
    """Rows per (split, label)."""
    out = SI.event_outcomes(spark, sf_dir).withColumn("split", SI.split_of("record_id"))
    return sm.class_counts(out, by=["split"])


@query("distinct_labels", S.with_(_OUTCOMES) + "SELECT DISTINCT label FROM outc")
def distinct_labels(spark, sf_dir):
    """A12."""
    return sm.distinct_labels(SI.event_outcomes(spark, sf_dir))


@query("class_weights", rounded(S.with_(_TOXIC) + """SELECT label, count(*) AS n,
    (SUM(count(*)) OVER ())::DOUBLE / (COUNT(*) OVER () * count(*)) AS weight FROM tox GROUP BY label""", ["weight"]))
def class_weights(spark, sf_dir):
    """A10: balanced class weights of the toxic label."""
    return stable(sm.class_weights(SI.doc_labels(spark, sf_dir, "toxic")))


@query("undersample_toxic", S.with_(_TOXIC, """c AS (SELECT label, count(*) AS n FROM tox GROUP BY label)""",
       """maj AS (SELECT label FROM c ORDER BY n DESC, label LIMIT 1)""",
       """ranked AS (SELECT *, row_number() OVER (ORDER BY """ + lehmer_sql("record_id", 42)
       + """, record_id) AS rk FROM tox WHERE label = (SELECT label FROM maj))""")
       + """SELECT record_id, label FROM ranked WHERE rk <= (SELECT min(n) FROM c)
UNION ALL SELECT record_id, label FROM tox WHERE label <> (SELECT label FROM maj)""")
def undersample_toxic(spark, sf_dir):
    """I4: majority class cut to the minority size by a seeded hash order."""
    return sm.undersample_majority(SI.doc_labels(spark, sf_dir, "toxic"), seed=catalog.SEED)


@query("label_join_report", S.with_(_OUTCOMES, """f AS (SELECT DISTINCT c_custkey AS record_id FROM customer)""")
       + """SELECT (SELECT count(*) FROM f JOIN outc USING (record_id)) AS matched,
  (SELECT count(*) FROM f ANTI JOIN outc USING (record_id)) AS only_features,
  (SELECT count(*) FROM outc ANTI JOIN f USING (record_id)) AS only_labels""")
def label_join_report(spark, sf_dir):
    """Labels attached by key; ids on one side only are counted, never paired by position."""
    from wardflow.operators.challenge import alignment_report

    feats = SI.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id")).distinct()
    return alignment_report(feats, SI.event_outcomes(spark, sf_dir), "record_id",
                            names=("matched", "only_features", "only_labels"))


@query("elapsed_minutes", """SELECT event_id,
  printf('%02d:%02d', m // 60, m % 60) AS hhmm,
  CAST(m AS INTEGER) AS minutes
FROM (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '""" + SI.EPOCH + """')) // 60000000 AS m FROM events)""")
def elapsed_minutes(spark, sf_dir):
    """Elapsed time as ``HH:MM`` (hours past 24) parsed back to minutes."""
    ev = SI.table(spark, sf_dir, "events")
    hhmm = elapsed_hhmm(SI.minutes_since_epoch("ts"))
    return ev.select("event_id", hhmm.alias("hhmm")).select("event_id", "hhmm", to_minutes("hhmm").alias("minutes"))


_PIVOT_SQL = S.with_(S.READINGS) + "SELECT record_id, t, " + ", ".join(
    f"nullif(avg(CASE WHEN parameter = '{p}' THEN value END), -1.0) AS \"{p}\"" for p in SI.EVENT_VITALS
) + " FROM readings WHERE parameter IS NOT NULL GROUP BY record_id, t"


@query("pivot_cells", rounded(_PIVOT_SQL, list(SI.EVENT_VITALS)))
def pivot_cells(spark, sf_dir):
    """(record, time) x parameter, duplicates averaged then the sentinel masked."""
    return stable(fx.pivot_readings(SI.event_readings(spark, sf_dir), SI.EVENT_VITALS))
