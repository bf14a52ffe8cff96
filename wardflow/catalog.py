"""Static catalogue: vital names, aggregate suffixes, intake fields, thresholds.

Everything here is small, fixed configuration. It becomes a broadcast-sized
DataFrame where a plan needs it (``catalog_frame``), never a per-row lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------

# The 36 time-varying vitals, in the order the intake catalogue lists them.
VITALS: tuple[str, ...] = (
    "BUN", "Creatinine", "GCS", "Albumin", "ALP", "ALT", "AST", "Bilirubin",
    "Cholesterol", "DiasABP", "FiO2", "Glucose", "HCO3", "HCT", "HR", "K",
    "Lactate", "Mg", "MAP", "MechVent", "Na", "NIDiasABP", "NIMAP", "NISysABP",
    "PaCO2", "PaO2", "pH", "Platelets", "RespRate", "SaO2", "SysABP", "Temp",
    "TroponinI", "TroponinT", "Urine", "WBC",
)

# Parameters that are record descriptors, not vitals.
BIOMETRICS: tuple[str, ...] = ("Age", "Gender", "Height", "Weight")
CONTINUOUS_BIOMETRICS: tuple[str, ...] = ("Age", "Height", "Weight")

# The ten per-vital aggregates, in the catalogue's order.
SUFFIXES: tuple[str, ...] = (
    "delta", "first", "last", "max", "mean", "median", "min", "missing", "range", "std",
)

# ICU type categories seen by the one-hot encoder (plus a NaN column).
ICU_TYPES: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0)

SENTINEL = -1.0

# Decision thresholds: (value, strict). strict means score > t, else score >= t.
THRESHOLDS = {
    "mlp": (0.35, True),
    "lstm": (0.23, True),
    "gbt": (0.23, False),
}

# Boosting hyper-parameters.
GBT_PARAMS = {
    "stepSize": 0.05,
    "maxDepth": 4,
    "featureSubsetStrategy": "sqrt",
    "minInstancesPerNode": 5,
    "maxIter": 200,
    "subsamplingRate": 0.7,
    "seed": 42,
}
MLP_HIDDEN = 10
SEED = 42

# Published challenge scores: (model, event1, event2).
PUBLISHED_SCORES = (
    ("Winner (Bayesian Ensemble)", 0.5310, 26.44),
    ("Contestant (MLP)", 0.27, 22.83),
)

# Hosmer-Lemeshow style score constants.
RISK_GROUPS = 10
HL_EPSILON = 0.001

# Intake field catalogue. Columns: name, question, required, type, min, max,
# choices [(label, value)], direct_column, feature_base, median.
# Choices given as plain strings use the string as both label and value.
_FIELDS = [
    ("age", "Age (years)", True, "int", 0, 120, None, "Age", None, 68.0),
    ("bun", "BUN (mg/dL)", True, "float", 0, None, None, None, "BUN", 19.75),
    ("weight", "Weight (kg)", True, "float", 0, None, None, "Weight", None, 80.0),
    ("creatinine", "Creatinine (mg/dL)", True, "float", 0, None, None, None, "Creatinine", 0.95),
    ("gcs", "GCS score", True, "int", 3, 15, None, None, "GCS", 12.087121212121213),
    ("height", "Height (cm)", False, "float", 0, None, None, "Height", None, 170.2),
    ("gender", "Gender", False, "choice", None, None, ["male", "female", "other"], "Gender", None, 1.0),
    ("icu_type", "ICUType", False, "choice", None, None,
     [("1: Coronary Care Unit", "1"), ("2: Cardiac Surgery Recovery Unit", "2"),
      ("3: Medical ICU", "3"), ("4: Surgical ICU", "4")], None, None, 3.0),
    ("albumin", "Albumin (g/dL)", False, "float", None, None, None, None, "Albumin", 2.9),
    ("alp", "ALP (IU/L)", False, "float", None, None, None, None, "ALP", 76.0),
    ("alt", "ALT (IU/L)", False, "float", None, None, None, None, "ALT", 31.5),
    ("ast", "AST (IU/L)", False, "float", None, None, None, None, "AST", 49.0),
    ("bilirubin", "Bilirubin (mg/dL)", False, "float", None, None, None, None, "Bilirubin", 0.7),
    ("cholesterol", "Cholesterol (mg/dL)", False, "float", None, None, None, None, "Cholesterol", 151.0),
    ("diasabp", "DiasABP (mmHg)", False, "float", None, None, None, None, "DiasABP", 58.0),
    ("fio2", "FiO2", False, "float", 0, 1, None, None, "FiO2", 0.525),
    ("glucose", "Glucose (mg/dL)", False, "float", None, None, None, None, "Glucose", 130.0),
    ("hco3", "HCO3 (mmol/L)", True, "float", None, None, None, None, "HCO3", 23.5),
    ("hct", "HCT (%)", False, "float", None, None, None, None, "HCT", 30.55),
    ("hr", "HR (bpm)", False, "float", None, None, None, None, "HR", 86.127441244621),
    ("k", "Potassium K (mEq/L)", False, "float", None, None, None, None, "K", 4.1),
    ("lactate", "Lactate (mmol/L)", False, "float", None, None, None, None, "Lactate", 1.94),
    ("mg", "Magnesium Mg (mmol/L)", False, "float", None, None, None, None, "Mg", 2.0),
    ("map", "MAP (mmHg)", False, "float", None, None, None, None, "MAP", 78.0),
    ("mechvent", "MechVent", False, "choice", None, None, ["0", "1"], None, "MechVent", 1.0),
    ("na", "Sodium Na (mEq/L)", False, "float", None, None, None, None, "Na", 139.0),
    ("nidiasabp", "NIDiasABP (mmHg)", True, "float", None, None, None, None, "NIDiasABP", 55.2962962962963),
    ("nimap", "NIMAP (mmHg)", False, "float", None, None, None, None, "NIMAP", 73.85),
    ("nisysabp", "NISysABP (mmHg)", False, "float", None, None, None, None, "NISysABP", 114.0),
    ("paco2", "PaCO2 (mmHg)", False, "float", None, None, None, None, "PaCO2", 39.666666666666664),
    ("pao2", "PaO2 (mmHg)", False, "float", None, None, None, None, "PaO2", 138.5),
    ("ph", "Arterial pH", False, "float", None, None, None, None, "pH", 7.385),
    ("platelets", "Platelets (cells/nL)", False, "float", None, None, None, None, "Platelets", 186.0),
    ("resprate", "RespRate (bpm)", False, "float", None, None, None, None, "RespRate", 19.0),
    ("sao2", "SaO2 (%)", False, "float", None, None, None, None, "SaO2", 97.2),
    ("sysabp", "SysABP (mmHg)", False, "float", None, None, None, None, "SysABP", 116.0),
    ("temp", "Temp (C)", True, "float", None, None, None, None, "Temp", 36.95555555555555),
    ("tropi", "TropI (ug/L)", False, "float", None, None, None, None, "TroponinI", 2.225),
    ("tropt", "TropT (ug/L)", False, "float", None, None, None, None, "TroponinT", 0.13333333333333333),
    ("urine", "Urine output (mL)", True, "float", None, None, None, None, "Urine", 103.33806818181819),
    ("wbc", "WBC (cells/nL)", False, "float", None, None, None, None, "WBC", 11.558333333333334),
]

# Messages of the field validator.
MSG_NUMERIC = "Please enter a numeric value."
MSG_INTEGER = "Please enter an integer."
MSG_CHOOSE = "Please choose a value."
MSG_ALLOWED = "Allowed values: {}."
MSG_TEXT = "Please provide text."

# ---------------------------------------------------------------------------


def _choices(raw):
    if raw is None:
        return None
    return [(c, c) if isinstance(c, str) else (c[0], c[1]) for c in raw]


def fields() -> list[dict]:
    """The intake catalogue as dicts, with ``position`` and ``section`` added."""
    out = []
    for pos, (name, question, required, typ, lo, hi, choices, direct, base, median) in enumerate(_FIELDS):
        out.append({
            "name": name, "question": question, "required": required, "type": typ,
            "min": lo, "max": hi, "choices": _choices(choices),
            "labelled": bool(choices) and not isinstance(choices[0], str),
            "direct_column": direct, "feature_base": base, "median": median,
            "position": pos, "section": "required" if required else "optional",
        })
    return out


REQUIRED_FIELDS = tuple(f["name"] for f in fields() if f["required"])
OPTIONAL_FIELDS = tuple(f["name"] for f in fields() if not f["required"])


def _fmt_bound(v):
    return None if v is None else str(v)


def allowed_message(f: dict) -> str | None:
    """The 'Allowed values' text of a choice field."""
    if f["type"] != "choice":
        return None
    if f["labelled"]:
        parts = [f"{lab.strip()} ({val.strip()})" for lab, val in f["choices"]]
    else:
        parts = [lab for lab, _ in f["choices"]]
    return MSG_ALLOWED.format(", ".join(parts))


CATALOG_SCHEMA = T.StructType([
    T.StructField("field", T.StringType(), False),
    T.StructField("question", T.StringType(), False),
    T.StructField("required", T.BooleanType(), False),
    T.StructField("section", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("min_value", T.DoubleType(), True),
    T.StructField("max_value", T.DoubleType(), True),
    T.StructField("min_text", T.StringType(), True),
    T.StructField("max_text", T.StringType(), True),
    T.StructField("allowed_text", T.StringType(), True),
    T.StructField("direct_column", T.StringType(), True),
    T.StructField("feature_base", T.StringType(), True),
    T.StructField("median", T.DoubleType(), True),
    T.StructField("position", T.IntegerType(), False),
])

CHOICE_SCHEMA = T.StructType([
    T.StructField("field", T.StringType(), False),
    T.StructField("choice_key", T.StringType(), False),
    T.StructField("choice_value", T.StringType(), False),
])


def catalog_rows() -> list[tuple]:
    return [
        (f["name"], f["question"], f["required"], f["section"], f["type"],
         None if f["min"] is None else float(f["min"]), None if f["max"] is None else float(f["max"]),
         _fmt_bound(f["min"]), _fmt_bound(f["max"]), allowed_message(f),
         f["direct_column"], f["feature_base"], f["median"], f["position"])
        for f in fields()
    ]


def choice_rows() -> list[tuple]:
    """Accepted lower-cased keys of every choice field and the value each maps to.

    Labelled choices accept the label or the value and return the value;
    plain choices accept and return the lower-cased string.
    """
    rows = []
    for f in fields():
        if f["type"] != "choice":
            continue
        seen = set()
        for lab, val in f["choices"]:
            if f["labelled"]:
                pairs = [(lab.strip().lower(), val.strip()), (val.strip().lower(), val.strip())]
            else:
                pairs = [(lab.strip().lower(), lab.strip().lower())]
            for key, v in pairs:
                if key not in seen:
                    seen.add(key)
                    rows.append((f["name"], key, v))
    return rows


def catalog_frame(spark: SparkSession) -> DataFrame:
    """41-row field catalogue (fixed size: safe to broadcast)."""
    from wardflow.session import local_frame

    return local_frame(spark, catalog_rows(), CATALOG_SCHEMA)


def choice_frame(spark: SparkSession) -> DataFrame:
    from wardflow.session import local_frame

    return local_frame(spark, choice_rows(), CHOICE_SCHEMA)


def feature_names(vitals=VITALS, icu_types=ICU_TYPES, biometrics=BIOMETRICS) -> list[str]:
    """All model feature names in their fixed (ASCII-sorted) order."""
    names = [f"{v}_{s}" for v in vitals for s in SUFFIXES]
    names += list(biometrics)
    names += [f"ICUType_{t}" for t in icu_types] + ["ICUType_nan"]
    return sorted(names)
