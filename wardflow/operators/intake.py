"""The intake form as batch operators over an answers table.

Answers: ``(session_id, seq, section, action, field, raw_value)`` with action
``submit`` or ``restart`` (a restart names its section, not a field). The
catalogue (41 fields) and its choice keys are broadcast. ``replay`` folds the
answers into one row per session (F6); what F4, F5, F7, F8 and F10 say of a session is
read from that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow import catalog
from wardflow.functions.scalar import gender_code, safe_float
from wardflow.operators.replay import coded, compose, deal, replay, states
from wardflow.session import compiled_stages

MISSING_MARK = {"required": "❌", "optional": "⚠️"}

ANSWER_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("section", T.StringType(), True),
    T.StructField("action", T.StringType(), False),
    T.StructField("field", T.StringType(), True),
    T.StructField("raw_value", T.StringType(), True),
])


def validate(answers: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Check submitted values against the catalogue.

    Adds ``ok``, ``value`` (normalised choice/text), ``number`` (normalised
    numeric) and ``message``. Numeric checks run in the form's order: not a
    number -> not an integer (int fields) -> below min -> above max. Choices
    match case-insensitively on label or value and return the value.
    Restart rows pass through with NULL checks.
    """
    spark = spark or answers.sparkSession
    compiled_stages(spark)  # fused with the steps that make its input, the checks may be one method too long for the JIT
    cat = F.broadcast(catalog.catalog_frame(spark).select(
        "field", F.col("type").alias("_type"), F.col("section").alias("_section"), "min_value", "max_value",
        "min_text", "max_text", "allowed_text"))
    choices = F.broadcast(catalog.choice_frame(spark))
    a = answers.join(cat, "field", "left")
    lowered = F.lower(F.trim(F.col("raw_value")))
    # The parsed number is used by every check: computed once as a column.
    a = a.withColumn("_key", lowered).withColumn("_num", safe_float("raw_value"))
    a = a.join(
        choices, (choices["field"] == a["field"]) & (choices["choice_key"] == F.col("_key")), "left"
    ).drop(choices["field"]).drop("choice_key")

    typ = F.col("_type")
    num = F.col("_num")
    is_num = typ.isin("int", "float")
    num_msg = (
        F.when(num.isNull(), F.lit(catalog.MSG_NUMERIC))
        .when((typ == "int") & (num != F.rint(num)), F.lit(catalog.MSG_INTEGER))
        .when(F.col("min_value").isNotNull() & (num < F.col("min_value")),
              F.concat(F.lit("Value must be >= "), F.col("min_text"), F.lit(".")))
        .when(F.col("max_value").isNotNull() & (num > F.col("max_value")),
              F.concat(F.lit("Value must be <= "), F.col("max_text"), F.lit(".")))
    )
    choice_msg = (
        F.when(F.col("raw_value").isNull() | (F.col("raw_value") == ""), F.lit(catalog.MSG_CHOOSE))
        .when(F.col("choice_value").isNull(), F.col("allowed_text"))
    )
    text_msg = F.when(F.coalesce(F.trim(F.col("raw_value")), F.lit("")) == "", F.lit(catalog.MSG_TEXT))
    unknown = F.lit("Unknown field.")
    message = (
        F.when(F.col("action") != "submit", F.lit(None).cast("string"))
        .when(typ.isNull(), unknown)
        .when(is_num, num_msg)
        .when(typ == "choice", choice_msg)
        .otherwise(text_msg)
    )
    # A column of its own: three outputs read it, and a stage whose method is too long for the JIT runs interpreted.
    a = a.withColumn("_message", message)
    message = F.col("_message")
    ok = F.when(F.col("action") == "submit", message.isNull())
    value = (
        F.when(typ == "choice", F.col("choice_value"))
        .when(typ == "text", F.trim(F.col("raw_value")))
    )
    number = F.when(is_num, num)
    return a.select(
        "session_id", "seq",
        F.coalesce(F.col("section"), F.col("_section")).alias("section"),
        "action", "field", "raw_value",
        ok.alias("ok"),
        F.when(ok, value).alias("value"),
        F.when(ok, number).alias("number"),
        F.coalesce(message, F.lit("")).alias("message"),
    )


def _restart_rows(validated: DataFrame, spark) -> DataFrame:
    """One 'restart' row per field of the restarted section (a join on section)."""
    cat = F.broadcast(catalog.catalog_frame(spark).select("field", "section"))
    r = validated.where(F.col("action") == "restart").select("session_id", "seq", "section")
    return r.join(cat, "section", "inner").select(
        "session_id", "seq", "section", F.lit("restart").alias("action"), "field",
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("number"),
    )


def replay_answers(answers: DataFrame, gate_optional: bool = True) -> DataFrame:
    """F1-F3 + F6: ``replay(validate(answers))``, with the answers dealt before they are checked.

    Dealing by range reads its input twice, to find the ranges and to deal the rows. So the
    checks run once, on the dealt rows, in a stage of their own.
    """
    return compose(states(coded(validate(deal(answers))), gate_optional))


def session_state(validated: DataFrame, gate_optional: bool = True) -> DataFrame:
    """the answers each session holds after replaying its submissions.

    Only valid submissions count; a restart clears only its own section.
    Optional answers count only when all required fields were captured since
    the latest required restart before them (see :mod:`wardflow.operators.replay`).
    Output: ``(session_id, field, section, value, number, seq)``.
    """
    return held_rows(replay(validated, gate_optional))


def held_rows(sessions: DataFrame) -> DataFrame:
    """The answers of replayed sessions, one row each."""
    name, section = ("array(" + ", ".join(f"'{f[k]}'" for f in _fields()) + ")" for k in ("name", "section"))
    rows = sessions.selectExpr("session_id", "posexplode(held) AS (p, a)").where("a IS NOT NULL")
    return rows.selectExpr("session_id", f"{name}[p] AS field", f"{section}[p] AS section", "a.value", "a.number", "a.seq")


def merge_sections(required: DataFrame, optional: DataFrame) -> DataFrame:
    """Merge two answer sets; on a shared (session, field) the optional (right) side wins."""
    a = required.withColumn("_p", F.lit(0))
    b = optional.withColumn("_p", F.lit(1))
    cols = [c for c in required.columns if c not in ("session_id", "field")]
    u = a.unionByName(b)
    return u.groupBy("session_id", "field").agg(
        F.max_by(F.struct(*cols), F.col("_p")).alias("s")
    ).select("session_id", "field", "s.*")


def _fields(section: str | None = None) -> list[dict]:
    """Catalogue fields in order of position."""
    return sorted((f for f in catalog.fields() if section in (None, f["section"])), key=lambda f: f["position"])


def _open_fields(section: str):
    """Names of a section's fields that a replayed session has not answered, in catalogue order."""
    return F.expr("array_compact(array(" + ", ".join(f"if(held[{f['position']}] IS NULL, '{f['name']}', null)" for f in _fields(section)) + "))")


def required_status(sessions: DataFrame) -> DataFrame:
    """per session: complete flag, number missing, missing names in catalogue order."""
    missing = _open_fields("required")
    return sessions.select(
        "session_id", (F.size(missing) == 0).alias("complete"), F.size(missing).alias("n_missing"), F.array_join(missing, ", ").alias("missing")
    )


def optional_remaining(sessions: DataFrame) -> DataFrame:
    """optional fields not yet answered and the next one by catalogue order."""
    rest = _open_fields("optional")
    return sessions.select("session_id", F.size(rest).cast("long").alias("remaining"), F.get(rest, F.lit(0)).alias("next_field"))


def progress(sessions: DataFrame) -> DataFrame:
    """completed / total per section and the percentage rounded half to even."""
    parts = F.array(*(
        F.struct(F.lit(s).alias("section"), (len(_fields(s)) - F.size(_open_fields(s))).cast("long").alias("completed"), F.lit(len(_fields(s))).cast("long").alias("total"))
        for s in ("required", "optional")
    ))
    return sessions.select("session_id", F.inline(parts)).withColumn("percent", F.bround(F.col("completed") / F.col("total") * 100, 0).cast("int"))


def float_text(x: F.Column) -> F.Column:
    """A double without exponent: shortest digits, at least one decimal (12000000.0, 0.0005)."""
    shortest = x.cast("string")
    plain = F.regexp_replace(shortest.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(shortest.contains("E"), F.coalesce(plain, shortest)).otherwise(shortest)


def answer_text(typ, value, number) -> F.Column:
    """The form's text of a captured answer (ints without decimals)."""
    return (
        F.when(typ == "int", number.cast("long").cast("string"))
        .when(typ == "float", float_text(number))
        .otherwise(value)
    )


def section_summary(sessions: DataFrame) -> DataFrame:
    """F8: every catalogue field per session with its answer or the section's missing mark."""
    listed = {k: "array(" + ", ".join(repr(f[k]) for f in _fields()) + ")" for k in ("section", "name", "type")}
    rows = sessions.selectExpr("session_id", "posexplode(held) AS (position, a)")
    rows = rows.selectExpr("session_id", f"{listed['section']}[position] AS section", f"{listed['name']}[position] AS field", "position", f"{listed['type']}[position] AS type", "a")
    mark = F.when(F.col("section") == "required", F.lit(MISSING_MARK["required"])).otherwise(F.lit(MISSING_MARK["optional"]))
    return rows.select("session_id", "section", "field", "position", F.coalesce(answer_text(F.col("type"), F.col("a.value"), F.col("a.number")), mark).alias("answer"))


# --- model rows -----------------------------------------------------------------------------

#: Per aggregate suffix: its value while the vital is unanswered, and once one reading is given.
#: "median" is the catalogue's median, "reading" the answer.
SUFFIX_RULES = {
    "first": ("median", "reading"), "last": ("median", "reading"), "max": ("median", "reading"), "mean": ("median", "reading"),
    "median": ("median", "reading"), "min": ("median", "reading"),
    "delta": (0.0, 0.0), "range": (0.0, 0.0), "std": (0.0, 0.0),
    "missing": (1.0, 0.0),
}
#: Kinds of model columns an answer sets: the number, the gender's code, a one-hot category, a suffix's value.
GENDER, ICU = "gender", "icu_type"


def model_columns(legacy_icu: bool = False) -> list[tuple[str, str | None, float, str]]:
    """(feature, field, default, kind) of every model column, by name: the catalogue crossed with the rules.

    ``kind`` says what an answer makes of it; a column without a field keeps its default.
    """
    known = [f for f in catalog.fields() if f["median"] is not None]
    direct = [(f["direct_column"], f["name"], float(f["median"]), "gender" if f["name"] == GENDER else "direct") for f in known if f["direct_column"]]
    hot = [(f"ICUType_{k}", None if legacy_icu else ICU, 0.0, f"onehot:{k}") for k in (*catalog.ICU_TYPES, "nan")]
    vitals = [
        (f"{f['feature_base']}_{suffix}", f["name"], float(f["median"]) if before == "median" else before, "value" if after == "reading" else f"fixed:{after}")
        for f in known if f["feature_base"] for suffix, (before, after) in SUFFIX_RULES.items()
    ]
    return sorted(direct + hot + vitals)


def default_row() -> list[tuple[str, float]]:
    """(feature, default) of every model column."""
    return [(feature, default) for feature, _, default, _ in model_columns()]


def answers_to_features(sessions: DataFrame, legacy_icu: bool = False) -> DataFrame:
    """one model row per replayed session, long ``(session_id, feature, value)``.

    Defaults (F9) are overridden by the session's answers: direct columns take
    the number (gender via its code), a vital answer is a single reading. ``legacy_icu=True``
    reproduces the observed form where the chosen ICU type never reaches the row.

    An answer is looked up by its position, so a row costs one pass over the model columns and no shuffle.
    """
    place = {f["name"]: f["position"] for f in catalog.fields()}
    x = F.transform("held", lambda a: F.coalesce(a["number"], safe_float(a["value"])))
    gender = gender_code(F.get("held", F.lit(place[GENDER]))["value"]).cast("double")
    wide = sessions.select("session_id", x.alias("x"), gender.alias("gender"), F.get(x, F.lit(place[ICU])).try_cast("int").alias("icu"))

    columns = ", ".join(
        f"struct('{feature}', {'null' if field is None else place[field]}, '{kind.partition(':')[0]}', '{kind.partition(':')[2]}', {default!r}D)"
        for feature, field, default, kind in model_columns(legacy_icu)
    )
    rows = wide.selectExpr("*", f"inline(array({columns})) AS (feature, p, kind, rule, default)").withColumn("given", F.expr("get(x, p)"))
    value = """coalesce(CASE WHEN p IS NULL THEN null WHEN kind = 'gender' THEN gender
        WHEN kind = 'onehot' THEN if(icu IS NULL, null, cast(concat(icu, '.0') = rule AS double))
        WHEN kind = 'fixed' THEN if(given IS NULL, null, cast(rule AS double)) ELSE given END, default)"""
    return rows.selectExpr("session_id", "feature", f"{value} AS value")


def model_feature_names() -> list[str]:
    return [k for k, _ in default_row()]
