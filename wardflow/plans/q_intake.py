"""Registered queries: the intake form over the answers stand-in (``orders``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.functions.scalar import gender_code, safe_float
from wardflow.operators import intake as ik
from wardflow.plans import sqltext as S
from wardflow.plans.registry import query, rounded, stable
from wardflow.sources import standins as SI


def _q(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({float(v)!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _cat_sql():
    rows = []
    for r in catalog.catalog_rows():
        (field, _q_, required, section, typ, lo, hi, lo_t, hi_t, allowed, direct, base, median, pos) = r
        rows.append("(" + ", ".join(_q(x) for x in (field, typ, section, lo, hi, lo_t, hi_t, allowed, median, pos)) + ")")
    cols = "field, type, section, min_value, max_value, min_text, max_text, allowed_text, median, position"
    cat = f"cat AS (SELECT * FROM (VALUES {', '.join(rows)}) t({cols}))"
    ch = ", ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in catalog.choice_rows())
    return cat + f",\nch AS (SELECT * FROM (VALUES {ch}) t(field, choice_key, choice_value))"


def _answers_sql():
    opt = "[" + ", ".join(_q(f) for f in catalog.OPTIONAL_FIELDS) + "]"
    n_opt = len(catalog.OPTIONAL_FIELDS)
    parts = []
    for j, kind in SI.answer_items():
        if kind == "required":
            f, act, sec, where = _q(catalog.REQUIRED_FIELDS[j]), "'submit'", "NULL", ""
        elif kind == "opt_a":
            f, act, sec, where = f"{opt}[o_orderkey % {n_opt} + 1]", "'submit'", "NULL", ""
        elif kind == "opt_b":
            f, act, sec, where = f"{opt}[(o_orderkey * 3 + 1) % {n_opt} + 1]", "'submit'", "NULL", ""
        elif kind == "restart_required":
            f, act, sec, where = "NULL", "'restart'", "'required'", "WHERE o_orderkey % 9 = 0"
        else:
            f, act, sec, where = "NULL", "'restart'", "'optional'", "WHERE o_orderkey % 13 = 0"
        parts.append(f"SELECT o_orderkey, o_custkey, {j} AS j, CAST({f} AS VARCHAR) AS field, {act} AS action, "
                     f"CAST({sec} AS VARCHAR) AS section FROM orders {where}")
    items = "\n    UNION ALL ".join(parts)
    choice = "CASE a.field " + " ".join(
        f"WHEN '{name}' THEN [{', '.join(_q(v) for v in vs)}][(a.o_orderkey + a.j) % {len(vs)} + 1]"
        for name, vs in SI.CHOICE_VARIANTS.items()) + " END"
    return f"""items AS (
    {items}),
a0 AS (SELECT a.*, c.type, c.section AS csec, c.median,
    CAST(round(c.median * (50 + (a.o_orderkey * (a.j + 3)) % 101)) AS BIGINT)
      * CASE WHEN (a.o_orderkey + a.j) % 23 = 0 THEN 1000 ELSE 1 END AS cents
  FROM items a LEFT JOIN cat c ON c.field = a.field),
ans AS (SELECT 's' || CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey * {SI.ANSWER_SLOTS} + j AS seq,
    coalesce(section, csec) AS section, action, field,
    CASE WHEN action = 'restart' THEN NULL
         WHEN type = 'choice' THEN {choice.replace('a.field', 'field').replace('a.o_orderkey', 'o_orderkey').replace('a.j', 'j')}
         WHEN (o_orderkey + j) % 17 = 0 THEN 'n/a'
         ELSE (CASE WHEN (o_orderkey + j) % 19 = 0 THEN '-' ELSE '' END) ||
           CASE WHEN type = 'int' THEN printf(CASE WHEN (o_orderkey + j) % 13 = 0 THEN '%d.5' ELSE '%d' END, (cents + 50) // 100)
                ELSE printf('%d.%02d', cents // 100, cents % 100) END
    END AS raw_value
  FROM a0)"""


_VAL = """v0 AS (SELECT a.*, c.type, c.min_value, c.max_value, c.min_text, c.max_text, c.allowed_text,
    TRY_CAST(trim(a.raw_value) AS DOUBLE) AS num, ch.choice_value
  FROM ans a LEFT JOIN cat c ON c.field = a.field
  LEFT JOIN ch ON ch.field = a.field AND ch.choice_key = lower(trim(a.raw_value))),
v1 AS (SELECT *, CASE WHEN action <> 'submit' THEN NULL
    WHEN type IS NULL THEN 'Unknown field.'
    WHEN type IN ('int', 'float') THEN CASE WHEN num IS NULL THEN 'Please enter a numeric value.'
        WHEN type = 'int' AND num <> round(num, 0) THEN 'Please enter an integer.'
        WHEN min_value IS NOT NULL AND num < min_value THEN 'Value must be >= ' || min_text || '.'
        WHEN max_value IS NOT NULL AND num > max_value THEN 'Value must be <= ' || max_text || '.' END
    WHEN type = 'choice' THEN CASE WHEN raw_value IS NULL OR raw_value = '' THEN 'Please choose a value.'
        WHEN choice_value IS NULL THEN allowed_text END
    ELSE CASE WHEN coalesce(trim(raw_value), '') = '' THEN 'Please provide text.' END END AS msg FROM v0),
val AS (SELECT session_id, seq, section, action, field, raw_value, type,
    CASE WHEN action = 'submit' THEN msg IS NULL END AS ok,
    CASE WHEN action = 'submit' AND msg IS NULL THEN
      CASE WHEN type = 'choice' THEN choice_value WHEN type = 'text' THEN trim(raw_value) END END AS value,
    CASE WHEN action = 'submit' AND msg IS NULL AND type IN ('int', 'float') THEN num END AS number,
    coalesce(msg, '') AS message FROM v1)"""

def _state_sql(gate: bool = True) -> str:
    """The replay; without ``gate`` every valid optional answer counts."""
    gated = ("JOIN comp c ON c.session_id = e.session_id AND c.epoch = e.epoch WHERE e.section = 'optional' AND e.seq > c.done"
             if gate else "WHERE e.section = 'optional'")
    return f"""subs AS (SELECT * FROM val WHERE action = 'submit' AND ok),
marks AS (SELECT session_id, seq FROM val WHERE action = 'restart' AND section = 'required'),
ep AS (SELECT s.*, coalesce((SELECT max(m.seq) FROM marks m WHERE m.session_id = s.session_id AND m.seq < s.seq), -1)
    AS epoch FROM subs s),
firsts AS (SELECT session_id, epoch, field, min(seq) AS f FROM ep WHERE section = 'required' GROUP BY ALL),
comp AS (SELECT session_id, epoch, max(f) AS done FROM firsts GROUP BY ALL HAVING count(*) = {len(catalog.REQUIRED_FIELDS)}),
kept AS (SELECT session_id, seq, section, 'submit' AS action, field, value, number FROM ep WHERE section = 'required'
  UNION ALL SELECT e.session_id, e.seq, e.section, 'submit', e.field, e.value, e.number
    FROM ep e {gated}
  UNION ALL SELECT r.session_id, r.seq, r.section, 'restart', c.field, NULL, NULL
    FROM val r JOIN cat c ON c.section = r.section WHERE r.action = 'restart'),
st AS (SELECT session_id, field, arg_max({{'action': action, 'section': section, 'value': value, 'number': number}}, seq) AS s,
    max(seq) AS seq FROM kept GROUP BY session_id, field),
state AS (SELECT session_id, field, s.section AS section, s.value AS value, s.number AS number, seq
  FROM st WHERE s.action = 'submit'),
sess AS (SELECT DISTINCT session_id FROM ans)"""


_BASE = S.with_(_cat_sql(), _answers_sql(), _VAL)
_WITH_STATE = S.with_(_cat_sql(), _answers_sql(), _VAL, _state_sql())
_UNGATED = S.with_(_cat_sql(), _answers_sql(), _VAL, _state_sql(gate=False))


def answers_df(spark, sf_dir):
    return SI.answers(spark, sf_dir)


def validated_df(spark, sf_dir):
    return ik.validate(answers_df(spark, sf_dir))


def state_df(spark, sf_dir):
    return ik.held_rows(sessions_df(spark, sf_dir))


def sessions_df(spark, sf_dir):
    return ik.replay_answers(answers_df(spark, sf_dir))


@query("validate_answers", _BASE + "SELECT session_id, seq, field, ok, value, number, message FROM val")
def validate_answers(spark, sf_dir):
    """Every answer checked against the catalogue with the form's messages."""
    return validated_df(spark, sf_dir).select("session_id", "seq", "field", "ok", "value", "number", "message")


@query("parse_values", _BASE + """SELECT session_id, seq, TRY_CAST(trim(raw_value) AS DOUBLE) AS as_float,
  CASE WHEN lower(trim(raw_value)) = 'male' THEN 1 WHEN lower(trim(raw_value)) = 'female' THEN 0
       ELSE CAST(trunc(TRY_CAST(trim(raw_value) AS DOUBLE)) AS INTEGER) END AS gender
FROM ans WHERE action = 'submit'""")
def parse_values(spark, sf_dir):
    """P7 + P8: safe numeric parse and gender code of every submitted raw value."""
    a = answers_df(spark, sf_dir).where(F.col("action") == "submit")
    return a.select("session_id", "seq", safe_float("raw_value").alias("as_float"),
                    gender_code("raw_value").alias("gender"))


@query("session_state", _WITH_STATE + "SELECT session_id, field, section, value, number, seq FROM state")
def session_state(spark, sf_dir):
    """answers held per session after replaying submissions and restarts."""
    return state_df(spark, sf_dir)


_REQ_SPINE = "(VALUES " + ", ".join(
    f"({_q(f['name'])}, {f['position']})" for f in catalog.fields() if f["required"]) + ") r(field, position)"
_OPT_SPINE = "(VALUES " + ", ".join(
    f"({_q(f['name'])}, {f['position']})" for f in catalog.fields() if not f["required"]) + ") r(field, position)"


@query("required_status", _WITH_STATE + f"""SELECT s.session_id, count(r.field) = 0 AS complete,
  CAST(count(r.field) AS INTEGER) AS n_missing,
  coalesce(string_agg(r.field, ', ' ORDER BY r.position), '') AS missing
FROM sess s LEFT JOIN (SELECT s2.session_id, r.field, r.position FROM sess s2, {_REQ_SPINE}
  WHERE NOT EXISTS (SELECT 1 FROM state t WHERE t.session_id = s2.session_id AND t.field = r.field)) r
  ON r.session_id = s.session_id
GROUP BY s.session_id""")
def required_status(spark, sf_dir):
    """required completeness and the missing names in catalogue order."""
    return ik.required_status(sessions_df(spark, sf_dir))


@query("optional_remaining", _WITH_STATE + f"""SELECT s.session_id, CAST(count(r.field) AS BIGINT) AS remaining,
  arg_min(r.field, r.position) AS next_field
FROM sess s LEFT JOIN (SELECT s2.session_id, r.field, r.position FROM sess s2, {_OPT_SPINE}
  WHERE NOT EXISTS (SELECT 1 FROM state t WHERE t.session_id = s2.session_id AND t.field = r.field)) r
  ON r.session_id = s.session_id
GROUP BY s.session_id""")
def optional_remaining(spark, sf_dir):
    """optional fields left and the next one offered."""
    return ik.optional_remaining(sessions_df(spark, sf_dir))


@query("progress", _WITH_STATE + f"""SELECT s.session_id, x.section,
  CAST(least(count(t.field), x.total) AS BIGINT) AS completed, CAST(x.total AS BIGINT) AS total,
  CAST(round_even(least(count(t.field), x.total) / x.total * 100, 0) AS INTEGER) AS percent
FROM sess s, (VALUES ('required', {len(catalog.REQUIRED_FIELDS)}), ('optional', {len(catalog.OPTIONAL_FIELDS)})) x(section, total)
LEFT JOIN state t ON t.session_id = s.session_id AND t.section = x.section
GROUP BY s.session_id, x.section, x.total""")
def progress(spark, sf_dir):
    """completed/total per section, percent rounded half to even."""
    return ik.progress(sessions_df(spark, sf_dir))


@query("section_summary", _WITH_STATE + """SELECT s.session_id, c.section, c.field, c.position,
  coalesce(CASE WHEN c.type = 'int' THEN CAST(CAST(t.number AS BIGINT) AS VARCHAR)
                WHEN c.type = 'float' THEN CAST(t.number AS VARCHAR) ELSE t.value END,
           CASE WHEN c.section = 'required' THEN '❌' ELSE '⚠️' END) AS answer
FROM sess s, cat c LEFT JOIN state t ON t.session_id = s.session_id AND t.field = c.field""")
def section_summary(spark, sf_dir):
    """F8: every field per session with its answer or the section's missing mark."""
    return ik.section_summary(sessions_df(spark, sf_dir))


def _features_sql(legacy: bool):
    defaults = ", ".join(f"({_q(k)}, {_q(float(v))})" for k, v in ik.default_row())
    omap = ", ".join(f"({_q(b)}, {_q(a)}, {_q(c)})" for a, b, _, c in ik.model_columns(legacy) if b)
    return _WITH_STATE + f""",
dflt AS (SELECT * FROM (VALUES {defaults}) d(feature, value)),
omap AS (SELECT * FROM (VALUES {omap}) m(field, feature, kind)),
ov0 AS (SELECT t.session_id, m.feature, m.kind, t.value AS sval,
    coalesce(t.number, TRY_CAST(trim(t.value) AS DOUBLE)) AS x FROM state t JOIN omap m ON m.field = t.field),
ov AS (SELECT session_id, feature, CASE
    WHEN kind = 'direct' THEN x
    WHEN kind = 'gender' THEN CAST(CASE WHEN lower(trim(sval)) = 'male' THEN 1 WHEN lower(trim(sval)) = 'female' THEN 0
        ELSE CAST(trunc(TRY_CAST(trim(sval) AS DOUBLE)) AS INTEGER) END AS DOUBLE)
    WHEN kind LIKE 'fixed:%' THEN CASE WHEN x IS NOT NULL THEN CAST(substr(kind, 7) AS DOUBLE) END
    WHEN kind = 'value' THEN x
    WHEN kind = 'onehot:nan' THEN CASE WHEN x IS NOT NULL THEN 0.0 END
    WHEN kind LIKE 'onehot:%' THEN CASE WHEN x IS NOT NULL THEN
        CASE WHEN 'onehot:' || CAST(CAST(trunc(x) AS INTEGER) AS VARCHAR) || '.0' = kind THEN 1.0 ELSE 0.0 END END
    END::DOUBLE AS value FROM ov0),
allv AS (SELECT s.session_id, d.feature, d.value::DOUBLE AS value, 0 AS p FROM sess s, dflt d
  UNION ALL SELECT session_id, feature, value, 1 FROM ov WHERE value IS NOT NULL)
SELECT session_id, feature, arg_max(value, p) AS value FROM allv GROUP BY session_id, feature"""


@query("answer_features", rounded(_features_sql(False), ["value"]))
def answer_features(spark, sf_dir):
    """F9 + F10: one model row per session (long), ICU type one-hot set as intended."""
    return stable(ik.answers_to_features(sessions_df(spark, sf_dir), legacy_icu=False))


@query("answer_features_legacy", rounded(_features_sql(True), ["value"]))
def answer_features_legacy(spark, sf_dir):
    """F10 with the observed form behaviour: the chosen ICU type never reaches the row."""
    return stable(ik.answers_to_features(sessions_df(spark, sf_dir), legacy_icu=True))


@query("merged_answers", _WITH_STATE + "SELECT session_id, field, section, value, number, seq FROM state")
def merged_answers(spark, sf_dir):
    """Required and optional answers merged, the optional side winning on a shared field."""
    st = state_df(spark, sf_dir)
    return ik.merge_sections(st.where(F.col("section") == "required"), st.where(F.col("section") == "optional")).select(
        "session_id", "field", "section", "value", "number", "seq")
