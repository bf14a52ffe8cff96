"""F6's replay as an associative fold: what a run of submissions does to a session, whatever came before.

Rows are dealt by range of (session, seq), so a session of any size is split into runs. A run (the rows of one
session in one Arrow batch, in order of seq) becomes one small state:

* ``suffix``: the required fields captured since the run's last required restart (in all of it if there is none);
  ``restarted`` tells which case it is;
* ``r_seq``, ``o_seq``: the last restart of either section;
* ``entries``: per required field the last submission since the last restart; per optional field the last
  submission for each ``need``: the required fields that must have been captured before the run for it to
  count (none: it counts anyway). Needs only shrink along a run, so there are at most ten per field.

States of a session compose from left to right: the required fields captured when a run begins follow from the
suffixes before it. States meet in one exchange by session, and what is read from a session
afterwards (status, progress, summaries, model rows) needs no other exchange and no join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow import catalog

# Codes of rows that are no submission of a field (those carry the field's position).
RESTART_REQUIRED, RESTART_OPTIONAL, NOTHING = 100, 101, 102
STATE = (
    "session_id string, lo long, restarted boolean, suffix int, r_seq long, o_seq long, "
    "entries array<struct<position: int, need: int, seq: long, value: string, number: double>>"
)


def coded(validated: DataFrame) -> DataFrame:
    """``session_id, seq, code, value, number``: valid submissions, restarts, and rows that only name their session."""
    of_field = "map(" + ", ".join(f"'{f['name']}', {f['position']}" for f in catalog.fields()) + ")[field]"
    code = (
        f"CASE WHEN action = 'submit' AND ok THEN {of_field} "
        f"WHEN action = 'restart' AND section = 'required' THEN {RESTART_REQUIRED} "
        f"WHEN action = 'restart' AND section = 'optional' THEN {RESTART_OPTIONAL} END"
    )
    return validated.selectExpr("session_id", "seq", f"coalesce({code}, {NOTHING}) AS code", "value", "number")


def _last(key: np.ndarray) -> np.ndarray:
    """Indices of the last row of each key, in order of key."""
    return len(key) - 1 - np.unique(key[::-1], return_index=True)[1]


def fold(batch: pa.RecordBatch, gate: bool = True) -> pa.RecordBatch:
    """One state per session of a batch (rows in order of session, seq)."""
    names = batch.column(0).dictionary_encode()
    g_raw, seq, code = names.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
    n, row = len(code), np.arange(batch.num_rows)
    new = np.append(True, g_raw[1:] != g_raw[:-1])
    g, first = np.cumsum(new) - 1, np.flatnonzero(new)
    end = np.append(first[1:], n) - 1

    bit = np.zeros(NOTHING + 1, np.int64)
    optional = np.zeros(NOTHING + 1, bool)
    for f in catalog.fields():
        if f["required"]:
            bit[f["position"]] = 1 << catalog.REQUIRED_FIELDS.index(f["name"])
        else:
            optional[f["position"]] = True
    full = (1 << len(catalog.REQUIRED_FIELDS)) - 1

    def latest(which: int) -> np.ndarray:
        """The last row of this code in each session, -1 where there is none."""
        out, rows = np.full(len(first), -1), np.flatnonzero(code == which)
        out[g[rows]] = rows
        return out

    r_last, o_last = latest(RESTART_REQUIRED), latest(RESTART_OPTIONAL)
    restart = code == RESTART_REQUIRED
    part = np.cumsum(new | restart) - 1  # parts between required restarts
    begin = np.flatnonzero(new | restart)
    required = np.flatnonzero(bit[code])
    added = np.zeros(n, np.int64)  # a field's bit where the part captures it first
    once = required[np.unique(part[required] * (NOTHING + 1) + code[required], return_index=True)[1]]
    added[once] = bit[code[once]]
    total = np.cumsum(added)
    have = total - (total - added)[begin][part]
    opening = part == part[first][g]  # before the session's first restart
    opening &= ~restart[first][g]

    need = np.where(opening, full & ~have, 0) if gate else np.zeros(n, np.int64)
    counts = optional[code] & (row > o_last[g]) & (opening | (have == full) if gate else True)
    o = np.flatnonzero(counts)
    o = o[_last((g[o] * (NOTHING + 1) + code[o]) * (full + 1) + need[o])]
    r = required[required > r_last[g[required]]]
    r = r[_last(g[r] * (NOTHING + 1) + code[r])]
    need[r] = 0
    at = np.concatenate([o, r])
    at = at[np.argsort(g[at], kind="stable")]
    pick = pa.array(at)
    entries = pa.StructArray.from_arrays(
        [pa.array(code[at].astype(np.int32)), pa.array(need[at].astype(np.int32)), batch.column(1).take(pick), batch.column(3).take(pick), batch.column(4).take(pick)],
        names=["position", "need", "seq", "value", "number"],
    )
    when = lambda last: pa.array(np.where(last >= 0, seq[last], 0), mask=last < 0)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(first)), pa.array(seq[first]), pa.array(r_last >= 0),
            pa.array(have[end].astype(np.int32)), when(r_last), when(o_last),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(g[at], np.arange(len(first) + 1)).astype(np.int32)), entries),
        ],
        names=["session_id", "lo", "restarted", "suffix", "r_seq", "o_seq", "entries"],
    )


def deal(rows: DataFrame) -> DataFrame:
    """Rows dealt by range of (session, seq); those without a session or a seq have no place in a replay."""
    return rows.where("session_id is not null and seq is not null").repartitionByRange("session_id", "seq")


def states(dealt: DataFrame, gate: bool = True) -> DataFrame:
    """The states of all runs of coded rows that :func:`deal` dealt."""

    def run(it):
        for b in it:
            if b.num_rows:
                yield fold(b, gate)

    return dealt.sortWithinPartitions("session_id", "seq").mapInArrow(run, STATE)


def compose(runs: DataFrame) -> DataFrame:
    """``session_id, held`` per session: ``held[p]`` is the answer to the field at position p (value, number, seq), or null."""
    low, n_required = -(1 << 63), len(catalog.REQUIRED_FIELDS)
    before = "(PARTITION BY session_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    known = runs.selectExpr(
        "session_id", "entries",
        f"coalesce(max(r_seq) OVER (PARTITION BY session_id), {low}) AS r_all",
        f"coalesce(max(o_seq) OVER (PARTITION BY session_id), {low}) AS o_all",
        f"coalesce(max(if(restarted, lo, null)) OVER {before}, {low}) AS since",
        *(f"max(if(suffix & {1 << i} > 0, lo, null)) OVER {before} AS last_{i}" for i in range(n_required)),
    )
    # A field is captured when a run begins if a run before it, not followed by a restart, ends with it.
    captured = " + ".join(f"if(last_{i} >= since, {1 << i}, 0)" for i in range(n_required))
    rows = known.selectExpr("session_id", f"{captured} AS captured", "r_all", "o_all", "explode_outer(entries) AS e")
    fields = sorted(catalog.fields(), key=lambda f: f["position"])
    required = ", ".join(str(f["position"]) for f in fields if f["required"])
    fits = f"CASE WHEN e.position IN ({required}) THEN e.seq > r_all ELSE e.seq > o_all AND e.need & ~captured = 0 END"
    rows = rows.selectExpr("session_id", f"if({fits}, e.position, null) AS p", "struct(e.seq, e.value, e.number) AS a")
    return rows.groupBy("session_id").agg(F.expr("array(" + ", ".join(f"max(if(p = {f['position']}, a, null))" for f in fields) + ")").alias("held"))


def replay(validated: DataFrame, gate_optional: bool = True) -> DataFrame:
    """``session_id, held`` of every session of validated rows, after all its submissions and restarts."""
    return compose(states(deal(coded(validated)), gate_optional))
