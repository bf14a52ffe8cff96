"""Driver tables re-aimed as the reference's inputs (see FIXTURES.md section 3).

Every stand-in reads a whole driver table; nothing is sub-set or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow import catalog
from wardflow.functions.scalar import apply_threshold, lehmer

# Fixed values of the stand-in recipes.
EVENT_VITALS = ("click", "error", "purchase", "signup", "view")
EPOCH = "2024-01-01 00:00:00"
TIME_BUCKET_MIN = 240
SENTINEL_EVERY = 11
ICU_SEGMENTS = {"AUTOMOBILE": 1.0, "BUILDING": 2.0, "FURNITURE": 3.0, "MACHINERY": 4.0}
SCORE_MODELS = (("mlp", 0.35, True), ("gbt", 0.23, False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than a shuffle would.

    A file is read by as many tasks as it has row groups, whatever the number of its splits;
    a row-multiplying step after it (an explode into 13 answers per order) would then run in
    a few long tasks. On an input of enough files this is a no-op.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not df.isStreaming and df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)


def minutes_since_epoch(ts) -> F.Column:
    # Whole minutes since the epoch: micros difference floored (ts >= epoch in the data,
    # and floor keeps it exact before it too).
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    return F.floor(micros / F.lit(60_000_000)).cast("long")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, t, parameter, value)`` from ``events`` (all rows).

    t = minutes since the epoch, floored to 4-hour buckets; every 11th event
    id carries the -1 sentinel.
    """
    ev = table(spark, sf_dir, "events")
    minutes = minutes_since_epoch("ts")
    return ev.select(
        F.col("user_id").alias("record_id"),
        (F.floor(minutes / TIME_BUCKET_MIN) * TIME_BUCKET_MIN).cast("int").alias("t"),
        F.col("event_type").alias("parameter"),
        F.when(F.pmod(F.col("event_id"), F.lit(SENTINEL_EVERY)) == 0, F.lit(catalog.SENTINEL))
        .otherwise(F.col("value")).alias("value"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id")).distinct()


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of ``events`` and all customers: most customers have descriptors only."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id")).unionByName(keys).distinct()


def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label = 1 when the user's latest event is an error."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("record_id")).agg(
        (F.max_by("event_type", F.struct("ts", "event_id")) == "error").cast("int").alias("label")
    )


def split_of(record_id) -> F.Column:
    """Deterministic a/b/c split of records (train/test/validation)."""
    k = F.pmod(lehmer(record_id, seed=7), F.lit(3))
    return F.when(k == 0, "a").when(k == 1, "b").otherwise("c")


def customer_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor cells ``(record_id, t, parameter, value)`` from ``customer`` at t = 0.

    Weight = account balance (-1 every 10th key), Gender from the nation key
    (-1 every 7th key), Age and Height from the nation key, ICUType from the
    market segment (HOUSEHOLD has none).
    """
    c = table(spark, sf_dir, "customer")
    icu = F.lit(None).cast("double")
    for seg, v in ICU_SEGMENTS.items():
        icu = F.when(F.col("c_mktsegment") == seg, F.lit(v)).otherwise(icu)
    vals = {
        "Weight": F.when(F.pmod("c_custkey", F.lit(10)) == 9, F.lit(-1.0)).otherwise(F.col("c_acctbal")),
        "Gender": F.when(F.pmod("c_custkey", F.lit(7)) == 3, F.lit(-1.0)).otherwise(
            F.pmod("c_nationkey", F.lit(2)).cast("double")),
        "Age": (F.lit(20) + F.col("c_nationkey") * 3).cast("double"),
        "Height": (F.lit(150) + F.pmod("c_custkey", F.lit(50))).cast("double"),
        "ICUType": icu,
    }
    kv = F.explode(F.array(*[F.struct(F.lit(k).alias("parameter"), v.alias("value")) for k, v in vals.items()]))
    return c.select(F.col("c_custkey").alias("record_id"), F.lit(0).alias("t"), kv.alias("kv")).select(
        "record_id", "t", "kv.parameter", "kv.value"
    )


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ``(model, record_id, label, pred, score)`` for two score formulas over ``orders``."""
    o = spread(table(spark, sf_dir, "orders"))
    label = (F.col("o_orderstatus") == "F").cast("int")
    price = F.col("o_totalprice") / 500000
    scores = {
        "mlp": F.round(price, 2),
        "gbt": F.round((price + F.pmod("o_custkey", F.lit(100)) / 100.0) / 2, 3),
    }
    parts = []
    for name, thr, strict in SCORE_MODELS:
        parts.append(o.select(
            F.lit(name).alias("model"), F.col("o_orderkey").alias("record_id"), label.alias("label"),
            scores[name].alias("score"),
        ).withColumn("pred", apply_threshold("score", thr, strict)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model", "record_id", "label", "pred", "score")


def doc_labels(spark: SparkSession, sf_dir: str, column: str = "toxic") -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), F.col(column).alias("label"))


# Fixed values of the answers recipe: raw texts offered to the three choice fields.
CHOICE_VARIANTS = {
    "gender": ("male", " MALE ", "female", "other", "x"),
    "icu_type": ("3: Medical ICU", "3", "1", "2: cardiac surgery recovery unit", "x"),
    "mechvent": ("0", "1", " 1", "yes", ""),
}
# Row j of an order: 0-8 the required fields, 9-10 two optional ones, 20/30 restarts.
ANSWER_SLOTS = 64


def answer_items():
    """(j, kind) of the rows each order expands to."""
    req = [(j, "required") for j in range(len(catalog.REQUIRED_FIELDS))]
    return req + [(9, "opt_a"), (10, "opt_b"), (20, "restart_required"), (30, "restart_optional")]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake answers from ``orders``: every order submits the 9 required fields and two
    optional ones of its customer's session, some orders restart a section, and
    bad values are planted by key modulus (not a number, not an integer, below
    min, above max, unknown choice)."""
    return answers_from_orders(spark, spread(table(spark, sf_dir, "orders")))


def answers_from_orders(spark: SparkSession, o: DataFrame) -> DataFrame:
    """The answers recipe over any ``orders`` frame (a table or a stream)."""
    # What the recipe needs of a field, as constants: field, type, median.
    known = {f["name"]: f for f in catalog.fields()}
    opt, req = (
        F.expr("array(" + ", ".join(
            f"named_struct('field', '{f}', 'type', '{known[f]['type']}', 'median', cast({'null' if known[f]['median'] is None else repr(float(known[f]['median']))} AS double))"
            for f in names) + ")")
        for names in (catalog.OPTIONAL_FIELDS, catalog.REQUIRED_FIELDS)
    )
    n_req, n_opt = len(catalog.REQUIRED_FIELDS), len(catalog.OPTIONAL_FIELDS)
    k = F.col("o_orderkey")
    j = F.col("j")
    slots = F.array(*[F.lit(x) for x, _ in answer_items()])
    info = (
        F.when(j < n_req, F.element_at(req, (j + 1).cast("int")))
        .when(j == 9, F.element_at(opt, (F.pmod(k, F.lit(n_opt)) + 1).cast("int")))
        .when(j == 10, F.element_at(opt, (F.pmod(k * 3 + 1, F.lit(n_opt)) + 1).cast("int")))
    )
    action = (
        F.when(j == 20, F.when(F.pmod(k, F.lit(9)) == 0, F.lit("restart")))
        .when(j == 30, F.when(F.pmod(k, F.lit(13)) == 0, F.lit("restart")))
        .otherwise(F.lit("submit"))
    )
    section = F.when((j < n_req) | (j == 20), F.lit("required")).when((j > 20) | info.isNotNull(), F.lit("optional"))
    rows = (
        o.select("o_orderkey", "o_custkey", F.explode(slots).alias("j"))
        .select("o_orderkey", "o_custkey", "j", info.alias("info"), action.alias("action"), section.alias("section"))
        .where(F.col("action").isNotNull())
        .select("o_orderkey", "o_custkey", "j", "info.field", "info.type", "info.median", "action", "section")
    )

    key = F.col("o_orderkey") + F.col("j")

    def hit(m):
        return F.pmod(key, F.lit(m)) == 0

    mult = F.when(hit(23), F.lit(1000)).otherwise(F.lit(1)).cast("long")
    kk = F.pmod(F.col("o_orderkey") * (F.col("j") + 3), F.lit(101))
    cents = F.floor(F.col("median") * (F.lit(50) + kk) + 0.5).cast("long") * mult  # medians are not negative: half up
    iv = F.expr("div(_cents + 50, 100)")
    rows = rows.withColumn("_cents", cents)
    int_text = F.concat(iv.cast("string"), F.when(hit(13), F.lit(".5")).otherwise(F.lit("")))
    float_text = F.concat(F.expr("div(_cents, 100)").cast("string"), F.lit("."), F.lpad(F.pmod(F.col("_cents"), F.lit(100)).cast("string"), 2, "0"))
    num_text = F.concat(F.when(hit(19), F.lit("-")).otherwise(F.lit("")),
                        F.when(F.col("type") == "int", int_text).otherwise(float_text))
    choice = F.lit(None).cast("string")
    for name, variants in CHOICE_VARIANTS.items():
        arr = F.array(*[F.lit(v) for v in variants])
        choice = F.when(F.col("field") == name, F.element_at(arr, (F.pmod(key, F.lit(len(variants))) + 1).cast("int"))).otherwise(choice)
    raw = (
        F.when(F.col("action") == "restart", F.lit(None).cast("string"))
        .when(F.col("type") == "choice", choice)
        .when(hit(17), F.lit("n/a"))
        .otherwise(num_text)
    )
    return rows.select(
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"),
        (F.col("o_orderkey") * ANSWER_SLOTS + F.col("j")).cast("long").alias("seq"),
        "section", "action", "field", raw.alias("raw_value"),
    )
