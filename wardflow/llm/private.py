"""Personal data (operator 5): patterns, then information-theoretic sanitisation; built-in functions only.

Base spans (e-mail, IP address, card, phone) come from patterns. Each distinct value found is a protected
entity c, and so is its group (``GROUPS``: e-mail domain, IP network, number prefix), which speaks for values
too rare to be counted. Terms (runs of at least ``TERM_LETTERS`` letters or digits) in its rows may give it
away: over the whole corpus, with probabilities as shares of rows,

    disclosure(c, t) = PMI(c; t) / IC(c) = log(p(c | t) / p(c)) / log(1 / p(c))

where n_ct counts rows that hold both, wherever they stand. What a row may disclose is estimated from the other
rows, p(c) = (n_c - 1) / (N - 1), and shrunk towards no link by ``PRIOR`` rows:

    p(c | t) = (n_ct - 1 + PRIOR p(c)) / (n_t - 1 + PRIOR)

so a value or group that occurs in one row only flags nothing, for lack of any other row. A term of disclosure
``GENERALISE`` or more is generalised, from ``REMOVE`` on it is removed, everywhere in the rows that hold the
entity. Base spans always stay.

The first pass runs over all rows and writes them with their base spans; all later steps but the
count of rows per term touch only rows with an entity. Counting is by keys with partial sums.

Defined cases: null or empty text has no spans (its redaction is null or empty as it was); spans of
different kinds may overlap, redaction covers their union; repeated rows count as often as they
occur and are each treated; an empty table gives no rows; further columns stay as they are in
:func:`sanitise` and are ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.common import cut

#: The kinds in order, each with its pattern. The patterns match what the plain
#: ones match, leftmost and non-overlapping, but read every character a bounded number of times.
PATTERNS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
VALID = {
    "email": "true",
    "ip": r"forall(split(x.value, '\\.'), p -> coalesce(try_cast(p as bigint) <= 255, false))",
    "card": "length(translate(x.value, ' -', '')) between 16 and 19 and luhn_check(translate(x.value, ' -', ''))",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) between 8 and 15",
}
SPAN = "array<struct<k: int, kind: string, start: int, end: int, value: string>>"
TERM_LETTERS, PRIOR, GENERALISE, REMOVE = 2, 0.5, 0.7, 0.9
#: The coarser entity of a value, by kind.
GROUPS = {
    "email": "substring_index(value, '@', -1)",
    "ip": "substring_index(value, '.', 3)",
    "card": "left(translate(value, ' -', ''), 6)",
    "phone": "regexp_replace(regexp_replace(value, '[^0-9]', ''), '[0-9]{4}$', '')",
}
#: What stands for a redacted span, by kind; a removed term leaves nothing.
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "removed": ""}


def _kind_spans(text: Column, k: int, kind: str, pattern: str) -> Column:
    """Spans of one kind: matches, placed by the lengths of what lies between them, then checked."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s, x):
        a = s["at"] + x["gap"]
        b = a + F.length(x["value"])
        span = F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["value"].alias("value"))
        return F.struct(F.coalesce(b, s["at"]).alias("at"), F.when(x["value"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(span))).alias("out"))

    placed = F.aggregate(pairs, start, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``spans``: the base spans by kind as listed, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs
    for k, (kind, pattern) in enumerate(PATTERNS):
        out = out.withColumn(f"spans_{kind}_", _kind_spans(text, k, kind, pattern))
    kept = [f"filter(spans_{kind}_, x -> {VALID[kind]})" for kind, _ in PATTERNS]
    return out.withColumn("spans", F.expr(f"concat({', '.join(kept)})")).drop(*(f"spans_{k}_" for k, _ in PATTERNS))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda t: F.length(t) >= TERM_LETTERS)


def _entities(found: DataFrame) -> DataFrame:
    """``row_, kind, value``: the protected values of each row, and the groups they belong to."""
    each = found.where(F.size("spans") > 0).select("row_", F.explode("spans").alias("s")).select("row_", "s.kind", F.lower("s.value").alias("value"))
    group = F.expr("case kind " + " ".join(f"when '{k}' then {x}" for k, x in GROUPS.items()) + " end")
    return each.unionByName(each.select("row_", F.concat("kind", F.lit(" group")).alias("kind"), group.alias("value"))).distinct()


def _term_rows(docs: DataFrame) -> DataFrame:
    """``term, n_t``: rows of the corpus with each term."""
    return docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame, each: DataFrame) -> DataFrame:
    """``kind, value, term, action``: terms to generalise ("term") or remove ("removed") with an entity of ``each``."""
    total = found.agg(F.count("*").alias("n")).first()["n"]
    p = (F.col("n_c") - 1) / F.lit(float(max(total - 1, 1)))
    entity = each.groupBy("kind", "value").agg(F.count("*").alias("n_c")).where(F.col("n_c").between(2, total - 1)).withColumn("p_c", p)
    # even if all rows of the entity had the term, one in more rows than this stays below GENERALISE
    most = (F.col("n_c") - 1 + PRIOR * F.col("p_c")) / F.pow("p_c", F.lit(1 - GENERALISE)) + 1 - PRIOR
    held = cut(each.join(entity.withColumn("most", most + 1e-6), ["kind", "value"]), "pii-held")
    # the loosest bound of all keeps words that no entity can reach from being joined at all
    bound = held.agg(F.max("most").alias("most")).first()["most"]
    rows = found.join(held.groupBy("row_").agg(F.max("most").alias("row_most")), "row_")
    counts = _term_rows(docs).where((F.col("n_t") >= 2) & (F.col("n_t") <= F.lit(float(bound or 0))))
    terms = rows.select("row_", "row_most", F.explode(_terms(F.col("text"))).alias("term")).join(counts, "term").where("n_t <= row_most")
    both = held.join(terms.select("row_", "term", "n_t"), "row_").where("n_t <= most")
    both = both.groupBy("kind", "value", "term").agg(F.count("*").alias("n_ct"), F.max("n_t").alias("n_t"), F.max("p_c").alias("p_c"))
    given = (F.col("n_ct") - 1 + PRIOR * F.col("p_c")) / (F.col("n_t") - 1 + PRIOR)
    pairs = both.withColumn("d", F.log(given / F.col("p_c")) / -F.log("p_c"))
    return pairs.where(F.col("d") >= GENERALISE).select("kind", "value", "term", F.when(F.col("d") >= REMOVE, "removed").otherwise("term").alias("action"))


def _term_spans(found: DataFrame, each: DataFrame, flags: DataFrame) -> DataFrame:
    """``row_, more``: places of flagged terms in the rows that hold their entity, off the base spans."""
    hit = found.where(F.size("spans") > 0)
    todo = each.join(flags, ["kind", "value"]).groupBy("row_", "term").agg(F.min("action").alias("action"))  # "removed" < "term"
    rows = hit.join(todo.select("row_").distinct(), "row_", "left_semi")
    run = F.arrays_zip(F.split("text", r"[\p{L}\p{N}]+", -1).alias("gap"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("run"))
    runs = rows.select("row_", F.posexplode(run).alias("i", "x")).select("row_", "i", F.length("x.gap").alias("gap"), "x.run").where(F.col("run").isNotNull())
    w = Window.partitionBy("row_").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("run")).over(w).cast("int")
    placed = runs.select("row_", F.lower("run").alias("term"), (end - F.length("run")).alias("start"), end.alias("end"), "run")
    placed = placed.join(todo, ["row_", "term"]).join(rows.select("row_", "spans"), "row_")
    placed = placed.where(F.expr("not exists(spans, s -> start < s.end and `end` > s.start)"))
    span = F.struct(F.when(F.col("action") == "term", 4).otherwise(5).alias("k"), F.col("action").alias("kind"), "start", "end", F.col("run").alias("value"))
    return placed.groupBy("row_").agg(F.sort_array(F.collect_list(span)).cast(SPAN).alias("more"))


def find(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``own_`` (all other columns of ``docs``), ``text``, ``spans`` (base), ``all_spans`` per row; ``text``
    only of rows with spans unless ``whole``."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own_")
    marked = base_spans(docs.select(own, "text"))
    text = F.col("text") if whole else F.when(F.size("spans") > 0, F.col("text"))
    found = cut(marked.select("own_", text.alias("text"), "spans", F.monotonically_increasing_id().alias("row_")), "pii-spans")
    # Written step by step, so that each plan stays small on the driver.
    each = cut(_entities(found), "pii-entities")
    flags = cut(disclosing(docs.select("text"), found, each), "pii-flags")
    more = cut(_term_spans(found, each, flags), "pii-terms")
    hit = found.where(F.size("spans") > 0).join(more, "row_", "left")
    hit = hit.select("own_", "text", "spans", F.concat("spans", F.coalesce("more", F.array().cast(SPAN))).alias("all_spans"))
    clean = found.where(F.size("spans") == 0).select("own_", "text", "spans", F.col("spans").alias("all_spans"))
    return clean.unionByName(hit)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with the union of its spans replaced by the mask of the first kind at each place."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    mask = F.create_map(*(F.lit(x) for kv in MASKS.items() for x in kv))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        new = x["start"] >= s["at"]
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), mask[x["kind"]])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(new, piece).otherwise(s["out"]).alias("out"))

    full = F.aggregate(order, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, full).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced or removed; all columns and rows stay."""
    text = redacted(F.col("text"), F.col("all_spans"))
    return find(docs, whole=True).select(*(text.alias(c) if c == "text" else F.col(f"own_.`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    rows = find(docs.select("doc_id", "text"))
    n = {f"n_{kind}": F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long") for kind, _ in PATTERNS}
    return rows.select("own_.doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))
