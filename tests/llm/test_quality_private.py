import hashlib
import re
from collections import defaultdict

from tests.llm.helpers import SF, documents, prose
from wardflow.llm import private, quality, queries
from wardflow.llm.common import table


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_measures(spark):
    texts = ["", " \t\n", "a b c d e f g h i j", "x y z u v\nx y z u v\nx y z u v", "é#$ <b> a|b\n\n \n" * 4, prose(500, 1), "one two three four five six one two three four five seven", "a " * 3000, "\x0bfoo\x0cbar baz\r\nbaz"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None)]
    got = {r["doc_id"]: r for r in quality.verdicts(documents(spark, rows, clash=False).select("doc_id", "text"), table(spark, SF, "labels")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t or "")
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_follow_the_trusted_rows(spark):
    good = [(i, prose(60, i)) for i in range(200)]
    junk = [(1000 + i, " ".join(f"#{w}!" for w in prose(60, i, 30).split())) for i in range(60)]
    docs = documents(spark, good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in good}
    untrusted = labels.where("quality = 0")
    assert quality.keep(docs, untrusted).count() == sum(not base(t)[-1] for _, t in good + junk)
    assert quality.keep(documents(spark, []), labels).count() == 0


def test_quality_query_uses_no_python(spark):
    plan = queries.op3_quality(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def spans(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m[0])] for k, p, ok in PLAIN]


TRICKY = [
    "", "a@b.c", "x@y@z.com", "a@b.com_c@d.org.", "🙂 é a.b%c+d@mail-1.example.com, 1.2.3.4 and 1.2.3.4.5.6.7.8 256.1.1.1",
    "4539 1488 0343 6467 4539-1488-0343-6467 4539148803436467 4539  1488", "+1 (555) 010-9999 +12 +123456789012345678 + 5 +4 4 4 4 4 4 4 4",
    "@@..a@..b@c..d 00000000255.1.1.001 99999999999999999999999.1.1.1", "a" * 20000 + "@", "1 " * 9000, "9" * 20000, "+1" * 3000, "a@b.c" * 50,
]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(50, None), (50, "a@b.c"), (50, "a@b.c")]
    got = private.report(documents(spark, rows)).collect()
    want = sorted(",".join(x for y in spans(t or "") for x in y) for _, t in rows)
    assert sorted(r["spans"] for r in got) == want
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(re.findall(f"{k}:", r["spans"])) for k, _, _ in PLAIN]
    assert private.report(documents(spark, [])).count() == 0


def test_disclosing_terms_are_masked_with_their_entity(spark):
    rows = [(i, f"{prose(12, i)} contact Zaphod at zb@example.org today {prose(12, 90 + i)}") for i in range(5)]
    rows += [(100 + i, f"{prose(20, 200 + i)} contact us today at noon") for i in range(200)]
    rows += [(900, "Zaphod alone is left alone"), (901, None), (902, "")]
    docs = documents(spark, rows)
    found = {r["doc_id"]: r["spans"] for r in private.report(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in private.sanitise(docs).collect()}
    text = dict(rows)
    for i in range(5):
        a = text[i].index("Zaphod")
        assert f"removed:{a}:{a + 6}" in found[i] and "contact" in clean[i] and "today" in clean[i]
        assert "Zaphod" not in clean[i] and "<EMAIL>" in clean[i] and "example" not in clean[i]
    assert all(clean[i] == text[i] for i in text if i >= 100)
    assert private.sanitise(docs).columns == docs.columns


def test_redaction_covers_overlaps(spark):
    docs = documents(spark, [(1, "mail a@1.2.3.4 now"), (2, "a@b.c")])
    clean = {r["doc_id"]: r["text"] for r in private.sanitise(docs).collect()}
    assert clean[2] == "<EMAIL>" and clean[1] == "mail <EMAIL> now"


def test_private_query_uses_no_python(spark):
    plan = queries.op5_private(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_disclosing_terms_of_rare_entities_anywhere_in_the_row(spark):
    """Far from the entity, of few letters, and of values that share no more than their domain."""
    far = " ".join(["we met again at the usual place"] * 10)
    rows = [(i, f"{prose(5, i)} Bob4 {far} write to bob@two.org") for i in range(2)]
    rows += [(10 + i, f"Ana {far} write to p{i}@small.example") for i in range(4)]
    rows += [(20, f"Solo {far} write to solo@one.net")]
    rows += [(100 + i, f"{prose(20, 200 + i)} {far} write to us") for i in range(200)]
    docs = documents(spark, rows)
    found = {r["doc_id"]: r["spans"] for r in private.report(docs).collect()}
    for i, t in rows:
        for name in ("Bob4", "Ana"):
            a = t.find(name)
            assert a < 0 or f":{a}:{a + len(name)}" in found[i]
        assert all(f":{m.start()}:{m.end()}" not in found[i] for m in re.finditer("we|met|write|to|Solo", t))
        assert i < 100 or found[i] == ""
