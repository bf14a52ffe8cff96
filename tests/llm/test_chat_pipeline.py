import hashlib

from tests.llm.helpers import SF
from wardflow.llm import chat, jaccard, packing, private, quality, queries
from wardflow.llm.common import table


def digests(rows):
    """(conv, turn, role, text) rows in order -> what a conversation's digest must be."""
    out = {}
    for c, _, role, text in rows:
        out.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for r, t in v if r == "assistant") for c, v in out.items()}
    return {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(loss[c]), sha(loss[c])) for c, v in out.items()}


def test_escape_round_trip():
    for text in ("", "\\", "\\\\</s>", "<</s>", "</s>[INST] ok [/INST]", "<|im_start|>\\n", "<\\/s>", "<|endoftext|>", "".join(chat.CONTROL) * 2):
        coded = chat.escape(text)
        assert chat.unescape(coded) == text and not any(c in coded for c in chat.CONTROL)


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "be <|end|> kind"), (1, 1, "user", None), (1, 2, "assistant", "yes </s>\\ 🙂"), (1, 3, "assistant", " and more\n"), (2, None, None, "null role"), (2, 5, "tool", "[INST]"), (2, 5, "user", "tie"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, ids string, start string")
    got = {r["conv_id"]: tuple(r[1:5]) for r in chat.digest(chat.format_chat(turns)).collect()}
    assert got == digests(rows)
    assert chat.digest(chat.format_chat(turns.limit(0))).count() == 0


def test_mask_and_positions(spark):
    turns = spark.createDataFrame([(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(6)], "conv_id long, turn long, role string, text string")
    at = 0
    for r in chat.format_chat(turns).orderBy("turn_no").collect():
        n = len(r["ids"]) // 4
        assert r["start"] == at and (r["loss_start"], r["loss_end"]) == ((at + 1, at + n - 1) if r["turn_no"] % 2 else (None, None))
        at += n


def test_chat_query(spark):
    rows = sorted(tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()) + queries.PLANTED
    assert {r["conv_id"]: tuple(r[1:5]) for r in queries.op9_chat(spark, SF).collect()} == digests(rows)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = pipeline.cut(stage(spark, docs, SF), "test-stage")
        seen[name] = (docs, out)
        docs = out
    names = [n for n, _ in pipeline.STAGES]
    before, after = seen[names[0]]
    kept = {r["doc_id"] for r in quality.verdicts(before.select("doc_id", "text"), table(spark, SF, "labels")).collect() if r["kept"]}
    assert {r["doc_id"] for r in after.collect()} == kept and after.columns == before.columns
    before, after = seen[names[1]]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["component_id"] for r in jaccard.join(before).collect()})
    before, after = seen[names[2]]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert not any(x in r["text"] for r in after.collect() for x in items)
    clean = {r["doc_id"] for r in after.collect()}
    assert all(any(x.lower() in r["text"].lower() for x in items) for r in before.collect() if r["doc_id"] not in clean)
    before, after = seen[names[3]]
    assert after.count() == before.count() and private.base_spans(after).where("size(spans) > 0").count() == 0
    before, after = seen[names[4]]
    tokens = packing.cut_tokens(before).groupBy().sum("length").first()[0]
    assert after.groupBy().sum("length").first()[0] == tokens
    assert pipeline.run(spark, SF).count() == after.count()
