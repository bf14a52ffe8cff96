"""Chat formatting (operator 9): token-level assembly.

Every turn's text is encoded on its own, and reserved ids beyond the vocabulary mark turns: one id
per role before the text, one id after it. Control strings (what a template of strings would use)
that occur inside a text are escaped reversibly before encoding, so no reader of the decoded text
can take them for marks. Positions and the loss mask come from prefix sums of turn lengths, so one
long conversation needs neither a list nor a group in memory.

``format_chat`` gives one row per turn: ids (reserved ones included), the place of its first id in
the conversation, and the loss span (first and end position, half open; assistant texts only).

Defined cases: null text counts as empty; a null role formats as the role "" ; turns with equal
numbers go by role, then ids; null turns first; repeated rows stay repeated; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.common import batches, small_batches

#: Control strings escaped inside texts, and the escape mark (itself doubled).
CONTROL = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|end|>")
MARK = "\\"
#: Reserved ids follow the vocabulary: end of turn, other role (its name follows, up to OTHER again), then known roles.
VOCAB = 50257
END, OTHER, ROLES = VOCAB, VOCAB + 1, {"system": VOCAB + 2, "user": VOCAB + 3, "assistant": VOCAB + 4}

_ESCAPE = re.compile("|".join(map(re.escape, (MARK, *CONTROL))))
_UNESCAPE = re.compile(r"\\(\\|.)", re.DOTALL)
_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    """Double the mark, and put one after the first character of each control string."""
    return _ESCAPE.sub(lambda m: MARK * 2 if m[0] == MARK else m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    """Inverse of :func:`escape`: a doubled mark is a mark, a single one vanishes."""
    return _UNESCAPE.sub(lambda m: m[1], text)


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = _tokenizers[path] = Tokenizer.from_file(path)
        t.encode_special_tokens = True
    return _tokenizers[path]


def default_path() -> str:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json")


def format_chat(turns: DataFrame, path: str | None = None) -> DataFrame:
    """``conv_id, turn, turn_no, ids (little-endian u4), start, loss_start, loss_end`` per turn."""
    path = path or default_path()

    def encode(it):
        t = tokenizer(path)
        for b in batches(it):
            texts = [escape(x or "") for x in b["text"]]
            roles = [x or "" for x in b["role"]]
            texts = t.encode_batch(texts, add_special_tokens=False)
            ids, head, tail = [], [], []
            for role, e in zip(roles, texts):
                first = [ROLES[role]] if role in ROLES else [OTHER, *t.encode(escape(role), add_special_tokens=False).ids, OTHER]
                body = e.ids
                ids.append(np.array([*first, *body, END], "<u4").tobytes())
                head.append(len(first))
                tail.append(len(first) + len(body))
            loss = [r == "assistant" for r in roles]
            cols = [pa.array(b["conv_id"], pa.int64()), pa.array(b["turn"], pa.int64()), pa.array(b["role"], pa.string()), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([h if y else None for h, y in zip(head, loss)], pa.int64()), pa.array([h if y else None for h, y in zip(tail, loss)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "role", "ids", "n", "head", "tail"])

    small_batches(turns.sparkSession)
    src = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    coded = src.mapInArrow(encode, "conv_id long, turn long, role string, ids binary, n long, head long, tail long")
    w = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), "ids")
    start = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return coded.select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("turn_no"), "ids", start.alias("start"), "head", "tail").select(
        "conv_id", "turn", "turn_no", "ids", "start", (F.col("start") + F.col("head")).alias("loss_start"), (F.col("start") + F.col("tail")).alias("loss_end")
    )


def read_turn(t, ids: np.ndarray) -> tuple[str, str, int]:
    """(role, unescaped text, characters of the decoded turn as it stands) from one turn's ids."""
    names = {v: k for k, v in ROLES.items()}
    if ids[-1] != END:
        raise ValueError("a turn must end with the end id")
    if ids[0] == OTHER:
        at = int(np.flatnonzero(ids[1:] == OTHER)[0]) + 1
        role, body = unescape(t.decode(ids[1:at].tolist(), skip_special_tokens=False)), ids[at + 1 : -1]
    else:
        role, body = names[int(ids[0])], ids[1:-1]
    shown = t.decode(body.tolist(), skip_special_tokens=False)
    return role, unescape(shown), len(shown) + 2


def digest(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Read conversations back from their ids and mask: one row of counts and hashes each.

    Rows stream in (conversation, turn) order, hashed as they come: memory does not grow with a
    conversation.
    """
    import hashlib

    path = path or default_path()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def decode(it):
        t = tokenizer(path)
        for b in batches(it):
            role, text, chars, loss = [], [], [], []
            for raw, start, lo, hi in zip(b["ids"], b["start"], b["loss_start"], b["loss_end"]):
                ids = np.frombuffer(raw, "<u4")
                r, x, c = read_turn(t, ids)
                role.append(r)
                text.append(x)
                chars.append(c)
                loss.append(None if lo is None else unescape(t.decode(ids[lo - start : hi - start].tolist(), skip_special_tokens=False)))
            cols = [pa.array(b["conv_id"], pa.int64()), pa.array(b["turn_no"], pa.int64()), pa.array(role), pa.array(text), pa.array(chars, pa.int64()), pa.array(loss, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn_no", "role", "text", "chars", "loss"])

    def fold(it):
        conv, state, seen = None, None, False
        done: list[tuple] = []

        def close():
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        for b in batches(it):
            for c, role, text, chars, loss in zip(b["conv_id"], b["role"], b["text"], b["chars"], b["loss"]):
                if not seen or c != conv:
                    if seen:
                        close()
                    conv, state, seen = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += chars
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
            if len(done) >= 1000:
                yield flush()
        if seen:
            close()
        if done:
            yield flush()

    small_batches(formatted.sparkSession)
    read = formatted.select("conv_id", "turn_no", "ids", "start", "loss_start", "loss_end").mapInArrow(decode, "conv_id long, turn_no long, role string, text string, chars long, loss string")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(fold, schema)
