"""Language identification (operator 7): error-correcting output codes.

Every language has a codeword of bits; one binary classifier per bit (logistic regression on hashed
character 2- and 3-grams of the whole text) predicts that bit, and the language whose codeword has
the least weighted logistic loss wins. Bits weigh by their accuracy on the training rows. A text is
ambiguous where the runner-up comes within ``AMBIGUOUS`` of the winner's probability.

Training uses at most ``per_lang`` labelled rows of each language (those of least id hash), turned
into fixed-size vectors before they reach the driver. Prediction covers every whole text.

Defined cases: null text, or text without a letter, gives ``und`` with score 0, and so does
everything when no row can be learned from; rows with a null lang are not learned from; repeated
rows get equal predictions; further columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.common import crc_mod, small_batches

DIMS, PER_LANG, STEPS, AMBIGUOUS = 4096, 400, 300, 0.2


def features(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """Unit vectors of square-rooted hashed n-gram counts, one row per text."""
    out = np.zeros((len(texts), dims), np.float32)
    for row, text in zip(out, texts):
        if not text:
            continue
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
        for g in (two, three):
            g = g ^ (g >> np.uint32(15))
            row += np.bincount((g * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=dims)
        np.sqrt(row, out=row)
        row /= np.linalg.norm(row)
    return out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +-1: all splits of up to 7 classes; beyond, the best of seeded random codes."""
    if n <= 7:
        bits = np.arange(1, 1 << max(n - 1, 0))
        return np.array([np.where((bits << 1) >> (n - 1 - k) & 1, 1, -1) for k in range(n)], np.int8).reshape(n, -1)
    rng = np.random.default_rng(7)
    width = int(np.ceil(10 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        far = width - (code.astype(np.int32) @ code.T.astype(np.int32) + width) // 2
        gap = int(far[np.triu_indices(n, 1)].min())
        if gap > best_gap and (np.abs(code.sum(0)) < n).all():
            best, best_gap = code, gap
    return best


def fit_bits(x: np.ndarray, bits: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Logistic regression for each column of ``bits`` (+-1), full-batch with momentum; last row is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = bits.astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v = np.zeros_like(w)
    scale = (weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(steps):
        m = y * (x @ w)
        grad = x.T @ (-y * scale / (1 + np.exp(np.clip(m, -30, 30)))) + 1e-5 * w
        v = 0.9 * v - 8.0 * grad
        w += v
    return w


def decode(margins: np.ndarray, code: np.ndarray, bit_weight: np.ndarray) -> np.ndarray:
    """(rows, classes) probabilities from the weighted logistic loss of each codeword."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]) @ bit_weight
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, learn, dims: int = DIMS, per_lang: int = PER_LANG):
    """``(languages, codewords, weights, bit weights)`` from at most ``per_lang`` rows a language."""
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    chosen = chosen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("doc_id", "lang").distinct()

    def vectors(it):
        for b in it:
            t = b.column(1).to_pylist()
            x = features(t, dims).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    rows = texts.select("lang", "text").mapInArrow(vectors, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return [], None, None, None
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32)
    k = np.array([langs.index(r["lang"]) for r in rows])
    code = codewords(len(langs))
    weights = fit_bits(x, code[k], 1 / np.bincount(k)[k])
    right = ((np.hstack([x, np.ones((len(x), 1), np.float32)]) @ weights > 0) == (code[k] > 0)).mean(0) if code.shape[1] else np.ones(0)
    return langs, code, weights, np.clip(2 * right - 1, 0.05, 1)


def predict(docs: DataFrame, model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row."""
    langs, code, weights, bit_weight = model

    def run(it):
        for b in it:
            texts = b.column(1).to_pylist()
            ok = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts]) if langs else np.zeros(len(texts), bool)
            pred, score, unsure = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if ok.any():
                x = features([t for t, o in zip(texts, ok) if o])
                p = decode(x @ weights[:-1] + weights[-1], code, bit_weight)
                top = np.sort(p, 1)
                pred[ok] = np.array(langs, object)[p.argmax(1)]
                score[ok] = top[:, -1]
                unsure[ok] = top[:, -1] - (top[:, -2] if len(langs) > 1 else 0) < AMBIGUOUS
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, mod: int = 3, held: int = 1, per_lang: int = PER_LANG) -> DataFrame:
    """Train on rows outside the held-out fold, predict all."""
    small_batches(docs.sparkSession)
    fold = crc_mod("doc_id", mod)
    model = train(docs, fold != held, per_lang=per_lang)
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "lang_pred", "score", "ambiguous")
