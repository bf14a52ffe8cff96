"""Toxicity (operator 4): a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed word vector (marks at its ends left off) beside the sum of its hashed
character 3-gram vectors over the root of their number, so unseen forms still show their letters. Texts are read in overlapping windows of ``WINDOW`` words, one
every ``STRIDE`` and one at the end; over a window two recurrent passes (one per direction) run, attention
weighs their states, and a logistic output scores the mean. A text's score is its highest window.

Labels belong to texts, not windows: training lets the top window of each text speak for it, and
adds random windows of texts labelled 0. It uses at most ``PER_CLASS`` labelled rows of each label (least id
hash) outside the held-out fold, on the driver; all texts are scored whole, in the tasks.

Defined cases: null or empty text is one window of no words, scored by the output bias alone; when
one of the labels is missing among the training rows every score is the share of label 1 (0 without rows);
repeated rows get equal scores; an id with several labels counts as toxic if any is; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import WordHash, crc_mod, mix, small_batches, words_of

WINDOW, STRIDE, PER_CLASS, EPOCHS, LEAST_STEPS = 48, 24, 1500, 18, 800
WORDS, GRAMS, DIM, HIDDEN, ATTEND = 1 << 16, 1 << 14, 12, 8, 6
ROWS, CHUNK = 4096, 2 << 20
MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def new_parameters(rng) -> dict[str, np.ndarray]:
    def normal(*shape, scale=0.3):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"word": normal(WORDS, DIM, scale=0.1), "gram": normal(GRAMS, DIM, scale=0.1), "att": normal(2 * HIDDEN, ATTEND), "att_v": normal(ATTEND), "out": normal(2 * HIDDEN), "bias": np.full(1, -2.0, np.float32)}
    for side in ("f", "b"):
        p |= {f"w_{side}": normal(2 * DIM, 3 * HIDDEN), f"u_{side}": normal(HIDDEN, 3 * HIDDEN), f"c_{side}": np.zeros(3 * HIDDEN, np.float32)}
    return p


class Inputs:
    """Inputs of distinct words; word 0 stands for no word."""

    def __init__(self, words: list[bytes], hashed: WordHash):
        words = [w.strip(MARKS) or w for w in words]
        self.word = (hashed.of(words) % np.uint64(WORDS)).astype(np.int64)
        raw = np.frombuffer(b"\0".join([b"", *words, b""]) + b"\0", np.uint8).astype(np.uint64)  # one zero before and after each word
        g = mix(raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:])
        n = np.fromiter(map(len, words), np.int64, len(words))
        self.n, self.root = n, np.sqrt(n).astype(np.float32)[:, None]
        keep = np.ones(len(g), bool)
        keep[np.cumsum(n + 1) - 1] = False
        self.gram = (g[keep[: len(g)]] % np.uint64(GRAMS)).astype(np.int64)[: int(n.sum())]
        self.start = np.cumsum(n) - n

    def matrix(self, p) -> np.ndarray:
        x = np.zeros((len(self.word) + 1, 2 * DIM), np.float32)
        if len(self.word):
            x[1:, :DIM] = p["word"][self.word]
            x[1:, DIM:] = np.add.reduceat(p["gram"][self.gram], self.start, axis=0) / self.root
        return x

    def back(self, dx: np.ndarray, g) -> None:
        np.add.at(g["word"], self.word, dx[1:, :DIM])
        np.add.at(g["gram"], self.gram, np.repeat(dx[1:, DIM:] / self.root, self.n, axis=0))


def windows(n_words: int) -> list[int]:
    """First words of the windows of a text."""
    if n_words <= WINDOW:
        return [0]
    return [*range(0, n_words - WINDOW, STRIDE), n_words - WINDOW]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(p, x: np.ndarray, at: np.ndarray, keep: bool = False):
    """Logits of windows ``at`` (rows of word numbers, 0 = none) over the inputs ``x``; with ``keep`` also what :func:`backward` needs."""
    b, t_all = at.shape
    live = at > 0
    states, memo = np.empty((b, t_all, 2 * HIDDEN), np.float32), {}
    for side, lo in (("f", 0), ("b", HIDDEN)):
        gates = x @ p[f"w_{side}"] + p[f"c_{side}"]
        u, h, steps = p[f"u_{side}"], np.zeros((b, HIDDEN), np.float32), []
        for t in range(t_all) if side == "f" else range(t_all - 1, -1, -1):
            xg, a = gates[at[:, t]], h @ u
            zr = _sigmoid(xg[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r, an = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
            n = np.tanh(xg[:, 2 * HIDDEN :] + r * an)
            new = np.where(live[:, t, None], n + z * (h - n), h)
            if keep:
                steps.append((t, z, r, an, n, h))
            h = new
            states[:, t, lo : lo + HIDDEN] = h
        memo[side] = steps
    k = np.tanh(states @ p["att"])
    s = np.where(live, k @ p["att_v"], -1e4)
    e = np.exp(s - s.max(1, keepdims=True)) * live
    weight = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
    mean = np.einsum("bt,bth->bh", weight, states)
    logit = mean @ p["out"] + p["bias"][0]
    return (logit, (x, at, live, states, memo, k, weight, mean)) if keep else logit


def backward(p, saved, d_logit: np.ndarray, g) -> np.ndarray:
    """Add the gradients of the parameters to ``g``; returns those of the inputs."""
    x, at, live, states, memo, k, weight, mean = saved
    g["out"] += mean.T @ d_logit
    g["bias"] += d_logit.sum()
    d_mean = d_logit[:, None] * p["out"]
    d_weight = np.einsum("bh,bth->bt", d_mean, states)
    d_s = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    g["att_v"] += np.einsum("bt,bta->a", d_s, k)
    d_k = d_s[:, :, None] * p["att_v"] * (1 - k * k)
    g["att"] += np.einsum("bth,bta->ha", states, d_k)
    d_states = weight[:, :, None] * d_mean[:, None] + d_k @ p["att"].T
    dx = np.zeros_like(x)
    for side, lo in (("f", 0), ("b", HIDDEN)):
        u, dh = p[f"u_{side}"], np.zeros((len(at), HIDDEN), np.float32)
        d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
        for t, z, r, an, n, h in reversed(memo[side]):
            dh = dh + d_states[:, t, lo : lo + HIDDEN]
            on = live[:, t, None]
            dz, dn = dh * (h - n) * on, dh * (1 - z) * on
            da_n = dn * (1 - n * n)
            dg = np.concatenate((dz * z * (1 - z), da_n * an * r * (1 - r), da_n), 1)
            da = dg.copy()
            da[:, 2 * HIDDEN :] *= r
            g[f"u_{side}"] += h.T @ da
            np.add.at(d_gates, at[:, t], dg)
            dh = np.where(on, dh * z, dh) + da @ u.T
        g[f"w_{side}"] += x.T @ d_gates
        g[f"c_{side}"] += d_gates.sum(0)
        dx += d_gates @ p[f"w_{side}"].T
    return dx


def lay_out(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(distinct words, windows as word numbers from 1, first window of each text)``."""
    seen: dict[bytes, int] = {}
    flat = np.fromiter((seen.setdefault(w, len(seen) + 1) for ws in texts for w in ws), np.int32)
    flat = np.append(flat, np.zeros(WINDOW, np.int32))
    starts, ends, first, at = [], [], [], 0
    for ws in texts:
        first.append(len(starts))
        starts.extend(at + s for s in windows(len(ws)))
        at += len(ws)
        ends.extend([at] * (len(starts) - len(ends)))
    place = np.array(starts, np.int64)[:, None] + np.arange(WINDOW)
    return list(seen), np.where(place < np.array(ends)[:, None], flat[np.minimum(place, len(flat) - 1)], 0), np.array(first)


def scores(p, texts: list[list[bytes]], hashed: WordHash) -> np.ndarray:
    """Highest window probability of each text."""
    words, at, first = lay_out(texts)
    x = Inputs(words, hashed).matrix(p)
    logit = np.concatenate([forward(p, x, at[i : i + ROWS]) for i in range(0, len(at), ROWS)])
    return _sigmoid(np.maximum.reduceat(logit.astype(np.float64), first))


def fit(texts: list[list[bytes]], y: np.ndarray, seed: int = 4, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam on the logistic loss, for at least LEAST_STEPS steps; from the third epoch each text speaks through its top window."""
    epochs = max(epochs, -(-LEAST_STEPS * 64 // (2 * len(texts))))
    rng, hashed = np.random.default_rng(seed), WordHash()
    p = new_parameters(rng)
    words, at, first = lay_out(texts)
    inputs = Inputs(words, hashed)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(at))))
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    for epoch in range(epochs):
        noise = rng.random(len(at))
        by_noise = np.lexsort((noise, owner))[first]
        if epoch < 2:
            chosen = np.concatenate((by_noise, np.lexsort((-noise, owner))[first]))
        else:
            if epoch % 2 == 0:
                x = inputs.matrix(p)
                logit = np.concatenate([forward(p, x, at[i : i + ROWS]) for i in range(0, len(at), ROWS)])
                top = np.lexsort((-logit, owner))[first]
            chosen = np.unique(np.concatenate((top, by_noise[y == 0])))
        chosen = rng.permutation(chosen)
        for i in range(0, len(chosen), 64):
            rows = chosen[i : i + 64]
            used, inv = np.unique(at[rows], return_inverse=True)
            used, inv = (used, inv) if used[0] == 0 else (np.append(0, used), inv + 1)
            part = Inputs([words[k - 1] for k in used[1:]], hashed)
            logit, saved = forward(p, part.matrix(p), inv.reshape(len(rows), WINDOW).astype(np.int32), True)
            k = owner[rows]
            g = {n: np.zeros_like(a) for n, a in p.items() if n not in ("word", "gram")}
            dx = backward(p, saved, ((_sigmoid(logit) - y[k]) * balance[k] / len(rows)).astype(np.float32), g)
            g |= {"word": np.zeros_like(p["word"]), "gram": np.zeros_like(p["gram"])}
            part.back(dx, g)
            touched = {"word": np.unique(part.word), "gram": np.unique(part.gram)}
            step += 1
            rate = 0.006 * min(1, 2 * (1 - epoch / epochs)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for n, a in p.items():
                r = touched.get(n, slice(None))
                d = g[n][r]
                m[n][r] = 0.9 * m[n][r] + 0.1 * d
                v[n][r] = 0.999 * v[n][r] + 0.001 * d * d
                a[r] -= rate * m[n][r] / (np.sqrt(v[n][r]) + 1e-8)
    return p


def train(docs: DataFrame, labels: DataFrame, learn, per_class: int = PER_CLASS):
    """Parameters, or the one score to give when there is nothing to tell apart."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(learn)
    each = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(each[0].unionByName(each[1])), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = sorted({(r["doc_id"], r["text"] or "", r["toxic"]) for r in rows})
    y = np.array([r[2] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    return fit([words_of(r[1]) for r in rows], y)


def predict(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score`` of every whole text."""

    def run(it):
        hashed = WordHash()
        for b in it:
            out, part, size = [], [], 0
            if isinstance(model, float):
                out = [np.full(b.num_rows, model)]
            else:
                for t in b.column(1).to_pylist():
                    part.append(words_of(t))
                    size += len(t) if t else 1
                    if size >= CHUNK:
                        out.append(scores(model, part, hashed))
                        part, size = [], 0
                if part:
                    out.append(scores(model, part, hashed))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def detect(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """Train on labelled rows outside the held-out fold, score all."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, crc_mod("doc_id", mod) != held)
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
