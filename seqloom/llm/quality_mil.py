"""Quality scores by attention-based multiple-instance learning.

A text is cut into passages of fixed length, all of them. Each passage is described by its character classes, by a
hashed bigram profile and by how few different bigrams it has; a learned layer encodes it, gated attention
(tanh times sigmoid) weighs it, and the weighted sum of the text's passages gives the score. Encoder, attention and
output are trained together from document labels, with Adam, on the driver.

Training and scoring read every passage of a text. The sample of labelled documents is bounded: the first in hash order,
at most `SAMPLE_DOCS` of them and at most `SAMPLE_PASSAGES` passages in all; a document that would go beyond that is left
out whole.

Defined results: a null or empty text is one passage without characters; a null id counts as held out; labels of a
document that disagree count as their smallest; null labels are left out; without labels every score is 0.5; repeated
rows give repeated rows, and count once in training; rows with the same id and other texts count each. Neither id,
language, source nor label enters a score.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_slices, texts

PASSAGE, BINS, FOLDED = 400, 256, 64
SAMPLE_DOCS, SAMPLE_PASSAGES = 4000, 100_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 8, 25, 64, 0.01, 1e-4, 7
FOLDS, THRESHOLD = 5, 0.3

SYMBOLS = "#*$%&|<>"
CLASSES = 12
FEATURES = CLASSES + 4 + FOLDED


def _class_table() -> np.ndarray:
    """Lower, upper, digit, space, line end, full stop, comma, exclamation, bar, other symbol, other punctuation, rest."""
    out = np.full(0x110000, 11, np.uint8)
    for i in range(0x30000):
        kind = unicodedata.category(chr(i))
        if kind in ("Ll", "Lo", "Lm"):
            out[i] = 0
        elif kind in ("Lu", "Lt"):
            out[i] = 1
        elif kind == "Nd":
            out[i] = 2
        elif kind[0] == "P":
            out[i] = 10
    for chars, kind in ((" \t", 3), ("\n", 4), (".", 5), (",", 6), ("!", 7), (SYMBOLS, 9), ("|", 8)):
        out[[ord(c) for c in chars]] = kind
    return out


CLASS = _class_table()


def passages(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages, and the number of passages of each text."""
    sizes = np.array([len(t) for t in values], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(values)), counts)
    first = np.cumsum(counts) - counts
    code = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(code)) - np.repeat(begin, sizes)
    at = np.repeat(first, sizes) + place // PASSAGE
    n = len(owner)
    length = np.bincount(at, minlength=n).astype(np.float64)
    kinds = CLASS[code]
    share = np.bincount(at * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
    bigram = (code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)) >> np.uint32(24)
    inside = at[:-1] == at[1:]
    profile = np.bincount(at[:-1][inside] * BINS + bigram[inside], minlength=n * BINS).reshape(n, BINS).astype(np.float32)
    pairs = np.maximum(profile.sum(axis=1), 1)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :CLASSES] = share / np.maximum(length, 1)[:, None]
    out[:, CLASSES] = np.log1p(length)
    out[:, CLASSES + 1] = (profile > 0).sum(axis=1) / np.minimum(pairs, BINS)
    out[:, CLASSES + 2] = profile.max(axis=1) / pairs
    out[:, CLASSES + 3] = length / np.maximum(share[:, 3] + share[:, 4] + 1, 1)  # characters a word
    out[:, CLASSES + 4 :] = np.sqrt(profile.reshape(n, FOLDED, -1).sum(axis=2) / pairs[:, None])
    return out, counts


class Model:
    """Gated-attention network; `train` fits it, `scores` applies it."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def _forward(w, x, starts, owner):
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["a"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[owner])
        a = a / np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(h * a[:, None], starts)
        return h, t, g, a, z, z @ w["c"] + w["d"]

    def logits(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        x = (x - self.w["mean"]) / self.w["std"]
        return self._forward(self.w, np.clip(x, -8, 8), starts, np.repeat(np.arange(len(counts)), counts))[-1]

    def scores(self, values: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*passages(values)).astype(np.float64), -30, 30)))

    @classmethod
    def train(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - mean) / std, -8, 8)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"E": init(x.shape[1], HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "a": init(GATE), "c": init(HIDDEN), "d": np.zeros((), np.float32)}
        m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
        begin, step = np.cumsum(counts) - counts, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(counts))
            for bags in np.array_split(order, max(1, len(order) // BATCH)):
                size = counts[bags]
                starts = np.cumsum(size) - size
                owner = np.repeat(np.arange(len(bags)), size)
                rows = np.arange(size.sum()) - starts[owner] + begin[bags][owner]
                b = x[rows]
                h, t, g, a, z, out = cls._forward(w, b, starts, owner)
                d_out = (1 / (1 + np.exp(-out)) - labels[bags]) / len(bags)
                d_z = d_out[:, None] * w["c"]
                d_h = d_z[owner] * a[:, None]
                d_a = (d_z[owner] * h).sum(axis=1)
                d_a = a * (d_a - np.add.reduceat(a * d_a, starts)[owner])
                d_tg = d_a[:, None] * w["a"]
                d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
                d_h += d_t @ w["V"].T + d_g @ w["U"].T
                d_e = d_h * (1 - h * h)
                grad = {"E": b.T @ d_e, "e": d_e.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_g, "a": (t * g).T @ d_a, "c": z.T @ d_out, "d": d_out.sum()}
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
                for k in w:
                    own = grad[k] + DECAY * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * own
                    v[k] = 0.999 * v[k] + 0.001 * own * own
                    w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return cls(w | {"mean": mean, "std": std})


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


def chosen(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> list[tuple[int, int]]:
    """Id and text hash of the documents of the training sample, at most SAMPLE_DOCS."""
    known = _labelled(labels, label_col).orderBy("rank", "label_id").limit(SAMPLE_DOCS)
    sizes = texts(docs).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))  # at most SAMPLE_DOCS rows are broadcast
    sizes = sizes.select("rank", "label_id", F.xxhash64("text").alias("body"), F.greatest(F.lit(1), F.ceil(F.length("text") / PASSAGE)).alias("n")).distinct()
    out, left = [], SAMPLE_PASSAGES
    for r in sizes.orderBy("rank", "label_id", "body").limit(SAMPLE_DOCS).collect():
        if r.n <= left:
            out.append((r.label_id, r.body))
            left -= r.n
    return out


def _labelled(labels: DataFrame, label_col: str) -> DataFrame:
    """label_id, label and rank (by hash) of the labelled documents that are not held out."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out())
    return clean.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(label_col).cast("double").alias("label")).withColumn("rank", F.xxhash64("label_id"))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, passages a document and labels of the bounded training sample; held-out documents are not in it."""
    ids = chosen(docs, labels, label_col)
    if not ids:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32)
    own = docs.sparkSession.createDataFrame(ids, "own_id long, own_body long")
    known = F.broadcast(own.join(_labelled(labels, label_col), F.col("own_id") == F.col("label_id")).select("own_id", "own_body", "label"))  # at most SAMPLE_DOCS rows
    joined = texts(docs).join(known, (F.col("doc_id") == F.col("own_id")) & (F.xxhash64("text") == F.col("own_body"))).dropDuplicates(["own_id", "own_body"]).select("own_id", "own_body", "label", "text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = passages(part.column("text").to_pylist())
        rows = [own.astype("<f4").tobytes() for own in np.split(x, np.cumsum(counts)[:-1])]
        return pa.RecordBatch.from_arrays([part.column("own_id"), part.column("own_body"), part.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "body", "label", "x"])

    got = map_slices(joined, lambda: run, "doc_id long, body long, label double, x binary").orderBy("doc_id", "body").collect()
    return np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in got]), np.array([len(r.x) // (4 * FEATURES) for r in got], np.int64), np.array([r.label for r in got], np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model | None:
    x, counts, y = sample(docs, labels, label_col)
    return Model.train(x, counts, y) if len(y) else None


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values = part.column("text").to_pylist()
        out = model.scores(values) if model else np.full(len(values), 0.5)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return map_slices(texts(docs, id_col, text_col), lambda: run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with the same columns, whose score reaches the threshold."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores([t or "" for t in part.column(text_col).to_pylist()]) if model else np.full(part.num_rows, 0.5)
        return part.filter(pa.array(scores >= threshold))

    return map_slices(docs, lambda: run, schema, text_col)
