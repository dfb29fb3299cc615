"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from the statistics of its bytes (which
bytes, which kinds of byte follow each other), its words and pairs of words in hashed buckets (A-Z folded), and the share of words that repeat the
one before, and gated attention (Ilse, Tomczak, Welling 2018) learns from labels
of documents alone which passages matter: with h the passage's encoding,

    e = tanh(W h + b)        a = softmax over the bag of  w . (tanh(V e) * sigmoid(U e))        z = sum a e

and the score is sigmoid(c . z + d), that z is a good document. Training is full gradient descent (Adam) in numpy on the
driver, on all passages of a bounded sample of labelled documents: of the first ``MAX_DOCS`` by hashed id, those that
bring the sum of passages to ``MAX_PASSAGES`` at most, in that order (one that would exceed it is passed over). Scoring takes every passage
of every text. Only the weights are broadcast.

Defined results. A null or empty text is a bag of one empty passage. Rows with a null id are never trained on. Labels of a
repeated doc_id count once, at their lowest quality; rows that repeat an id and its text are trained on once. Without labels of both kinds the score is the share of good ones
(or one half without any label). Only the named columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, mix, segments, slices, table, text_bytes, word_count, word_hashes, word_spans

PASSAGE, MAX_DOCS, MAX_PASSAGES, SLICE, THRESHOLD = 64, 4000, 32_768, 1 << 20, 0.3
HIDDEN, GATE, STEPS, RATE, DECAY, SEED = 24, 12, 250, 0.02, 1e-4, 7
BYTES, KINDS, WORDS = 136, 8, 64  # ASCII on its own, others by their low bits; kinds of byte; buckets of words, and of pairs
WIDTH = BYTES + KINDS * KINDS + 2 * WORDS + 3


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    which = np.where(byte < 128, byte, 128 + byte % 8).astype(np.int64)
    kind = np.full(256, 7, np.int64)  # of a character beyond ASCII
    for c in range(128):
        s = chr(c)
        kind[c] = 0 if s in " \t\r\v\f" else 1 if s == "\n" else 2 if s.islower() else 3 if s.isupper() else 4 if s.isdigit() else 5 if s in ".,;:?'\"-()" else 6
    return which, kind


def encode_passages(col: pa.Array, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(encoding of every passage, n + 1 offsets of each text's passages). Words from their start to the next word's."""
    data, offsets = text_bytes(col)
    starts, ends, words = word_spans(data, offsets)
    n = np.diff(words)
    count = np.maximum(1, -(-n // passage))
    at = segments(count)
    first = np.repeat(offsets[:-1], count)  # a text's first passage begins with the text
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    order = np.arange(at[-1]) - np.repeat(at[:-1], count)
    first[inner] = starts[(np.repeat(words[:-1], count) + order * passage)[inner]]
    edges = np.append(first, len(data))
    size = np.diff(edges)
    which, kind = _classes()
    own = np.repeat(np.arange(at[-1]), size)
    h = np.zeros((at[-1], WIDTH))
    h[:, :BYTES] = np.bincount(own * BYTES + which[data], minlength=at[-1] * BYTES).reshape(-1, BYTES)
    if len(data) > 1:
        k = kind[data]
        pair = own[:-1] * (KINDS * KINDS) + k[:-1] * KINDS + k[1:]
        h[:, BYTES : BYTES + KINDS * KINDS] = np.bincount(pair[own[:-1] == own[1:]], minlength=at[-1] * KINDS * KINDS).reshape(-1, KINDS * KINDS)
    h = np.sqrt(h / np.maximum(size, 1)[:, None])
    held = np.minimum(passage, np.maximum(0, np.repeat(n, count) - order * passage))
    if len(starts):
        known, of = word_hashes(data, starts, ends, fold_case=True), own[starts]
        near = np.flatnonzero(of[1:] == of[:-1])  # words that another of their passage follows
        pair = mix(known[near] * np.uint64(3) + known[near + 1])
        for k, (hashes, passages) in enumerate(((known, of), (pair, of[near]))):
            a = BYTES + KINDS * KINDS + k * WORDS
            share = np.bincount(passages * WORDS + (hashes >> np.uint64(32)).astype(np.int64) % WORDS, minlength=at[-1] * WORDS).reshape(-1, WORDS)
            h[:, a : a + WORDS] = np.sqrt(share / np.maximum(held, 1)[:, None])
        again = np.flatnonzero(known[1:] == known[:-1]) + 1
        h[:, -3] = np.bincount(of[again], minlength=at[-1]) / np.maximum(held, 1)
    h[:, -2] = np.log1p(held)
    h[:, -1] = size / np.maximum(held, 1) / 10
    return h, at


class Model:
    """Weights; and what scales encodings."""

    def __init__(self, width: int, rng: np.random.Generator):
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"W": draw(width, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(width), np.ones(width), None

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict:
        """x: scaled encodings of bags on end; at: n + 1 offsets; no bag is empty."""
        w, bag = self.w, np.repeat(np.arange(len(at) - 1), np.diff(at))
        e = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-np.clip(e @ w["U"], -30, 30)))
        s = ((t * g) @ w["a"])[:, 0]
        s = np.exp(s - np.maximum.reduceat(s, at[:-1])[bag])
        a = s / np.add.reduceat(s, at[:-1])[bag]
        z = np.add.reduceat(a[:, None] * e, at[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip((z @ w["c"])[:, 0] + w["d"][0], -30, 30)))
        return {"bag": bag, "e": e, "t": t, "g": g, "a": a, "z": z, "y": y}

    def gradients(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy."""
        w, f = self.w, self.forward(x, at)
        dy = (weight * (f["y"] - label) / weight.sum())[:, None]
        out = {"c": f["z"].T @ dy, "d": dy.sum(axis=0)}
        dz = (dy @ w["c"].T)[f["bag"]]
        da = (dz * f["e"]).sum(axis=1)
        mean = np.add.reduceat(f["a"] * da, at[:-1])[f["bag"]]
        ds = (f["a"] * (da - mean))[:, None]
        out["a"] = (f["t"] * f["g"]).T @ ds
        dt, dg = ds * w["a"].T * f["g"] * (1 - f["t"] ** 2), ds * w["a"].T * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["e"].T @ dt, f["e"].T @ dg
        de = f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T
        dx = de * (1 - f["e"] ** 2)
        out["W"], out["b"] = x.T @ dx, dx.sum(axis=0)
        return out

    def score(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return self.forward((h - self.mean) / self.scale, at)["y"]


def train(h: np.ndarray, at: np.ndarray, label: np.ndarray, *, steps: int = STEPS, seed: int = SEED) -> Model:
    model = Model(h.shape[1], np.random.default_rng(seed))
    if len(label) == 0 or label.min() == label.max():
        model.constant = float(label.mean()) if len(label) else 0.5
        return model
    model.mean, model.scale = h.mean(axis=0), h.std(axis=0) + 0.02
    x = (h - model.mean) / model.scale
    weight = np.ones(len(label))
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    for step in range(1, steps + 1):
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in model.gradients(x, at, label, weight).items():
            g = g + DECAY * model.w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            model.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(id_col, 5) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> Model:
    """labels (doc_id, quality). The driver chooses among max_docs documents by their sizes; executors encode the chosen ones, and
    max_passages passages at most come to the driver."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    order = (F.xxhash64("_id"), F.col("_id"))
    sample = labels.select(F.col("doc_id").alias("_id"), "label").orderBy(*order).limit(max_docs)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id").withColumn("_text", F.xxhash64("text"))
    passages = F.greatest(F.ceil(word_count(F.col("text")) / PASSAGE), F.lit(1))
    sizes = own.select("_id", "_text", passages.alias("n")).distinct().orderBy(*order, "_text").limit(max_docs).collect()
    chosen, total = [], 0
    for r in sizes:
        if total + r["n"] <= max_passages:
            chosen.append((r["_id"], r["_text"]))
            total += r["n"]
    if not chosen:
        return train(np.empty((0, WIDTH)), np.zeros(1, np.int64), np.empty(0))
    chosen = docs.sparkSession.createDataFrame(chosen, f"_id {dict(own.dtypes)['_id']}, _text long")
    rows = own.join(F.broadcast(chosen), ["_id", "_text"]).groupBy("_id", "_text").agg(F.first("label").alias("label"), F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, at = encode_passages(part.column("text"))
                kept = [h[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([part.column("_id"), part.column("_text"), part.column("label"), pa.array(kept, pa.binary())], names=["_id", "_text", "label", "passages"])

    got = map_arrow(rows, run, rows.drop("text").schema.add("passages", "binary")).toPandas().sort_values(["_id", "_text"], kind="stable")
    bags = [np.frombuffer(x, "<f4").reshape(-1, WIDTH) for x in got["passages"]]
    h = np.concatenate(bags).astype(np.float64)
    return train(h, segments(np.array([len(x) for x in bags], np.int64)), got["label"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs, without the text, with score; a column of docs with that name is replaced."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                h, at = encode_passages(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(held.value.score(h, at))], names=[*rest, "score"])

    return map_arrow(docs, run, docs.drop(text_col).schema.add("score", "double"))


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()).select("doc_id", "quality"))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
