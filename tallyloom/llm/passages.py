"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of a fixed number of words, all of its text. A passage is
encoded from shares of character classes and shapes of words by a learned layer; gated attention
(a tanh unit times a sigmoid unit) weighs the passages, the weights sum to one in a document, and
the weighted representation is scored. Only document labels are learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.tokens import SEPARATOR, as_bytes, slabs, word_bounds, word_tokens

PASSAGE_WORDS = 64
TRAIN_ROWS, TRAIN_PASSAGES = 3000, 1000

KIND = np.full(256, 6, np.int64)
for _kind, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b"#*$%&|<>",
                                  b".,;:!?'\"()-", range(0x80, 0x100))):
    KIND[list(_members)] = _kind
KINDS = 7
SHAPES = KINDS * KINDS * 4
WIDTH = KINDS + 4 + SHAPES
Weights = dict[str, np.ndarray]


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and each text's first; a text without words has an empty one."""
    data, starts, ends, first = word_bounds(texts)
    tokens, _ = word_tokens(texts)
    n_words = np.diff(first)
    n_passages = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n_passages, out=begin[1:])
    out = np.zeros((begin[-1], WIDTH))
    if not len(starts):
        return out, begin
    owner = np.repeat(np.arange(len(texts)), n_words)
    passage = begin[owner] + (np.arange(len(starts)) - first[owner]) // PASSAGE_WORDS
    size = np.bincount(passage, minlength=len(out))
    lengths = ends - starts
    chars = np.flatnonzero(~SEPARATOR[data])
    place = np.repeat(passage, lengths)
    per_char = np.maximum(np.bincount(place, minlength=len(out)), 1)
    out[:, :KINDS] = np.bincount(
        place * KINDS + KIND[data[chars]], minlength=len(out) * KINDS
    ).reshape(-1, KINDS) / per_char[:, None]
    per_word = np.maximum(size, 1)
    out[:, KINDS] = np.bincount(passage, lengths, minlength=len(out)) / per_word / 8
    echo = np.zeros(len(tokens), bool)
    echo[1:] = (tokens[1:] == tokens[:-1]) & (passage[1:] == passage[:-1])
    out[:, KINDS + 1] = np.bincount(passage, echo, minlength=len(out)) / per_word
    order = np.lexsort((tokens, passage))
    again = np.zeros(len(tokens), bool)
    again[order[1:]] = (tokens[order[1:]] == tokens[order[:-1]]) & (
        passage[order[1:]] == passage[order[:-1]])
    out[:, KINDS + 2] = np.bincount(passage, again, minlength=len(out)) / per_word
    out[:, KINDS + 3] = size / PASSAGE_WORDS
    bucket = np.minimum(np.log2(lengths).astype(np.int64), 3)
    shape = (KIND[data[starts]] * KINDS + KIND[data[ends - 1]]) * 4 + bucket
    out[:, KINDS + 4:] = np.bincount(
        passage * SHAPES + shape, minlength=len(out) * SHAPES).reshape(-1, SHAPES) / per_word[:, None]
    return out, begin


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin[:-1], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scaled(w: Weights, x: np.ndarray) -> np.ndarray:
    return ((x - w["mean"]) / w["scale"]).astype(np.float32)


def _pass(w: Weights, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    h = np.tanh(x @ w["encode"] + w["bias"])
    t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    raw = (t * g) @ w["attend"]
    raw = np.exp(raw - np.maximum.reduceat(raw, begin[:-1])[bag])
    a = raw / _sums(raw, begin)[bag]
    z = _sums(a[:, None] * h, begin)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z,
            "p": _sigmoid(z @ w["out"] + w["shift"])}


def learn(x: np.ndarray, begin: np.ndarray, label: np.ndarray, hidden: int = 24, units: int = 12,
          rounds: int = 200, rate: float = 0.02, decay: float = 1e-3) -> Weights:
    """Weights by Adam on the mean log loss of the documents; the same data give the same ones."""
    rng = np.random.default_rng(7)
    w: Weights = {
        "encode": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "bias": np.zeros(hidden),
        "tanh": rng.normal(0, 0.3, (hidden, units)), "gate": rng.normal(0, 0.3, (hidden, units)),
        "attend": rng.normal(0, 0.3, units), "out": rng.normal(0, 0.3, hidden),
        "shift": np.zeros(1), "mean": x.mean(axis=0), "scale": np.maximum(x.std(axis=0), 0.02)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    label = label.astype(np.float32)
    learned = [k for k in w if k not in ("mean", "scale")]
    first, second = ({k: np.zeros_like(w[k]) for k in learned} for _ in range(2))
    scaled = _scaled(w, x)
    for step in range(1, rounds + 1):
        s = _pass(w, scaled, begin)
        bag, h, a = s["bag"], s["h"], s["a"]
        error = (s["p"] - label) / len(label)
        dz = error[:, None] * w["out"]
        da = (dz[bag] * h).sum(axis=1)
        draw = a * (da - _sums(a * da, begin)[bag])
        dunit = draw[:, None] * w["attend"]
        dt, dg = dunit * s["g"] * (1 - s["t"] ** 2), dunit * s["t"] * s["g"] * (1 - s["g"])
        dh = (a[:, None] * dz[bag] + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - h ** 2)
        grad = {"encode": scaled.T @ dh, "bias": dh.sum(axis=0), "tanh": h.T @ dt,
                "gate": h.T @ dg, "attend": (s["t"] * s["g"]).T @ draw, "out": s["z"].T @ error,
                "shift": error.sum(keepdims=True)}
        for k in learned:
            move = grad[k] + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * move
            second[k] = 0.999 * second[k] + 0.001 * move ** 2
            w[k] = w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return w


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for low, high in slabs(texts):
            x, begin = passage_features(texts[low:high])
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([
                part.column("label"), part.column("id"),
                pa.array([x[a:b].astype(np.float32).tobytes()
                          for a, b in zip(begin, begin[1:], strict=False)], pa.binary()),
            ], ["label", "id", "x"])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held: Column,
    train_rows: int = TRAIN_ROWS, train_passages: int = TRAIN_PASSAGES,
) -> Weights | None:
    """Weights learned from at most ``train_rows`` labelled documents outside the held fold.

    Those of the least id hash are drawn; documents of more than ``train_passages`` passages'
    words are not, so what reaches the driver is bounded. None without both labels.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__label_id"))
        .agg(F.min(label_col).alias("label"))
        .where(~F.coalesce(F.crc32(F.col("__label_id").cast("string")) % 3 == 1, F.lit(False)))
        .orderBy(F.xxhash64("__label_id"), "__label_id").limit(train_rows))
    mine = docs.where(~held).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = mine.join(F.broadcast(chosen), F.col("id") == F.col("__label_id")).select(
        F.col("label").cast("double").alias("label"), "id", "text")
    rows = known.mapInArrow(_features, T.StructType([
        T.StructField("label", T.DoubleType()),
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.BinaryType())]))
    drawn = rows.where(F.length("x") <= 4 * WIDTH * train_passages).orderBy(
        F.xxhash64("id"), "x").limit(train_rows).collect()
    label = np.array([r["label"] for r in drawn])
    if not len(label) or label.min() == label.max():
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in drawn]
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return learn(np.concatenate(bags).astype(np.float64), begin, label)


def _scores(columns: list[str], weights: Weights | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("__source"))
            for low, high in slabs(texts):
                x, begin = passage_features(texts[low:high])
                p = _pass(weights, _scaled(weights, x), begin)["p"] if weights else np.full(high - low, 0.5)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], pa.array(p.astype(np.float64)),
                     pa.array(np.diff(begin), pa.int64())], [*columns, "score", "n_passages"])
    return run


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", **options,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` and ``n_passages``.

    ``held_out`` rows, whose CRC-32 of the id as text leaves 1 modulo 3, are never learned from;
    a null id is not held out. ``score`` depends on the text alone. A null or empty text is one
    empty passage. Without labels of both kinds every score is 0.5. Repeated rows each get a row.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    weights = train(docs, labels, id_col, text_col, label_col, held, **options)
    source = docs.select(id_col, held.alias("held_out"), F.col(text_col).alias("__source"))
    columns = [id_col, "held_out"]
    scored = source.mapInArrow(_scores(columns, weights), T.StructType([
        docs.schema[id_col], T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())]))
    return scored.select(
        *columns, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
