"""LM scoring: the marginal likelihood of a text over all its subword segmentations.

The pieces are those of an existing tokenizer's vocabulary. Their ranks there give first
probabilities; one round of expectation maximisation over the words of the training documents,
by forward and backward recursion through every word's lattice, fits them to the corpus. No
piece crosses a word, so a document's probability is the product over its words and the end
mark, and every distinct word's lattice is summed once, however often it occurs.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.tokens import as_bytes
from tallyloom.session import durable

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HELD_WORDS = 200_000
FREQUENT, LOOKED_UP_BYTES = 100_000, 64
#: Characters of a word whose arcs are held at a time.
SLAB = 4096


class Lattice:
    """Pieces with log probabilities, and the two recursions over a word."""

    def __init__(self, pieces: list[str], logs: list[float]) -> None:
        self.ids = {p: i for i, p in enumerate(pieces) if not _is_byte(p)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if _is_byte(p)}
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.logs = logs

    def arcs(self, text: str, first: int, last: int
             ) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """(from, to, log probability, pieces) of the arcs that begin in a range, by start; a
        character without a piece of its own is spelled in bytes."""
        out, ids, prefixes, logs = [], self.ids, self.prefixes, self.logs
        size = len(text)
        for i in range(first, min(last, size)):
            j = i + 1
            part = text[i:j]
            if part not in ids:
                spelled = tuple(self.bytes[b] for b in part.encode())
                out.append((i, j, sum(logs[k] for k in spelled), spelled))
            while part in prefixes:
                k = ids.get(part)
                if k is not None:
                    out.append((i, j, logs[k], (k,)))
                if j == size:
                    break
                j += 1
                part = text[i:j]
        return out

    def _open(self, size: int) -> list[float] | array:
        """One value a character; as plain numbers where there are many."""
        return [-math.inf] * (size + 1) if size <= SLAB else array("d", [-math.inf]) * (size + 1)

    def forward(self, alpha: list[float] | array, arcs: list) -> None:
        exp, log1p = math.exp, math.log1p
        for i, j, log, _ in arcs:
            new, old = alpha[i] + log, alpha[j]
            if old == -math.inf:
                alpha[j] = new
            elif new > old:
                alpha[j] = new + log1p(exp(old - new))
            else:
                alpha[j] = old + log1p(exp(new - old))

    def marginal(self, word: str) -> float:
        """Natural log of the word's probability, summed over all segmentations.

        The arcs of a long word are made a slab of it at a time.
        """
        text = SPACE + word
        alpha = self._open(len(text))
        alpha[0] = 0.0
        for low in range(0, len(text), SLAB):
            self.forward(alpha, self.arcs(text, low, low + SLAB))
        return alpha[-1]

    def expected(self, word: str, weight: float, counts: np.ndarray) -> None:
        """Add the pieces' expected uses in ``weight`` occurrences of the word."""
        text = SPACE + word
        lows, arcs = range(0, len(text), SLAB), []
        alpha, beta = self._open(len(text)), self._open(len(text))
        alpha[0] = beta[-1] = 0.0
        for low in lows:
            arcs = self.arcs(text, low, low + SLAB)
            self.forward(alpha, arcs)
        for low in reversed(lows):
            if low != lows[-1]:
                arcs = self.arcs(text, low, low + SLAB)
            for i, j, log, pieces in reversed(arcs):
                new, old = beta[j] + log, beta[i]
                beta[i] = max(new, old) + math.log1p(math.exp(-abs(new - old))) \
                    if old > -math.inf else new
                share = weight * math.exp(alpha[i] + log + beta[j] - alpha[-1])
                for k in pieces:
                    counts[k] += share


def _is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")


def load_pieces(model_file: str) -> tuple[list[str], list[float]]:
    """The vocabulary and log probabilities in proportion to 1 / rank; control pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kept = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i))]
    ranks = np.array([max(-model.get_score(i), 0.0) for i in kept])
    byte = np.array([model.is_byte(i) for i in kept])
    ranks[byte] = ranks.max()
    weights = 1 / (ranks + 10)
    return [model.id_to_piece(i) for i in kept], np.log(weights / weights.sum()).tolist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their uses in training documents; words of other documents with 0."""
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        batch = pa.RecordBatch.from_arrays(
            [words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        held = batch.column("held_out").to_pylist()
        for text, kept_out in zip(as_bytes(batch.column("text")), held, strict=True):
            words = text.lower().split()
            if kept_out:
                for word in set(words):
                    counts[word] += 0
            else:
                counts.update(words)
            if len(counts) >= HELD_WORDS:
                yield out()
    if counts:
        yield out()


def _expectations(pieces: list[str], logs: list[float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(pieces, logs), np.zeros(len(pieces))
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(),
                               strict=True):
                lattice.expected(word, n, counts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used])], ["piece", "uses"])
    return run


def _marginals(pieces: list[str], logs: list[float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logs)
        for batch in batches:
            value = [lattice.marginal(w) / math.log(10) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(value, pa.float64())],
                ["word", "n", "log10"])
    return run


def _documents(columns: list[str], frequent: dict[bytes, tuple[float, int, float]]) -> Callable:
    """A row per document with the sums over frequent words, and one for each other word in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = as_bytes(batch.column("__source")), batch.column("__row").to_pylist()
            for low in range(0, len(texts), 200):
                picked: list[int] = []
                row: list[int] = []
                words: list[bytes | None] = []
                sums: list[tuple[int, int, float, float]] = []
                for i in range(low, min(low + 200, len(texts))):
                    counts = Counter(texts[i].lower().split())
                    base = score = 0.0
                    known = total = 0
                    picked.append(i)
                    row.append(rows[i])
                    words.append(None)
                    sums.append((0, 0, 0.0, 0.0))
                    at = len(sums) - 1
                    for word, n in counts.items():
                        total += n
                        values = frequent.get(word)
                        if values is None:
                            picked.append(i)
                            row.append(rows[i])
                            words.append(word)
                            sums.append((n, 0, 0.0, 0.0))
                        else:
                            base += n * values[0]
                            known += n * values[1]
                            score += n * values[2]
                    sums[at] = (total, known, base, score)
                take = pa.array(picked)
                n, known_n, base_n, score_n = zip(*sums, strict=True)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(take) for c in columns], pa.array(row, pa.int64()),
                    pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                    pa.array(known_n, pa.int64()), pa.array(base_n, pa.float64()),
                    pa.array(score_n, pa.float64()),
                ], [*columns, "__row", "word", "uses", "known", "base", "score"])
    return run


def fitted(words: DataFrame, documents: int, model_file: str) -> tuple[list[str], list[float], float]:
    """Pieces, their log probabilities after one round over ``words``, and the end mark's.

    What reaches the driver is one number per piece of the vocabulary.
    """
    pieces, first = load_pieces(model_file)
    uses = words.where("n > 0").mapInArrow(_expectations(pieces, first), "piece long, uses double")
    counts = np.full(len(pieces), 0.5)
    for row in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        counts[row["piece"]] += row["uses"]
    total = counts.sum() + documents + 0.5
    return pieces, np.log(counts / total).tolist(), math.log10((documents + 0.5) / total)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL,
    folds: int = 5, held_fold: int = 1, frequent_words: int = FREQUENT,
) -> DataFrame:
    """One row per document with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``.

    A-Z count as lower case. Tokens are the words and one end mark. Documents whose CRC-32 of
    the id as text falls into ``held_fold`` of ``folds`` are not learned from; a null id is
    learned from. ``base_score`` is the add-half unigram log10 probability, ``score`` that of the
    lattice. A null or empty text is its end mark alone. Repeated rows each get a row and count
    each. The ``frequent_words`` most used words of at most 64 bytes are looked up where documents
    are read, which bounds the table sent to the tasks; all others, long or rare, are joined. The
    result does not depend on that number.
    """
    spark: SparkSession = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_fold, F.lit(False))
    source = docs.select(id_col, held.alias("held_out"), F.col(text_col).alias("__source"))
    counted = source.select(F.col("__source").alias("text"), "held_out").mapInArrow(
        _count_words, "word string, n long")
    words = durable(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    training = source.where(~F.col("held_out")).count()
    seen = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    tokens = (seen["n"] or 0) + training
    kinds = seen["kinds"] + (training > 0)
    below = tokens + 0.5 * (kinds + 1)
    pieces, logs, end = fitted(words, training, model_file)
    valued = durable(words.mapInArrow(
        _marginals(pieces, logs), "word string, n long, log10 double"), "valued")
    short = valued.where(F.octet_length("word") <= LOOKED_UP_BYTES)
    top = short.orderBy(F.desc("n"), "word").limit(frequent_words).collect()
    frequent = {r["word"].encode(): (math.log10((r["n"] + 0.5) / below), int(r["n"] > 0), r["log10"])
                for r in top}
    shared = spark.sparkContext.broadcast(frequent)
    scan = source.withColumn("__row", F.monotonically_increasing_id())
    schema = T.StructType([
        docs.schema[id_col], T.StructField("held_out", T.BooleanType()),
        T.StructField("__row", T.LongType()), T.StructField("word", T.StringType()),
        T.StructField("uses", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
    columns = [id_col, "held_out"]
    parts = durable(scan.mapInArrow(
        lambda batches: _documents(columns, shared.value)(batches), schema), "parts")
    rare = parts.where("word IS NOT NULL").select("__row", "word", "uses").join(valued, "word")
    uses = F.col("uses")
    sums = rare.groupBy("__row").agg(
        F.sum(F.when(F.col("n") > 0, uses).otherwise(0)).alias("rare_known"),
        F.sum(uses * F.log10((F.col("n") + 0.5) / below)).alias("rare_base"),
        F.sum(uses * F.col("log10")).alias("rare_score"))
    whole = parts.where("word IS NULL").join(sums, "__row", "left")

    def plus(own: str, other: str, value: float | int) -> Column:
        return F.col(own) + F.coalesce(other, F.lit(0)) + F.lit(value)

    return whole.select(
        id_col, "held_out", (uses + 1).alias("n_tokens"),
        plus("known", "rare_known", int(training > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        plus("base", "rare_base", math.log10((training + 0.5) / below)).alias("base_score"),
        plus("score", "rare_score", end).alias("score"))
