"""Quality rules: fixed base rules, and a decision list learned by sequential covering.

Rules are grown condition by condition on one part of the labelled statistics, pruned on the
other, and kept while they are precise there; what a rule covers is set aside before the next
is grown. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.tokens import SEPARATOR, as_bytes, mix, rolling, slabs, word_bounds, word_tokens

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share",
            "digit_share", "mark_share", "echo_share"]
#: The characters that the base rules call symbols: a fixed value.
SYMBOLS = b"#*$%&|<>"
Condition = tuple[str, str, float]
TRAIN_ROWS = 20_000


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SYMBOL = _class(SYMBOLS)
IS_UPPER, IS_DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
IS_MARK = _class(b".,;:!?'\"()[]{}-_/\\^~`=+@")
STARTS_CHARACTER = ~SEPARATOR & ((np.arange(256) & 0xC0) != 0x80)


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    again = np.zeros(len(values), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Base counts and shares of every text.

    No share depends on the length of an even text, so that long clean texts look like short ones.
    """
    data, _, _, first = word_bounds(texts)
    tokens, _ = word_tokens(texts)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=edges[1:])
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    covered = np.zeros(len(tokens) + 1, np.int64)
    if len(tokens) >= 5:
        windows = rolling(tokens, 5, 0x9FB21C651E98DF25)
        inside = np.flatnonzero(owner[:len(windows)] == owner[4:])
        if len(inside):
            seen = mix(windows[inside] ^ mix(owner[inside].astype(np.uint64)))
            twice = inside[_repeated(seen)]
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + 5, -1)
    covered = (np.cumsum(covered)[:-1] > 0)
    echo = np.zeros(len(tokens), bool)
    if len(tokens):
        echo[1:] = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
    dup_lines, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        full = [line for line in text.split(b"\n") if line.strip()]
        lines[i], dup_lines[i] = len(full), len(full) - len(set(full))
    chars = _per_text(STARTS_CHARACTER[data], edges)
    symbols = _per_text(IS_SYMBOL[data], edges)
    repeats = _per_text(covered, first)
    per_char, per_word = np.maximum(chars, 1), np.maximum(n_words, 1)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeats, "symbol_share": symbols / per_char,
        "dup_line_share": dup_lines / np.maximum(lines, 1), "repeat_share": repeats / per_word,
        "word_length": chars / per_word,
        "upper_share": _per_text(IS_UPPER[data], edges) / per_char,
        "digit_share": _per_text(IS_DIGIT[data], edges) / per_char,
        "mark_share": _per_text(IS_MARK[data], edges) / per_char,
        "echo_share": _per_text(echo, first) / per_word,
    }


def _statistics(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("__source"))
            for low, high in slabs(texts):
                found = text_statistics(texts[low:high])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns],
                     *[pa.array(found[c].astype(np.int64)) for c in COUNTS],
                     *[pa.array(found[c].astype(np.float64)) for c in FEATURES]],
                    [*columns, *[f"__{c}" for c in COUNTS + FEATURES]])
    return run


def with_statistics(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """``columns`` and every statistic, named ``__`` and its name."""
    schema = T.StructType([
        *[docs.schema[c] for c in columns],
        *[T.StructField(f"__{c}", T.LongType()) for c in COUNTS],
        *[T.StructField(f"__{c}", T.DoubleType()) for c in FEATURES]])
    return docs.select(*columns, F.col(text_col).alias("__source")).mapInArrow(
        _statistics(columns), schema)


def _covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    size = len(next(iter(x.values())))
    return reduce(lambda m, c: m & (x[c[0]] >= c[2] if c[1] == ">=" else x[c[0]] <= c[2]),
                  rule, np.ones(size, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Add the condition of the highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (live & ~bad).any() and (live & bad).any():
        p, n = int((live & bad).sum()), int((live & ~bad).sum())
        before, best = np.log2(p / (p + n)), (0.0, None, None)
        for name, values in x.items():
            for at in np.unique(np.quantile(values[live], np.linspace(0, 1, 65))):
                for sign in (">=", "<="):
                    take = live & (values >= at if sign == ">=" else values <= at)
                    p1, n1 = int((take & bad).sum()), int((take & ~bad).sum())
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - before) if p1 else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, sign, float(at)), take)
        if best[1] is None:
            break
        rule.append(best[1])
        live = best[2]
    return rule


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5,
    most_rules: int = 12, most_conditions: int = 4,
) -> list[list[Condition]]:
    """An ordered list of rules for bad rows; rows in a fixed order make a fixed list.

    At most ``most_rules`` rules of at most ``most_conditions`` thresholds each, so that the list
    can be read; covering also ends where no further rule is precise enough. Every third row is for pruning. A rule stays if it covers at least ``least`` bad rows of all
    and ``precision`` of what it covers is bad, in both parts.
    """
    part = np.arange(len(bad)) % 3 == 2
    open_ = np.ones(len(bad), bool)
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        grow, prune = open_ & ~part, open_ & part
        if not (grow & bad).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if not rule:
            break

        def worth(cut: list[Condition], of: np.ndarray) -> tuple[float, int]:
            hit = _covers(cut, x) & of
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / max(p + n, 1), p

        rule = max((rule[:k] for k in range(1, len(rule) + 1)),
                   key=lambda c: (worth(c, prune), -len(c)))
        hit = _covers(rule, x)
        precise = all(
            (hit & of & bad).sum() >= precision * (hit & of).sum() for of in (grow, prune))
        if not precise or (hit & open_ & bad).sum() < least:
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def rejected(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional expression over the statistics."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [
            F.col(f"__{c}") >= F.lit(v) if sign == ">=" else F.col(f"__{c}") <= F.lit(v)
            for c, sign, v in rule])
        out = F.when(test, True) if out is None else out.when(test, True)
    return F.lit(False) if out is None else out.otherwise(False)


def base_failed() -> Column:
    return (F.col("__n_words") < 10) | (
        100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", train_rows: int = TRAIN_ROWS, **options,
) -> list[list[Condition]]:
    """Rules learned from at most ``train_rows`` labelled documents, those of the least id hash.

    That bound is also the proof that the labels joined by broadcast are few. Labels other than
    0 and 1 count as absent; of several for one id the least counts. Without both labels there
    are no rules. Further options, ``precision``, ``least``, ``most_rules`` and
    ``most_conditions``, as for ``learn_rules``.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__label_id"))
        .agg(F.min(label_col).alias("__label"))
        .orderBy(F.xxhash64("__label_id"), "__label_id").limit(train_rows))
    mine = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text_of"))
    known = mine.join(F.broadcast(chosen), F.col("__doc") == F.col("__label_id"))
    rows = with_statistics(known, ["__doc", "__label"], "__text_of").select(
        "__doc", "__label", *[f"__{c}" for c in FEATURES + COUNTS])
    table = rows.orderBy(F.xxhash64("__doc"), *rows.columns).limit(train_rows).toPandas()
    table = table[(table["__n_words"] >= 10)
                  & (100 * table["__n_repeat_words"] <= 20 * table["__n_words"])]
    bad = table["__label"].to_numpy() == 0
    if not len(bad) or bad.all() or not bad.any():
        return []
    return learn_rules({c: table[f"__{c}"].to_numpy() for c in FEATURES}, bad, **options)


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per document: id, the base counts, ``base_failed`` and ``kept``.

    A null text has no words and fails. Rules are learned on what the base rules let pass.
    Repeated rows each get a row.
    """
    rules = train(docs, labels, id_col, text_col, **options)
    judged = with_statistics(docs, [id_col], text_col)
    return judged.select(
        id_col, *[F.col(f"__{c}").alias(c) for c in COUNTS], base_failed().alias("base_failed"),
        (~base_failed() & ~rejected(rules)).alias("kept"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents that neither the base rules nor the list reject, columns unchanged."""
    rules = train(docs, labels, id_col, text_col, **options)
    judged = with_statistics(docs, docs.columns, text_col)
    return judged.where(~base_failed() & ~rejected(rules)).select(*docs.columns)
