"""Token counts by a user's encoder that sees every distinct piece of text once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import durable

#: A word with the space before it, a run of digits or of other characters, or white space.
PIECE = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

#: Texts that share a vocabulary.
ROWS = 2000


def encoder_counts(
    df: DataFrame, text: str, load: Callable[[], Callable[[str], list]], pattern: str = PIECE,
    count: str = "n_tokens",
) -> DataFrame:
    """Add the number of tokens that an encoder makes of a text; NULL for a NULL text.

    ``pattern`` cuts a text into the pieces that the encoder's tokens never cross (its
    pre-tokens). Texts are cut in the JVM, and ``ROWS`` at a time stored as numbers into a
    vocabulary of their own. Only the vocabularies are shuffled: the distinct pieces of all are
    encoded once each, and their counts go back to the vocabularies, as one array for each, and
    from there to the texts. ``load`` runs once per Python task and returns
    ``encode(piece) -> tokens``.
    """
    @F.arrow_udf("batch string, codes array<int>, vocabulary array<string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("batch", pa.string()), ("codes", pa.list_(pa.int32())),
                          ("vocabulary", pa.list_(pa.string()))])
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                cuts = batch.slice(start, ROWS)
                found = cuts.flatten().dictionary_encode()
                ends = pc.fill_null(pc.list_value_length(cuts), 0).to_numpy().cumsum()
                codes = pa.ListArray.from_arrays(
                    pa.array([0, *ends], pa.int32()), found.indices,
                    mask=cuts.is_null())
                first = pa.array([found.dictionary.to_pylist(), *[None] * (len(cuts) - 1)],
                                 pa.list_(pa.string()))
                names = pa.array([uuid.uuid4().hex] * len(cuts))
                yield pa.StructArray.from_arrays([names, codes, first], fields=list(kind))

    cut = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    rows = durable(df.withColumn("__coded", coded.asNondeterministic()(cut)), "coded")
    words = rows.where("__coded.vocabulary IS NOT NULL").select(
        F.col("__coded.batch").alias("__batch"),
        F.posexplode("__coded.vocabulary").alias("__code", "__piece"))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for batch in batches:
            yield pd.DataFrame({"__piece": batch["__piece"],
                                "__size": [len(encode(p)) for p in batch["__piece"]]})

    # Stored, so that an encoder runs once per piece and a frequent piece's rows can be split.
    known = durable(words.select("__piece").distinct().mapInPandas(
        encoded, "__piece string, __size long"), "encoded")
    sizes = words.join(known, "__piece").groupBy(F.col("__batch").alias("__of")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__code", "__size"))),
                    lambda x: x["__size"]).alias("__sizes"))
    total = F.aggregate("__coded.codes", F.lit(0).cast("long"),
                        lambda n, code: n + F.get("__sizes", code))
    return rows.join(sizes, F.col("__coded.batch") == F.col("__of"), "left").select(
        *df.columns, total.alias(count))
