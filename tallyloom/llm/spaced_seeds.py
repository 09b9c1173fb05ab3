"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask looks at some of eight consecutive words and ignores the others, so a replaced word
spoils only the seeds that look at it. The benchmark and the documents are hashed at every word;
equal hashes give a document, an item and how far they are shifted against each other. Besides,
an item is cut into one piece more than it may have replaced words, so that a piece stays whole
wherever they are; the pieces' first words, four at most, are seeds too.
Along that shift the words are compared one by one: a match counts 1, a replaced word -2, and
the best stretch decides, or else the share of the item's words that are equal.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import let
from tallyloom.llm.repeats import REF, with_ref
from tallyloom.operators.ordered import join_on
from tallyloom.session import durable

MASKS = ("11101011", "11010111", "10111101")
STRIDE = 1
PIECE = 4
MIN_SCORE = 12
#: Tenths of an item's words that make a leak whatever the score.
TENTHS = 8
BROADCAST_ROWS = 500_000


def compared_words(text: Column) -> Column:
    """Lower-case words of letters and digits only; whatever else is in a word is left out."""
    plain = F.regexp_replace(
        F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(hashes: Column, size: int, i: Column) -> Column:
    """Place and hash of ``size`` consecutive words; the number keeps them apart from masks."""
    return F.struct(i.cast("int").alias("i"), F.xxhash64(
        F.lit(-size), *[hashes[(i + k).cast("int")] for k in range(size)]).alias("seed"))


def seeds(words: Column, masks: Sequence[str], stride: int, grams: Sequence[int] = ()) -> Column:
    """``i``, ``seed``: hashes of all masks at every ``stride``-th word, of ``grams`` at each."""
    span = len(masks[0])

    def at(hashes: Column, i: Column) -> Column:
        return F.array(*[
            F.struct(i.alias("i"), F.xxhash64(
                F.lit(m), *[hashes[i + k] for k, on in enumerate(mask) if on == "1"]).alias("seed"))
            for m, mask in enumerate(masks)
        ])

    def places(hashes: Column, size: int, step: int) -> Column:
        return F.when(F.size(hashes) >= size, F.sequence(
            F.lit(0), F.size(hashes) - size, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def all_of(hashes: Column) -> Column:
        return F.concat(
            F.flatten(F.transform(places(hashes, span, stride), lambda i: at(hashes, i))),
            *[F.transform(places(hashes, n, 1), partial(_gram, hashes, n)) for n in grams])

    return let(_hashed(words), all_of)


def piece_size(n: Column, tenths: int) -> Column:
    """Words looked at in each piece of an item of ``n`` words; pieces are ``_pieces(n)`` many."""
    return F.least(F.lit(PIECE), F.floor(n / _pieces(n, tenths))).cast("int")


def _pieces(n: Column, tenths: int) -> Column:
    return (n - F.ceil(n * tenths / 10) + 1).cast("int")


def piece_seeds(words: Column, tenths: int) -> Column:
    """``i``, ``seed`` of the pieces of an item, one of which no permitted replacement touches."""
    n = F.size(words)
    size, pieces = piece_size(n, tenths), _pieces(n, tenths)

    def at(hashes: Column, j: Column) -> Column:
        i = F.floor(j * n / pieces).cast("int")
        chosen = F.when(size == 1, _gram(hashes, 1, i))
        for k in range(2, PIECE + 1):
            chosen = chosen.when(size == k, _gram(hashes, k, i))
        return chosen

    return F.when(n > 0, let(_hashed(words), lambda hashes: F.transform(
        F.sequence(F.lit(0), pieces - 1), lambda j: at(hashes, j))))


def placed_seeds(
    docs: DataFrame, masks: Sequence[str], stride: int, grams: Sequence[int]
) -> DataFrame:
    """``i``, ``seed`` of documents known by REF with their word hashes ``__h``.

    One row per word first, then the seeds that begin there: plain hashes of that row's
    neighbours, for which code is generated, where a lambda over the array would be interpreted.
    """
    at = docs.select(*REF, "__h", F.posexplode("__h").alias("i", "__w"))
    n = F.size("__h")

    def seed(kind: int, places: Sequence[int], span: int) -> Column:
        looked = [F.get("__h", F.col("i") + k) for k in places]
        whole = F.col("i") + span <= n
        if kind >= 0:
            whole &= F.col("i") % stride == 0
        return F.when(whole, F.xxhash64(F.lit(kind), *looked))

    made = [seed(m, [k for k, on in enumerate(mask) if on == "1"], len(mask))
            for m, mask in enumerate(masks)]
    made += [seed(-g, range(g), g) for g in grams]
    return at.select(*REF, "i", F.explode(F.array(*made)).alias("seed")).where(
        F.col("seed").isNotNull())


def _best_stretch(part: Column, item: Column, first: Column) -> Column:
    """Of a document's words beside those of an item from ``first`` on: the highest score of any
    run (``best``) and the number of equal ones (``equal``)."""
    start = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"), F.lit(0).alias("equal"))

    def step(state: Column, same: Column) -> Column:
        return let(F.greatest(state["here"] + F.when(same, 1).otherwise(-2), F.lit(0)), lambda here: F.struct(
            here.alias("here"), F.greatest(state["best"], here).alias("best"),
            (state["equal"] + same.cast("int")).alias("equal")))

    same = F.transform(part, lambda w, q: w == F.get(item, first + q))
    return F.aggregate(same, start, step)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", masks: Sequence[str] = MASKS,
    stride: int = STRIDE, min_score: int = MIN_SCORE, broadcast_rows: int = BROADCAST_ROWS,
    tenths: int | None = TENTHS, pieces: bool = True,
) -> DataFrame:
    """Documents that hold a benchmark item or a stretch of one: ref, item id and ``score``.

    ``score`` is that of the best stretch, at least ``min_score`` or the item's whole length if
    that is less; or any, where ``tenths`` / 10 of the item's words are equal to the document's along
    one shift (None: the score alone decides). With ``pieces`` and a share no such item is missed,
    nor a whole one, however short; without, items shorter than a mask are not looked for. A
    stretch of an item is found by the masks, which need eight words with few replaced ones.
    Rows are known by ``__id`` and ``__text`` (see ``with_ref``); repeated rows are one here. The
    benchmark's seeds are broadcast while there are at most ``broadcast_rows``; beyond that they
    are joined by a shuffle.
    """
    if len({len(m) for m in masks}) != 1 or not all("1" in m for m in masks):
        raise ValueError("masks must be of one length and look at a word at least")
    source = with_ref(docs, id_col, text_col).select(F.col(text_col).alias("__source"), *REF)
    items = benchmark.select(
        F.col(item_col).alias("item"), F.col(item_text_col).alias("__source")).distinct()
    cut = 10 if tenths is None else tenths
    words = F.col("words")
    planted = seeds(words, masks, 1)
    if pieces:
        planted = F.concat(planted, F.coalesce(piece_seeds(words, cut), F.slice(planted, 1, 0)))
    known = durable(items.select("item", compared_words(F.col("__source")).alias("words")).select(
        "item", "words", F.inline(planted)).withColumnRenamed("i", "q"), "seeds")
    # At most PIECE numbers reach the driver.
    grams = sorted(r[0] for r in known.select(
        piece_size(F.size("words"), cut)).distinct().collect()) if pieces else []
    places = known.select("item", "seed", "q").distinct()
    if known.count() <= broadcast_rows:
        places = F.broadcast(places)
    hashed = source.select(*REF, _hashed(compared_words(F.col("__source"))).alias("__h"))
    found = placed_seeds(hashed, masks, stride, grams)
    hits = durable(found.join(places, "seed").select(
        *REF, "item", (F.col("i") - F.col("q")).alias("shift")).distinct(), "hits")
    texts = known.select("item", "words").distinct()
    # Numbers only: an item's words come to a hit after it has left the document's row.
    sizes = texts.select("item", F.size("words").alias("n"))
    pairs = join_on(hits, sizes, ["item"]).groupBy(*REF).agg(
        F.collect_list(F.struct("item", "shift", "n")).alias("hits"))
    aligned = join_on(source, pairs, REF, "inner").select(*REF, F.explode(let(
        compared_words(F.col("__source")), lambda document: F.transform("hits", lambda h: let(
            F.greatest(F.lit(0), -h["shift"]), lambda first: F.struct(
                h["item"].alias("item"), first.alias("first"), F.slice(
                    document, F.greatest(F.lit(0), h["shift"]) + 1,
                    F.greatest(h["n"] - first, F.lit(0))).alias("part")))))).alias("hit"))
    beside = join_on(aligned.select(*REF, "hit.*"), texts, ["item"])
    checked = beside.select(*REF, F.struct(
        "item", F.size("words").alias("n"),
        _best_stretch(F.col("part"), F.col("words"), F.col("first")).alias("run")).alias("hit"))
    leak = F.col("hit.run.best") >= F.least(F.lit(min_score), F.col("hit.n"))
    if tenths is not None:
        leak |= 10 * F.col("hit.run.equal") >= tenths * F.col("hit.n")
    return checked.where(leak).groupBy(*REF, F.col("hit.item").alias("item")).agg(
        F.max("hit.run.best").cast("long").alias("score"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col``, ``item_id`` and ``score`` of every leak; rows alike in id and text are one."""
    found = leaks(docs, benchmark, id_col, **options)
    return found.select(
        F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("item").alias("item_id"), "score")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents without a leak; columns and clean rows stay as they are."""
    marked = durable(leaks(docs, benchmark, id_col, text_col, **options).select(*REF).distinct(),
                     "leaks")
    return join_on(with_ref(docs, id_col, text_col), marked, REF, "left_anti").select(*docs.columns)
