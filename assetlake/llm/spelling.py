"""Spelling variants: words one edit apart, found by dense comparison of blocks of padded code points."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.operators.skew import attach
from assetlake.session import pin

_NEAR = "word string, n_near long, fewer long, best string"
_KEY = ["tile", "longer", "side", "i", "j"]
# Pairs compared at a time, as cells of one column.
_CELLS = 1 << 20


def _near(x: slice, y: slice, left: np.ndarray, right: np.ndarray, short: np.ndarray, tail: bool) -> np.ndarray:
    """Which rows ``x`` are one edit from which rows ``y``; of a tile by tails only those without a common first half."""
    width = left.shape[1]
    shared = []
    for codes, columns in ((left, range(width)), (right, range(width - 1, -1, -1))):
        alive = np.ones((x.stop - x.start, y.stop - y.start), dtype=bool)
        length = np.zeros(alive.shape, dtype=np.uint8 if width < 256 else np.int32)
        for c in columns:
            alive &= codes[x, c, None] == codes[None, y, c]
            if not alive.any():
                break
            length += alive
        shared.append(length)
    prefix, suffix = shared
    near = (prefix < width // 2) == tail
    # Sums of two such lengths may not fit; what the suffix lacks does.
    near &= suffix >= width - 1 - np.minimum(prefix, width - 1)
    # Not equal words, nor two of the lesser length, which have a tile of their own.
    near &= prefix < width
    return near & ~(short[x, None] & short[None, y])


def _compared(words: list[str], n: np.ndarray, own: np.ndarray, width: int, tail: bool, two: bool) -> Iterator[tuple]:
    """For each word of a tile: near words, and of them the most frequent, ties to the first in code-point order."""
    order = sorted(range(len(words)), key=lambda k: (own[k], -n[k], words[k]))
    words, n, own = [words[k] for k in order], n[order], own[order]
    sizes = np.array([len(w) for w in words])
    codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width) + np.uint32(1)
    codes[np.arange(width) >= sizes[:, None]] = 0
    codes = codes.astype(np.uint16) if codes.max() < 1 << 16 else codes
    short = sizes < width
    right = codes.copy()
    right[short, 1:], right[short, 0] = codes[short, :-1], 0
    half = int(np.searchsorted(own, own[-1])) if two else 0
    blocks = [(slice(0, half), slice(half, len(words))), (slice(half, len(words)), slice(0, half))] if two else [(slice(0, len(words)),) * 2]
    for x, y in blocks:
        step = max(1, _CELLS // max(1, y.stop - y.start))
        for a in range(x.start, x.stop, step):
            rows = slice(a, min(a + step, x.stop))
            hits = _near(rows, y, codes, right, short, tail)
            many, first = hits.sum(axis=1), hits.argmax(axis=1) + y.start
            for k in np.flatnonzero(many):
                yield words[rows.start + k], int(many[k]), -int(n[first[k]]), words[first[k]]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile follow each other, through as many batches as they need."""
    names, waiting, out = [c.split()[0] for c in _NEAR.split(", ")], [], []

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(waiting)
        waiting.clear()
        if rows.num_rows > 1:
            _, longer, side, i, j = (rows.column(c)[0].as_py() for c in _KEY)
            own = rows.column("own").to_numpy()
            if i == j or own.min() < own.max():
                out.extend(_compared(rows.column("word").to_pylist(), rows.column("n").to_numpy(), own, longer, side == 1, i < j))
        if len(out) > 20_000:
            yield flush()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names)
        out.clear()
        return batch

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _KEY], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(starts, starts[1:]):
            if waiting and tuple(keys[a]) != last:
                yield from done()
            waiting.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if waiting:
        yield from done()
    if out:
        yield flush()


def near_words(words: DataFrame, total: int, tile_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """``word, n_near, best, best_n`` for the words that have near ones; ``words`` has distinct ``word`` and ``n``.

    Two words, the longer of ``m`` code points, are one edit apart if their common prefix and suffix together reach
    ``m - 1``; so one of the two has ``m // 2`` code points or more. Each word stands by its head and by its tail of that
    length, for itself as the longer and as the shorter. A hash gathers heads (or tails) into tiles of
    about ``tile_rows``, and inside a tile all words of a length and the length below are compared densely. A tile of more
    than ``block_rows`` such words is cut into blocks by a hash of the word and its pairs of blocks are dealt
    apart. A pair is counted at its head if it can be, else at its tail: once. Tiles give one row per word, not per pair.
    """
    size = F.length("word")

    def places(side: int, affix) -> list[Column]:
        return [F.struct((size + d).alias("longer"), F.lit(side).alias("side"), affix(F.floor((size + d) / 2).cast("int")).alias("affix")) for d in (0, 1)]

    every = F.array(*places(0, lambda k: F.substring("word", F.lit(1), k)), *places(1, lambda k: F.substring("word", size - k + 1, k)))
    tiles = max(1, ceil(4 * total / tile_rows))
    placed = words.select("word", "n", F.explode(every).alias("at")).select(
        "word", "n", "at.longer", "at.side", F.pmod(F.xxhash64("at.longer", "at.side", "at.affix"), F.lit(tiles)).cast("int").alias("tile"))
    group = ["tile", "longer", "side"]
    wide = placed.groupBy(*group).count().filter(F.col("count") > block_rows).select(*group, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    cut = placed.join(wide, group, "left").withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "word", "n", "own", *group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(4 * total / 50_000))
    found = dealt.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_tiles, _NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("fewer", "best")).alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.fewer")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last form, by steps that double. Forms must not lead in a circle."""
    now = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        far = attach(now, now.select(F.col("word").alias("root"), F.col("root").alias("next")), ["root"], "left")
        moved = pin(far.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        now = moved.drop("on")
        if not moved.filter("on").head(1):
            return now


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word with the frequent word that it is likely a misspelling of.

    ``words`` has a word and its number ``n`` of occurrences per row. Near are two words that differ by one inserted, deleted
    or replaced code point. The ``form`` of a word is its near word of largest ``n`` (ties: smallest in code-point order) if that has
    ``times`` its own ``n`` or more (``times`` above 1, so that forms lead to no circle); ``root`` is the last of its forms, or the word.
    Rows of one word are added up; null words and counts are left out. The empty word is a word. Other columns are ignored;
    an empty table gives no rows.
    """
    if times <= 1:
        raise ValueError("times must be above 1")
    known = pin(words.filter("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(known, known.count())
    told = pin(known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= times * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n"))).alias("f")))
    led = roots(told.filter("f is not null").select("word", "f.form"))
    return told.join(led, "word", "left").select("word", "f.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "f.form_n")
