"""Mixing sources to target weights: fixed blocks, drawn counts per shard, permuted indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from assetlake.llm.common import WORD, prefix_sums, shuffled, words_in
from assetlake.operators.skew import null_safe_join
from assetlake.session import pin

CHUNK = 8192
TASK_BLOCKS = 2_000_000


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: float) -> DataFrame:
    """``source, source_size, width, blocks, weight, target, quota, first`` from one row per source.

    Weights repeat over the sources in code point order, null last. The targets share ``share``
    times all sizes by weight; a target stops at ``limit`` times its source, and what it leaves
    goes to the others by weight. With the sources in order of size over weight those that stop
    come first, so running sums find them in one pass. ``quota`` is the target in blocks.
    """
    # Windows over one row per source.
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(ranked) - 1) % len(weights) + 1)
    everything = W.partitionBy()
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    tail = filling.rowsBetween(0, W.unboundedFollowing)
    rows = (
        sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share))
                    - F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(tail)))
    stopped = F.col("cap") * F.col("rest") <= F.col("left") * F.col("weight")
    level = F.max(F.when(~stopped, F.struct(F.col("rest").alias("rest"), F.col("left").alias("left")))).over(everything)
    quota = F.when(F.col("source_size") > 0, F.least(
        F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), (F.col("blocks") * F.lit(float(limit))).cast("long")))
    return (
        rows.withColumn("_level", level)
        .withColumn("target", F.when(stopped, F.col("cap")).otherwise(F.col("weight") * F.col("_level.left") / F.col("_level.rest")))
        .withColumn("quota", F.coalesce(quota, F.lit(0)))
        .withColumn("first", F.coalesce(F.sum("quota").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("source", "source_size", "width", "blocks", "weight", "target", "quota", "first"))


def draw_blocks(targets: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """``source, shard, block, epoch``: the blocks of every output shard.

    Every source holds as many tickets as its quota, all tickets are dealt to output places
    by one pseudorandom permutation, and a shard is a run of places. A shard's source counts are
    so a multinomial draw by target, conditioned on the totals: the sum over the shards is each
    quota exactly. Counted slots run on through a source from shard to shard; slot ``s`` is block
    ``s mod blocks`` under the permutation of its epoch ``s div blocks``, so that no block
    comes again before all have come.
    """
    every = targets.agg(F.sum("quota")).first()[0] or 0
    # A short row stands for very many: the number of tasks follows the blocks, not the bytes of such rows.
    tasks = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every // TASK_BLOCKS))
    chunks = targets.filter("quota > 0").select(
        "source", "blocks", "quota", "first", F.explode(F.expr(f"sequence(0L, (quota - 1) div {CHUNK})")).alias("chunk")
    ).repartition(tasks, "source", "chunk")
    ticket = F.explode(F.expr(f"sequence(chunk * {CHUNK}, least((chunk + 1) * {CHUNK}, quota) - 1)"))
    place = shuffled(F.col("first") + F.col("ticket"), F.lit(max(every, 1)), F.lit(seed), inverse=True)
    counts = (
        chunks.withColumn("ticket", ticket).select("source", "blocks", place.alias("place"))
        .withColumn("shard", F.floor(F.col("place") / shard_blocks)).groupBy("source", "blocks", "shard").agg(F.count("*").alias("drawn")))
    slots = prefix_sums(counts, ["shard"], "drawn", by=["source"]).repartition(tasks, "source", "shard").select(
        "source", "blocks", "shard", F.explode(F.expr("sequence(before, before + drawn - 1)")).alias("slot"))
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    block = shuffled(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "source", epoch))
    return slots.select("source", "shard", block.alias("block"), epoch.alias("epoch"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block_words: int = 128,
    shard_blocks: int = 65_536, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The targets per source, the drawn blocks, and the documents' pieces with their draws.

    A source's documents, in order of key, form one line of words, cut into blocks of
    ``block_words``, or of a hundredth of a source that is smaller than a hundred of these, so that a target is met
    within about a hundredth. Pieces: ``row, source, key, size, source_size, target, block, words, start,
    draws``, where ``start`` counts the words of the document before the piece. A document
    without words has one piece without a block. Null sources are one source; null and repeated
    keys are kept. A hot source only has more blocks: every shuffle is by block, ticket or shard.
    """
    # Pinned, so that the texts are read once and not also to sample the order.
    rows = pin(docs.select(
        F.col(source).alias("source"), F.col(key).alias("key"), words_in(text).alias("size"), F.xxhash64(text).alias("hash")))
    lined = pin(prefix_sums(rows, ["key", "hash", "size"], "size", by=["source"]))
    width = F.least(F.lit(block_words), F.greatest(F.expr("source_size div 100"), F.lit(1))).cast("long")
    sizes = lined.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("width", width).withColumn(
        "blocks", F.ceil(F.col("source_size") / F.col("width")))
    targets = pin(source_targets(sizes, weights, share, limit))
    drawn = draw_blocks(targets, shard_blocks, seed)
    # Spark takes what is drawn for as small as the table of sources, and would broadcast it.
    times = drawn.groupBy("source", "block").agg(F.count("*").alias("draws")).hint("merge")
    span = F.expr("if(size > 0, sequence(before div width, (before + size - 1) div width), null)")
    start = F.greatest(F.col("block") * F.col("width") - F.col("before"), F.lit(0))
    end = F.least((F.col("block") + 1) * F.col("width") - F.col("before"), F.col("size"))
    # One row per source, but their number has no bound: Spark decides how to join.
    placed = null_safe_join(lined, targets.select("source", "source_size", "target", "width"), ["source"])
    pieces = placed.withColumn("block", F.explode_outer(span)).withColumn("start", start).withColumn("words", end - F.col("start"))
    pieces = null_safe_join(pieces, times, ["source", "block"], "left").drop("width")
    return targets, drawn, pieces.withColumn("draws", F.coalesce("draws", F.lit(0)))


def taken_words(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, size, source_size, target, taken`` per document, repeats counted."""
    return pieces.groupBy("source", "row", "key", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("words") * F.col("draws")), F.lit(0)).alias("taken")
    ).select(F.col("key").alias(key), "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as rows of ``docs``: a document once for each of its times in the mix, with the
    words drawn so often, their own white space between them.

    Rows equal in source, key and text are drawn each on its own; one of them lends its other
    columns to all. A document without words, or with none drawn, is not in the mix.
    """
    same = lambda s, k, h: F.md5(F.to_json(F.struct(s.alias("s"), k.alias("k"), h.alias("h"))))
    _, _, pieces = mix(docs, key=key, text=text, source=source, **how)
    copies = (
        pieces.filter("draws > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, draws)")))
        .groupBy("source", "key", "hash", "row", "size", "__copy")
        .agg(F.sum("words").alias("__words"), F.sort_array(F.collect_list(F.struct("start", "words"))).alias("__ranges"))
        .groupBy(same(F.col("source"), F.col("key"), F.col("hash")).alias("__id"), F.col("size").alias("__size"))
        .agg(F.collect_list(F.struct("__words", "__ranges")).alias("__takes")))
    # The columns of docs stand aside in a struct, so that no name of theirs meets one of these.
    one = docs.select(
        same(F.col(source), F.col(key), F.xxhash64(text)).alias("__id"), F.col(text).alias("__text"), F.struct(*docs.columns).alias("__row")).dropDuplicates(["__id"])
    parts = F.regexp_extract_all("__text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__take.__ranges", lambda r: F.slice(F.col("__parts"), (r["start"] + 1).cast("int"), r["words"].cast("int")))), "")
    taken = (
        one.join(copies, "__id").withColumn("__parts", F.when(F.exists("__takes", lambda t: t["__words"] < F.col("__size")), parts))
        .withColumn("__take", F.explode("__takes")).withColumn("__text", F.when(F.col("__take.__words") == F.col("__size"), F.col("__text")).otherwise(cut)))
    changed = {text: F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return taken.select(*[changed.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])
