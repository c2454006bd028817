"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.llm import vectors
from assetlake.llm.common import components
from assetlake.operators.skew import attach
from assetlake.session import pin

BITS, TABLES, WIDTH = 64, 4, 16
BALL = 2  # differing bits that a table bridges: one on either side
RADIUS = TABLES * (BALL + 1) - 1
MET, MOST = 0.98, 32  # the share of pairs at the limit that must meet, and the most codes for that
BLOCK = 2048


def fit_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are the code: principal axes, turned to meet the signs closely.

    Each round takes the signs of the turned sample and then the turn that best carries the sample onto them.
    With fewer dimensions than bits, several such codes with other starting turns are set side by side.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:bits].T
    flat, random, parts = centred @ axes, np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(random.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return mean, np.hstack(parts)[:, :bits]


def partners(x: np.ndarray, least: float, seed: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors, and others at cosine ``least`` from them: to any side, and towards other vectors of the sample."""
    random = np.random.default_rng(seed)
    out = []
    for side in (random.standard_normal(x.shape), x[random.permutation(len(x))] - x):
        side = side - (side * x).sum(axis=1)[:, None] * x
        length = np.linalg.norm(side, axis=1)
        some = length > 1e-9
        out.append((x[some], least * x[some] + np.sqrt(max(1 - least**2, 0)) * side[some] / length[some][:, None]))
    return out


def fit_codes(sample: np.ndarray, least: float, met: float = MET, most: int = MOST) -> list[tuple[np.ndarray, np.ndarray]]:
    """So many rotations that of pairs at cosine ``least`` the share ``met`` lies within the radius in some code.

    Measured on partners drawn for sampled vectors. None at all, if more than ``most`` would be needed.
    """
    x = sample[:4000]
    sides = [(a, b) for a, b in partners(x, least) if len(a)]
    found, seen = [], [np.zeros(len(a), dtype=bool) for a, _ in sides]
    while True:
        mean, turn = fit_rotation(sample if not found else sample[:4000], seed=5 + 101 * len(found))
        found.append((mean, turn))
        for s, (a, b) in zip(seen, sides):
            s |= (((a - mean) @ turn > 0) != ((b - mean) @ turn > 0)).sum(axis=1) <= RADIUS
        share = min((s.mean() for s in seen), default=0.0)
        if share >= met:
            return found
        if len(found) == most or (1 - share) ** (most / len(found)) > 1 - met:
            return []


def codes(classes: DataFrame, fitted: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``number, code, turn`` of unit vectors, a row for each rotation, the code as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = vectors.matrix(batch.column(1))
            for i, (mean, projection) in enumerate(fitted if batch.num_rows else []):
                packed = np.packbits((unit - mean) @ projection > 0, axis=1, bitorder="little").view("<u8").reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(packed), pa.array(np.full(len(packed), i, dtype=np.int32))], ["number", "code", "turn"])

    return classes.select("number", "unit").mapInArrow(run, "number long, code long, turn int")


def all_pairs(classes: DataFrame, least: float) -> DataFrame:
    """``a < b`` of rows whose cosine may reach ``least``, by comparing every block of rows with every other."""
    blocks = -(-classes.count() // BLOCK)
    number, least = F.pmod(F.xxhash64("number"), F.lit(max(blocks, 1))).cast("int"), least - 1e-9
    cells = F.transform(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)), lambda i: F.struct(
        F.least(i, "block").alias("low"), F.greatest(i, "block").alias("high")))
    dealt = classes.select("number", "unit", number.alias("block")).select("number", "unit", "block", F.explode(cells).alias("c")).select(
        "number", "unit", "block", "c.*")

    def group(rows: pa.Table) -> pa.Table:
        low = rows.column("low")[0].as_py()
        high = rows.column("high")[0].as_py()
        block, ids, unit = rows.column("block").to_numpy(), rows.column("number").to_numpy(), vectors.matrix(rows.column("unit"))
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        i, j = np.nonzero(unit[one] @ unit[two].T >= least) if len(one) and len(two) else (one[:0], two[:0])
        a, b = ids[one[i]], ids[two[j]]
        kept = a < b if low == high else a != b
        return pa.table({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("low", "high").applyInArrow(group, "a long, b long")


def _part(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def code_pairs(coded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a < b`` of rows whose codes differ in at most ``radius`` bits, each pair once.

    By the pigeonhole principle such a pair differs by two bits or fewer in one of four parts.
    Every row stands in each part's table under its own value and the values one bit away, so
    two rows two bits apart meet half-way: 17 rows for each part in place of a ball of 137. A pair is taken
    in the first part that it meets in, at the smaller of the two values between them, which both
    rows can tell within the join; so no distinct step follows. Codes of several ``turn`` are compared
    each with its own, and a pair may come once for each.
    """
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(WIDTH)])

    def around(i: int) -> Column:
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("part"), _part(F.col("code"), i).bitwiseXOR(m).alias("value")))

    turn = ["turn"] if "turn" in coded.columns else []
    stored = coded.select(*turn, "number", "code", F.explode(F.concat(*[around(i) for i in range(TABLES)])).alias("k")).select(*turn, "number", "code", "k.*")
    left, right = (stored.select(*turn, "part", "value", F.col("number").alias(n), F.col("code").alias(f"code_{n}")) for n in "ab")
    x = F.col("code_a").bitwiseXOR(F.col("code_b"))
    near = [F.bit_count(_part(x, i)) <= BALL for i in range(TABLES)]
    first, between = F.lit(False), F.lit(None).cast("long")
    for i in reversed(range(TABLES)):
        here = F.col("part") == i
        own, bits = _part(F.col("code_a"), i), _part(x, i)
        rest = bits.bitwiseAND(bits - 1)
        between = F.when(here, F.least(own.bitwiseXOR(bits.bitwiseXOR(rest)), own.bitwiseXOR(rest))).otherwise(between)
        earlier = F.lit(True)
        for j in range(i):
            earlier = earlier & ~near[j]
        first = F.when(here, near[i] & earlier).otherwise(first)
    # Spark takes the tables for as small as the codes that they repeat 68 times.
    return left.join(right.hint("merge"), [*turn, "part", "value"]).filter(
        (F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & first & (F.col("value") == between)).select("a", "b")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, sample_rows: int = 20_000) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row; links are pairs with cosine ``least`` or more.

    The rotation is learned on up to ``sample_rows`` vectors; all vectors are coded. Equal vectors are one class, linked
    and counted by its size, so copies are never paired. Pairs of codes within the radius are verified by
    cosine on the original vectors in double precision. The radius is 11 of 64 bits. How many codes, each by a rotation of its own, are
    needed for pairs exactly at ``least`` is measured on partners drawn for the sample: 98 % must meet, and
    closer pairs differ in fewer bits. Where no bounded number is enough, as with a low ``least``, all pairs are compared.

    A vector that is null, zero, of an uncommon length, or that holds nulls or numbers that are not finite
    links with nothing: no links, its own component, kept. A row without key has no component and is not
    kept. Repeated keys are rows of their own. Labels and other columns are ignored.
    """
    good = vectors.usable(table, key, vector)
    same = lambda v: F.concat_ws("-", F.hex(F.xxhash64(v)), F.hex(F.xxhash64(F.lit(1), v)))
    good = good.withColumn("same", same("vector"))
    norm = F.sqrt(vectors.dot("vector", "vector"))
    classes = pin(good.groupBy("same").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("n"))).select(
        F.monotonically_increasing_id().alias("number"), "*", norm.alias("norm")).withColumn(
        "unit", F.transform("vector", lambda x: x.cast("double") / F.col("norm")))
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(good.schema["vector"].dataType).alias("vector"))
    plain = rows.select(
        F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    sample = vectors.bounded_sample(classes, "unit", sample_rows)
    if not len(sample):
        return plain
    fitted = fit_codes(sample, least)
    pairs = code_pairs(pin(codes(classes, fitted)).drop(*["turn"] * (len(fitted) == 1))) if fitted else all_pairs(classes, least)
    pairs = pairs.distinct() if len(fitted) > 1 else pairs
    side = lambda n: classes.select(F.col("number").alias(n), F.col("vector").alias(f"v{n}"), F.col("norm").alias(f"norm_{n}"), F.col("n").alias(f"n_{n}"))
    cosine = vectors.dot("va", "vb") / (F.col("norm_a") * F.col("norm_b"))
    links = pin(pairs.join(side("a"), "a").join(side("b"), "b").filter(cosine >= least).select("a", "b", "n_a", "n_b"))
    linked = components(links, "a", "b").withColumnRenamed("node", "number")
    degree = links.select(F.col("a").alias("number"), F.col("n_b").alias("n_links")).unionByName(
        links.select(F.col("b").alias("number"), F.col("n_a").alias("n_links"))).groupBy("number").agg(F.sum("n_links").alias("others"))
    ids = classes.select("number", "same", "least", "n").join(degree, "number", "left").join(linked, "number", "left").withColumn(
        "component", F.coalesce("component", "number"))
    lowest = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = attach(ids, lowest, ["component"]).select(
        "same", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    # Unusable rows have no class: they keep what the plain result says.
    keyed = rows.withColumn("same", F.when(F.col("id").isNotNull() & (F.size("vector") == sample.shape[1]), same("vector")))
    return attach(keyed, labels, ["same"], "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
