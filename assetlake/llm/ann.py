"""Nearest neighbours by inverted lists with an adaptive dimension scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from assetlake.llm import vectors
from assetlake.session import pin

BLOCK = 16


class Index:
    """Centroids of the lists, the rotation, and the lists to probe.

    Largest inner product becomes least distance: a vector gets one more component so that all have the
    length of the longest, a query gets zero there. ``probes`` is the least number of lists that
    finds ``recall`` of the sample's own neighbours.
    """

    def __init__(self, sample: np.ndarray, longest: float, rows: int, k: int, recall: float, list_rows: int, seed: int = 3):
        random = np.random.default_rng(seed)
        self.longest = longest
        points = self.lengthened(sample)
        n = min(max(rows // list_rows, 1), 4096, max(len(points) // 8, 1))
        centres = points[random.choice(len(points), n, replace=False)]
        for _ in range(12):
            near = self._nearest(points, centres, 1)[:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            size = np.bincount(near, minlength=n)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        self.centres = centres
        self.turn = np.linalg.qr(random.standard_normal((points.shape[1], points.shape[1])))[0].astype(np.float32)
        self.probes = self._probes(sample, points, k, recall)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, more[:, None]])

    @staticmethod
    def asked(q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))])

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
        d = (centres * centres).sum(axis=1) - 2 * x @ centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(axis=1)[:, None]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.lengthened(x), self.centres, 1)[:, 0]

    def probed(self, q: np.ndarray) -> np.ndarray:
        return self._nearest(self.asked(q), self.centres, max(self.probes, 2))[:, : self.probes]

    def _probes(self, sample: np.ndarray, points: np.ndarray, k: int, recall: float) -> int:
        own, tried = self._nearest(points, self.centres, 1)[:, 0], sample[:: max(len(sample) // 300, 1)]
        order = self._nearest(self.asked(tried), self.centres, max(len(self.centres), 2))
        place = np.argsort(order, axis=1)
        scores = tried @ sample.T
        k = min(k + 1, len(sample))
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        at = np.sort(np.take_along_axis(place, own[best], axis=1).reshape(-1))
        return int(at[min(int(np.ceil(recall * len(at))), len(at) - 1)]) + 1


def scan(query_ids, queries, limits, ids, found, index: Index, k: int, error: float) -> list[tuple]:
    """The ``k`` best of one block of a list for each of its queries: ``query, id, score``.

    The rotated vectors stand in blocks of columns. After each block the distance so far, scaled to
    all dimensions, estimates the whole one; a candidate is abandoned when the estimate passes the
    query's limit by more than the error that so many random dimensions allow. Blocks are computed for
    all pairs while most survive, then for the survivors alone. What is left is scored exactly.
    """
    out: list[tuple] = []
    turned = (index.lengthened(found) @ index.turn).astype(np.float32)
    asked = (index.asked(queries) @ index.turn).astype(np.float32)
    # A limit is a score; in distances with the lengthened vectors.
    limit = (queries * queries).sum(axis=1) + index.longest**2 - 2 * limits
    slack = 1e-4 * index.longest**2
    dims, some = turned.shape[1], max(1, 2_000_000 // len(ids))
    blocks = [slice(at, min(at + BLOCK, dims)) for at in range(0, dims, BLOCK)]
    for at in range(0, len(queries), some):
        q, lim = asked[at: at + some], limit[at: at + some]
        part = np.zeros((len(q), len(ids)), dtype=np.float32)
        alive, pairs = query_ids[at: at + some, None] != ids[None, :], None
        for b in blocks:
            if pairs is None:
                x, y = q[:, b], turned[:, b]
                part += (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
            else:
                gap = q[pairs[0], b] - turned[pairs[1], b]
                far += np.einsum("ij,ij->i", gap, gap)
            bound = lim * (b.stop / dims) * ((1 + error / np.sqrt(b.stop)) ** 2 if b.stop < dims else 1) + slack
            if pairs is None:
                alive &= part <= bound[:, None]
                if alive.mean() < 0.3 or b.stop == dims:
                    pairs = np.nonzero(alive)
                    far = part[pairs]
            else:
                left = far <= bound[pairs[0]]
                pairs, far = (pairs[0][left], pairs[1][left]), far[left]
        qi, ci = pairs
        score = np.einsum("ij,ij->i", queries[at + qi], found[ci])
        order = np.lexsort((ids[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        first = np.concatenate(([True], qi[1:] != qi[:-1])) if len(qi) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.append(starts, len(qi))))
        top = rank < k
        out.append((query_ids[at + qi[top]], ids[ci[top]], score[top]))
    return out


def search(
    table: DataFrame, ask, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample_rows: int = 20_000, recall: float = 0.985,
    error: float = 2.1, list_rows: int = 400, block_rows: int = 4096,
) -> DataFrame:
    """``query_id, rank, key, score``: for each row that ``ask`` (a condition on ``id``) picks, its ``k`` largest
    inner products among all other rows, nearest first, ties to the smaller key.

    Centroids, and the number of lists to probe, come from up to ``sample_rows`` vectors; every vector
    is put in its list. A query's nearest list is scanned first and gives the limit against which all
    its other lists abandon. A list, and the queries that ask it, are cut into blocks of about
    ``block_rows``, so that neither a hot list nor a much-asked one is a task of its own; each
    pair of blocks is one group. Scores are inner products of the original vectors in double precision.

    Vectors that are null, zero, of an uncommon length, or not finite take no part, nor do rows without key. A repeated
    key is one query, with its least vector, and as many candidates as rows, except to itself. Fewer than
    ``k`` candidates are all returned. Other columns are ignored.
    """
    spark = table.sparkSession
    good = pin(vectors.usable(table, key, vector).withColumn("vector", F.col("vector").cast("array<double>")))
    schema = f"query_id long, rank int, {key} long, score double"
    stats = good.agg(F.count("*").alias("n"), F.max(vectors.dot("vector", "vector")).alias("longest")).first()
    if stats["n"] < 2:
        return spark.createDataFrame([], schema)
    index = Index(vectors.bounded_sample(good, "vector", sample_rows), float(np.sqrt(stats["longest"])), stats["n"], k, recall, list_rows)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = index.lists(vectors.matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], ["list", "id", "vector"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = index.probed(vectors.matrix(b.column(1))) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([vectors.lists(at.astype(np.int32), pa.int32()), *b.columns], ["lists", "id", "vector"])

    placed = pin(good.select("id", "vector").mapInArrow(listed, "list int, id long, vector array<double>"))
    queries = pin(good.filter(ask(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector")).mapInArrow(
        asking, "lists array<int>, id long, vector array<double>"))

    def found(asked: DataFrame) -> DataFrame:
        """The best of each block for ``list, id, vector, limit``."""
        # One row per list, of which there are at most 4,096.
        counts = placed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).join(
            asked.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("askers")), "list")
        counts = F.broadcast(counts)
        number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = placed.join(counts, "list").select("list", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), number("askers").alias("asker"), "id", "vector")
        two = asked.join(counts, "list").select(
            "list", number("blocks").alias("block"), F.pmod(F.xxhash64("id"), "askers").cast("int").alias("asker"), "id", "vector", "limit")
        names = ["list", "block", "asker"]

        def group(left: pa.Table, right: pa.Table) -> pa.Table:
            got = []
            if left.num_rows and right.num_rows:
                arrays = [t.column(n).to_numpy() for t, n in ((right, "id"), (right, "limit"), (left, "id"))]
                got = scan(arrays[0], vectors.matrix(right.column("vector")), arrays[1], arrays[2], vectors.matrix(left.column("vector")), index, k, error)
            columns = [np.concatenate(c) if got else np.zeros(0) for c in (zip(*got) if got else [[]] * 3)]
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

        return one.groupBy(names).cogroup(two.groupBy(names)).applyInArrow(group, "query_id long, id long, score double")

    def best(rows: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = pin(best(found(queries.select(F.element_at("lists", 1).alias("list"), "id", "vector", F.lit(float("-inf")).alias("limit")))))
    limits = first.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("limit")).withColumnRenamed("query_id", "id")
    others = queries.join(limits, "id", "left").select(
        F.explode(F.slice("lists", 2, max(len(index.centres), 1))).alias("list"), "id", "vector", F.coalesce("limit", F.lit(float("-inf"))).alias("limit"))
    return best(first.select("query_id", "id", "score").unionByName(found(others))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
