"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.session import pin

WORDS, STARTS, SHAPES, FACTS = 1 << 17, 1 << 16, 1 << 12, 1 << 9
DIMS = WORDS + STARTS + SHAPES + FACTS
_EDGE = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$")
_RUNS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^A-Za-z0-9])\1+"), rb"\1"))


class Features:
    """Sparse features of a text: places and values.

    Words without their outer punctuation, and shapes (runs of capitals, small letters,
    digits and signs), each as the square root of its share of the text, so that
    the length does not matter; the first four letters of words, as present or not, so that a
    rare word counts in a long text too; and facts about the whole text in steps. What a word gives
    is remembered for words met before; a memory of more than ``most_bytes`` starts anew.
    """

    def __init__(self, most_bytes: int = 25_000_000):
        self.most, self.used, self.known = most_bytes, 0, {}

    def _word(self, raw: bytes) -> tuple[int, int, int]:
        shape = raw
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        word = _EDGE.sub(b"", raw).decode(errors="replace").lower()
        start = WORDS + zlib.crc32(word[:4].encode()) % STARTS
        return zlib.crc32(word.encode()) % WORDS, WORDS + STARTS + zlib.crc32(shape) % SHAPES, start

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode()
        count = Counter(raw.split())
        if self.used > self.most:
            self.known, self.used = {}, 0
        known, total = self.known, sum(count.values())
        for word in count:
            if word not in known:
                known[word] = self._word(word)
                self.used += 300 + len(word)
        places = np.array([known[w] for w in count], dtype=np.int64).reshape(-1, 3)
        times = np.fromiter(count.values(), dtype=np.float64, count=len(count))
        place, back = np.unique(places[:, :2].T.reshape(-1), return_inverse=True)
        value = np.sqrt(np.bincount(back, np.concatenate((times, times)), len(place)) / max(total, 1))
        starts, facts = np.unique(places[:, 2]), self._facts(raw, count, total)
        return np.concatenate((place, starts, facts)).astype(np.int32), np.concatenate(
            (value, np.full(len(starts), 0.3), np.full(len(facts), 0.5)))

    @staticmethod
    def _facts(raw: bytes, count: Counter, total: int) -> np.ndarray:
        step = lambda x, n=15: min(int(x * n), n)
        lines = raw.split(b"\n")
        letters = max(len(raw), 1)
        size = min(total.bit_length(), 15)
        facts = (
            size, 16 * min(size, 7) + step(len(count) / max(total, 1)), step(max(count.values(), default=0) / max(total, 1)),
            step((len(raw) - total) / max(total, 1) / 20), step(1 - len(set(lines)) / len(lines)),
            step(sum(map(raw.count, (b"!", b"*", b"#", b"$", b"%", b"&", b"|"))) / letters * 4))
        starts = (0, 16, 144, 160, 176, 192)
        return WORDS + STARTS + SHAPES + np.array([s + f for s, f in zip(starts, facts)])


@dataclass
class Model:
    """Shared weights and rising thresholds: P(grade <= k) = logistic(threshold k - score)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Rising thresholds: all but the first stand as logarithms of their rise."""
    return np.cumsum(np.concatenate((free[:1], np.exp(np.clip(free[1:], -20, 20)))))


def loss_and_slope(p: np.ndarray, cuts: int, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of -log P(grade) over some rows, and its slope in the weights and the last ``cuts`` parameters."""
    weights, free = p[:-cuts], p[-cuts:]
    sizes = np.array([len(i) for i, _ in rows])
    places, values = (np.concatenate(x) for x in zip(*rows))
    owner = np.repeat(np.arange(len(rows)), sizes)
    score = np.bincount(owner, weights[places] * values, len(rows))
    edges = np.concatenate(([-np.inf], _thresholds(free), [np.inf]))
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    up, down = logistic(edges[grades + 1] - score), logistic(edges[grades] - score)
    chance = np.maximum(up - down, 1e-12)
    d_up, d_down = up * (1 - up) / chance, down * (1 - down) / chance
    by_cut = np.zeros(cuts + 2)
    np.add.at(by_cut, grades + 1, -d_up)
    np.add.at(by_cut, grades, d_down)
    # A rise moves every threshold from its own on.
    rises = np.cumsum(by_cut[1:-1][::-1])[::-1] * np.concatenate(([1.0], np.exp(np.clip(free[1:], -20, 20))))
    return float(-np.log(chance).sum()), np.concatenate((np.bincount(places, values * (d_up - d_down)[owner], len(weights)), rises))


def chosen_features(counts: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places to keep and their scale, from how many rows of each grade have each feature.

    A word or word start stays if its frequency differs between the grades on either side of
    some threshold by ``least`` standard errors; shapes and facts stay if they occur. Rare
    features are scaled up, or the penalty would hold them back most.
    """
    share, apart = counts.sum(axis=0) / rows.sum(), np.zeros(counts.shape[1])
    for k in range(1, len(rows)):
        low, high = rows[:k].sum(), rows[k:].sum()
        if low and high:
            error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / low + 1 / high))
            apart = np.maximum(apart, np.abs(counts[:k].sum(axis=0) / low - counts[k:].sum(axis=0) / high) / error)
    apart[WORDS + STARTS:] = np.inf
    kept = np.flatnonzero((apart >= least) & (share > 0))
    return kept, 1 / np.sqrt(share[kept] + 0.005)


def minimise(f, x: np.ndarray, rounds: int, memory: int = 8, close: float = 1e-4) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(rounds):
        way = slope.copy()
        used = []
        for s, y in reversed(steps):
            a = s @ way / (s @ y)
            way -= a * y
            used.append(a)
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used)):
            way += (a - y @ way / (s @ y)) * s
        size = 1.0 if steps else 1 / max(np.linalg.norm(slope), 1e-12)
        while True:
            to = x - size * way
            new, new_slope = f(to)
            if new <= value - 1e-4 * size * (slope @ way) or size < 1e-6:
                break
            size /= 2
        s, y = to - x, new_slope - slope
        steps = [*steps, (s, y)][-memory:] if s @ y > 1e-10 else steps
        done = value - new < close * max(abs(value), 1)
        x, value, slope = to, new, new_slope
        if done:
            break
    return x


def fit(
    graded: DataFrame, grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", sample_rows: int = 20_000, parts: int = 8,
    rounds: int = 60, penalty: float = 1e-4, least: float = 6.0,
) -> Model | None:
    """The model of up to ``sample_rows`` graded rows, chosen by a hash of the key; None without any.

    The features are made once, in ``parts`` tasks. A first pass counts them by grade to choose the
    telling ones; then each round sums the parts' losses and slopes. Rows with a null grade, or
    one outside 0 .. grades-1, are left out; a null text is an empty one.
    """
    usable = graded.filter(F.col(grade).between(0, grades - 1)).select(
        F.coalesce(text, F.lit("")).alias("text"), F.col(grade).cast("int").alias("grade"), F.xxhash64(F.lit(11), key).alias("h"))
    # Whole texts are not moved to choose rows: the limit is on the hashes.
    limit = usable.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if limit is None:
        return None
    schema, names = "places array<int>, parts array<double>, grade int", ["places", "parts", "grade"]
    kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32())

    def packed(made: list, column: pa.Array) -> pa.RecordBatch:
        columns = ([i for i, _ in made], [v for _, v in made])
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), column], names)

    def pairs(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(zip(*([x.values.to_numpy() for x in b.column(c)] for c in (0, 1))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            yield packed([features(t) for t in b.column(0).to_pylist()], b.column(1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((grades, DIMS), dtype=np.int32), np.zeros(grades, dtype=np.int64)
        for b in batches:
            for (places, _), g in zip(pairs(b), b.column(2).to_pylist()):
                counts[g, places] += 1
                rows[g] += 1
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()]), pa.array([rows.tobytes()])], ["counts", "rows"])

    made = pin(usable.filter(F.col("h") <= limit).repartition(parts, "h").sortWithinPartitions("h").select("text", "grade").mapInArrow(make, schema))
    # However many tasks made the features, what reaches the driver is one row for each of few parts.
    made = made.coalesce(parts)
    counted = made.mapInArrow(count, "counts binary, rows binary").collect()
    rows_of = sum(np.frombuffer(r[1], dtype=np.int64) for r in counted)
    kept, scale = chosen_features(sum(np.frombuffer(r[0], dtype=np.int32) for r in counted).reshape(grades, DIMS), rows_of, least)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places, values in pairs(b):
                at = np.minimum(np.searchsorted(kept, places), len(kept) - 1)
                known = kept[at] == places
                out.append((at[known].astype(np.int32), values[known] * scale[at[known]]))
            yield packed(out, b.column(2))

    rows, n, cuts = pin(made.mapInArrow(choose, schema)), int(rows_of.sum()), grades - 1

    def total(p: np.ndarray) -> tuple[float, np.ndarray]:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope = 0.0, np.zeros(len(p))
            for b in batches:
                if b.num_rows:
                    more, by = loss_and_slope(p, cuts, pairs(b), b.column(2).to_numpy())
                    loss, slope = loss + more, slope + by
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()])], ["loss", "slope"])

        got = rows.mapInArrow(some, "loss double, slope binary").collect()  # one row for each part
        weights, slope = p[:-cuts], sum(np.frombuffer(r[1]) for r in got) / n
        slope[:-cuts] += 2 * penalty * weights
        return math.fsum(r[0] for r in got) / n + penalty * weights @ weights, slope

    start = np.zeros(len(kept) + cuts)
    start[-cuts] = -1.0
    p = minimise(total, start, rounds)
    weights = np.zeros(DIMS)
    weights[kept] = p[:-cuts] * scale
    return Model(weights, _thresholds(p[-cuts:]))


def grade_texts(docs: DataFrame, model: Model | None, text: str = "text", expected: str = "expected_grade", tails: str = "tails") -> DataFrame:
    """The rows with the ``expected`` grade and ``tails``, the probabilities of grade k or more from k = 1.

    Every text is read whole. Without a model both are null. Null and empty texts are graded by
    their few facts. Columns of these two names are replaced; all other columns stay.
    """
    kept = [c for c in docs.columns if c not in (expected, tails)]
    if model is None:
        return docs.select(*kept, F.lit(None).cast("double").alias(expected), F.lit(None).cast("array<double>").alias(tails))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, model = Features(), sent.value
        for some in texts:
            score = np.array([model.weights[i] @ v for i, v in map(features, (t.as_py() for t in some))]).reshape(-1)
            yield pa.array(list(model.tails(score)), pa.list_(pa.float64()))

    # Only texts go to the Python tasks. As a function that Spark may not repeat it is evaluated once.
    told = F.arrow_udf(run, "array<double>").asNondeterministic()
    graded = docs.select(*kept, told(F.col(text)).alias(tails))
    return graded.select(*kept, F.aggregate(tails, F.lit(0.0), lambda a, x: a + x).alias(expected), tails)


def graded_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``grade``: 0 for poor quality, 1 for good but toxic, 2 for good. Of several
    labels of a document the lowest grade counts; labels with nulls do not."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    graded = labels.select(F.col(key), grade.alias("grade")).filter("grade is not null").groupBy(key).agg(F.min("grade").alias("grade"))
    return docs.drop("grade").join(graded, key)


def accepted(least: float = 0.7, tails: str = "tails") -> Column:
    """The condition for a document to stay: its chance of the highest grade. Ungraded ones stay."""
    return F.coalesce(F.element_at(tails, -1) >= least, F.lit(True))
