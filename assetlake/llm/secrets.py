"""Secret scans with an incremental blob ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators.skew import attach, free_name
from assetlake.session import pin, scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern with a version. Of the matches, leftmost and not overlapping, those whose
    ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed values. Letters are given in both cases, so that no engine folds letters beyond ASCII.
# The keyword and digit rules ask for the least length within the pattern: their runs take all
# they can, so a run that is too short holds no other match. A short assigned value may hold
# another keyword, which must not be found, so there the length is tested after matching.
_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = "(" + _KEYWORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", 1, ASSIGN, 8, 2),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", 1, "[0-9a-f]{32,}", 32),
)

_LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def content_address(text: str) -> Column:
    """SHA-256 of the UTF-8 text; a null text is an empty one."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Start and end (exclusive) of each kept match, in code points.

    The parts between the matches, and the matches, give all positions by their lengths.
    """
    parts = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    pairs = F.arrays_zip(
        parts.alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m)).alias("whole"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m)).alias("part"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + pair["whole"]
        span = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        found = F.when(pair["part"] >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"])
        return F.struct(F.coalesce(end, acc["at"]).cast("bigint").alias("at"), found.alias("found"))

    walked = F.aggregate(pairs, zero, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows ``blob, rule, spans``: one for each blob and rule version not yet in the ledger.

    Also a pair without findings has a row, so that it is not scanned again. What the ledger lacks
    is found from the addresses alone; only texts with something to scan go on, by a broadcast where the
    lacking blobs are few. Copies are one blob: they meet in a partial aggregate before the
    shuffle of the texts, however many they are. Without a ledger everything is unseen.
    """
    blobs = docs.select(content_address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("lacking", names)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        lacking = pin(blobs.select("blob").distinct().join(seen, "blob", "left").select(
            "blob", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("lacking")).filter(F.size("lacking") > 0))
        todo = attach(blobs, lacking, ["blob"]).groupBy("blob").agg(F.first("text").alias("text"), F.first("lacking").alias("lacking"))
    one = lambda r: F.when(
        F.array_contains("lacking", r.name), F.struct(F.lit(r.name).alias("rule"), rule_spans(F.col("text"), r).alias("spans")))
    return todo.select("blob", F.explode(F.array_compact(F.array(*[one(r) for r in rules]))).alias("row")).select("blob", "row.*")


def update_ledger(docs: DataFrame, path: str | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger table at ``path`` has not seen, append it, and return the ledger.

    Without a path a new ledger is begun in the shared folder. A repeated append after a
    failure would only repeat rows, which readers drop.
    """
    spark = docs.sparkSession
    old = None
    if path is None:
        path = scratch_path(spark, "ledger")
    else:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            old = spark.read.schema(_LEDGER).parquet(path)
    scan_unseen(docs, old, rules, text).write.mode("append").parquet(path)
    return spark.read.schema(_LEDGER).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", into: str = "found") -> DataFrame:
    """The rows of ``docs`` with the column ``into``: kind, start and end of all findings by start, then kind.

    Every path that holds a blob gets the blob's findings; the join splits a blob of very many
    paths. Only blobs with findings enter it. Nulls, empty and repeated rows stay rows, found empty.
    A column named ``into`` is replaced; all others stay.
    """
    hit, blob = free_name("__hits", docs), free_name("__blob", docs)
    order = {r.name: i for i, r in enumerate(rules)}
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    hits = (
        ledger.filter(F.col("rule").isin(list(order)) & (F.size("spans") > 0)).groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
        .groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(F.transform(
            "spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("rule")].alias("rank"), s["end"].alias("end")))))).alias(hit)))
    named = F.transform(F.coalesce(hit, F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")), lambda h: F.struct(
        F.element_at(kinds, h["rank"] + 1).alias("kind"), h["start"].alias("start"), h["end"].alias("end")))
    marked = docs.withColumn(blob, content_address(text))
    return attach(marked, hits.withColumnRenamed("blob", blob), [blob], "left").withColumn(into, named).drop(hit, blob)


def joined_spans(found: str) -> Column:
    """``kind:start:end`` of all findings, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, found: str, mark: str = "[removed]") -> Column:
    """The text with every finding replaced; overlapping findings become one mark."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.expr(f"substring(`{text}`, 1)").substr((acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, zero, step, rest)).otherwise(F.col(text))
