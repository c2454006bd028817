"""Ordered logic: latest and last rows, sequences, bursts, growth, retention, hysteresis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.operators.skew import attach, best_per_key, carry_forward, null_safe_join, number_rows, row_blocks, running_total


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return best_per_key(df, keys, order, rest, latest=True).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return best_per_key(df, keys, order, rest).select(*df.columns)


def last_n(df: DataFrame, key: str, order: Sequence[str], n: int = C.HISTORY_LENGTH) -> DataFrame:
    """The last ``n`` rows per key; the order must end in a unique column.

    Up to a limit (``spark.sql.optimizer.windowGroupLimitThreshold``) Spark cuts each map task's
    share of a key before the shuffle. Beyond it the rows are numbered over all tasks.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        return number_rows(df, [F.desc(c) for c in order], [key], "_r").filter(F.col("_r") <= n).drop("_r")
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def last_n_salted(df: DataFrame, key: str, order: Sequence[str], n: int = C.HISTORY_LENGTH, salts: int = 64) -> DataFrame:
    """The last ``n`` rows per key in two steps: of each share of a key, then of what the shares keep.

    No task sees more than its share of a key, and the last step ``salts`` times ``n`` rows of a key at most, whatever the number of
    input tasks. The order must end in a unique column.
    """
    by = [F.desc(c) for c in order]
    share = W.partitionBy(key, "_salt").orderBy(*by)
    kept = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))).withColumn("_r", F.row_number().over(share)).filter(F.col("_r") <= n)
    return kept.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*by))).filter(F.col("_r") <= n).select(*df.columns)


def sequence(df: DataFrame, order: Sequence[str | Column], reset_on: Sequence[str] = (), name: str = "seq") -> DataFrame:
    """Numbers from 1 that restart on date, camera or folder columns, or never."""
    return number_rows(df, order, reset_on, name)


def pair_sequence(files: DataFrame, base: str = "pair_base", path: str = "path", name: str = "seq") -> DataFrame:
    """Numbers over sorted files, one number for all files that share a base."""
    firsts = files.groupBy(base).agg(F.min(path).alias("_first"), F.count("*").alias("_n"))
    numbered = number_rows(firsts, ["_first"], name=name)
    return attach(files, numbered.select(base, "_n", name), [base]).drop("_n")


def flag_conflicts(plan: DataFrame, target: Column, order: Sequence[str | Column], name: str = "conflict") -> DataFrame:
    """True for the second and later row with one target; the first by order stays free."""
    keyed = plan.withColumn("_t", target)
    marks = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    firsts = keyed.groupBy("_t").agg(F.min(marks).alias("_first"), F.count("*").alias("_n"))
    return (
        attach(keyed, firsts.filter("_n > 1"), ["_t"], "left")
        .withColumn(name, F.coalesce(marks != F.col("_first"), F.lit(False)))
        .drop("_t", "_first", "_n")
    )


def bursts(df: DataFrame, taken: str, by: str, gap: int = C.BURST_GAP_SECONDS, least: int = C.BURST_MIN_FILES) -> DataFrame:
    """Rapid shots: files of one ``by`` value whose times follow within ``gap`` seconds.

    Adds ``burst_index`` (numbering bursts of at least ``least`` files per ``by`` value, else
    null) and ``burst_size``. Files are first counted per second; the windows then see one day
    of one ``by`` value, at most 86,400 rows, whatever the number of files.
    """
    timed = df.withColumn("_s", F.unix_seconds(F.col(taken).cast("timestamp")))
    secs = timed.filter("_s is not null").groupBy(by, "_s").agg(F.count("*").alias("_n")).withColumn("_day", F.floor(F.col("_s") / 86400))
    in_day = W.partitionBy(by, "_day").orderBy("_s")
    # A gap inside the day opens a new run; whether the first second does depends on earlier days.
    marked = secs.withColumn("_gap", F.coalesce((F.col("_s") - F.lag("_s").over(in_day) > gap).cast("int"), F.lit(0)))
    days = marked.groupBy(by, "_day").agg(F.min("_s").alias("_from"), F.max("_s").alias("_to"), F.sum("_gap").alias("_gaps"))
    by_day = W.partitionBy(by).orderBy("_day")
    days = days.withColumn("_opens", F.coalesce((F.col("_from") - F.lag("_to").over(by_day) > gap).cast("int"), F.lit(1)))
    runs_before = F.coalesce(F.sum(F.col("_gaps") + F.col("_opens")).over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select(by, "_day", (runs_before + F.col("_opens")).alias("_base"))
    so_far = F.sum("_gap").over(in_day.rowsBetween(W.unboundedPreceding, 0))
    runs = null_safe_join(marked.withColumn("_run", so_far), days, [by, "_day"]).select(
        by, "_s", "_n", "_day", (F.col("_run") + F.col("_base")).alias("_run"))
    sized = runs.groupBy(by, "_run").agg(F.sum("_n").alias("burst_size"), F.min("_s").alias("_from"), F.min("_day").alias("_day"))
    real = running_total(sized.filter(F.col("burst_size") >= least), [by], "_day", ["_from"], F.lit(1), "burst_index")
    found = null_safe_join(runs.select(by, "_s", "_run"), real.select(by, "_run", "burst_index", "burst_size"), [by, "_run"])
    return attach(timed, found.select(by, "_s", "burst_index", "burst_size"), [by, "_s"], "left", null_safe=True).drop("_s")


def month_change(monthly: DataFrame, value: str, month: str = "month") -> DataFrame:
    """Difference and percent change to the month before. One row per month comes in."""
    w = W.partitionBy(F.lit(1)).orderBy(month)
    before = F.lag(value).over(w)
    return monthly.withColumn("change", F.col(value) - before).withColumn(
        "change_pct", F.round(100.0 * (F.col(value) - before) / F.when(before != 0, before), 2))


def growth(monthly: DataFrame, value: str, month: str = "month", name: str = "running") -> DataFrame:
    """Running total over months. One row per month comes in."""
    w = W.partitionBy(F.lit(1)).orderBy(month).rowsBetween(W.unboundedPreceding, W.currentRow)
    return monthly.withColumn(name, F.sum(value).over(w))


def next_sequence(log: DataFrame, day: str) -> DataFrame:
    """Next number per task type after the greatest task id of the day by text order; 1 where
    the last part of that id is not a number. Types without a task that day are absent."""
    last = log.filter(F.col("task_id").like(f"TASK_{day}%")).groupBy("task_type").agg(F.max("task_id").alias("last_id"))
    tail = F.element_at(F.split("last_id", "_"), -1).try_cast("long")
    return last.select("task_type", F.coalesce(tail + 1, F.lit(1).cast("long")).alias("next_seq"))


def keep_backups(backups: DataFrame, key: str, ts: str, keep: Mapping[str, int] = C.RETENTION) -> DataFrame:
    """Backups kept by daily, weekly and monthly retention, with the reasons.

    The latest backup of each day, ISO week and month is a partial aggregate; the ranks then
    run over one row per period.
    """
    cols = backups.columns
    kept = None
    for period, n in keep.items():
        slot = F.date_trunc(period, F.col(ts))
        latest = best_per_key(backups.withColumn("_slot", slot), [key, "_slot"], [ts, *[c for c in cols if c not in (key, ts)]],
                              [c for c in cols if c != key], latest=True)
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_slot")))
        part = latest.withColumn("_r", rank).filter(F.col("_r") <= n).select(*cols, F.lit(period).alias("_period"))
        kept = part if kept is None else kept.unionByName(part)
    return kept.groupBy(*cols).agg(F.array_join(F.sort_array(F.collect_set("_period")), ",").alias("kept_as"))


def signals(readings: DataFrame, pause: float = C.PAUSE_CELSIUS, resume: float = C.RESUME_CELSIUS) -> DataFrame:
    """Readings at or beyond a limit, with the ``event`` that they call for. Those between the limits say nothing."""
    t = F.col("temperature")
    event = F.when(t >= pause, "THERMAL_PAUSE").when(t <= resume, "THERMAL_RESUME")
    return readings.select("drive", "ts", "event_id", "temperature", event.alias("event")).filter("event is not null")


def last_signals(found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``drive, ts, event_id, event``: the last signal of each drive, also of those that only ``before`` has."""
    rows = found.select("drive", "ts", "event_id", "event")
    return latest_per_key(rows if before is None else rows.unionByName(before), ["drive"], ["ts", "event_id"])


def thermal_events(
    readings: DataFrame, pause: float = C.PAUSE_CELSIUS, resume: float = C.RESUME_CELSIUS, before: DataFrame | None = None,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Pause and resume transitions per drive: pause at or above one limit while running,
    resume at or below the other while paused.

    A scan of state transitions: every signal sets the state whatever it was, so a run of readings does to the state
    what its last signal does. Blocks of bounded rows (``row_blocks``) find the state before each of their own signals and pass on one
    row per drive. ``before`` has the state that each drive comes with, as ``last_signals`` returns it; others are running.
    """
    blocks = row_blocks(signals(readings, pause, resume), ["drive"], ["ts", "event_id"], block_rows=block_rows)
    found = carry_forward(blocks, ["drive"], "_block", ["ts", "event_id"], "event", "_prev")
    state = F.coalesce("_prev", F.lit("THERMAL_RESUME"))
    if before is not None:
        found = null_safe_join(found, before.select("drive", F.col("event").alias("_came")), ["drive"], "left")
        state = F.coalesce("_prev", "_came", F.lit("THERMAL_RESUME"))
    limit = F.when(F.col("event") == "THERMAL_PAUSE", F.lit(float(pause))).otherwise(F.lit(float(resume)))
    return found.filter(F.col("event") != state).select(
        "drive", "ts", "event_id", "event", "temperature", limit.alias("threshold"))


def count_alerts(events: DataFrame) -> DataFrame:
    return events.groupBy("drive").agg(
        F.count_if(F.col("event") == "THERMAL_PAUSE").alias("pauses"), F.count_if(F.col("event") == "THERMAL_RESUME").alias("resumes"))
