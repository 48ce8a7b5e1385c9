"""Append-only case journals, replayed in batch or as a stream.

A journal row is (case_id, seq, status, identity): the planned cases are known before the first row,
each case ends once (completed or failed) and keeps the identity it was planned with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.skew import range_lag
from ..session import scratch_path

TERMINAL = ("completed", "failed")


# --- batch ------------------------------------------------------------------------------------


def replay(planned: DataFrame, journal: DataFrame) -> DataFrame:
    """State per planned case (pending, completed, failed) and what its journal did wrong.

    All counts are mergeable aggregates: a case that collects a third of the journal is folded
    before it is shuffled.
    """
    terminal = F.col("status").isin(*TERMINAL)
    folded = journal.groupBy("case_id").agg(
        F.min_by(F.struct("status", "identity"), F.when(terminal, F.col("seq"))).alias("_end"),
        F.count_if(terminal).alias("_n_terminal"),
        F.count_if(~terminal).alias("n_nonterminal"),
        F.min("identity").alias("_least"),
        F.max("identity").alias("_greatest"),
    )
    return planned.select("case_id", F.col("identity").alias("_planned")).join(folded, "case_id", "left").select(
        "case_id",
        F.when(F.coalesce("_n_terminal", F.lit(0)) == 0, "pending").otherwise(F.col("_end.status")).alias("state"),
        F.greatest(F.coalesce("_n_terminal", F.lit(0)) - 1, F.lit(0).cast("long")).alias("n_repeated"),
        F.coalesce("n_nonterminal", F.lit(0)).alias("n_nonterminal"),
        F.coalesce((F.col("_least") != F.col("_planned")) | (F.col("_greatest") != F.col("_planned")), F.lit(False)).alias("rewritten"),
    )


def unknown_cases(planned: DataFrame, journal: DataFrame) -> DataFrame:
    return journal.join(planned.select("case_id"), "case_id", "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))


def snapshot(states: DataFrame, by: str) -> DataFrame:
    """Counts per run and its status: incomplete while cases are pending, failed on any failure."""
    counts = states.groupBy(by).agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("pending", *TERMINAL)]
    )
    return counts.withColumn(
        "run_status",
        F.when(F.col("n_pending") > 0, "incomplete").when(F.col("n_failed") > 0, "failed").otherwise("completed"),
    )


def interrupted_runs(starts: DataFrame, finals: DataFrame, key: str) -> DataFrame:
    """Runs that were started and never finished."""
    return starts.select(key).distinct().join(finals, key, "left_anti")


def changes(df: DataFrame, key: str, order: str, fingerprint: Column, slices: int = 256) -> DataFrame:
    """Rows whose fingerprint (`token`) differs from that of the row before them in the same series."""
    marked = range_lag(df.withColumn("token", fingerprint), [key], order, "token", "_before", slices)
    return marked.filter(~F.col("token").eqNullSafe(F.col("_before"))).drop("_before")


# --- streams ----------------------------------------------------------------------------------


def _drain(stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Run a stream over everything that is available into a table, and read the table."""
    spark = stream.sparkSession
    target, mark = scratch_path(spark, label), scratch_path(spark, label + "-log")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    return spark.read.schema(schema).parquet(target)


def _latest(log: DataFrame, key: str) -> DataFrame:
    """The last update of every key in the log of a stream that ran in update mode."""
    columns = [c for c in log.columns if c not in (key, "_batch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("s")).select(key, "s.*")


def stream_replay(planned: DataFrame, journal: DataFrame) -> DataFrame:
    """`replay` over a journal stream, with every violation: one row per planned or journalled case.

    Columns: case_id, state, n_repeated (ends after the first), n_nonterminal, rewritten, unexpected (a case that
    nobody planned). The plan is a static side of the stream. The state of a case is an aggregate that merges
    inside each task first, so a case with a third of the events sends a few rows; a micro-batch touches the
    state of its own cases only, and late or repeated files cannot change which event ended a case.
    """
    terminal = F.col("status").isin(*TERMINAL)
    plan = planned.select("case_id", F.col("identity").alias("_planned"), F.lit(True).alias("_known"))
    end = F.when(terminal, F.col("seq"))
    updates = journal.join(plan, "case_id", "left").groupBy("case_id").agg(
        F.min_by("status", end).alias("_end"),
        F.count_if(terminal).alias("_n_terminal"),
        F.count_if(~terminal).alias("n_nonterminal"),
        F.max(F.coalesce((F.col("identity") != F.col("_planned")), F.lit(False))).alias("rewritten"),
        F.max(F.col("_known").isNull()).alias("unexpected"),
    ).select(
        "case_id",
        F.when(F.col("_n_terminal") > 0, F.col("_end")).otherwise("pending").alias("state"),
        F.greatest(F.col("_n_terminal") - 1, F.lit(0).cast("long")).alias("n_repeated"),
        "n_nonterminal",
        "rewritten",
        "unexpected",
    )
    seen = _latest(_drain(updates, "replay", "update"), "case_id")
    silent = planned.select("case_id").join(seen, "case_id", "left_anti")
    none, no = F.lit(0).cast("long"), F.lit(False)
    return seen.unionByName(silent.select("case_id", F.lit("pending").alias("state"), none.alias("n_repeated"), none.alias("n_nonterminal"), no.alias("rewritten"), no.alias("unexpected")))


def stream_snapshot(journal: DataFrame, by: list[str]) -> DataFrame:
    """Running counts per key in complete mode; the last snapshot replaces the earlier ones."""
    log = _drain(journal.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events")), "snapshot", "complete")
    return log.join(log.agg(F.max("_batch").alias("_batch")), "_batch").drop("_batch")


def stream_interrupted(events: DataFrame, key: str, time: str, is_final: Column, gap: str) -> DataFrame:
    """One row per run without a final record: (`key`, started_at, last_at, n_events, timed_out).

    A run is all events of its key: a final record after any pause ends it, and a run that is still open when
    the stream has been read is reported as well. `timed_out` says whether the stream's clock (the latest event
    of all) has reached `gap` after the run's last event. The state is one mergeable row per run.
    """
    runs = events.withColumn("_final", is_final).groupBy(key).agg(
        F.min(time).alias("started_at"), F.max(time).alias("last_at"), F.count(F.lit(1)).alias("n_events"), F.max("_final").alias("_final")
    )
    log = _drain(runs, "interrupted", "update")
    clock = log.agg(F.max("last_at").alias("_clock"))  # one row
    open_runs = _latest(log, key).filter("not _final").crossJoin(F.broadcast(clock))
    silent = F.col("last_at") + F.expr(f"INTERVAL {gap}") <= F.col("_clock")
    return open_runs.select(key, "started_at", "last_at", "n_events", silent.alias("timed_out"))


def stream_silent_sessions(events: DataFrame, key: str, time: str, is_final: Column, gap: str) -> DataFrame:
    """One row per session without a final record that timed out: (`key`, started_at, timed_out_at, n_events).

    A session ends with a pause of `gap`; a key has as many as it has such pauses. The watermark closes a session
    once the stream has moved past it, and only then is it reported and its state dropped.
    """
    sessions = (
        events.withColumn("_final", is_final)
        .withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, gap)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count_if("_final").alias("n_final"), F.count(F.lit(1)).alias("n_events"))
        .filter("n_final = 0")
        .select(
            key,
            F.col("w.start").cast("timestamp_ntz").alias("started_at"),
            F.col("w.end").cast("timestamp_ntz").alias("timed_out_at"),
            "n_events",
        )
    )
    return _drain(sessions, "sessions", "append").drop("_batch")


_CHANGE = StructType([StructField("key", StringType()), StructField("seq", LongType()), StructField("token", StringType())])
_LAST = StructType([StructField("seq", LongType()), StructField("token", StringType())])


def stream_changes(events: DataFrame, key: str, order: str, fingerprint: Column) -> DataFrame:
    """(key, seq, token) for events whose token differs from the last one of the key.

    The last (seq, token) of a key is keyed state of the stream: a micro-batch reads and writes the state of
    its own keys only, whatever the number of silent ones. Events of one micro-batch are ordered by seq; an
    event that arrives after a later one of its key is compared with the newest token known by then. A task
    holds the events of one key and micro-batch, two narrow columns each.
    """
    marked = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("seq"), fingerprint.alias("token"))

    def compare(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        before = rows["token"].shift()
        last = state.getOption
        if last is not None:
            before.iloc[0] = last[1]
        same = (rows["token"] == before) | (rows["token"].isna() & before.isna())
        if last is None:
            same.iloc[0] = False
        newest = rows.iloc[-1]
        if last is None or newest["seq"] >= last[0]:
            state.update((int(newest["seq"]), newest["token"]))
        yield rows.loc[~same, ["key", "seq", "token"]]

    found = marked.groupBy("key").applyInPandasWithState(compare, _CHANGE, _LAST, "append", "NoTimeout")
    return _drain(found, "changes", "append").drop("_batch")
