"""Streaming forms: arrival completeness, incremental evaluation, counters, patience, pooling.

State is keyed as finely as the data allows. Repeated arrivals are removed per (arm, fold, case), and
what is kept per fold is a handful of counters, so a fold with a third of all cases needs no more
state in one place than a small one. Late rows within the watermark still count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def expected_counts(expected: DataFrame) -> DataFrame:
    """Number of expected cases per fold and arm: (fold, arm, want)."""
    return expected.select("arm", "fold", "case_id").distinct().groupBy("fold", "arm").agg(F.count(F.lit(1)).alias("want"))


def arrival_status(arrivals: DataFrame, expected: DataFrame, delay: str = "7 days") -> DataFrame:
    """What has arrived of every fold and arm, out of a stream of arrivals (arm, fold, case_id, kind, arrived).

    Kinds are ``case``, ``marker`` and ``marker_removed``. Repeated cases count once. Of the markers the
    latest counts (a removal, if both came at one time), so a marker that is set again holds again.
    """
    known = expected.select("arm", "fold", "case_id").distinct().withColumn("known", F.lit(True))
    timed = arrivals.withWatermark("arrived", delay)
    cases = timed.filter("kind = 'case'").dropDuplicatesWithinWatermark(["arm", "fold", "case_id"])
    flagged = cases.unionByName(timed.filter("kind <> 'case'")).join(known, ["arm", "fold", "case_id"], "left")
    case, removed = F.col("kind") == "case", F.col("kind") == "marker_removed"
    return flagged.groupBy("fold", "arm").agg(
        F.count(F.when(case & F.col("known"), 1)).alias("have"),
        F.count(F.when(case & F.col("known").isNull(), 1)).alias("unexpected"),
        F.max_by(F.when(~case, ~removed), F.when(~case, F.struct("arrived", removed.alias("r")))).alias("marked"),
    )


def ready_folds(status: DataFrame, counts: DataFrame) -> DataFrame:
    """(fold, ready): every expected arm has its marker and exactly the expected cases, and no arm has others.

    ``status`` is the newest row per fold and arm; a fold of which nothing arrived is not ready.
    """
    both = counts.join(status, ["fold", "arm"], "full")
    odd = F.coalesce("unexpected", F.lit(0)) > 0
    ok = F.when(F.col("want").isNull(), ~odd).otherwise(F.coalesce((F.col("have") == F.col("want")) & F.col("marked"), F.lit(False)) & ~odd)
    return both.groupBy("fold").agg((F.bool_and(ok) & (F.count("want") > 0)).alias("ready"))


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write every micro-batch under ``path/batch=<id>``; a replayed batch overwrites only itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def latest(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of a table written by :func:`append_batches`."""
    rest = [c for c in written.columns if c not in keys and c != "batch"]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*keys, "m.*")


def incremental_evaluation(
    detections: DataFrame, gts: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Match every case that a micro-batch touches from all of its rows so far and store its events.

    Arrivals are kept below ``path/arrived``, events below ``path/events``. A case may come in several
    batches: each of them matches it anew, and :func:`newest_cases` reads the last result of every
    case as a whole. A replayed batch overwrites only itself.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/arrived/batch={batch_id}")
        touched = batch.select("case_id").distinct()
        so_far = spark.read.parquet(f"{path}/arrived").filter(F.col("batch") <= batch_id)
        rows = latest(so_far.join(touched, "case_id", "left_semi"), ["case_id", "det_id"]).select(*batch.columns)
        match(rows, gts.join(touched, "case_id", "left_semi")).write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")

    return detections.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def newest_cases(written: DataFrame) -> DataFrame:
    """The events of every case as its last batch left them."""
    last = written.groupBy("case_id").agg(F.max("batch").alias("batch"))
    return written.join(last, ["case_id", "batch"]).drop("batch")


def running_counters(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Counts per outcome, updated as rows arrive."""
    return append_batches(stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), path, checkpoint, "update")


PATIENCE_OUT = "run bigint, step bigint, best double, idle_steps bigint, fired boolean"
PATIENCE_STATE = "best double, idle bigint, step bigint, fired boolean"


def patience_stream(metrics: DataFrame, wait: int) -> DataFrame:
    """Stop signal per run out of a stream (run, step, value): best so far, idle steps, fired.

    Non-finite values are skipped; a value must be larger to count as an improvement; a fired run
    stays fired. A run's rows of one micro-batch are put in order of step as a whole, however they were
    cut for transfer. The state of a run is four numbers and survives restarts through the checkpoint.
    """

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState):
        best, idle, last, fired = state.get if state.exists else (float("-inf"), 0, -1, False)
        rows = pd.concat(list(batches)).sort_values("step", kind="stable")
        last = max(last, int(rows["step"].max()))
        values = rows["value"].to_numpy(dtype=float)
        values = values[np.isfinite(values)]
        if len(values) and not fired:
            before = np.maximum.accumulate(np.concatenate([[best], values[:-1]]))
            at = np.arange(len(values))
            better = np.maximum.accumulate(np.where(values > before, at, -1))
            waits = np.where(better < 0, idle + at + 1, at - better)
            over = np.flatnonzero(waits >= wait)
            end = over[0] if len(over) else len(values) - 1
            best, idle, fired = float(max(before[end], values[end])), int(waits[end]), bool(len(over))
        state.update((best, idle, last, fired))
        yield pd.DataFrame({"run": [key[0]], "step": [last], "best": [best], "idle_steps": [idle], "fired": [fired]})

    return metrics.groupBy("run").applyInPandasWithState(advance, PATIENCE_OUT, PATIENCE_STATE, "update", GroupStateTimeout.NoTimeout)


def pool_when_done(status: DataFrame, expected: DataFrame, pool: Callable[[], DataFrame], path: str) -> bool:
    """Write the pooled result once every fold of ``expected`` is ready; do nothing if it is there already.

    Meant for ``foreachBatch`` on the status table. The write refuses to overwrite, so of two
    callers one wins.
    """
    wanted = expected.select("fold").distinct()
    if not wanted.join(status.filter("ready").select("fold"), "fold", "left_anti").isEmpty():
        return False
    from pyspark.errors import AnalysisException

    try:
        pool().write.mode("errorifexists").parquet(path)
    except AnalysisException as exc:
        if "already exists" in str(exc).lower() or "PATH_ALREADY_EXISTS" in str(exc):
            return False
        raise
    return True


def status_changes(written: DataFrame) -> DataFrame:
    """Rows where the readiness of a fold differs from the batch before."""
    w = Window.partitionBy("fold").orderBy("batch")
    before = F.lag("ready").over(w)
    return written.withColumn("_p", before).filter(F.col("_p").isNull() | (F.col("_p") != F.col("ready"))).drop("_p")
