"""Job states: the latest state of each job in batch, and the same as a stateful stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("completed", "failed")


def latest_state(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest status of each job, how many events it had, and whether it is at its end."""
    newest = F.max_by("status", F.struct(*order))
    return events.groupBy(job).agg(newest.alias("status"), F.count(F.lit(1)).alias("n_events"), newest.isin(*TERMINAL).alias("terminal"))


def stream_states(events: DataFrame) -> DataFrame:
    """Stream (job_id, seq, status) to (job_id, status, seq): queued -> processing -> completed or failed; an end is final,
    a cancel fails a job that has not ended; older events than the last seen change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seq = state.get if state.exists else ("queued", -1)
        for pdf in batches:
            for s, new in sorted(zip(pdf["seq"], pdf["status"], strict=True)):
                if s > seq and status not in TERMINAL:
                    status, seq = ("failed" if new == "cancelled" else new), int(s)
        state.update((status, seq))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "seq": [seq]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, seq long", "status string, seq long", "update", GroupStateTimeout.NoTimeout)


# How long a job's record is kept after its last write, and the longest wait between two callbacks.
KEPT_DAYS, LONGEST_WAIT = 7, 8


def lifecycle(events: DataFrame) -> DataFrame:
    """One row per job: (job_id, status, error_code, conflicts, ignored, expires, callback).

    events: (job_id, seq, status, ts). The first end is final; a cancel before it fails the job. Events after the end change
    nothing; a cancel after completion is a conflict. Each write before puts the expiry off; an end calls back, whatever comes
    of the call. A job seen only as queued or processing is still so. Only counts and least values leave a partition.
    """
    ends = F.col("status").isin(*TERMINAL, "cancelled")
    end = events.where(ends).groupBy("job_id").agg(F.min(F.struct("seq", "status")).alias("end"))
    rows = events.join(end, "job_id", "left")
    late = F.coalesce(F.col("seq") > F.col("end.seq"), F.lit(False))
    got = rows.groupBy("job_id").agg(
        F.first("end").alias("end"), F.max_by(F.when(~late, F.col("status")), F.when(~late, F.col("seq"))).alias("now"),
        F.count_if(late & (F.col("status") == "cancelled") & (F.col("end.status") == "completed")).alias("conflicts"), F.count_if(late).alias("ignored"),
        F.max(F.when(~late, F.col("ts"))).alias("last"),
    )
    s = F.col("end.status")
    status = F.when(s == "cancelled", "failed").when(s.isNotNull(), s).otherwise(F.col("now"))
    return got.select("job_id", status.alias("status"), F.when(s == "cancelled", "CANCELLED").when(s == "failed", "FAILED").alias("error_code"), "conflicts", "ignored", (F.col("last") + F.expr(f"INTERVAL {KEPT_DAYS} DAYS")).alias("expires"), s.isNotNull().alias("callback"))


def callback(first_success: Column, most: int = 3) -> Column:
    """struct(attempts, delivered, waited): how a callback goes of which attempt first_success (or none) is the first to go through."""
    n = F.least(F.coalesce(first_success, F.lit(1 << 30)), F.lit(max(1, most)))
    wait = F.when(n > 1, F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda a, k: a + F.least(F.pow(F.lit(2), k - 1).cast("int"), F.lit(LONGEST_WAIT)))).otherwise(0)
    return F.struct(n.alias("attempts"), F.coalesce(first_success <= n, F.lit(False)).alias("delivered"), wait.alias("waited"))


def deliver(rows: DataFrame, send: Callable[[dict, dict], None], token: str = "", most: int = 3, wait: Callable[[float], None] = time.sleep) -> list[tuple]:
    """Sends terminal records of one micro-batch, (job_id, delivered, error) each; for foreachBatch. At least once: a batch that
    is run again sends again, so receivers go by job_id. A failed call never fails the job."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    out = []
    for row in rows.toLocalIterator():  # one record at a time
        error = None
        for k in range(1, max(1, most) + 1):
            try:
                send(row.asDict(recursive=True), headers)
                error = None
                break
            except Exception as e:  # noqa: BLE001  a receiver may fail in any way
                error = f"{type(e).__name__}: {e}"
                if k < most:
                    wait(min(2 ** (k - 1), LONGEST_WAIT))
        out.append((row["job_id"], error is None, error))
    return out
