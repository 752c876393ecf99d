"""Job backlog, job state and outage analytics over call logs."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.operators.statistics import n_rows
from fieldloom.plans.order import global_rank, sorted_blocks

# Urgency of a job type; a dependent extract job ranks lower.
PRIORITY = {"crawl": 100, "extract": 50, "validate": 45, "normalize": 30, "translate": 20, "generate": 10}
DEPENDENT_EXTRACT = 40


def job_priority(job_type: Column, dependent: Column) -> Column:
    out = F.when((job_type == "extract") & dependent, DEPENDENT_EXTRACT)
    for name, value in PRIORITY.items():
        out = out.when(job_type == name, value)
    return out


def backlog_rank(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending jobs in working order, and jobs of unknown type as error rows."""
    rows = jobs.where("status = 'pending'").withColumn("priority", job_priority(F.col("job_type"), F.coalesce("dependent", F.lit(False))))
    known = global_rank(rows.where("priority IS NOT NULL"), [F.desc("priority"), F.asc("scheduled_at"), F.asc("job_id")])
    unknown = rows.where("priority IS NULL").select("job_id", "job_type", F.concat(F.lit("no priority for job type "), "job_type").alias("error"))
    return known, unknown


def queue_status(jobs: DataFrame) -> DataFrame:
    """(section, name, n): size of the queue, pending per type, jobs per state."""
    pending = jobs.where("status = 'pending'")
    return (
        pending.agg(n_rows()).select(F.lit("queue").alias("section"), F.lit("size").alias("name"), "n")
        .unionByName(pending.groupBy(F.col("job_type").alias("name")).agg(n_rows()).select(F.lit("pending").alias("section"), "name", "n"))
        .unionByName(jobs.groupBy(F.col("status").alias("name")).agg(n_rows()).select(F.lit("state").alias("section"), "name", "n"))
    )


def queue_sample(jobs: DataFrame, n: int = 10) -> DataFrame:
    rows = jobs.where("status = 'pending'").withColumn("priority", job_priority(F.col("job_type"), F.coalesce("dependent", F.lit(False))))
    return rows.where("priority IS NOT NULL").orderBy(F.desc("priority"), "scheduled_at", "job_id").limit(n)


def job_state(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Latest state of each job from its event log, in any arrival order.

    ``events``: event_id, job_id, ts, status, error.  Only order-free aggregates are used,
    so a busy job is combined in every task and the same code folds a stream.
    """
    when = lambda s: F.max(F.when(F.col("status") == s, F.col("ts")))
    order = F.struct("ts", "event_id")
    folded = events.groupBy("job_id").agg(
        F.max_by("status", order).alias("_last"),
        F.count_if(F.col("status") == "failed").alias("attempts"),
        when("running").alias("started_at"), when("completed").alias("completed_at"), when("failed").alias("_failed"),
        F.max_by("error", F.when(F.col("status") == "failed", order)).alias("last_error"))
    spent = F.col("attempts") >= max_attempts
    status = F.when((F.col("_last") == "failed") & ~spent, "pending").otherwise(F.col("_last"))
    return folded.select("job_id", status.alias("status"), "attempts", "started_at", "completed_at", F.when(spent, F.col("_failed")).alias("failed_at"), "last_error")


# --- outage episodes ---------------------------------------------------------
#
# A service opens at the n-th failure in a row, refuses calls until the timeout has
# passed, and lets the next call probe: success closes, failure reopens.  A service
# may hold most of the log, so its calls are cut into blocks.  Each block is reduced
# to what it does to every possible incoming state; following one state through these
# small summaries gives each block its true incoming state, and blocks then run alone.
#
# A state is (kind, a, b): (0, failures, 0) closed; (1, opened, episode start) open.
# Inside a summary b = -1 stands for the start of the episode that came in.

_CLOSED, _OPEN = 0, 1


class _Block:
    def __init__(self, ts: np.ndarray, ok: np.ndarray, threshold: int, timeout: int):
        self.ts, self.ok, self.threshold, self.timeout = ts, ok, threshold, timeout
        self.n = len(ts)
        good = np.flatnonzero(ok)
        at = np.searchsorted(good, np.arange(self.n + 1))
        self.next_ok = np.append(good, self.n)[at]

    def probe_after(self, opened: int) -> int:
        return int(np.searchsorted(self.ts, opened + self.timeout, side="right"))

    def opening(self, start: int, failures: int) -> tuple[int | None, int]:
        """(index that opens, -1) or (None, index after the next success; -1 at the end)."""
        last = start + self.threshold - failures - 1
        if self.next_ok[start] > last:
            return last, -1
        return None, int(self.next_ok[start]) + 1 if self.next_ok[start] < self.n else -1

    def summary(self):
        """End states for 0..threshold-1 failures, and (last ts, end state) runs of probes."""
        closed = [None] * (self.n + 2)
        probe = [None] * (self.n + 1)
        closed[self.n] = (_CLOSED, 0, 0)

        def from_open(opened: int, start: int):
            p = self.probe_after(opened)
            end = (_OPEN, opened, -1) if p >= self.n else probe[p]
            return (end[0], end[1], start) if end[0] == _OPEN and end[2] == -1 else end

        def from_closed(i: int, failures: int):
            opens, later = self.opening(i, failures)
            if opens is not None and opens < self.n:
                return from_open(int(self.ts[opens]), int(self.ts[opens]))
            return closed[later] if later >= 0 else (_CLOSED, failures + self.n - i, 0)

        for i in range(self.n - 1, -1, -1):
            probe[i] = closed[i + 1] if self.ok[i] else from_open(int(self.ts[i]), -1)
            closed[i] = from_closed(i, 0)
        runs: list[tuple[int, tuple]] = []
        for i in range(self.n):
            if runs and runs[-1][1] == probe[i]:
                runs[-1] = (int(self.ts[i]), probe[i])
            else:
                runs.append((int(self.ts[i]), probe[i]))
        return [from_closed(0, f) for f in range(self.threshold)], runs

    def walk(self, state):
        """Episode parts of the block: start, closed_at, failed probes, refused calls."""
        parts, i = [], 0
        kind, a, b = state
        failures, opened, start = (a, 0, 0) if kind == _CLOSED else (0, a, b)
        while True:
            if kind == _CLOSED:
                opens, later = self.opening(i, failures)
                if opens is None or opens >= self.n:
                    if later < 0 or later > self.n:
                        return parts
                    i, failures = later, 0
                    if i >= self.n:
                        return parts
                    continue
                kind, opened, start, i = _OPEN, int(self.ts[opens]), int(self.ts[opens]), opens + 1
                parts.append([start, None, 0, 0])
            elif not parts or parts[-1][0] != start:
                parts.append([start, None, 0, 0])
            p = max(i, self.probe_after(opened))
            parts[-1][3] += min(p, self.n) - i
            if p >= self.n:
                return parts
            i = p + 1
            if self.ok[p]:
                parts[-1][1] = int(self.ts[p])
                kind, failures = _CLOSED, 0
                if i >= self.n:
                    return parts
            else:
                parts[-1][2] += 1
                opened = int(self.ts[p])


def outage_episodes(calls: DataFrame, threshold: int = 10, timeout_seconds: int = 300, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Episodes per service, and the state each service ends in.

    ``calls``: event_id, service_id, ts_us (long), success.  ``start``: service_id, kind, a, b of
    an earlier run.  Episodes: service_id, opened_us, closed_us (NULL while open),
    failed_probes, refused_calls.
    """
    timeout = timeout_seconds * 1_000_000
    key_type = calls.schema["service_id"].dataType.simpleString()
    placed = sorted_blocks(calls.select("service_id", "ts_us", "event_id", "success"), [F.col("service_id"), F.col("ts_us"), F.col("event_id")])

    def block_of(pdf: pd.DataFrame) -> _Block:
        pdf = pdf.sort_values("_pos")
        return _Block(pdf["ts_us"].to_numpy(), pdf["success"].to_numpy(dtype=bool), threshold, timeout)

    def summarize(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ends, runs = block_of(pdf).summary()
        return pd.DataFrame({
            "service_id": [keys[0]], "_block": [keys[1]], "ends": [[list(e) for e in ends]],
            "run_ts": [[r[0] for r in runs]], "run_end": [[list(r[1]) for r in runs]]})

    summaries = placed.groupBy("service_id", "_block").applyInPandas(
        summarize, f"service_id {key_type}, _block int, ends array<array<bigint>>, run_ts array<bigint>, run_end array<array<bigint>>")
    if start is None:
        summaries = summaries.withColumn("_start", F.lit(None).cast("array<bigint>"))
    else:
        summaries = summaries.join(start.select("service_id", F.array(F.col("kind").cast("long"), "a", "b").alias("_start")), "service_id", "left")

    def follow(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pdf = pdf.sort_values("_block")
        first = pdf["_start"].iloc[0]
        state = tuple(int(x) for x in first) if first is not None and len(first) else (_CLOSED, 0, 0)
        for block, ends, run_ts, run_end in zip(pdf["_block"], pdf["ends"], pdf["run_ts"], pdf["run_end"]):
            before = state
            if state[0] == _CLOSED:
                state = tuple(int(x) for x in ends[state[1]])
            else:
                at = bisect.bisect_right(list(run_ts), state[1] + timeout)
                if at < len(run_ts):
                    end = tuple(int(x) for x in run_end[at])
                    state = (end[0], end[1], state[2]) if end[0] == _OPEN and end[2] == -1 else end
            rows.append((keys[0], block, *before, *state))
        return pd.DataFrame(rows, columns=["service_id", "_block", "kind", "a", "b", "kind_out", "a_out", "b_out"])

    states = summaries.groupBy("service_id").applyInPandas(
        follow, f"service_id {key_type}, _block int, kind int, a long, b long, kind_out int, a_out long, b_out long")

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        parts = block_of(pdf).walk((int(head["kind"]), int(head["a"]), int(head["b"])))
        out = pd.DataFrame(parts, columns=["opened_us", "closed_us", "failed_probes", "refused_calls"])
        out["closed_us"] = out["closed_us"].astype("Int64")
        return out.assign(service_id=keys[0])

    parts = placed.join(states.select("service_id", "_block", "kind", "a", "b"), ["service_id", "_block"]).groupBy("service_id", "_block").applyInPandas(
        run, f"opened_us long, closed_us long, failed_probes long, refused_calls long, service_id {key_type}")
    episodes = parts.groupBy("service_id", "opened_us").agg(
        F.max("closed_us").alias("closed_us"), F.sum("failed_probes").alias("failed_probes"), F.sum("refused_calls").alias("refused_calls"))
    final = states.groupBy("service_id").agg(F.max_by(F.struct("kind_out", "a_out", "b_out"), "_block").alias("s"))
    return episodes, final.select("service_id", F.col("s.kind_out").alias("kind"), F.col("s.a_out").alias("a"), F.col("s.b_out").alias("b"))
