"""A worker over the task queue: the queue is an append-only table of events in a shared folder.

Each verb is an appended event; the state of a task is the fold of its events (tasks.replay), so a
worker that dies leaves a claim whose lease runs out, and nothing half written.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tasks

EVENTS = "task_id long, seq long, verb string, node string, error string, max_attempts int, kind string, priority long, created_at double, payload string, lease_until double"


class Queue:
    """Events of tasks in ``path``, one file for each append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: list[dict]) -> None:
        """Events with the next sequence numbers, in order."""
        first = 1 + (self.events().agg(F.max("seq")).first()[0] or 0)
        names = [c.split()[0] for c in EVENTS.split(", ")]
        values = [tuple((row | {"seq": first + i}).get(n) for n in names) for i, row in enumerate(rows)]
        self.spark.createDataFrame(values, EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        from ..sources.annotations import exists

        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(self.path)

    def submit(self, kind: str, payload: str = "", priority: int = 0, max_attempts: int = 1, now: float | None = None) -> int:
        task = 1 + (self.events().agg(F.max("task_id")).first()[0] or 0)
        self.append([{"task_id": task, "verb": "submit", "max_attempts": max_attempts, "kind": kind, "priority": priority, "created_at": time.time() if now is None else now, "payload": payload}])
        return task

    def tasks(self) -> DataFrame:
        """(task_id, status, attempts, owner, error, kind, priority, created_at, payload, lease_until) of every task."""
        events = self.events()
        told = tasks.replay(events.select("task_id", "seq", "verb", "node", "error", "max_attempts"))
        given = events.where("verb = 'submit'").groupBy("task_id").agg(F.max(F.struct("seq", "kind", "priority", "created_at", "payload", "max_attempts")).alias("g"))
        lease = events.where("lease_until is not null").groupBy("task_id").agg(F.max_by("lease_until", "seq").alias("lease_until"))
        out = told.join(given, "task_id").join(lease, "task_id", "left")
        return out.select("task_id", F.col("state").alias("status"), "attempts", "owner", "error", "g.kind", "g.priority", "g.created_at", "g.payload", "g.max_attempts", "lease_until")

    def expire(self, now: float) -> int:
        """Fail events for running tasks whose lease is over, which queue them again while attempts are left."""
        over = self.tasks().where((F.col("status") == "running") & (F.col("lease_until") < now)).select("task_id", "owner").collect()
        if over:
            self.append([{"task_id": r["task_id"], "verb": "fail", "node": r["owner"], "error": "lease expired"} for r in over])
        return len(over)


class Worker:
    """Claims the next task of its kinds, runs its handler, and tells the queue how it went."""

    def __init__(self, queue: Queue, node: str, handlers: dict[str, Callable[[str], str | None]], lease: float = 60.0):
        self.queue, self.node, self.handlers, self.lease = queue, node, handlers, lease

    def step(self, now: float | None = None) -> int | None:
        """One task: its id, or None where nothing is queued. An error of the handler is the task's."""
        now = time.time() if now is None else now
        self.queue.expire(now)
        head = tasks.claimable(self.queue.tasks(), list(self.handlers), 1).collect()
        if not head:
            return None
        task = head[0]
        self.queue.append([{"task_id": task["task_id"], "verb": "claim", "node": self.node, "lease_until": now + self.lease}])
        if self.queue.tasks().where(F.col("task_id") == task["task_id"]).first()["owner"] != self.node:
            return None  # another worker's claim came first
        try:
            self.handlers[task["kind"]](task["payload"])
            done = {"verb": "complete"}
        except Exception:
            done = {"verb": "fail", "error": traceback.format_exc()}
        self.queue.append([{"task_id": task["task_id"], "node": self.node, **done}])
        return task["task_id"]

    def run(self, once: bool = False, poll: float = 2.0) -> int:
        """Works until nothing is queued (``once``: one task at most, no waiting); how many tasks it did."""
        count = 0
        while True:
            done = self.step()
            count += done is not None
            if once:
                return count
            if done is None:
                time.sleep(poll)
