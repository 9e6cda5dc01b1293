"""A task queue as an append-only event table: states, leases, retries, listings, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: verb -> (states it applies to, state after it). Fixed values of the state machine.
TRANSITIONS = {
    "claim": (("queued",), "running"),
    "complete": (("running",), "succeeded"),
    "pause": (("queued",), "paused"),
    "resume": (("paused",), "queued"),
    "cancel": (("queued", "running", "paused"), "cancelled"),
    "retry": (("failed", "cancelled"), "queued"),
}
ERROR_CHARS = 8000


def next_state(state: Column, verb: Column, attempts: Column, most: Column) -> Column:
    """The state after a verb; a failure requeues while attempts are left; else unchanged."""
    out = F.when((verb == "fail") & (state == "running"), F.when(attempts < most, "queued").otherwise("failed"))
    for name, (before, after) in TRANSITIONS.items():
        out = out.when((verb == name) & state.isin(*before), F.lit(after))
    return out.otherwise(state)


def replay(events: DataFrame) -> DataFrame:
    """(task_id, state, attempts, owner, error) from (task_id, seq, verb, node, error, max_attempts).

    A task's events are folded in order by built-in functions. Verbs that do not apply are passed
    over; complete and fail count only from the node that holds the lease.
    """
    event = F.struct("seq", "verb", "node", F.expr(f"right(error, {ERROR_CHARS})").alias("error"), "max_attempts")
    start = F.struct(F.lit("new").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("most"))

    def step(s: Column, e: Column) -> Column:
        lawful = ~e["verb"].isin("complete", "fail") | s["owner"].eqNullSafe(e["node"])
        state = F.when(e["verb"] == "submit", "queued").when(lawful, next_state(s["state"], e["verb"], s["attempts"], s["most"])).otherwise(s["state"])
        claimed = (e["verb"] == "claim") & (s["state"] == "queued")
        return F.struct(
            state.alias("state"),
            F.when(claimed, s["attempts"] + 1).when(e["verb"] == "retry", 0).otherwise(s["attempts"]).alias("attempts"),
            F.when(claimed, e["node"]).when(state == "running", s["owner"]).alias("owner"),
            F.when((e["verb"] == "fail") & lawful, e["error"]).otherwise(s["error"]).alias("error"),
            F.coalesce(F.when(e["verb"] == "submit", e["max_attempts"]), s["most"]).alias("most"),
        )

    folded = events.groupBy("task_id").agg(F.sort_array(F.collect_list(event)).alias("e")).withColumn("s", F.aggregate("e", start, step))
    return folded.select("task_id", "s.state", "s.attempts", "s.owner", "s.error")


def claimable(tasks: DataFrame, kinds: list[str], n: int = 1) -> DataFrame:
    """The next n queued tasks: highest priority, then oldest, then by id; a distributed top-k."""
    return tasks.where((F.col("status") == "queued") & F.col("kind").isin(*kinds)).orderBy(F.desc("priority"), "created_at", "task_id").limit(n)


def claim(tasks: DataFrame, chosen: DataFrame, node: str, now: float, lease: float) -> DataFrame:
    """``tasks`` with the chosen ones running on a node, their attempts one up and leased."""
    mine = chosen.select("task_id", F.lit(True).alias("__mine"))
    hit = F.coalesce(F.col("__mine"), F.lit(False)) & (F.col("status") == "queued")
    out = tasks.join(mine, "task_id", "left")
    return out.withColumns({"owner": F.when(hit, node).otherwise(F.col("owner")), "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")), "lease_until": F.when(hit, now + lease).otherwise(F.col("lease_until")), "status": F.when(hit, "running").otherwise(F.col("status"))}).drop("__mine")


def heartbeat(tasks: DataFrame, beats: DataFrame, now: float, lease: float) -> DataFrame:
    """Leases moved on for (task_id, node) that hold them."""
    out = tasks.join(beats.select("task_id", F.col("node").alias("__node")).distinct(), "task_id", "left")
    held = (F.col("status") == "running") & (F.col("owner") == F.col("__node"))
    return out.withColumn("lease_until", F.when(held, now + lease).otherwise(F.col("lease_until"))).drop("__node")


def expire(tasks: DataFrame, now: float) -> DataFrame:
    """Running tasks whose lease is over: queued again while attempts are left, else failed."""
    over = (F.col("status") == "running") & (F.col("lease_until") < now)
    return tasks.withColumns({"status": F.when(over, F.when(F.col("attempts") < F.col("max_attempts"), "queued").otherwise("failed")).otherwise(F.col("status")), "owner": F.when(~over, F.col("owner")), "lease_until": F.when(~over, F.col("lease_until"))})


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: upserts and replacements by last write."""
    whole = F.struct(F.col(order), F.struct(*[F.col(c) for c in rows.columns]).alias("r"))
    return rows.groupBy(*keys).agg(F.max(whole).alias("l")).select("l.r.*")


def listing(tasks: DataFrame, status: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """Newest first, filtered where asked."""
    for name, value in (("status", status), ("kind", kind)):
        if value is not None:
            tasks = tasks.where(F.col(name) == value)
    return tasks.orderBy(F.desc("created_at"), F.desc("task_id")).limit(limit)


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The last n events of every task."""
    w = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    return events.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def state_counts(tasks: DataFrame) -> DataFrame:
    """(what, value, n) of statuses and kinds in one pass."""
    return tasks.select(F.explode(F.array(F.struct(F.lit("status").alias("what"), F.col("status").alias("value")), F.struct(F.lit("kind").alias("what"), F.col("kind").alias("value")))).alias("c")).groupBy("c.what", "c.value").agg(F.count("*").alias("n"))


def chained(done: DataFrame, follows: dict[str, str]) -> DataFrame:
    """Child tasks of those that succeeded: (parent_id, kind, payload), such as analyze after download."""
    table = F.create_map(*[x for k, v in follows.items() for x in (F.lit(k), F.lit(v))])
    child = F.element_at(table, F.col("kind"))
    return done.where((F.col("status") == "succeeded") & child.isNotNull()).select(F.col("task_id").alias("parent_id"), child.alias("kind"), "payload", F.lit("queued").alias("status"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of the same key, sorted by key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(key)


def changed_content(old: DataFrame, new: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Keys that are there already with other content; a copy must not replace these."""
    return old.select(key, F.col(digest).alias("old")).join(new.select(key, F.col(digest).alias("new")), key).where("old <> new")
