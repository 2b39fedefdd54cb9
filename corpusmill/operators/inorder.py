"""Requests of one batch, judged as if they came one by one (M1, M2).

Whether a request creates, deduplicates, replaces or fails depends on what the
earlier ones of its scope did to two things: the active memories of its own
fingerprint and the memory it wants to replace. Requests are judged in rounds;
each round settles, with a few joins over narrow rows, every request whose
answer no open earlier request can change any more:

- it is a duplicate if a memory of its fingerprint is active that no open
  earlier request names as its target;
- it makes a memory if none is active and no open earlier request of its
  fingerprint might make one, and its target, if any, is active and named by no
  open earlier request;
- it fails if its target is gone or was never there.

A thousand equal requests, or a thousand for one target, are settled together in
the round after their first. The number of rounds is the longest chain of
requests that truly wait for each other; the earliest open request of a scope
can always be settled, so rounds come to an end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import written

JUDGED = ["request_id", "scope_id", "fingerprint", "target", "new_id", "action", "memory_id", "reason"]


def _with_killers(alive: DataFrame, open_: DataFrame) -> DataFrame:
    """``alive`` with ``killer``: the earliest open request that names the memory after it was made."""
    named = open_.filter(F.col("target").isNotNull()).select("scope_id", F.col("target").alias("memory_id"), F.col("request_id").alias("_by"))
    first = (
        alive.join(named, ["scope_id", "memory_id"])
        .filter(F.col("born").isNull() | (F.col("born") < F.col("_by")))
        .groupBy("scope_id", "memory_id").agg(F.min("_by").alias("killer"))
    )
    return alive.join(first, ["scope_id", "memory_id"], "left")


def _round(open_: DataFrame, alive: DataFrame, statuses: DataFrame) -> DataFrame:
    """``open_`` with action (null: still open), memory_id and reason."""
    r = F.col("request_id")
    known = written(_with_killers(alive, open_), "alive")
    there = (F.col("born").isNull() | (F.col("born") < r)) & (F.col("died").isNull() | (F.col("died") > r))
    certain = F.col("died").isNotNull() | F.col("killer").isNull() | (F.col("killer") >= r)
    mine = (
        open_.select("scope_id", "fingerprint", "request_id")
        .join(known.filter("fingerprint IS NOT NULL"), ["scope_id", "fingerprint"])
        .filter(there)
        .groupBy("scope_id", "request_id")
        .agg(F.bool_and(certain).alias("_sure"), F.min("memory_id").alias("_active"))
    )
    state = known.select("scope_id", F.col("memory_id").alias("target"), "born", "died", "killer")
    pending = open_.select("scope_id", F.col("new_id").alias("target"), F.col("request_id").alias("_maker"))
    seen = (
        open_.join(mine, ["scope_id", "request_id"], "left")
        .join(state, ["scope_id", "target"], "left")
        .join(pending, ["scope_id", "target"], "left")
        .join(statuses, ["scope_id", "target"], "left")
    )
    lives = F.coalesce((F.col("_state") == 1) & there, F.lit(False))
    seen = seen.withColumn("_state", F.when(F.col("born").isNotNull() | F.col("died").isNotNull() | (F.col("_status") == "active"), 1))
    seen = seen.withColumn("_lives", lives).withColumn("_pending", F.coalesce(F.col("_maker") < r, F.lit(False)))
    seen = seen.withColumn("_maker_of", F.col("target").isNull() | F.col("_lives") | F.col("_pending"))
    first = seen.filter("_maker_of").groupBy("scope_id", "fingerprint").agg(F.min("request_id").alias("_first"))
    seen = seen.join(first, ["scope_id", "fingerprint"], "left")
    turn = F.col("_active").isNull() & (F.col("_first").isNull() | (F.col("_first") >= r))
    gone = turn & ~F.col("_maker_of")
    exists = F.col("_status").isNotNull() | F.col("died").isNotNull() | (F.coalesce(F.col("born") < r, F.lit(False)))
    action = (
        F.when(F.col("_active").isNotNull() & F.col("_sure"), "deduplicated")
        .when(turn & F.col("target").isNull(), "created")
        .when(turn & F.col("_lives") & (F.col("killer") == r), "replaced")
        .when(gone, "rejected")
    )
    reason = F.when(gone, F.when(exists, "superseded_memory_not_active").otherwise("superseded_memory_not_found"))
    made = F.when(F.col("action").isin("created", "replaced"), F.col("new_id"))
    return seen.withColumns({"action": action, "reason": reason}).withColumn(
        "memory_id", F.when(F.col("action") == "deduplicated", F.col("_active")).otherwise(made)
    ).select(*JUDGED)


def play(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each request: action, memory_id, reason, and what it was judged by.

    ``requests``: request_id, scope_id, fingerprint, target, new_id, in the order
    of request_id within a scope. ``memories``: the table before the batch. Of
    several active memories of one fingerprint the least id stands for all.
    """
    open_ = written(requests.select("request_id", "scope_id", "fingerprint", "target", "new_id"), "requests")
    when = open_.schema["request_id"].dataType
    prints = open_.select("scope_id", "fingerprint").distinct()
    targets = open_.filter(F.col("target").isNotNull()).select("scope_id", "target").distinct()
    narrow = memories.select("scope_id", "memory_id", "fingerprint", "status")
    statuses = written(narrow.join(targets.withColumnRenamed("target", "memory_id"), ["scope_id", "memory_id"], "left_semi").select(
        "scope_id", F.col("memory_id").alias("target"), F.col("status").alias("_status")), "statuses")
    active = narrow.filter(F.col("status") == "active").drop("status")
    same = active.join(prints, ["scope_id", "fingerprint"], "left_semi").select("scope_id", "memory_id", "fingerprint")
    wanted = active.join(targets.withColumnRenamed("target", "memory_id"), ["scope_id", "memory_id"], "left_semi").select("scope_id", "memory_id", "fingerprint")
    none = F.lit(None).cast(when)
    alive = written(same.unionByName(wanted).distinct().withColumns({"born": none, "died": none}), "alive")
    done = None
    while True:
        judged = written(_round(open_, alive, statuses), "judged")
        settled = judged.filter(F.col("action").isNotNull())
        done = settled if done is None else done.unionByName(settled)
        open_ = judged.filter(F.col("action").isNull()).select("request_id", "scope_id", "fingerprint", "target", "new_id")
        if open_.isEmpty():
            return done
        made = settled.filter(F.col("action").isin("created", "replaced")).select(
            "scope_id", F.col("new_id").alias("memory_id"), "fingerprint", F.col("request_id").alias("born"), none.alias("died")
        )
        ended = settled.filter(F.col("action") == "replaced").select("scope_id", F.col("target").alias("memory_id"), F.col("request_id").alias("_end"))
        alive = alive.join(ended, ["scope_id", "memory_id"], "left").withColumn("died", F.coalesce("died", "_end")).drop("_end")
        alive = written(alive.unionByName(made), "alive")
