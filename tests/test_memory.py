import pytest
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions.text import fingerprint
from corpusmill.operators import memory as M
from corpusmill.sources.store import conform

NOW = "2024-02-01 00:00:00"


@pytest.fixture()
def table(spark):
    rows = spark.createDataFrame(
        [("m1", "a", "decision", "use tabs", "active"), ("m2", "a", "bug", "leak", "forgotten"),
         ("m3", "b", "decision", "use tabs", "active")],
        "memory_id string, scope_id string, type string, content string, status string",
    )
    fp = fingerprint(F.col("scope_id"), F.col("type"), F.col("content"))
    return conform(rows.withColumn("fingerprint", fp), schemas.MEMORIES, confidence=F.lit(0.8))


def _requests(spark, rows):
    return spark.createDataFrame(
        rows, "request_id int, scope_id string, type string, content string, supersedes_memory_id string"
    )


def test_remember_dedup_supersede_and_reject(spark, table):
    requests = _requests(spark, [
        (1, "a", "decision", " use tabs\n", None),      # equal to m1
        (2, "a", "decision", "use spaces", "m1"),        # replaces m1
        (3, "a", "decision", "use spaces", None),        # equal to request 2
        (4, "a", "decision", "other", "m1"),             # m1 is taken by request 2
        (5, "a", "decision", "more", "m2"),              # m2 is not active
        (6, "a", "decision", "again", "m3"),             # m3 belongs to scope b
        (7, "b", "decision", "new", None),
    ])
    change = M.remember(table, requests, NOW)
    actions = {r.request_id: r.action for r in change.outcomes.collect()}
    assert actions == {1: "deduplicated", 2: "replaced", 3: "deduplicated", 7: "created"}
    reasons = {r.request_id: r.reason for r in change.rejects.collect()}
    assert reasons == {4: "superseded_memory_not_active", 5: "superseded_memory_not_active",
                       6: "superseded_memory_not_found"}
    rows = {r.memory_id: r for r in change.table.collect()}
    made = [r for r in change.outcomes.collect() if r.request_id == 2][0].memory_id
    assert rows["m1"].status == "superseded" and rows["m1"].superseded_by == made
    assert rows["m3"].status == "active" and len(rows) == 5


def test_remember_is_idempotent(spark, table):
    requests = _requests(spark, [(1, "a", "bug", "new bug", None)])
    once = M.remember(table, requests, NOW).table
    again = M.remember(once, requests, NOW)
    assert again.outcomes.first().action == "deduplicated"
    assert again.table.count() == once.count()


def test_forget_modes(spark, table):
    facts = spark.createDataFrame([("f1", "a", "m1"), ("f2", "b", "m3")], "fact_id string, scope_id string, source_memory_id string")
    requests = spark.createDataFrame(
        [(1, "a", "m1", "hard_delete", "r", None), (2, "a", "m2", "expire", "r", None),
         (3, "b", "m3", "supersede", "r", "m9"), (4, "b", "m1", "expire", "r", None)],
        "request_id int, scope_id string, memory_id string, mode string, reason string, superseded_by string")
    change, left = M.forget(table, facts, requests, NOW)
    assert {r.request_id: r.reason for r in change.rejects.collect()} == {2: "invalid_transition", 4: "memory_not_found"}
    rows = {r.memory_id: r.status for r in change.table.collect()}
    assert rows == {"m2": "forgotten", "m3": "superseded"}
    assert [r.fact_id for r in left.collect()] == ["f2"]
    assert {r.facts_deleted for r in change.outcomes.filter("mode = 'hard_delete'").collect()} == {1}
