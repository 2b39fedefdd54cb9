"""The context flow: reuse, recall of what was remembered, and its commit."""

import pytest
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.plans import context_flow as flow
from corpusmill.sources.store import conform

MARKDOWN = "# Build\n\n## Setup\n\n- use [gradle](http://x.org)\n- run **all** of it\n\n```sh\ngradle\n```\n\n| a | b |\n|---|---|\n" * 8
NOW = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def done(spark):
    rows = [
        (1, "a", MARKDOWN, ["gradle builds it"], "VERIFIED", "gradle"),
        (2, "a", MARKDOWN, ["the same text"], "VERIFIED", None),
        (3, "b", "Nothing to see here.", [], "VERIFIED", "gradle"),
        (4, "a", None, ["no text"], "UNKNOWN", " "),
    ]
    requests = spark.createDataFrame(rows, "request_id long, scope_id string, content string, facts array<string>, verification string, query string")
    requests = requests.withColumns({"goal": F.lit(""), "inferences": F.array().cast("array<string>"), "contradictory": F.lit(False)})
    empty = lambda ddl: conform(spark.createDataFrame([], "x int"), ddl)
    return flow.context_flow(requests, empty(schemas.MEMORIES), empty(schemas.ORIGINALS), NOW)


def test_steps(done):
    steps = {r.request_id: r for r in done.steps.collect()}
    assert set(steps) == {1, 2, 3, 4}
    assert (steps[1].cache_hit, steps[2].cache_hit) == (False, True)
    assert steps[1].ccr_id == steps[2].ccr_id
    # remembered by the batch, recalled by it, in its own scope only
    assert steps[1].memory.status == "ok" and steps[1].recalled > 0
    assert (steps[3].recall.status, steps[3].recalled) == ("ok", 0)
    assert (steps[2].recall.status, steps[2].recall.reason) == ("skipped", "not requested")
    # a text that is not there is not stored, and the step says so
    assert steps[4].original.status == "failed" and steps[1].original.status == "ok"


def test_a_broken_run_is_not_seen_and_written_again(spark, done, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    real = flow._tables

    def two_then_stop(f):
        names = list(real(f).items())
        yield from names[:2]
        raise RuntimeError("executor lost")

    class Broken(dict):
        def items(self):
            return two_then_stop(done)

    monkeypatch.setattr(flow, "_tables", lambda f: Broken())
    with pytest.raises(RuntimeError):
        flow.commit(done, folder, "r1")
    assert flow.committed(spark, folder, "r1") is None
    monkeypatch.setattr(flow, "_tables", real)
    tables = flow.commit(done, folder, "r1")
    assert set(tables) == {"compressed", "originals", "memories", "facts", "receipts", "failures", "steps"}
    counts = {name: t.count() for name, t in tables.items()}
    assert counts["steps"] == 4 and counts["compressed"] >= 2 and counts["memories"] >= 1
    again = flow.commit(done, folder, "r1")
    assert {name: t.count() for name, t in again.items()} == counts
    assert sorted(map(str, again["steps"].collect())) == sorted(map(str, done.steps.collect()))
