"""Batches of memory requests against a plain one-by-one run."""

import random

import pytest

from corpusmill.operators import inorder


def one_by_one(memories, requests):
    """{(scope, request): (action, memory, reason)}."""
    out = {}
    for scope in {r[1] for r in requests}:
        status = {m: s for sc, m, _, s in memories if sc == scope}
        live = {m: f for sc, m, f, s in memories if sc == scope and s == "active"}
        for rid, sc, fp, target, new in sorted(requests):
            if sc != scope:
                continue
            same = [m for m, f in live.items() if f is not None and f == fp]
            if same:
                out[(scope, rid)] = ("deduplicated", min(same), None)
                continue
            if target is not None and target not in live:
                why = "superseded_memory_not_active" if target in status else "superseded_memory_not_found"
                out[(scope, rid)] = ("rejected", None, why)
                continue
            if target is not None:
                del live[target]
            live[new], status[new] = fp, "active"
            out[(scope, rid)] = ("replaced" if target is not None else "created", new, None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_play_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    prints = [f"f{k}" for k in range(6)]
    memories = [(rng.choice("ab"), f"m{k}", rng.choice(prints + [None]), rng.choice(["active", "active", "expired"])) for k in range(14)]
    requests = []
    for k in range(120):
        # targets: memories of the table, ones the batch itself makes, and none that exist
        target = rng.choice([None, f"m{rng.randint(0, 15)}", f"n{rng.randint(0, 120)}"])
        requests.append((k, rng.choice("ab"), rng.choice(prints), target, f"n{k}"))
    got = inorder.play(
        spark.createDataFrame(memories, "scope_id string, memory_id string, fingerprint string, status string"),
        spark.createDataFrame(requests, "request_id long, scope_id string, fingerprint string, target string, new_id string"),
    ).collect()
    assert len(got) == len(requests)
    assert {(r.scope_id, r.request_id): (r.action, r.memory_id, r.reason) for r in got} == one_by_one(memories, requests)


def test_many_equal_requests_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = inorder._round
    monkeypatch.setattr(inorder, "_round", lambda *a: rounds.append(1) or real(*a))
    requests = [(k, "a", "same", None, f"n{k}") for k in range(300)] + [(300 + k, "a", f"f{k}", "m0", f"n{300 + k}") for k in range(300)]
    memories = [("a", "m0", "x", "active")]
    got = inorder.play(
        spark.createDataFrame(memories, "scope_id string, memory_id string, fingerprint string, status string"),
        spark.createDataFrame(requests, "request_id long, scope_id string, fingerprint string, target string, new_id string"),
    ).collect()
    assert {(r.scope_id, r.request_id): (r.action, r.memory_id, r.reason) for r in got} == one_by_one(memories, requests)
    assert len(rounds) <= 3
