import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import recall as K

NOW = "2024-02-01 00:00:00"
TEXTS = [
    ("m1", "a", "Payment retries use an idempotency key", "idempotency"),
    ("m2", "a", "Header names are lower case", None),
    ("m3", "a", "retry the payment three times, then fail", "retry policy"),
    ("m4", "b", "payment service of another scope", None),
    ("m5", "a", "100% of a_b tests", None),
]


@pytest.fixture(scope="module")
def memories(spark):
    rows = [(i, s, "bug", c, t, None, 0.8, "active" if i != "m2" else "expired") for i, s, c, t in TEXTS]
    df = spark.createDataFrame(rows, "memory_id string, scope_id string, type string, content string, summary string, "
                                     "source_ref string, confidence double, status string")
    return df.withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))


def _brute(query, content, summary):
    terms, c, s = query.lower().split(), content.lower(), (summary or "").lower()
    if not any(t in c or t in s for t in terms):
        return None
    score = 0.0
    for t in terms:
        score += (math.log(c.count(t) + 1) + 2 * math.log(s.count(t) + 1)) * (0.5 if len(t) < 3 else 1.0)
    phrase = " ".join(terms)
    score += 3 if phrase in c else 4 if phrase in s else 0
    return math.floor((score + min(1, 200 / len(c))) * 100 + 0.5) / 100


@pytest.mark.parametrize("query", ["payment", "retry policy", "a", "PAYMENT retries use", "%", "a_b", "zzz", "idempot key"])
def test_matches_equal_brute_force(spark, memories, query):
    asked = spark.createDataFrame([(1, "a", query)], "query_id int, scope_id string, query string")
    got = {r.memory_id: r.score for r in K.matches(memories, asked).collect()}
    want = {i: _brute(query, c, s) for i, sc, c, s in TEXTS if sc == "a" and i != "m2"}
    assert got == {i: v for i, v in want.items() if v is not None}


def test_search_limits_filters_and_scope(spark, memories):
    asked = spark.createDataFrame(
        [(1, "a", "payment retry header", 1, None), (2, "a", "header", 5, ["expired"]), (3, "b", "retry", 5, None), (4, "a", "  ", 5, None)],
        "query_id int, scope_id string, query string, limit int, statuses array<string>")
    hits = K.search(memories, asked, NOW).collect()
    assert {(h.query_id, h.memory_id) for h in hits} == {(1, "m3"), (2, "m2")}


def test_expansion_prefers_longest_phrase(spark):
    asked = spark.createDataFrame([(1, "幂等键 X-Id"), (2, "plain words")], "query_id int, query string")
    rows = {r.query_id: r for r in K.expand(asked).collect()}
    assert rows[1].expanded_query == "X-Id idempotency key"
    assert rows[1].original_terms == ["幂等键", "X-Id"]
    assert rows[2].expanded_query is None


def test_expanded_match_method(spark, memories):
    asked = spark.createDataFrame([(1, "a", "幂等")], "query_id int, scope_id string, query string")
    hit = K.matches(memories, asked).first()
    assert (hit.memory_id, hit.match_method, hit.matched_terms) == ("m1", "expanded", ["idempotency"])
