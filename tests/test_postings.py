"""Postings and the pruned search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import postings as P
from corpusmill.operators import recall as K
from corpusmill.session import written

NOW = "2024-02-01 00:00:00"


def table(spark, rows):
    df = spark.createDataFrame(rows, "memory_id string, scope_id string, type string, content string, summary string, source_ref string, confidence double, status string")
    return df.withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    out = [(f"m{k:03}", rng.choice("pppq"), "bug", text(rng.randint(1, 60)), rng.choice([None, text(3)]), None, rng.choice([0.1, 0.8, 1.0]), rng.choice(["active"] * 5 + ["expired"])) for k in range(150)]
    return out + [("m900", "p", "bug", "", "", None, 0.8, "active"), ("m901", "p", "bug", "日本語の 文 " * 3, None, None, 0.5, "active"), ("m902", "p", "bug", "aaaaa aaa", "aa", None, 0.5, "active")]


def test_counts_do_not_overlap(spark, rows):
    asked = [("p", t) for t in ("a", "aa", "aaa", "ab", "本", "日本語", "zzz", "abc")] + [("q", "aa")]
    text = K._memory_text(table(spark, rows))
    got = {(r.scope_id, r.term, r.memory_id): (r.n_content, r.n_summary) for r in P.build(text, spark.createDataFrame(asked, "scope_id string, term string")).collect()}
    want = {}
    for m, s, _, content, summary, *_ in rows:
        for scope, t in asked:
            n = (content.count(t), (summary or "").count(t))
            if scope == s and any(n):
                want[(s, t, m)] = n
    assert got == want


def test_many_groups_and_lists_change_nothing(spark, rows, monkeypatch):
    asked = spark.createDataFrame([("p", t) for t in ("a", "b", "ab", "abc", "ca")], "scope_id string, term string")
    text = K._memory_text(table(spark, rows))
    once = sorted(map(tuple, P.build(text, asked).collect()))
    monkeypatch.setattr(P, "GROUP_BYTES", 500)
    monkeypatch.setattr(P, "LIST_TERMS", 2)
    assert sorted(map(tuple, P.build(text, asked).collect())) == once


def score(query, content, summary):
    terms, c, s = query.split(), content, summary or ""
    if not any(t in c or t in s for t in terms):
        return None
    total = sum((math.log(c.count(t) + 1) + 2 * math.log(s.count(t) + 1)) * (0.5 if len(t) < 3 else 1) for t in terms)
    phrase = " ".join(terms)
    total += 3 if phrase in c else 4 if phrase in s else 0
    return math.floor((total + min(1, 200 / max(1, len(c)))) * 100 + 0.5) / 100


def test_pruned_search_ranks_as_all_pairs_do(spark, rows):
    rng = random.Random(9)
    pool = " ".join(r[3] for r in rows[:40]).split()
    asked = [(k, "p", " ".join(rng.sample(pool, rng.randint(1, 6))), rng.choice([1, 2, 5])) for k in range(12)]
    hits = K.search(table(spark, rows), spark.createDataFrame(asked, "query_id long, scope_id string, query string, limit int"), NOW).collect()
    for k, _, query, limit in asked:
        want = []
        for m, s, _, content, summary, _, confidence, status in rows:
            value = score(query, content, summary) if s == "p" and status == "active" else None
            if value is not None:
                want.append((-math.floor(value * (0.2 + confidence * 0.8) * 1.5 * 10000 + 0.5) / 10000, m))
        want = [(m, -x) for x, m in sorted(want)[:limit]]
        assert [(h.memory_id, h.final_score) for h in sorted(hits, key=lambda h: h.rank) if h.query_id == k] == want


def test_written_tables_are_not_broadcast(spark):
    schema = "scope_id string, query_id long, term string, memory_id string, variant int, pos int, weight double, n_content long, n_summary long"
    row = spark.createDataFrame([("s", 1, "t", "m", 0, 0, 1.0, 1, 0)], schema)
    pairs, places, index = (
        written(row.select(*names), "small")
        for names in (["scope_id", "query_id", "memory_id"], ["scope_id", "query_id", "variant", "pos", "term", "weight"],
                      ["scope_id", "term", "memory_id", "n_content", "n_summary"])
    )
    for found in (P.looked_up(pairs, places, index), P.all_pairs(places, index)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.select("scope_id", "query_id", "memory_id", "o_n").collect() == [("s", 1, "m", 1)]


def test_a_shared_term_makes_no_pairs_of_all_queries(spark, monkeypatch):
    """Every query shares one term with every memory: pairs grow with the queries, not with queries times memories."""
    table_rows = [(f"m{k:03}", "p", "bug", f"fact {k + 1000} of {k % 7}", None, None, [0.8, 0.3, -0.9][k % 3], "active" if k % 5 else "expired") for k in range(120)]
    asked = [(k, "p", f"fact {k + 1000}" if k % 4 else "fact", 1 + k % 3) for k in range(60)]
    made = {}
    real = P.looked_up

    def counted(pairs, places, index):
        made[len(made)] = pairs.count()
        return real(pairs, places, index)

    monkeypatch.setattr(P, "looked_up", counted)
    queries = spark.createDataFrame(asked, "query_id long, scope_id string, query string, limit int")
    hits = K.search(table(spark, table_rows), queries, NOW).collect()
    for k, _, query, limit in asked:
        want = []
        for m, _, _, content, summary, _, confidence, status in table_rows:
            value = score(query, content, summary) if status == "active" else None
            if value is not None:
                want.append((-math.floor(value * (0.2 + confidence * 0.8) * 1.5 * 10000 + 0.5) / 10000, m))
        want = [(m, -x) for x, m in sorted(want)[:limit]]
        assert [(h.memory_id, h.final_score) for h in sorted(hits, key=lambda h: h.rank) if h.query_id == k] == want
    # 32 memories score below zero and are kept; of 60 x 96 others a few a query
    assert max(made.values()) < 60 * (32 + 3 + 2)


def test_all_terms_look_up_the_rarest_one_only(spark, monkeypatch):
    table_rows = [(f"m{k:03}", "p", "bug", f"fact {k + 1000}", None, None, 0.8, "active") for k in range(50)]
    table_rows += [("m001", "p", "bug", "fact 1001 again", None, None, 0.8, "active")]
    asked = [(k, "p", f"fact {k + 1000}") for k in range(50)] + [(90, "p", "fact nowhere"), (91, "p", "fact")]
    queries = spark.createDataFrame(asked, "query_id long, scope_id string, query string")
    made = []
    real = P.rarest_pairs
    monkeypatch.setattr(P, "rarest_pairs", lambda *a: (made.append(real(*a)), made[0])[1])
    found = K.matches(table(spark, table_rows), queries, mode="all").select("query_id", "memory_id", "score").collect()
    # m001 is there twice, and its rows add up, as they do for any other search
    one = {(k, f"m{k:03}") for k in range(50) if k != 1} | {(91, f"m{k:03}") for k in range(50) if k != 1}
    assert {(r.query_id, r.memory_id) for r in found if r.memory_id != "m001"} == one
    assert made[0].count() < 50 + 50 + 52 + 1


def ranked(spark, table_rows, asked, every=False):
    queries = spark.createDataFrame(asked, "query_id long, scope_id string, query string, limit int")
    hits = K.search(table(spark, table_rows), queries, NOW, mode="all" if every else "any").collect()
    return sorted((h.query_id, h.rank, h.memory_id, h.score, h.final_score, h.match_method, tuple(h.matched_terms)) for h in hits)


def test_a_ranked_search_keeps_the_best_pairs_only(spark, rows, monkeypatch):
    """Whole texts as queries share terms with every memory; postings and pairs of all of them are not written."""
    asked = [(k, "p", r[3], 1 + k % 3) for k, r in enumerate(rows) if r[3].strip()]
    made = {}
    real = P.written

    def counted(df, name, *a):
        out = real(df, name, *a)
        made[name] = out.count()
        return out

    monkeypatch.setattr(P, "written", counted)
    monkeypatch.setattr(P, "build", lambda *a: pytest.fail("postings of all memories are not needed"))
    hits = ranked(spark, rows, asked)
    assert made["best"] <= sum(limit for *_, limit in asked)
    for k, _, query, limit in asked[::7]:
        values = [(score(query, c, t), v, m) for m, s, _, c, t, _, v, status in rows if s == "p" and status == "active"]
        want = sorted((-math.floor(x * (0.2 + v * 0.8) * 1.5 * 10000 + 0.5) / 10000, m) for x, v, m in values if x is not None)
        assert [(-h[4], h[2]) for h in hits if h[0] == k] == want[:limit]


@pytest.mark.parametrize("every", [False, True])
def test_small_groups_lists_and_blocks_change_no_hit(spark, rows, monkeypatch, every):
    twice = rows + rows[:20] + [("m900", "p", "bug", "again", None, None, None, "active"), (None, "p", "bug", "a", None, None, 0.8, "active"), ("m903", "p", "bug", "ab ab", None, None, None, "active")]
    asked = [(k, "p", " ".join(r[3].split()[: 1 + k % 9]), 4) for k, r in enumerate(rows[:40])] + [(3, "p", "ab", 2), (None, "p", "a", 3), (77, "p", "错误 a", 5)]
    once = ranked(spark, twice, asked, every)
    assert once
    for name, value in {"RANKED_BYTES": 700, "RANKED_TERMS": 40, "CELLS": 64, "ROWS": 16, "DENSE": 2}.items():
        monkeypatch.setattr(P, name, value)
    assert ranked(spark, twice, asked, every) == once


def test_occurrences_in_words_are_those_of_the_texts():
    words, terms = ["aaaa", "abab", "", "日本語日本", "xaax"], ["a", "aa", "aba", "ab", "日本", "語"]
    starts, which, times = P._occurrences(words, terms)
    got = {(w, terms[which[k]]): times[k] for j, w in enumerate(words) for k in range(starts[j], starts[j + 1])}
    assert got == {(w, t): w.count(t) for w in words for t in terms if t in w}
