"""Recall: a table of queries against the memory table.

A memory matches when it contains any term of the query as a substring. The
scope alone would be a poor join key (one scope may hold a third of all rows),
so pairs come from postings of (scope, term), see :mod:`postings`, and carry
numbers; a text is read again only for phrases and for the hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, ordered_distinct, round_half_up, trim
from corpusmill.operators import lookup, postings
from corpusmill.operators.listing import live_facts
from corpusmill.session import as_time, shuffled, written
from corpusmill.sources.store import new_failures, new_receipts

#: Lists of phrases that one text may meet.
SHARES = 16


@dataclass(frozen=True)
class Scorer:
    """How relevance, confidence and age combine."""

    confidence_base: float = 0.2
    confidence_weight: float = 0.8
    decay_days: float = 60.0
    max_boost: float = 0.5


DEFAULT_SCORER = Scorer()
LEGACY_SCORER = Scorer(0.0, 1.0, 30.0, 0.3)

# Technical terms and their English equivalents, longest first.
EXPANSIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("本地优先", ("local-first",)),
    ("离线优先", ("offline-first",)),
    ("幂等键", ("idempotency", "key")),
    ("幂等性", ("idempotency",)),
    ("幂等", ("idempotency",)),
    ("请求头", ("header",)),
    ("响应头", ("header",)),
    ("接口路径", ("API", "path")),
    ("接口", ("API", "endpoint")),
    ("超时时间", ("timeout",)),
    ("超时", ("timeout",)),
    ("包管理器", ("package", "manager")),
    ("依赖安装", ("dependency", "install")),
    ("安装依赖", ("install", "dependency")),
    ("身份认证", ("authentication",)),
    ("权限校验", ("authorization",)),
    ("数据库", ("database",)),
    ("缓存", ("cache",)),
    ("重试", ("retry",)),
    ("限流", ("rate", "limit")),
    ("日志", ("log",)),
    ("错误", ("error",)),
    ("测试", ("test",)),
    ("构建", ("build",)),
    ("配置", ("configuration",)),
    ("依赖", ("dependency",)),
)
PRESERVED_TOKEN = r"/?[A-Za-z0-9_$@.][A-Za-z0-9_$@./:\\-]*"


def terms(query: Column) -> Column:
    """K1."""
    return F.filter(F.split(trim(query), r"\s+"), lambda t: F.length(t) > 0)


def expand(queries: DataFrame) -> DataFrame:
    """K7: add preserved, matched and translated terms and the expanded query.

    Matched phrases are blanked out one after the other, longest first, so a
    phrase inside an already matched one is not translated again.
    """
    rest = trim(F.col("query"))
    staged = queries.withColumns(
        {
            "_rest0": rest,
            "preserved_terms": F.regexp_extract_all(rest, F.lit(f"({PRESERVED_TOKEN})"), 1),
        }
    )
    has_cjk = F.col("_rest0").rlike("[一-鿿]")

    def fold(text: Column) -> Column:
        state = F.struct(
            text.alias("rest"),
            F.array().cast("array<string>").alias("matched"),
            F.array().cast("array<string>").alias("translated"),
        )
        entries = F.array(
            *[
                F.struct(F.lit(p).alias("phrase"), F.array(*[F.lit(w) for w in words]).alias("words"))
                for p, words in EXPANSIONS
            ]
        )
        return F.aggregate(
            entries,
            state,
            lambda s, e: F.when(
                F.contains(s["rest"], e["phrase"]),
                F.struct(
                    F.replace(s["rest"], e["phrase"], F.lit("\u0000")).alias("rest"),
                    F.array_append(s["matched"], e["phrase"]).alias("matched"),
                    F.concat(s["translated"], e["words"]).alias("translated"),
                ),
            ).otherwise(s),
        )

    none = F.array().cast("array<string>")
    staged = staged.withColumn("_fold", F.when(has_cjk, fold(F.col("_rest0"))))
    matched = F.coalesce(F.col("_fold.matched"), none)
    translated = F.coalesce(F.col("_fold.translated"), none)
    expanded = ordered_distinct(F.concat(F.col("preserved_terms"), translated))
    return staged.withColumns(
        {
            "original_terms": ordered_distinct(F.concat(matched, F.col("preserved_terms"))),
            "expanded_terms": expanded,
            "expanded_query": F.when(F.size(translated) > 0, F.array_join(expanded, " ")),
        }
    ).drop("_rest0", "_fold", "preserved_terms")


def _memory_text(memories: DataFrame) -> DataFrame:
    content, summary = F.lower("content"), F.lower(F.coalesce("summary", F.lit("")))
    return memories.withColumns({"_content": content, "_summary": summary})


def _scale(confidence: Column, created_at: Column, now: Column | str, scorer: Scorer) -> tuple[Column, Column]:
    """What confidence and age make of a relevance: the factor of the one, the boost of the other."""
    micros = F.unix_micros(as_time(now).cast("timestamp")) - F.unix_micros(
        created_at.cast("timestamp")
    )
    age_days = F.greatest(F.lit(0), micros) / F.lit(86_400_000_000.0)
    return F.lit(scorer.confidence_base) + confidence * scorer.confidence_weight, F.exp(-age_days / scorer.decay_days)


def final_score(
    relevance_: Column, confidence: Column, created_at: Column, now: Column | str, scorer: Scorer
) -> Column:
    """K6: struct(merged_score, recency_boost, final_score), four digits."""
    effective, boost = _scale(confidence, created_at, now, scorer)
    merged = relevance_ * effective
    return F.struct(
        round_half_up(merged, 4).alias("merged_score"),
        round_half_up(boost, 4).alias("recency_boost"),
        round_half_up(merged * (1 + boost * scorer.max_boost), 4).alias("final_score"),
    )


def prepare(memories: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lower-cased memory text, and queries with terms, filters and expansion."""
    for name, kind in {"types": "array<string>", "statuses": "array<string>", "limit": "int"}.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    asked = expand(queries.filter(~is_blank(F.col("query"))))
    lower = lambda c: F.transform(c, lambda t: F.lower(t))
    differs = F.lower("expanded_query") != F.lower(trim(F.col("query")))
    asked = asked.withColumns(
        {
            "_terms": lower(terms(F.col("query"))),
            "_expanded_terms": F.when(differs, lower(terms(F.col("expanded_query")))),
        }
    )
    return _memory_text(memories), asked


def _places(asked: DataFrame) -> DataFrame:
    """(scope_id, query_id, variant, pos, term, weight): a row for each place of a query's terms, as asked (0) and expanded (1)."""
    rows = []
    for variant, name in ((0, "_terms"), (1, "_expanded_terms")):
        rows.append(asked.select("scope_id", "query_id", F.lit(variant).alias("variant"), F.posexplode(name).alias("pos", "term")))
    return rows[0].unionByName(rows[1]).withColumn("weight", F.when(F.length("term") < 3, 0.5).otherwise(1.0))


def _allowed(pairs: DataFrame, asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs whose memory has a status and type that the query asks for, with the columns of both; no texts."""
    query_columns = ["scope_id", "query_id", "types", "statuses", "limit", "_terms", "_expanded_terms"]
    active = F.array(F.lit("active"))
    return (
        pairs.join(shuffled(facts), ["scope_id", "memory_id"])
        .join(shuffled(asked.select(*query_columns)), ["scope_id", "query_id"])
        .filter(F.array_contains(F.coalesce("statuses", active), F.col("status")))
        .filter(F.col("types").isNull() | F.array_contains("types", F.col("type")))
    )


def _methods(pairs: DataFrame, every: bool) -> DataFrame:
    """K2 / K4: pairs that match, with the variant that counts; its terms, numbers and, if all are in one text, phrase."""
    wanted = lambda name, n: F.col(n) == F.size(name) if every else F.col(n) > 0
    original, expanded = wanted("_terms", "o_n"), F.coalesce(wanted("_expanded_terms", "e_n"), F.lit(False))
    found = pairs.withColumns({"_original": original, "_expanded": expanded}).filter(F.col("_original") | F.col("_expanded"))
    pick = lambda a, b: F.when(F.col("_original"), F.col(a)).otherwise(F.col(b))
    method = F.when(F.col("_original") & F.col("_expanded"), "original+expanded").when(F.col("_original"), "original").otherwise("expanded")
    found = found.withColumns({
        "match_method": method, "_used": pick("_terms", "_expanded_terms"), "frequency": pick("o_frequency", "e_frequency"),
        "_in_content": pick("o_content", "e_content"), "_in_summary": pick("o_summary", "e_summary"),
    })
    n = F.size("_used")
    whole = (n > 1) & ((F.col("_in_content") == n) | (F.col("_in_summary") == n))
    return found.withColumns({"_n_used": n, "phrase": F.when(whole, F.array_join("_used", " "))})


def _bonus(found: DataFrame, text: DataFrame) -> DataFrame:
    """K3: adds ``bonus``, 3 where the content holds the phrase, 4 where only the summary does.

    A phrase needs all its terms, so only pairs that have them are looked up in
    the texts, with all phrases that a memory is asked for side by side: a text
    meets at most ``SHARES`` lists and not every query.
    """
    asked = found.filter("phrase IS NOT NULL").select("scope_id", "memory_id", "phrase").distinct()
    asked = asked.groupBy("scope_id", "memory_id", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).agg(F.collect_list("phrase").alias("phrases"))
    texts = text.select("scope_id", "memory_id", "_content", "_summary")
    where = lambda p: F.when(F.contains("_content", p), 3.0).when(F.contains("_summary", p), 4.0)
    held = asked.join(texts, ["scope_id", "memory_id"]).select(
        "scope_id", "memory_id", F.explode(F.transform("phrases", lambda p: F.struct(p.alias("phrase"), where(p).alias("held")))).alias("p")
    )
    held = held.filter("p.held IS NOT NULL").select("scope_id", "memory_id", "p.phrase", "p.held")
    single = F.when(F.col("_n_used") == 1, F.when(F.col("_in_content") > 0, 3.0).when(F.col("_in_summary") > 0, 4.0))
    whole = shuffled(found.filter("phrase IS NOT NULL")).join(held, ["scope_id", "memory_id", "phrase"], "left")
    plain = found.filter("phrase IS NULL").withColumn("bonus", F.coalesce(single, F.lit(0.0)))
    return plain.unionByName(whole.withColumn("bonus", F.coalesce("held", F.lit(0.0))).drop("held"))


def _density() -> Column:
    return F.least(F.lit(1.0), F.lit(200) / F.greatest(F.lit(1), F.col("_chars")))


def _relevant(pairs: DataFrame, asked: DataFrame, facts: DataFrame, text: DataFrame, every: bool) -> DataFrame:
    """K2-K4: matching pairs with relevance and match method."""
    found = _methods(_allowed(pairs, asked, facts), every).select(
        "scope_id", "query_id", "memory_id", "limit", "frequency", "phrase", "_n_used", "_in_content", "_in_summary", "_chars",
        "match_method", "type", "status", "source_ref", "confidence", "created_at",
    )
    return _bonus(written(found, "found"), text).select(
        "scope_id", "query_id", "memory_id", "limit", round_half_up(F.col("frequency") + F.col("bonus") + _density(), 2).alias("score"),
        "match_method", "type", "status", "source_ref", "confidence", "created_at",
    )


def _facts(text: DataFrame) -> DataFrame:
    """Memories without their texts."""
    return text.select(
        "scope_id", "memory_id", "type", "status", "source_ref", "confidence", "created_at", F.length("_content").alias("_chars")
    )


def _index(text: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places of the queries' terms, and the postings of these terms, written: several steps read them."""
    places = written(_places(asked), "places")
    return places, written(postings.build(text, places.select("scope_id", "term").distinct()), "postings")


def _with_matched_terms(hits: DataFrame, text: DataFrame, asked: DataFrame) -> DataFrame:
    """K8: the query terms that occur in the hit's summary or content."""
    words = asked.select(
        "scope_id", "query_id", "query", "original_terms", "expanded_terms"
    )
    texts = text.select(
        "scope_id", "memory_id", F.concat("_summary", F.lit("\n"), "_content").alias("_haystack")
    )
    named = (
        F.when(
            F.col("match_method") == "original+expanded",
            F.concat("original_terms", "expanded_terms"),
        )
        .when(F.col("match_method") == "expanded", F.col("expanded_terms"))
        .when(F.size("original_terms") > 0, F.col("original_terms"))
        .otherwise(terms(F.col("query")))
    )
    present = F.filter(named, lambda t: F.contains(F.col("_haystack"), F.lower(t)))
    return (
        hits.join(shuffled(words), ["scope_id", "query_id"])
        .join(texts, ["scope_id", "memory_id"])
        .withColumn("matched_terms", ordered_distinct(present))
        .drop("query", "original_terms", "expanded_terms", "_haystack")
    )


def matches(memories: DataFrame, queries: DataFrame, mode: str = "any") -> DataFrame:
    """K2-K4, K7, K8: every matching (query, memory) with its relevance.

    Scope isolation, type and status filters apply here. ``mode='all'`` wants
    every term. A memory found by both variants keeps the original's score.
    """
    text, asked = prepare(memories, queries)
    asked = written(asked, "asked")
    places, index = _index(text, asked)
    if mode == "all":
        pairs = postings.looked_up(written(postings.rarest_pairs(text, places, index), "pairs"), places, index)
    else:
        pairs = postings.all_pairs(places, index)
    found = _relevant(pairs, asked, _facts(text), text, mode == "all")
    return _with_matched_terms(found, text, asked).drop("limit")


def _pairs_for_hits(
    places: DataFrame, text: DataFrame, asked: DataFrame, now: Column | str, scorer: Scorer, mode: str, default_limit: int
) -> DataFrame:
    """The numbers of all pairs that can be among the asked hits."""
    effective, boost = _scale(F.col("confidence"), F.col("created_at"), now, scorer)
    scaled = text.withColumns({
        "density": F.least(F.lit(1.0), F.lit(200) / F.greatest(F.lit(1), F.length("_content"))).cast("double"),
        "effective": effective.cast("double"), "gain": (1 + boost * scorer.max_boost).cast("double"),
    })
    limited = asked.withColumn("limit", F.coalesce("limit", F.lit(default_limit)).cast("int"))
    found = postings.best_pairs(scaled, limited, mode == "all")
    return postings.looked_up(found.select("scope_id", "query_id", "memory_id"), places, found)


def search(
    memories: DataFrame,
    queries: DataFrame,
    now: Column | str,
    scorer: Scorer = DEFAULT_SCORER,
    compressed: DataFrame | None = None,
    mode: str = "any",
    default_limit: int = 10,
) -> DataFrame:
    """K9: ranked hits per query, as many as the query's limit.

    Only the best pairs of each group of memories leave it (:mod:`postings`); texts
    are read again for phrases and for the ranked rows. The rows of each
    query are cut to the largest limit asked for before they meet in one task,
    then to their own. The terms a hit matched and whether it can be expanded
    (C8) are worked out for the ranked rows only.
    """
    text, asked = prepare(memories, queries)
    asked = written(asked, "asked")
    columns = ["scope_id", "memory_id", "type", "status", "source_ref", "confidence", "created_at", "_content", "_summary"]
    text = text.join(asked.select("scope_id").distinct(), "scope_id", "left_semi").select(*columns)
    text = written(text, "texts", "zstd")
    facts = _facts(text)
    pairs = _pairs_for_hits(_places(asked), text, asked, now, scorer, mode, default_limit)
    scored = _relevant(pairs, asked, facts, text, mode == "all")
    parts = final_score(F.col("score"), F.col("confidence"), F.col("created_at"), now, scorer)
    scored = scored.withColumn("_s", parts).select(
        "scope_id", "query_id", "memory_id", "type", "status", "source_ref", "score", "confidence",
        "_s.*", "match_method",
        F.coalesce("limit", F.lit(default_limit)).alias("_limit"),
    )
    # a literal bound, which Spark applies in every partition before the shuffle
    most = asked.agg(F.max(F.coalesce("limit", F.lit(default_limit)))).first()[0] or 0
    window = Window.partitionBy("scope_id", "query_id").orderBy(F.col("final_score").desc(), F.col("memory_id"))
    top = scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most)
    top = top.filter(F.col("rank") <= F.col("_limit")).drop("_limit")
    top = _with_matched_terms(top, text, asked)
    if compressed is not None:
        top = lookup.with_can_expand(top, compressed)
    return top


def bm25(
    memories: DataFrame,
    queries: DataFrame,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """K5: BM25 scores (higher is better) of active memories with every query word.

    Words are runs of letters and digits of content and summary. Frequencies,
    lengths and document counts are aggregates over the whole memory table.
    """
    words_of = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    active = memories.filter(F.col("status") == "active")
    docs = active.select(
        "scope_id", "memory_id",
        words_of(F.concat_ws(" ", "summary", "content")).alias("_words"),
    ).withColumn("_length", F.size("_words"))
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    mean_length = docs.agg(F.avg("_length")).scalar()
    asked = queries.select(
        "scope_id", "query_id", F.array_distinct(words_of(F.col("query"))).alias("_q")
    ).withColumn("_wanted", F.size("_q"))
    query_words = asked.select(
        "scope_id", "query_id", "_wanted", F.explode("_q").alias("word")
    )
    vocabulary = query_words.select("word").distinct()
    frequencies = (
        docs.select("scope_id", "memory_id", "_length", F.explode("_words").alias("word"))
        .join(vocabulary, "word", "left_semi")
        .groupBy("scope_id", "memory_id", "_length", "word")
        .agg(F.count(F.lit(1)).alias("_tf"))
    )
    df = frequencies.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    rarity = F.log((n_docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = df.withColumns({"_idf": F.greatest(rarity, F.lit(1e-6)), "_mean": mean_length})
    hits = query_words.join(weights, "word").join(frequencies, ["scope_id", "word"])
    tf = F.col("_tf")
    norm = tf + k1 * (1 - b + b * F.col("_length") / F.col("_mean"))
    return (
        hits.groupBy("scope_id", "query_id", "memory_id", "_wanted")
        .agg(F.sum(F.col("_idf") * tf * (k1 + 1) / norm).alias("score"),
             F.count(F.lit(1)).alias("_found"))
        .filter(F.col("_found") == F.col("_wanted"))
        .drop("_wanted", "_found")
    )


def recall_failures(queries: DataFrame, hits: DataFrame, now: Column | str) -> DataFrame:
    """No hit at all, or all hits below 0.3."""
    best = hits.groupBy("query_id").agg(F.max("final_score").alias("_best"))
    judged = queries.join(best, "query_id", "left")
    weak = F.col("_best") < 0.3
    event = F.when(F.col("_best").isNull(), "recall_no_hit").when(weak, "recall_low_confidence")
    reason = F.when(F.col("_best").isNull(), "no_results_for_query").otherwise(
        "all_results_below_confidence_threshold"
    )
    rows = judged.filter(F.col("_best").isNull() | weak).withColumns(
        {
            "error_reason": reason,
            "metadata": F.to_json(F.struct("query", F.col("_best").alias("maxScore"))),
        }
    )
    return new_failures(rows, "recall", event, now, ["query_id"])


def recall_receipts(
    queries: DataFrame, hits: DataFrame, now: Column | str, related: DataFrame | None = None
) -> DataFrame:
    """One audit row per query with its memory ids in rank order."""
    ranked = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "memory_id"))).alias("_hits")
    )
    rows = queries.join(ranked, "query_id", "left").withColumn(
        "memory_ids",
        F.coalesce(F.col("_hits.memory_id"), F.array().cast("array<string>")),
    )
    return new_receipts(rows, "recall", now, ["query_id"])


@dataclass(frozen=True)
class Recall:
    """Everything a recall answers with, one table each."""

    hits: DataFrame
    profile: DataFrame
    related: DataFrame
    failures: DataFrame
    receipts: DataFrame


def recall(
    memories: DataFrame,
    queries: DataFrame,
    facts: DataFrame,
    compressed: DataFrame,
    now: Column | str,
    scorer: Scorer = DEFAULT_SCORER,
    originals: DataFrame | None = None,
) -> Recall:
    """Hits, the profile of each queried scope, related compressed rows and audit."""
    hits = search(memories, queries, now, scorer, compressed)
    scopes = queries.select("scope_id").distinct()
    profile = live_facts(facts, now).join(scopes, "scope_id", "left_semi")
    links = lookup.related_compressed(hits, compressed)
    if originals is not None:
        links = lookup.with_originals(links, originals)
    of_query = hits.select("query_id", "scope_id", "source_ref").distinct()
    related = of_query.join(links, ["scope_id", "source_ref"]).dropDuplicates(
        ["query_id", "ccr_id"]
    )
    return Recall(
        hits,
        profile,
        related,
        recall_failures(queries, hits, now),
        recall_receipts(queries, hits, now),
    )


def with_terms(queries: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """K1 as a table operator: queries that have at least one term."""
    asked = queries.withColumn("terms", terms(F.col("query")))
    return asked.filter(F.size("terms") > 0).select("query_id", "scope_id", "terms", *fields)
