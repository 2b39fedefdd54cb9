"""Quality rules: hashed n-gram log-likelihood ratio, after a few counted rules.

Words and word pairs are hashed into ``buckets``; two multinomials over the
buckets are counted, one over all documents and one over trusted documents. A
text scores the mean of log p_trusted - log p_raw over its n-grams, and is kept
if that lies no further below the trusted mean than ``slack`` standard
deviations (of one n-gram's log ratio among trusted n-grams), plus
``sampling / sqrt(n)`` deviations for what n n-grams vary by chance.

A few words of abuse vanish in that mean. So a second ratio judges by terms
(words and word pairs without case and punctuation): those that significantly
more toxic than other labelled documents hold add their log odds, as in a
naive Bayes model of the terms present, and a text that is more likely toxic is not kept.

Everything that touches documents is built from DataFrame functions. Only the
counts of the buckets, whose number is a parameter, come to the driver; they go
back as one folded array literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import saved

SPACE = "\\x20\\x09-\\x0D"
#: Trusted documents whose n-grams are counted, those of least hashed id first.
TRUSTED = 20_000
BUCKETS = 1 << 16
PER_BUCKET = 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _pairs(ids: str, gap: int) -> Column:
    """Hashes of the ids that stand ``gap`` apart."""
    left = F.greatest(F.size(ids) - gap, F.lit(0))
    return F.zip_with(F.slice(ids, F.lit(1), left), F.slice(ids, F.lit(1 + gap), left), lambda a, b: F.xxhash64(a, b))


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all columns), text, words, h1 (words), h2 (word pairs)."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("h2", _pairs("h1", 1))


def _bucket(buckets: int):
    bits = buckets.bit_length() - 1
    return lambda h: F.shiftrightunsigned(h, 64 - bits).cast("int")


def _repeats(rows: DataFrame, span: int = 8) -> DataFrame:
    """Adds n_repeat_words: words in windows of eight that the text holds twice or more."""
    rows = rows.withColumn("h4", _pairs("h2", 2)).withColumn("h8", _pairs("h4", 4))
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    rows = rows.withColumn("sorted", F.when(some, F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        "sorted",
        lambda x, i: F.coalesce(x["h"] == F.get("sorted", i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("sorted", i - 1)["h"], F.lit(False)),
    )
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    steps = F.zip_with(
        "at", F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(F.lit(span), F.coalesce(b - a, F.lit(span)))
    )
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def count_buckets(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, limit: int = TRUSTED) -> DataFrame:
    """(bucket, n_raw, n_trusted) over all documents; buckets without an n-gram are left out."""
    sample = trusted.select(F.col(trusted.columns[0]).cast("long").alias("_trusted")).filter("_trusted IS NOT NULL").distinct()
    sample = sample.orderBy(F.xxhash64("_trusted"), "_trusted").limit(limit)  # at most ``limit`` ids: small enough to send everywhere
    rows = _hashed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text")
    rows = rows.join(F.broadcast(sample), F.col("row.id") == F.col("_trusted"), "left")
    # outer: a plain explode would be planned with a filter that makes the hashes once more
    grams = F.explode_outer(F.transform(F.concat("h1", "h2"), _bucket(buckets))).alias("bucket")
    grams = rows.select(grams, F.col("_trusted").isNotNull().cast("long").alias("t"))
    return grams.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_raw"), F.sum("t").alias("n_trusted"))


def model(counts: list[tuple[int, int, int]], buckets: int) -> tuple[list[float], float, float]:
    """Log ratio of each bucket, and its mean and deviation among trusted n-grams; each bucket counts one more.

    Buckets are folded by their upper bits until they hold ``PER_BUCKET``
    trusted n-grams on average, so that a small trusted set is not learned by
    heart.
    """
    fold, n = 0, sum(c[2] for c in counts)
    while (buckets >> fold) > 256 and (buckets >> fold) * PER_BUCKET > n:
        fold += 1
    raw, trusted = [1] * (buckets >> fold), [1] * (buckets >> fold)
    for bucket, n_raw, n_trusted in counts:
        raw[bucket >> fold] += n_raw
        trusted[bucket >> fold] += n_trusted
    all_raw, all_trusted = sum(raw), sum(trusted)
    ratio = [round(math.log(t / all_trusted) - math.log(r / all_raw), 6) for t, r in zip(trusted, raw, strict=True)]
    mean = math.fsum(t * w for t, w in zip(trusted, ratio, strict=True)) / all_trusted
    spread = math.sqrt(math.fsum(t * (w - mean) ** 2 for t, w in zip(trusted, ratio, strict=True)) / all_trusted)
    return ratio, mean, spread


#: Terms that are sent to every task; more are joined by a shuffle.
SEND_TERMS = 1_000_000


def _with_terms(rows: DataFrame) -> DataFrame:
    """Adds t1 (words without case and punctuation) and t2 (their pairs), hashed, to rows with ``text``."""
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    rows = rows.withColumn("t1", F.transform(words, lambda w: F.xxhash64(w)))
    return rows.withColumn("t2", _pairs("t1", 1))


def toxic_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int = TRUSTED) -> tuple[list[tuple[int, float]], float]:
    """(hash, log odds) of the terms that tell toxic documents, and the log odds of a text without any.

    ``labels``: ids and 1 (toxic) or 0; at most ``limit`` of either are read,
    those of least hashed id first. A term counts once a document. It is taken
    if its log-likelihood statistic would be a chance of 5 % over all terms of
    toxic documents together (Bonferroni).
    """
    ids = labels.select(F.col(labels.columns[0]).cast("long").alias("_label"), F.col(labels.columns[1]).cast("int").alias("toxic"))
    ids = ids.filter("_label IS NOT NULL AND toxic IN (0, 1)").groupBy("_label").agg(F.max("toxic").alias("toxic"))
    prior = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    first = [ids.filter(F.col("toxic") == t).orderBy(F.xxhash64("_label"), "_label").limit(limit) for t in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("_label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(first[0].union(first[1])), "_label")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return [], -math.inf
    a, b = size[1], size[0]

    def terms(toxic: int) -> DataFrame:
        # outer: as in count_buckets
        return _with_terms(rows.filter(F.col("toxic") == toxic)).select(F.explode_outer(F.array_distinct(F.concat("t1", "t2"))).alias("h")).filter("h IS NOT NULL")

    def statistic(x: Column, y: Column) -> Column:
        total = F.lit(0.0)
        for seen, of in ((x, a), (y, b), (a - x, a), (b - y, b)):
            share = (x + y) / (a + b) if seen is x or seen is y else 1 - (x + y) / (a + b)
            total += F.when(seen > 0, 2 * seen * F.log(seen / (of * share))).otherwise(0.0)
        return total

    x, y = F.col("x").cast("double"), F.coalesce("y", F.lit(0)).cast("double")
    toxic = saved(terms(1).groupBy("h").agg(F.count(F.lit(1)).alias("x")), "toxic-terms")
    least = 2 * math.log(20 * max(toxic.count(), 1))
    # no other term can become significant, however few other documents hold it
    some = toxic.filter(statistic(x, F.lit(0.0)) > least)
    some = saved(some, "some-terms")
    # sent to the tasks, so that the terms of all other documents need not be dealt out by hash
    sent = F.broadcast(some.select("h")) if some.count() <= SEND_TERMS else some.select("h")
    other = terms(0).join(sent, "h").groupBy("h").agg(F.count(F.lit(1)).alias("y"))
    found = some.join(other, "h", "left").filter((x * b > y * a) & (statistic(x, y) > least)).select("h", x.alias("x"), y.alias("y")).collect()
    # terms that a text lacks say nothing: one word of abuse is enough, and few texts hold several
    odds = [(r["h"], round(math.log((r["x"] + 0.5) / (a + 1)) - math.log((r["y"] + 0.5) / (b + 1)), 6)) for r in sorted(found)]
    return odds, min(math.log(prior[1] / prior[0]), 0.0)


def rate(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", result: str = "quality",
    buckets: int = BUCKETS, limit: int = TRUSTED, slack: float = 0.7, sampling: float = 2.0,
    labels: DataFrame | None = None,
) -> DataFrame:
    """All columns of ``docs`` and a struct ``result``, a row for each input row in no new order.

    result: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, llr (double, null without words), toxic_odds (log odds, null
    if no term tells toxic documents), kept. ``trusted``: a table
    whose first column holds ids of trusted documents. ``labels``: a table whose
    first two columns hold ids and 1 for toxic, 0 for other documents. Null and
    wordless texts count zeros and fail the rules. Without any trusted document
    only the rules and toxic terms decide. A column named ``result`` is replaced, all others may have any
    name. Repeated rows are rated alike. An empty table gives no rows.
    """
    if buckets & (buckets - 1) or buckets < 2:
        raise ValueError("buckets must be a power of two")
    counts = [(r[0], r[1], r[2]) for r in count_buckets(docs, trusted, id_col, text_col, buckets, limit).collect()]
    ratio, mean, spread = model(counts, buckets)
    known = sum(c[2] for c in counts) > 0
    # one string literal, split and cast: folded to a single array when planned
    weights = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<double>")
    rows = _repeats(_hashed(docs, text_col))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    n, grams = F.size("words"), F.size("h1") + F.size("h2")
    bucket = _bucket(len(ratio))
    rows = rows.withColumn("lines", lines).withColumn(
        "sum", F.aggregate(F.concat("h1", "h2"), F.lit(0.0), lambda s, h: s + F.get(weights, bucket(h)))
    )
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    llr = F.when(grams > 0, F.col("sum") / grams)
    enough = llr >= mean - spread * (slack + sampling / F.sqrt(grams)) if known else F.lit(True)
    odds, none = toxic_terms(docs, labels, id_col, text_col, limit) if labels is not None else ([], -math.inf)
    toxic_odds = F.lit(None).cast("double")
    if odds:
        rows = _with_terms(rows)
        # IN is a look-up in a set; only the few hits are looked up in the map, whose keys it goes through
        listed = ",".join(f"{h}L" if h > -(2**63) else "CAST('-9223372036854775808' AS BIGINT)" for h, _ in odds)
        rows = rows.withColumn("hits", F.array_distinct(F.expr(f"filter(concat(t1, t2), x -> x IN ({listed}))")))
        weight = F.map_from_arrays(*[F.split(F.lit(",".join(str(o[k]) for o in odds)), ",").cast(f"array<{kind}>") for k, kind in ((0, "long"), (1, "double"))])
        toxic_odds = F.aggregate("hits", F.lit(none), lambda s, h: s + F.element_at(weight, h))
    rating = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words"), failed.alias("base_failed"), llr.alias("llr"),
        toxic_odds.alias("toxic_odds"),
        (~failed & F.coalesce(enough, F.lit(False)) & F.coalesce(toxic_odds <= 0, F.lit(True))).alias("kept"),
    )
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c != result]
    return rows.select(*columns, rating.alias(result))
