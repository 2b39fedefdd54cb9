"""Benchmark decontamination by template canonicalisation.

Texts become words in which numbers, units after numbers and names (capitalised
words inside a sentence) are typed slots that remember their value. Windows of
eight template words of all documents are hash-joined with those of the
benchmark items; matches on one diagonal (same distance between the two
positions) make a passage. A passage counts if it covers enough of its item's
windows and its slots are consistent: one value of the item always stands for
one value of the document. So a question is found again after its numbers,
names and units were changed, but not where the words only happen to agree.

Copies are also looked for by their plain words, without case and punctuation
and with all values: windows of eight words, and whole items of fewer. This
finds copies in other case and items that are mostly slots.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.op2_quality_llr import SPACE, words_of

WINDOW = 8
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Words that are units where they follow a number.
UNITS = (
    "km", "m", "cm", "mm", "mi", "ft", "kg", "g", "mg", "lb", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years",
    "usd", "eur", "dollars", "euros", "cents", "percent", "degrees", "apples", "miles", "meters", "metres", "pounds", "grams", "liters", "litres",
)
NAME_RULE = f"([^.!?{SPACE}][{SPACE}]+)(\\p{{Lu}})"
NUMBER_RULE = "[0-9]+(?:[.,:/-][0-9]+)*"
UNIT_RULE = f"(\\x01[^ ]+ +)({'|'.join(UNITS)})([^\\p{{L}}\\p{{N}}]|$)"
DROP_RULE = f"[^\\p{{L}}\\p{{N}}\\x01-\\x03{SPACE}]+"
#: Window rows of the benchmark that are sent to every executor; more are joined by a shuffle.
SEND_ROWS = 1_000_000


def valued_words(text: Column) -> Column:
    """Lower-case words without punctuation; slots start with their type and keep their value."""
    text = F.lower(F.regexp_replace(text, NAME_RULE, f"$1{NAME}$2"))
    text = F.regexp_replace(text, NUMBER_RULE, f" {NUMBER}$0 ")
    text = F.regexp_replace(text, UNIT_RULE, f"$1{UNIT}$2$3")
    return words_of(F.regexp_replace(text, DROP_RULE, ""))


def plain_words(text: Column) -> Column:
    """Lower-case words without punctuation, values as they stand."""
    return words_of(F.regexp_replace(F.lower(text), f"[^\\p{{L}}\\p{{N}}{SPACE}]+", ""))


def _is_slot(word: Column) -> Column:
    return word < F.lit("\x04")


def _with_windows(rows: DataFrame) -> DataFrame:
    """Adds ``windows``, the hash of the template of every eight words, to rows with ``words``."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(F.when(_is_slot(w), F.substring(w, 1, 1)).otherwise(w))))
    for gap in (1, 2, 4):
        left = F.greatest(F.size("h") - gap, F.lit(0))
        pair = F.zip_with(F.slice("h", F.lit(1), left), F.slice("h", F.lit(1 + gap), left), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn("h", pair)
    return rows.withColumnRenamed("h", "windows")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """window, item, item_at, n (windows of the item), words: windows that are at least half words."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    rows = _with_windows(items.select("item", valued_words(F.col("t")).alias("words")))
    # outer: a plain explode would be planned with a filter that makes the windows once more
    rows = rows.select("item", "words", F.posexplode_outer("windows").alias("item_at", "window")).filter("window IS NOT NULL")
    slots = F.size(F.filter(F.slice("words", F.col("item_at") + 1, F.lit(WINDOW)), _is_slot))
    rows = rows.filter(slots * 2 <= WINDOW)
    # item and text together: an id may come with several texts
    return rows.join(rows.groupBy("item", "words").agg(F.count(F.lit(1)).alias("n")), ["item", "words"])


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` plain words; those of other sizes differ."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(words, i, F.lit(size)), " "))))


def plain_copies(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, coverage: float) -> DataFrame:
    """(id, hash, items): items of which a diagonal of plain windows covers enough; short ones are found whole."""
    items = benchmark.select(F.col(item_col).alias("item"), plain_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).distinct()
    items = items.withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).filter("size > 0")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # eight at most
    if not sizes:
        return docs.select("id", "hash", F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>").alias("items")).limit(0)
    # plain words are never slots, so windows of templates are those of the words as they stand
    runs = lambda size: F.col("windows") if size == WINDOW else _runs(F.col("words"), size)
    items, grams = _with_windows(items), None
    for size in sizes:
        own = items.filter(F.col("size") == size).select("item", (F.size("words") - size + 1).alias("n"), F.posexplode(runs(size)).alias("item_at", "window"))
        grams = own if grams is None else grams.union(own)
    if grams.count() <= SEND_ROWS:
        grams = F.broadcast(grams)
    rows = _with_windows(docs.select("id", "hash", plain_words(F.col("text")).alias("words")))
    at = F.flatten(F.array(*[
        F.coalesce(F.transform(runs(size), lambda w, i: F.struct(i.alias("doc_at"), w.alias("window"))), F.array().cast("array<struct<doc_at:int,window:bigint>>"))
        for size in sizes
    ]))
    found = rows.select("id", "hash", F.explode_outer(at).alias("w")).select("id", "hash", "w.doc_at", "w.window").join(grams, "window")
    # rows equal in id and text match at the same places: they are counted once
    diagonal = found.groupBy("id", "hash", "item", "n", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.count_distinct("item_at").alias("matched"))
    enough = diagonal.filter(F.col("matched") >= F.ceil(F.col("n") * coverage))
    return enough.groupBy("id", "hash").agg(F.collect_set("item").alias("items"))


def passages(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """(id, hash, passages): per document the diagonals that cover enough of an item.

    ``docs``: id, hash, text. A passage has item, doc_at, item_at (first match)
    and length in words.
    """
    # window rows have no words: an item's words are joined again for the few passages found
    windows = benchmark.select("window", "item", "item_at", "n")
    if windows.count() <= SEND_ROWS:
        windows = F.broadcast(windows)
    rows = _with_windows(docs.select("id", "hash", valued_words(F.col("text")).alias("words")))
    found = rows.select("id", "hash", F.posexplode_outer("windows").alias("doc_at", "window")).join(windows, "window")
    diagonal = found.groupBy("id", "hash", "item", "n", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(
        # rows equal in id and text match at the same places: they are counted once
        F.count_distinct("item_at").alias("matched"), F.min("item_at").alias("first"), F.max("item_at").alias("last")
    )
    enough = diagonal.filter(F.col("matched") >= F.ceil(F.col("n") * coverage))
    words = benchmark.groupBy("item").agg(F.first("words").alias("item_words"))
    length = F.col("last") - F.col("first") + WINDOW
    return enough.join(words, "item").select(
        "id", "hash", F.struct(
            "item", (F.col("first") + F.col("shift")).alias("doc_at"), length.alias("length"),
            F.slice("item_words", F.col("first") + 1, length).alias("words"), "matched",
        ).alias("passage"),
    )


def _consistent(passage: Column, words: str) -> Column:
    """Each value of a slot of the item stands for one value of the document."""
    here = F.slice(words, passage["doc_at"] + 1, passage["length"])
    both = F.zip_with(passage["words"], here, lambda b, d: F.struct(b.alias("b"), d.alias("d")))
    slots = F.array_distinct(F.filter(both, lambda x: _is_slot(x["b"]) & _is_slot(x["d"])))
    return F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda x: x["b"])))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = 0.4, result: str = "leak",
) -> DataFrame:
    """All columns of ``docs`` and a struct ``result``, a row for each input row.

    result: contaminated, items (sorted distinct ids of the items found).
    ``coverage``: the share of an item's windows that a passage must match.
    Null and empty texts and items hold nothing; items of fewer than eight
    words are looked for whole, by their plain words. Rows equal in id and text are
    judged alike, also with a null id. A column named ``result`` is replaced,
    others may have any name. An empty benchmark finds nothing; an empty table
    gives no rows.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumns({"id": F.coalesce("id", F.lit("")), "hash": F.xxhash64("text")})
    items = benchmark_windows(benchmark, item_col, item_text_col)
    found = passages(rows.select("id", "hash", "text"), items, coverage)
    found = found.groupBy("id", "hash").agg(F.collect_list("passage").alias("passages"))
    copies = plain_copies(rows.select("id", "hash", "text"), benchmark, item_col, item_text_col, coverage)
    found = found.join(copies.withColumnRenamed("items", "copies"), ["id", "hash"], "full")
    joined = rows.join(found, ["id", "hash"], "left")
    # the words of the few documents with a passage are made again
    joined = joined.withColumn("words", F.when(F.col("passages").isNotNull(), valued_words(F.col("text"))))
    kept = F.filter("passages", lambda p: _consistent(p, "words"))
    none = F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>")
    hits = F.concat(F.coalesce(F.transform(kept, lambda p: p["item"]), none), F.coalesce("copies", none))
    hits = F.array_sort(F.array_distinct(hits))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c != result]
    joined = joined.withColumn("items", hits)
    return joined.select(*columns, F.struct((F.size("items") > 0).alias("contaminated"), "items").alias(result))
