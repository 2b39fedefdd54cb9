"""Line dedup by range-partitioned hashes; only DataFrame functions are used.

Every line that is long enough becomes a row of numbers: two hashes of its key,
its document and its place. Rows are range-partitioned by hash and sorted by
hash, then document (largest first) and position, so that a pass over a sorted
partition meets the occurrence to be kept first and counts documents as it
goes. What it finds are places, which return as one run-compressed keep bitmap
for each document; no text takes part in the shuffle of lines.

A hash that would fill a good part of a partition is not sorted: a frequent-item
sketch over all rows names these (there can be no more of them than a multiple
of the number of partitions), their documents are counted with a combine before
the shuffle, and their lines are judged where they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import saved, width

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h, g, doc, row, pos): a row for each line whose key has at least ``min_chars`` code points.

    ``row`` is a hash of the text: rows that share an id are one document, but
    have lines of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode_outer(F.split(text, "\n")).alias("pos", "line")
    )
    rows = rows.filter(F.octet_length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    rows = rows.filter(F.length("line") >= min_chars).withColumn("line", lower_ascii(F.col("line")))
    return rows.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "doc", "row", "pos")


def _frequent(rows: DataFrame) -> DataFrame:
    """(h): hashes that hold over a quarter of an even partition, at most four for each partition.

    The sketch sees every row; its error is below half of that share. A hash
    named without need costs nothing but the other way of counting it.
    """
    parts = width(rows.sparkSession)
    found = rows.agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(h, {4 * parts}, {32 * parts})").alias("top"))
    return found.select("total", F.explode("top").alias("t")).filter(F.col("t.count") * 4 * parts > F.col("total")).select(F.col("t.item").alias("h"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row, pos): places of the lines that go, each once or more."""
    rows = saved(line_rows(docs, id_col, text_col, min_chars), "lines")
    parts = width(docs.sparkSession)
    # at most four hashes for each partition: a bound, whatever the data
    frequent = saved(_frequent(rows), "frequent")
    heads = rows.join(F.broadcast(frequent), "h").groupBy("h", "g").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
    heads = saved(heads, "heads")
    common = rows.join(F.broadcast(heads), ["h", "g"]).filter((F.col("n") >= min_docs) & (F.col("doc") < F.col("keeper")))
    rest = rows.join(F.broadcast(frequent), "h", "left_anti")
    rest = rest.repartitionByRange(parts, "h", "g").sortWithinPartitions("h", "g", F.desc("doc"), "row", "pos")
    one = Window.partitionBy("h", "g")
    # the first document of a stream is the one that keeps its lines
    rest = rest.withColumn("rank", F.dense_rank().over(one.orderBy(F.desc("doc"))))
    rest = rest.withColumn("n", F.max("rank").over(one)).filter((F.col("n") >= min_docs) & (F.col("rank") > 1))
    return common.select("doc", "row", "pos").unionByName(rest.select("doc", "row", "pos"))


def _kept_runs(n_lines: Column, dropped: Column) -> Column:
    """The keep bitmap as runs of set bits (start, length), from the sorted places of its zeros."""
    lows = F.concat(F.array(F.lit(-1)), dropped)
    highs = F.concat(dropped, F.array(n_lines))
    runs = F.zip_with(lows, highs, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row, n_lines, n_dropped, keep): one row for each distinct id and text.

    ``keep`` is the bitmap of lines that stay, compressed to its runs of ones;
    ``row`` the hash of the text, ``doc`` the id (a null id as the smallest).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
    ).groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"))
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    # one document's places: no more than it has lines
    gone = gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    both = sizes.join(gone, ["doc", "row"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return both.select("doc", "row", "n_lines", F.size("gone").alias("n_dropped"), _kept_runs(F.col("n_lines"), F.col("gone")).alias("keep"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, result: str = "lines"
) -> DataFrame:
    """All columns of ``docs`` and a struct ``result``, a row for each input row.

    result: n_lines, n_dropped (int), keep (runs of kept lines), text (kept
    lines joined by a line feed). A line goes if its key (blanks stripped at
    both ends, A-Z in lower case) has ``min_chars`` code points, stands in at
    least ``min_docs`` documents, and this document is not the one of the
    largest id among them. Null and empty texts are one empty line. Rows that
    share an id are one document, and each is judged on its own lines; a null
    id counts as the smallest. Other columns may have any name; one named
    ``result`` is replaced. An empty table gives no rows.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("_in"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"))
    joined = rows.withColumn("row", F.xxhash64("_text")).join(bitmaps, ["doc", "row"], "left")
    lines = F.split("_text", "\n")
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    text = F.when(F.col("n_dropped") == 0, F.col("_text")).otherwise(kept)
    columns = [F.col("_in").getField(c).alias(c) for c in docs.columns if c != result]
    return joined.select(*columns, F.struct("n_lines", "n_dropped", "keep", text.alias("text")).alias(result))
