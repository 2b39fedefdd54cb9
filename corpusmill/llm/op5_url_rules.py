"""URL filters: a sort-merge range join of urls and (host, path) rules.

A host's canonical key is its labels from the last to the first, each followed
by a separator, so a rule's host with all its subdomains is one interval of
keys, and such intervals are nested or apart. Rules give two events each, the
start and the end of their interval, and each event carries the stack of rules
active after it. Sorted between the events, a host finds its stack in the last
event before it. A second sweep of the same kind runs over the paths of each
active rule host, where path prefixes are the intervals.

Buckets (top label, or rule host) are split into ``salts``: urls go to the salt
of their hash and events to all salts, so one hot domain is swept by many tasks.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x01"
AFTER = b"\xff"  # sorts after any continuation in UTF-8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), SEPARATOR), F.lit(SEPARATOR))


def _sweep(points: DataFrame, events: DataFrame, bucket: str, hashed: list[str], salts: int) -> DataFrame:
    """Points with the ``top`` of the last event at or before their key in their bucket."""
    dealt = points.withColumns({"salt": F.pmod(F.xxhash64(*hashed), F.lit(salts)), "kind": F.lit(1), "top": F.lit(None).cast(events.schema["top"].dataType)})
    spread = events.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    order = Window.partitionBy(bucket, "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.unionByName(spread, allowMissingColumns=True)
    return both.withColumn("top", F.last("top", ignorenulls=True).over(order)).filter("kind = 1").drop("salt", "kind", "key")


def _host_events(rules: DataFrame) -> DataFrame:
    """bucket, key, kind, top: the rule hosts active after each start and end."""
    hosts = rules.select("host").distinct().withColumn("labels", F.split("host", "\\."))
    size = F.size("labels")
    tails = F.transform(F.sequence(F.lit(1), size), lambda k: F.array_join(F.slice("labels", size - k + 1, k), "."))
    chain = hosts.select("host", F.explode(tails).alias("outer")).join(hosts.select(F.col("host").alias("outer")), "outer")
    stacks = chain.groupBy("host").agg(F.array_sort(F.collect_list("outer")).alias("stack"))  # a host has few labels
    bucket, key = F.element_at(F.split("host", "\\."), -1).alias("bucket"), host_key(F.col("host")).cast("binary")
    start = stacks.select(bucket, key.alias("key"), F.lit(0).alias("kind"), F.col("stack").alias("top"))
    end = stacks.select(
        bucket, F.concat(key, F.lit(AFTER)).alias("key"), F.lit(0).alias("kind"), F.array_remove("stack", F.col("host")).alias("top")
    )
    return start.unionByName(end)


def _path_events(rules: DataFrame) -> DataFrame:
    """rule_host, key, kind, top: the longest path rule of the host active after each start and end."""
    kept = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda k: F.substring("path", F.lit(1), k))
    inner = kept.filter("path <> ''").select("host", "path", F.explode(prefixes).alias("outer"))
    parents = (
        inner.join(kept.select("host", F.col("path").alias("outer"), F.col("verdict").alias("v")), ["host", "outer"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.col("outer").alias("path"), F.col("v").alias("verdict")), F.length("outer")).alias("parent"))
    )
    none = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("verdict"))
    full = kept.join(parents, ["host", "path"], "left")
    key = F.col("path").cast("binary")
    start = full.select(F.col("host").alias("rule_host"), key.alias("key"), F.lit(0).alias("kind"), F.struct("path", "verdict").alias("top"))
    end = full.select(F.col("host").alias("rule_host"), F.concat(key, F.lit(AFTER)).alias("key"), F.lit(0).alias("kind"), F.coalesce("parent", none).alias("top"))
    return start.unionByName(end)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", salts: int = 32) -> DataFrame:
    """All columns of ``pages`` in a struct ``row``, and host, path, rule, verdict.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains
    where the path starts with its path; the longest (host and path together)
    wins, then the deeper host; of two verdicts for one host and path the first by
    name holds. Rules with a null host or path are left out.
    ``rule`` is null and ``verdict`` is ``default`` where none fits. Null urls
    and urls without ``://`` have an empty host and path. Repeated rows are
    judged alike. No rules: all default; no pages: no rows.
    """
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct()
    hosts = rows.select("host").distinct().select(
        "host", F.element_at(F.split("host", "\\."), -1).alias("bucket"), host_key(F.col("host")).cast("binary").alias("key")
    )
    active = _sweep(hosts, _host_events(rules), "bucket", ["host"], salts)
    active = active.select("host", F.explode("top").alias("rule_host")).filter(
        (F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), F.col("rule_host")))
    )
    points = urls.join(active, "host").withColumn("key", F.col("path").cast("binary"))
    fits = _sweep(points, _path_events(rules), "rule_host", ["host", "path"], salts).filter("top.path IS NOT NULL")
    rule = F.concat("rule_host", "top.path")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule), F.length("rule_host"), rule.alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
