"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import op1_token_blocks, op3_attention_lm as op3_, op4_gumbel_pieces as op4_, op8_template_decontamination as op8_, op9_pii_crf, op2_quality_llr as op2_quality_llr_, op5_url_rules as op5_url_rules_, op6_substring_dedup, op7_suffix_dedup, op10_fast_sketch_dedup, op11_line_dedup, op12_periodic_runs as op12_periodic_runs_, op13_merkle_manifest as op13_merkle_manifest_
from corpusmill.llm.common import shared_dir
from corpusmill.llm.op2_quality_llr import SPACE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_blocks_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    op1_token_blocks.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = op1_token_blocks.read_tokens(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


@query
def op4_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_.with_samples(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2)
    part = lambda name: F.transform("samples", lambda s: s[name])
    return found.select("doc_id", part("ids").alias("ids"), part("log_prob").alias("log_probs"), part("log_inclusion").alias("log_inclusions"))


#: Host, path and verdict of each rule.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = op5_url_rules_.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


ORACLES["op5_url_rules"] = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
fits AS (SELECT page_id, arg_max(h || p, (length(h || p), length(h))) AS rule, arg_max(v, (length(h || p), length(h))) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (page_id)"""


@query
def op6_substring_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op6_substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_suffix_dedup_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7_suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_fast_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_fast_sketch_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rated = op2_quality_llr_.rate(table(spark, sf_dir, "documents"), trusted, labels=labels)
    return rated.select("doc_id", "quality.*")


@query
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op8_.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "leak.contaminated", F.array_join("leak.items", ",").alias("items"))


_units = "|".join(op8_.UNITS)
_valued = f"""string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''),
  '{op8_.NAME_RULE}', '\\1' || chr(2) || '\\2', 'g')), '{op8_.NUMBER_RULE}', ' ' || chr(1) || '\\0 ', 'g'),
  '{op8_.UNIT_RULE}', '\\1' || chr(3) || '\\2\\3', 'g'), '{op8_.DROP_RULE}', '', 'g'), '[{SPACE}]+')"""
_grams = """SELECT key, words, w.i - 1 AS at, list_aggregate(list_transform(words[w.i : w.i + 7],
  lambda x: CASE WHEN x < chr(4) THEN x[1] ELSE x END), 'string_agg', ' ') AS gram,
  len(list_filter(words[w.i : w.i + 7], lambda x: x < chr(4))) AS slots, len(words) - 7 AS n"""
ORACLES["op8_template_decontamination"] = f"""
WITH d AS (SELECT doc_id AS key, list_filter({_valued}, lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id AS key, list_filter({_valued}, lambda x: x <> '') AS words FROM benchmark),
dg AS ({_grams} FROM d, unnest(range(1, len(words) - 6)) AS w(i)),
bg AS ({_grams} FROM b, unnest(range(1, len(words) - 6)) AS w(i)),
runs AS (SELECT dg.key AS doc, bg.key AS item, dg.at - bg.at AS shift, min(bg.at) AS a, max(bg.at) AS z, count(*) AS c, any_value(bg.n) AS n,
  any_value(dg.words) AS dw, any_value(bg.words) AS bw
  FROM dg JOIN bg ON dg.gram = bg.gram AND bg.slots <= 4 GROUP BY ALL),
long AS (SELECT doc, item, list_filter(list_zip(bw[a + 1 : z + 8], dw[a + shift + 1 : z + shift + 8]),
  lambda x: x[1] < chr(4) AND x[2] < chr(4)) AS slots FROM runs WHERE c >= ceil(n * 0.4::DOUBLE)),
hits AS (SELECT DISTINCT doc, item FROM long
  WHERE len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda x: x[1])))),
per AS (SELECT doc, string_agg(item, ',' ORDER BY item) AS items FROM hits GROUP BY doc)
SELECT doc_id, doc IS NOT NULL AS contaminated, coalesce(items, '') AS items FROM documents LEFT JOIN per ON doc = doc_id"""


@query
def op9_pii_crf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op9_pii_crf.with_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *op9_pii_crf.digest("pii"))


@query
def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_line_dedup_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op11_line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    long = lambda name: F.col(f"lines.{name}").cast("long").alias(name)
    return found.select("doc_id", long("n_lines"), long("n_dropped"), F.sha2("lines.text", 256).alias("kept_sha256"))


_UPPER, _LOWER = op11_line_dedup.UPPER, op11_line_dedup.LOWER
ORACLES["op11_line_dedup_bitmaps"] = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = op12_periodic_runs_.with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = op12_periodic_runs_.with_runs(planted)
    return found.select("doc_id", *op12_periodic_runs_.digest("periodic"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = op13_merkle_manifest_.leaf_digest([op11_line_dedup.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    manifest = op13_merkle_manifest_.build(docs, columns, carry={"tampered": F.when(hit, lowered)})
    proved = op13_merkle_manifest_.prove(manifest, "tampered")
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
