"""From raw documents to sampled token pieces, stage by stage.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``; every decision takes effect on the rows or texts.
Nulls, empty and very long texts, repeated rows, empty tables and extra columns
are treated as the operators say; an empty input passes through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import op2_quality_llr, op4_gumbel_pieces, op8_template_decontamination, op9_pii_crf, op10_fast_sketch_dedup
from corpusmill.llm.common import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules, the log-likelihood ratio or toxic terms reject; trusted are labelled good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.filter("quality = 1 AND toxic = 0").select("doc_id")
    # written first: a filter on the rating is otherwise planned into the expressions that make it
    rated = saved(op2_quality_llr.rate(docs, trusted, result="_quality", labels=labels.select("doc_id", "toxic")), "rated")
    return rated.filter("_quality.kept").drop("_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, 80 %)."""
    return op10_fast_sketch_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also with other numbers, names or units."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = saved(op8_template_decontamination.decontaminate(docs, benchmark, result="_leak"), "judged")
    return judged.filter("NOT _leak.contaminated").drop("_leak")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [KIND] in the place of personal data; n_chars follows where it is a column."""
    found = op9_pii_crf.with_personal_data(docs, result="_pii")
    masked = found.withColumn("text", op9_pii_crf.masked(F.col("text"), F.col("_pii"))).drop("_pii")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and two distinct segmentations of each text, as ``samples``."""
    encoded = op4_gumbel_pieces.with_samples(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)
    return encoded.select("doc_id", "lang", "source", "samples")


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("sentence pieces", sampled_pieces),
]

#: SQL has neither the hashed model, the random field nor the sampler.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the results of all but the last are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
