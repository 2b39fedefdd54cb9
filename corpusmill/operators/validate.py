"""Row validation of change and recall requests.

Every request row gets an ``errors`` array; an empty array means valid. Checks
run as column expressions, so a bad row never stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, parse_source_ref, trim
from corpusmill.schemas import FORGET_MODES, MEMORY_STATUSES, MEMORY_TYPES, PROFILE_LAYERS

# Request limits.
MAX_CONTENT_CHARS = 256_000
MAX_QUERY_CHARS = 1_000
MAX_REASON_CHARS = 2_000
DEFAULT_RECALL_LIMIT = 10
MAX_RECALL_LIMIT = 50


def _errors(**checks: Column) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()])
    )


def _given(name: str) -> Column:
    return ~is_blank(F.col(name))


def is_iso_time(c: Column) -> Column:
    text = trim(c)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")
    return shaped & F.try_to_timestamp(text).isNotNull()


def validate_remember(requests: DataFrame) -> DataFrame:
    """Type, content, confidence, expires_at (text) and profile_target.

    An unrecognised source_ref only adds a warning.
    """
    t = trim(F.col("type"))
    errors = _errors(
        type_required=is_blank(F.col("type")),
        type_invalid=_given("type") & ~t.isin(*MEMORY_TYPES),
        content_required=is_blank(F.col("content")),
        content_too_long=F.length("content") > MAX_CONTENT_CHARS,
        confidence_out_of_range=F.isnan("confidence")
        | (F.col("confidence") < 0)
        | (F.col("confidence") > 1),
        expires_at_invalid=_given("expires_at") & ~is_iso_time(F.col("expires_at")),
        profile_target_invalid=_given("profile_target")
        & ~trim(F.col("profile_target")).isin(*PROFILE_LAYERS),
    )
    unknown = parse_source_ref(F.col("source_ref"))["prefix"] == "unknown"
    warnings = _errors(source_ref_unrecognized=_given("source_ref") & unknown)
    return requests.withColumns({"errors": errors, "warnings": warnings})


def validate_recall(requests: DataFrame) -> DataFrame:
    """Query, types, statuses and limit; adds the limit to use.

    A limit over ``MAX_RECALL_LIMIT`` is used as given and warned of.
    Without a status filter only active memories are wanted, or all of them
    where ``include_inactive`` is set.
    """
    q = trim(F.col("query"))

    def unknown(column: str, allowed: tuple[str, ...]) -> Column:
        return F.exists(F.col(column), lambda v: (F.length(v) > 0) & ~v.isin(*allowed))

    errors = _errors(
        query_required=is_blank(F.col("query")),
        query_too_long=F.length(q) > MAX_QUERY_CHARS,
        types_invalid=unknown("types", MEMORY_TYPES),
        status_invalid=unknown("statuses", MEMORY_STATUSES),
        limit_invalid=F.isnan("limit") | (F.col("limit") < 1),
    )
    limit = F.coalesce(F.floor("limit"), F.lit(DEFAULT_RECALL_LIMIT)).cast("int")
    warnings = _errors(limit_large=~F.isnan("limit") & (F.col("limit") > MAX_RECALL_LIMIT))
    no_filter = F.coalesce(F.size("statuses"), F.lit(0)) <= 0
    everything = F.array(*[F.lit(s) for s in MEMORY_STATUSES])
    active = F.array(F.lit("active"))
    statuses = (
        F.when(~no_filter, F.col("statuses"))
        .when(F.coalesce(F.col("include_inactive"), F.lit(False)), everything)
        .otherwise(active)
    )
    return requests.withColumns(
        {"errors": errors, "warnings": warnings, "effective_limit": limit, "effective_statuses": statuses}
    )


def validate_forget(requests: DataFrame) -> DataFrame:
    """Id, mode, reason and the successor a supersede needs."""
    mode = trim(F.col("mode"))
    errors = _errors(
        id_required=is_blank(F.col("memory_id")),
        mode_required=is_blank(F.col("mode")),
        mode_invalid=_given("mode") & ~mode.isin(*FORGET_MODES),
        reason_too_long=F.length(trim(F.col("reason"))) > MAX_REASON_CHARS,
        superseded_by_required=(mode == "supersede") & is_blank(F.col("superseded_by")),
    )
    return requests.withColumn("errors", errors)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the errors column, rejected rows with it)."""
    good = validated.filter(F.size("errors") == 0).drop("errors")
    return good, validated.filter(F.size("errors") > 0)
