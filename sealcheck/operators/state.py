"""Latest state and status of every backup scope, derived from the event log and sealed archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sealcheck import rules as R
from sealcheck.functions.text import bad_text, is_blank, safe_text
from sealcheck.operators.events import POSITION, SCOPE
from sealcheck.operators.findings import coded

LIFECYCLE = {"operation.started": "STARTED", "operation.completed": "SUCCEEDED", "operation.failed": "FAILED",
             "operation.skipped": "SKIPPED"}
VERIFICATION = "verification.recorded"


def _metadata(key: str) -> Column:
    return F.try_element_at(F.col("metadata"), F.lit(key))


def lifecycle(events: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Events that move a scope's state, in the shape both the batch and the streaming projection use."""
    outcome = F.lit(None).cast("string")
    for name, value in LIFECYCLE.items():
        outcome = F.when(F.col("type") == name, value).otherwise(outcome)
    return events.filter(F.col("type").isin(*LIFECYCLE, VERIFICATION)).select(
        *scope, *POSITION, "type", outcome.alias("attempt_outcome"), F.coalesce(_metadata("archive_path"), F.lit("")).alias("archive_path"),
        _metadata("result").alias("result"))


def project_state(events: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Last attempt, last success and last verification per scope, newest by (operation_id, sequence).

    A success counts only with an archive path. A STARTED attempt without a later end reads as interrupted.
    Each value is a max over a struct, so events combine before the shuffle.
    """
    moves = lifecycle(events, scope)
    position = F.struct(*POSITION)
    attempt = F.when(F.col("attempt_outcome").isNotNull(), position)
    success = F.when((F.col("attempt_outcome") == "SUCCEEDED") & (F.col("archive_path") != ""), position)
    verified = F.when(F.col("type") == VERIFICATION, position)
    grouped = moves.groupBy(*scope).agg(
        F.max_by(F.struct(*POSITION, F.col("attempt_outcome").alias("outcome")), attempt).alias("a"),
        F.max_by(F.struct(*POSITION, "archive_path"), success).alias("s"),
        F.max_by(F.struct(*POSITION, "result", "archive_path"), verified).alias("v"))
    return grouped.select(
        *scope, F.col("a.operation_id").alias("attempt_operation_id"), F.col("a.sequence").alias("attempt_sequence"),
        F.col("a.outcome").alias("attempt_outcome"), F.coalesce(F.col("a.outcome") == "STARTED", F.lit(False)).alias("interrupted"),
        F.col("s.operation_id").alias("success_operation_id"), F.col("s.archive_path").alias("success_archive_path"),
        F.col("v.result").alias("verification_result"), F.col("v.archive_path").alias("verification_archive_path"))


def attempt_rules(prefix: str) -> list[tuple[Column, str]]:
    """Contradictions inside one recorded attempt; its columns carry `prefix`."""
    c = {name: F.col(f"{prefix}_{name}") for name in (
        "operation_id", "operation", "stage", "outcome", "started_at", "ended_at", "error_reason", "skip_reason", "archive_path")}
    there = c["operation_id"].isNotNull()
    skip = F.coalesce(c["skip_reason"], F.lit(""))
    rules = [
        (bad_text(c["operation_id"], R.MAX_OPERATION_ID), "OPERATION_ID_INVALID"),
        (~F.coalesce(c["operation"].isin(R.OPERATIONS), F.lit(False)), "OPERATION_UNKNOWN"),
        (~F.coalesce(c["stage"].isin(R.STAGES), F.lit(False)), "STAGE_UNKNOWN"),
        (~F.coalesce(c["outcome"].isin(R.OUTCOMES), F.lit(False)), "OUTCOME_UNKNOWN"),
        (c["started_at"].isNull(), "START_MISSING"), (c["ended_at"] < c["started_at"], "ENDED_BEFORE_START"),
        ((c["outcome"] == "STARTED") & c["ended_at"].isNotNull(), "STARTED_BUT_ENDED"),
        ((c["outcome"] == "FAILED") & c["error_reason"].isNull(), "FAILED_WITHOUT_REASON"),
        ((c["outcome"] == "SUCCEEDED") & c["error_reason"].isNotNull(), "SUCCEEDED_WITH_ERROR"),
        ((c["outcome"] == "SKIPPED") & c["ended_at"].isNull(), "SKIPPED_WITHOUT_END"),
        ((c["outcome"] == "SKIPPED") & c["error_reason"].isNotNull(), "SKIPPED_WITH_ERROR"),
        ((c["outcome"] == "SKIPPED") & (skip == ""), "SKIPPED_WITHOUT_REASON"),
        ((c["outcome"] != "SKIPPED") & (skip != ""), "SKIP_REASON_WITHOUT_SKIP"),
        (c["error_reason"].isNotNull() & ~c["error_reason"].isin(R.HEALTH_REASONS), "ERROR_REASON_UNKNOWN"),
        (bad_text(F.coalesce(c["archive_path"], F.lit("")), R.MAX_PATH, allow_empty=True), "ARCHIVE_PATH_INVALID")]
    return [(there & condition, f"{prefix.upper()}_{code}") for condition, code in rules]


DIGEST = r"^sha256:[0-9a-fA-F]{64}$"


def validate_state(records: DataFrame) -> DataFrame:
    """Contradictions of a state record, coded. One row per scope, `scope_key` names it."""
    success = F.col("success_operation_id").isNotNull()
    verified = F.col("verification_result").isNotNull()
    rules = [
        (~F.coalesce(F.col("schema_version") == 3, F.lit(False)), "VERSION_UNSUPPORTED"),
        (bad_text(F.col("connector"), R.MAX_TEXT), "CONNECTOR_INVALID"),
        (bad_text(F.col("workspace_id"), R.MAX_TEXT), "WORKSPACE_INVALID"),
        (bad_text(F.col("destination"), R.MAX_PATH), "DESTINATION_INVALID"),
        (~F.coalesce(F.col("destination").startswith("/"), F.lit(False)), "DESTINATION_NOT_ABSOLUTE"),
        (F.col("updated_at").isNull(), "UPDATE_TIME_MISSING"),
        *attempt_rules("attempt"), *attempt_rules("success"),
        (success & ~F.coalesce(F.col("success_outcome") == "SUCCEEDED", F.lit(False)), "SUCCESS_NOT_SUCCEEDED"),
        (success & F.col("success_ended_at").isNull(), "SUCCESS_WITHOUT_END"),
        (success & is_blank(F.col("success_archive_path")), "SUCCESS_WITHOUT_ARCHIVE"),
        (success & (F.col("attempt_started_at") < F.col("success_started_at")), "ATTEMPT_OLDER_THAN_SUCCESS"),
        (verified & ~F.col("verification_result").isin(R.RESULTS), "VERIFICATION_RESULT_UNKNOWN"),
        (verified & F.col("verification_at").isNull(), "VERIFICATION_TIME_MISSING"),
        (verified & ~F.coalesce(F.col("verification_archive_path").startswith("/"), F.lit(False)), "VERIFICATION_PATH_NOT_ABSOLUTE"),
        (verified & ~F.coalesce(F.col("verification_checksum").rlike(DIGEST), F.lit(False)), "VERIFICATION_CHECKSUM_INVALID")]
    return coded(records.withColumn("snapshot_id", F.col("scope_key")), "validate_state", rules, "state", F.col("scope_key"))


def archive_condition(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Whether a verified archive is still there and still the same.

    `recorded` has (scope_key, path, manifest_checksum), `current` (path, manifest_checksum, readable).
    """
    found = current.select("path", F.col("manifest_checksum").alias("_now"), "readable", F.lit(True).alias("_there"))
    joined = recorded.join(found, "path", "left")
    condition = (F.when(is_blank(F.col("path")), "UNREADABLE").when(F.col("_there").isNull(), "MISSING")
                 .when(~F.coalesce("readable", F.lit(True)), "UNREADABLE")
                 .when(~F.col("_now").eqNullSafe(F.col("manifest_checksum")), "CHANGED").otherwise("PRESENT"))
    return joined.select("scope_key", "path", condition.alias("condition"))


def scope_status(state: DataFrame, now: Column, key: str = "scope_key") -> DataFrame:
    """ATTENTION with its reasons, else UNKNOWN if something is not established, else HEALTHY.

    `state` has per scope: health_state, health_reason, health_observed_at, auth_state, auth_observed_at,
    attempt_outcome, success_operation_id, verification_result, archive_condition, notification_problem and
    undelivered (array of destination ids). An observation older than a day is flagged stale, never judged for it.
    """
    def text(condition, *parts):
        return F.when(F.coalesce(condition, F.lit(False)), F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    fixed = F.array(
        text(F.col("health_state").isin("DEGRADED", "UNAVAILABLE"), "health", F.col("health_state"), F.col("health_reason")),
        text(F.col("auth_state").isin("REJECTED", "REQUIRED"), "authentication", F.col("auth_state")),
        text(F.col("attempt_outcome") == "FAILED", "last attempt failed"),
        text(F.col("attempt_outcome") == "STARTED", "last attempt interrupted"),
        text(F.col("attempt_outcome") == "SKIPPED", "last attempt skipped"),
        text(~F.col("verification_result").isin(R.VERIFIED, R.LIMITED), "verification", F.col("verification_result")),
        text(F.col("verification_result").isNotNull() & F.col("archive_condition").isin("MISSING", "CHANGED", "UNREADABLE"),
             "archive", F.col("archive_condition")),
        text(F.col("notification_problem").isNotNull(), "notifications", F.col("notification_problem")))
    failed = F.transform(F.coalesce("undelivered", F.array().cast("array<string>")), lambda d: F.concat(F.lit("undelivered "), d))
    attention = F.array_sort(F.filter(F.concat(fixed, failed), lambda r: r.isNotNull()))
    unknown = (F.col("health_state").isNull() | (F.col("health_state") == "UNKNOWN") | (F.col("auth_state") == "UNKNOWN")
               | F.col("attempt_outcome").isNull()
               | (F.col("verification_result").isNull() & F.col("success_operation_id").isNotNull()))

    def age(observed):
        return F.when(observed.isNotNull(), F.greatest(F.unix_timestamp(now) - F.unix_timestamp(observed), F.lit(0).cast("long")))

    return state.select(
        key, attention.alias("attention"), age(F.col("health_observed_at")).alias("health_age_seconds"),
        F.coalesce(age(F.col("health_observed_at")) > R.STALE_SECONDS, F.lit(False)).alias("health_stale"),
        F.when(F.size(attention) > 0, "ATTENTION").when(F.coalesce(unknown, F.lit(True)), "UNKNOWN").otherwise("HEALTHY").alias("status"))


def overall_status(scopes: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Worst status of all scopes: UNKNOWN without any, at least UNREADABLE when a state could not be read."""
    level = F.lit(0)
    for name, value in R.STATUS_SEVERITY.items():
        level = F.when(F.col("status") == name, value).otherwise(level)
    broken = unreadable.select(F.lit("UNREADABLE").alias("status"), F.lit(False).alias("is_scope"))
    rows = scopes.select("status", F.lit(True).alias("is_scope")).unionByName(broken)
    return rows.agg(F.max_by("status", level).alias("worst"), F.count_if("is_scope").alias("n_scopes"),
                    F.count_if(~F.col("is_scope")).alias("n_unreadable")).select(
        F.coalesce("worst", F.lit("UNKNOWN")).alias("status"), "n_scopes", "n_unreadable")


def backup_catalogue(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state per scope, outcome per path) over all archives found under a destination.

    `archives` has (path, connector, workspace_id, destination, completed_at, readable, result). The newest proven
    archive of a scope is its last success, the newest judged one its last verification. Archives that cannot be
    read, dated or attributed are skipped with a reason; failed and partial working directories are listed apart.
    """
    name = F.element_at(F.split("path", "/"), -1)
    working = F.when(name.endswith(".failed"), "FAILED_WORKING_STATE").when(name.contains(".partial-"), "ABANDONED_WORKING_STATE")
    skipped = (F.when(~F.coalesce("readable", F.lit(False)), "MANIFEST_UNREADABLE")
               .when(F.col("completed_at").isNull(), "NOT_DATED")
               .when(is_blank(F.col("connector")) | is_blank(F.col("workspace_id")), "SOURCE_UNKNOWN")
               .when(~F.coalesce(F.col("result").isin(R.RESULTS), F.lit(False)), "NOT_VERIFIABLE"))
    judged = archives.withColumn("outcome", F.coalesce(working, skipped, F.lit("RECORDED")))
    proven = F.col("result").isin(R.VERIFIED, R.LIMITED)
    age = F.struct("completed_at", "path")
    state = judged.filter("outcome = 'RECORDED'").groupBy(*SCOPE).agg(
        F.max_by("path", F.when(proven, age)).alias("success_archive_path"),
        F.max_by("path", age).alias("verification_archive_path"), F.max_by("result", age).alias("verification_result"),
        F.count(F.lit(1)).alias("n_archives"), F.count_if(proven).alias("n_proven"))
    return state, judged.select("path", "outcome")


def bounded_limitations(limitations: DataFrame, limit: int = R.MAX_LIMITATIONS) -> DataFrame:
    """Keep limit - 1 of more than `limit` limitations and state how many were left out.

    `limitations` has (snapshot_id, ordinal, limitation). Blank texts are dropped before counting.
    """
    clean = limitations.withColumn("limitation", safe_text(F.col("limitation"))).filter("limitation <> ''")
    sizes = clean.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = clean.withColumn("position", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("ordinal")))
    first = ranked.filter(F.col("position") <= limit)
    kept = first.join(sizes, "snapshot_id").filter((F.col("n") <= limit) | (F.col("position") < limit)).select(
        "snapshot_id", F.col("position").cast("long").alias("position"), "limitation")
    more = sizes.filter(F.col("n") > limit).select("snapshot_id", F.lit(limit).cast("long").alias("position"), F.concat(
        (F.col("n") - (limit - 1)).cast("string"), F.lit(" further limitations are recorded in the archive")).alias("limitation"))
    return kept.unionByName(more)


def attach_verification(verdicts: DataFrame, state: DataFrame) -> DataFrame:
    """A standalone verification belongs to the first scope that refers to the judged archive.

    `verdicts` has (path, result), `state` (scope_key, success_archive_path, attempt_archive_path,
    verification_archive_path). An unknown archive creates no scope.
    """
    paths = F.array_distinct(F.filter(F.array("success_archive_path", "attempt_archive_path", "verification_archive_path"),
                                      lambda p: p.isNotNull() & (p != "")))
    refers = state.select("scope_key", F.explode(paths).alias("path"))
    first = refers.groupBy("path").agg(F.min("scope_key").alias("scope_key"))
    return verdicts.join(first, "path").select("scope_key", "path", "result")
