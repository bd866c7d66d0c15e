"""The append-only event log, in batch. Ordering is by (operation_id, sequence), never by the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sealcheck import rules as R
from sealcheck.functions.ids import idempotency_key
from sealcheck.functions.text import bad_text, is_blank
from sealcheck.operators.findings import coded

SCOPE = ["connector", "workspace_id", "destination"]
POSITION = ["operation_id", "sequence"]


def _by_type(values: dict[str, list[str]]) -> Column:
    """Lookup of a list by event type, as a literal map."""
    return F.create_map(*[part for name, items in values.items() for part in (
        F.lit(name), F.array(*[F.lit(i) for i in items]).cast("array<string>"))])


def event_rules() -> list[tuple[Column, str]]:
    """What makes an event ambiguous, unsafe or contradictory."""
    types = [name for name, *_ in R.EVENT_TYPES]
    allowed = F.try_element_at(_by_type({n: a for n, a, _, _ in R.EVENT_TYPES}), F.col("type"))
    required = F.try_element_at(_by_type({n: q for n, _, q, _ in R.EVENT_TYPES}), F.col("type"))
    outcomes = F.try_element_at(_by_type({n: o for n, _, _, o in R.EVENT_TYPES}), F.col("type"))
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    outcome = F.coalesce("outcome", F.lit(""))
    stage = F.coalesce("stage", F.lit(""))
    limit = lambda key: F.when(key.isin(R.PATH_METADATA), R.MAX_PATH).otherwise(R.MAX_TEXT)
    bad_value = F.exists(F.map_entries(metadata), lambda e: is_blank(e["value"]) | (
        F.octet_length(e["value"]) > limit(e["key"])) | e["value"].rlike(r"[\x00-\x1f\x7f]"))
    lacking = F.exists(required, lambda key: is_blank(F.try_element_at(metadata, key)))
    return [
        (~F.coalesce(F.col("type").isin(types), F.lit(False)), "TYPE_UNKNOWN"),
        (bad_text(F.col("operation_id"), R.MAX_OPERATION_ID), "OPERATION_ID_INVALID"),
        (F.coalesce(F.col("sequence") < 1, F.lit(True)), "SEQUENCE_INVALID"),
        (F.col("recorded_at").isNull(), "TIME_MISSING"),
        (bad_text(F.col("connector"), R.MAX_TEXT), "CONNECTOR_INVALID"),
        (bad_text(F.col("workspace_id"), R.MAX_TEXT), "WORKSPACE_INVALID"),
        (bad_text(F.col("destination"), R.MAX_PATH), "DESTINATION_INVALID"),
        (~F.coalesce(F.col("destination").startswith("/"), F.lit(False)), "DESTINATION_NOT_ABSOLUTE"),
        (~F.coalesce(F.col("operation").isin(R.OPERATIONS), F.lit(False)), "OPERATION_UNKNOWN"),
        ((stage != "") & ~stage.isin(R.STAGES), "STAGE_UNKNOWN"),
        ((F.size(outcomes) == 0) & (outcome != ""), "OUTCOME_NOT_ALLOWED"),
        ((F.size(outcomes) > 0) & ~F.array_contains(outcomes, outcome), "OUTCOME_NOT_ALLOWED"),
        (bad_text(F.col("message"), R.MAX_TEXT), "MESSAGE_INVALID"),
        (F.size(metadata) > R.MAX_METADATA, "METADATA_TOO_MANY"),
        (F.size(F.array_except(F.map_keys(metadata), allowed)) > 0, "METADATA_NOT_ALLOWED"),
        (bad_value, "METADATA_INVALID"), (lacking, "METADATA_REQUIRED")]


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, findings)."""
    rules = event_rules()
    broken = F.lit(False)
    for condition, _ in rules:
        broken = broken | F.coalesce(condition, F.lit(False))
    findings = coded(events.withColumn("snapshot_id", F.concat_ws("/", *SCOPE)), "validate_events", rules, "event",
                     F.concat_ws("/", "operation_id", "sequence"))
    return events.filter(~broken), findings


def dedupe_events(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First event per (operation_id, sequence) by arrival; aggregated before the shuffle, so replays stay cheap."""
    packed = F.struct(*[c for c in events.columns if c not in POSITION])
    return events.groupBy(*POSITION).agg(F.min_by(packed, F.col(arrival)).alias("e")).select(*POSITION, "e.*")


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy(*POSITION)


def latest_events(events: DataFrame, n: int, scope: list[str] = SCOPE) -> DataFrame:
    """Newest n events per scope, n = 0 meaning all.

    With a limit, the rank filter is applied in each task before the shuffle, so a hot scope sends n rows per task.
    Without one there is nothing to rank: order by (scope, operation_id desc, sequence desc) to read them.
    """
    if n == 0:
        return events
    newest = Window.partitionBy(*scope).orderBy(F.desc("operation_id"), F.desc("sequence"))
    return events.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n).drop("recency")


def activity(events: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Per scope: recorded and failed events, and the newest one."""
    failed = (F.col("outcome") == "FAILED") | (F.col("type") == R.NEVER_NOTIFIED)
    newest = F.max_by(F.struct("type", "outcome", "operation_id", "sequence"), F.struct(*POSITION))
    return events.groupBy(*scope).agg(F.count(F.lit(1)).alias("recorded"), F.count_if(failed).alias("failed"),
                                      newest.alias("last")).select(
        *scope, "recorded", "failed", F.col("last.type").alias("last_type"), F.col("last.outcome").alias("last_outcome"),
        F.col("last.operation_id").alias("last_operation_id"), F.col("last.sequence").alias("last_sequence"))


# Subscriptions that are sent to every task; more are joined.
MAX_SENT = 100_000


def notifications_due(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events each enabled destination asked for; a delivery problem is never itself delivered.

    `subscriptions` has (destination_id, event_type, enabled). There are few types, so the destinations of each go to the
    tasks as one list where their number allows it, and events are not shuffled by type.
    """
    wanted = subscriptions.filter("enabled").select("destination_id", F.col("event_type").alias("type")).distinct()
    sent = F.broadcast if wanted.limit(MAX_SENT + 1).count() <= MAX_SENT else lambda frame: frame
    lists = sent(wanted.groupBy("type").agg(F.collect_list("destination_id").alias("destinations")))
    due = events.filter(F.col("type") != R.NEVER_NOTIFIED).join(lists, "type").withColumn("destination_id", F.explode("destinations"))
    return due.select("destination_id", "type", *POSITION, idempotency_key("operation_id", "sequence", "type").alias("idempotency_key"))
