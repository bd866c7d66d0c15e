"""Event log, state and status (I), and the readers and writers (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from queries.mapping import text
from queries.oracle import pid as sql_pid, s
from queries.organize import DOCUMENTS, clean
from queries.registry import findings, query
from queries.seal import sql_aggregate
from sealcheck import rules as R
from sealcheck.connectors import clickup, notion
from sealcheck.functions.ids import digest, scope_key
from sealcheck.operators import events as E, health as H, organize as O, state as S
from sealcheck.schemas import LEDGER, PORTABLE_COLUMNS, SOURCE_OBJECT
from sealcheck.session import shared_folder
from sealcheck.sources import documents as SD, events as SE, evidence as SV, portable as SP
from sealcheck.sources.arrays import read_array
from sealcheck.sources.files import list_files
from sealcheck.streaming import events as ST

EVENT_KEY = "operation_id || '/' || sequence"
INVALID = """ev AS (SELECT *, event_id % 29 = 0 AS rel, event_id % 31 = 0 AS zero, event_id % 37 = 0 AS wrong, event_id % 41 = 0 AS extra, event_id % 47 = 0 AS ctl, event_id % 53 = 0 AS orbit FROM event_log),
iv AS (SELECT 'tpch/' || workspace_id || '/' || CASE WHEN rel THEN 'rel' ELSE destination END AS snapshot_id, operation_id, CASE WHEN zero THEN 0 ELSE sequence END AS sequence, type, rel, zero, wrong, extra, ctl, orbit FROM ev)
---
"""


@query("i01_validate_events", INVALID + findings(
    "validate_events", *[(f"'{code}'", "'event'", EVENT_KEY, "NULL", f"iv WHERE {when}") for code, when in (
        ("DESTINATION_NOT_ABSOLUTE", "rel"), ("SEQUENCE_INVALID", "zero"), ("OUTCOME_NOT_ALLOWED", "wrong"), ("METADATA_NOT_ALLOWED", "extra"), ("MESSAGE_INVALID", "ctl"), ("STAGE_UNKNOWN", "orbit"))]))
def validate(m):
    key = F.col("event_id")
    damaged = m.event_log.withColumns({
        "destination": F.when(key % 29 == 0, "rel").otherwise(F.col("destination")), "sequence": F.when(key % 31 == 0, 0).otherwise(F.col("sequence")),
        "outcome": F.when(key % 37 == 0, "ODD").otherwise(F.col("outcome")), "message": F.when(key % 47 == 0, "a\tb").otherwise(F.col("message")),
        "stage": F.when(key % 53 == 0, "orbit").otherwise(F.col("stage")),
        "metadata": F.when(key % 41 == 0, F.map_concat("metadata", F.create_map(F.lit("token"), F.lit("x")))).otherwise(F.col("metadata"))})
    return E.validate_events(damaged)[1]


@query("i02_dedupe_events", "SELECT operation_id, sequence, type, 'first' AS message FROM event_log")
def dedupe(m):
    log = m.event_log.select("operation_id", F.col("sequence").cast("long").alias("sequence"), "type", "event_id")
    times = F.sequence(F.lit(1), F.when(F.col("event_id") % 5 == 0, 3).otherwise(1))
    repeated = log.withColumn("n", F.explode(times)).select("operation_id", "sequence", "type", F.when(F.col("n") == 1, "first").otherwise("later").alias("message"),
                                                           F.struct("n", "event_id").alias("arrival"))
    return E.dedupe_events(repeated).drop("arrival")


@query("i03_order_events", "SELECT operation_id, sequence, type FROM event_log")
def order(m):
    return E.order_events(m.event_log.select("operation_id", F.col("sequence").cast("long").alias("sequence"), "type"))


@query("i04_latest_events", """SELECT connector, workspace_id, destination, operation_id, sequence, type FROM event_log
QUALIFY row_number() OVER (PARTITION BY connector, workspace_id, destination ORDER BY operation_id DESC, sequence DESC) <= 7""")
def latest(m):
    return E.latest_events(m.event_log.select("connector", "workspace_id", "destination", "operation_id", F.col("sequence").cast("long").alias("sequence"), "type"), 7)


@query("i04_latest_events_large", """SELECT connector, workspace_id, operation_id, sequence, type FROM event_log
QUALIFY row_number() OVER (PARTITION BY connector, workspace_id ORDER BY operation_id DESC, sequence DESC) <= 5000""")
def latest_large(m):
    """A limit beyond a thousand over a wider scope is still cut in each task before the shuffle."""
    events = m.event_log.select("connector", "workspace_id", "operation_id", F.col("sequence").cast("long").alias("sequence"), "type")
    return E.latest_events(events, 5000, ["connector", "workspace_id"])


@query("i05_activity", """SELECT connector, workspace_id, destination, count(*) AS recorded, count(*) FILTER (WHERE outcome = 'FAILED') AS failed, arg_max(type, k) AS last_type,
  arg_max(coalesce(outcome, '-'), k) AS last_outcome, max(operation_id) AS last_operation_id, arg_max(sequence, k) AS last_sequence
FROM (SELECT *, operation_id || lpad(CAST(sequence AS VARCHAR), 9, '0') AS k FROM event_log) GROUP BY 1, 2, 3""")
def activity(m):
    return E.activity(m.event_log).withColumns({"last_sequence": F.col("last_sequence").cast("long"), "last_outcome": F.coalesce("last_outcome", F.lit("-"))})


@query("i06_scope_key", "SELECT c_custkey, substr(sha256('v1' || chr(0) || 'tpch' || chr(0) || c_name || chr(0) || '/x/' || c_custkey), 1, 32) AS scope_key FROM customer")
def scope_keys(m):
    return m.read("customer").select("c_custkey", scope_key(F.lit(" tpch\n"), F.concat(F.lit("\t"), "c_name", F.lit(" ")),
                                                            F.concat(F.lit("/x//./"), text("c_custkey"), F.lit("/"))).alias("scope_key"))


STATE = """lg AS (SELECT *, operation_id || lpad(CAST(sequence AS VARCHAR), 9, '0') AS k FROM event_log)
---
SELECT connector, workspace_id, destination, max(operation_id) FILTER (WHERE type LIKE 'operation.%') AS attempt_operation_id, arg_max(sequence, k) FILTER (WHERE type LIKE 'operation.%') AS attempt_sequence,
  arg_max(outcome, k) FILTER (WHERE type LIKE 'operation.%') AS attempt_outcome, coalesce(arg_max(outcome, k) FILTER (WHERE type LIKE 'operation.%') = 'STARTED', FALSE) AS interrupted,
  arg_max(operation_id, k) FILTER (WHERE type = 'operation.completed' AND archive_path IS NOT NULL) AS success_operation_id,
  arg_max(archive_path, k) FILTER (WHERE type = 'operation.completed' AND archive_path IS NOT NULL) AS success_archive_path,
  arg_max(result, k) FILTER (WHERE type = 'verification.recorded') AS verification_result, arg_max(archive_path, k) FILTER (WHERE type = 'verification.recorded') AS verification_archive_path
FROM lg GROUP BY 1, 2, 3"""


@query("i07_project_state", STATE)
def state(m):
    return S.project_state(m.event_log).withColumn("attempt_sequence", F.col("attempt_sequence").cast("long"))


def folder(m, name: str) -> str:
    return shared_folder(m.spark, name)


def write_log(m, damaged: bool = False) -> str:
    """The event log as JSON lines in several files; optionally with lines a reader must refuse."""
    source = F.struct("connector", "workspace_id", "destination").alias("source")
    line = F.to_json(F.struct("schema_version", "type", "operation_id", "sequence", "recorded_at", source, "operation", "stage", "outcome", "message", "metadata"))
    if damaged:
        key = F.col("event_id") % 40
        # An extra key inside the source, blank lines (which are no damage) and version 1 (which is lifted).
        line = F.when(key == 3, F.regexp_replace(line, '"source":[{]', '"source":{"owner":"x",')).when(
            key == 4, F.regexp_replace(line, '"schema_version":2', '"schema_version":1')).otherwise(line)
        line = F.when(key == 5, F.concat(line, F.lit("\n \t"))).otherwise(line)
        line = (F.when(key == 0, F.substring(line, 1, 40)).when(key == 1, F.regexp_replace(line, '"schema_version":2', '"schema_version":3'))
                .when(key == 2, F.regexp_replace(line, '"stage":"scan"', '"stage":"scan","secret":1')).otherwise(line))
    path = folder(m, "log")
    m.event_log.select(line.alias("value")).write.text(path)
    return path


@query("i07_project_state_stream", STATE)
def state_stream(m):
    """The batch projection, reached by a stream over the written log in several micro-batches."""
    target = folder(m, "state")
    stream = SE.stream_events(m.spark, write_log(m), files_per_trigger=2).filter("NOT unreadable")
    ST.run_available(ST.state_stream(stream), target, folder(m, "offsets"))
    return ST.read_merged(m.spark, target).withColumn("attempt_sequence", F.col("attempt_sequence").cast("long"))


@query("i02_dedupe_stream", "SELECT operation_id, sequence, type FROM event_log")
def dedupe_stream(m):
    """Every line written twice, streamed once per position."""
    path, target = write_log(m), folder(m, "deduped")
    m.spark.read.text(path).write.mode("append").text(path)
    stream = SE.stream_events(m.spark, path, files_per_trigger=4).filter("NOT unreadable").select(
        "operation_id", F.col("sequence").cast("long").alias("sequence"), "type")
    ST.run_available(ST.dedupe_stream(stream), target, folder(m, "offsets"), mode="append")
    return ST.read_appended(m.spark, target)


def state_records(m):
    """One state record per order; which columns contradict each other depends on its keys."""
    key, when, customer = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp"), F.col("o_custkey")
    outcome = F.element_at(F.array(*[F.lit(o) for o in R.OUTCOMES]), (key % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return m.read("orders").select(
        text("o_orderkey").alias("scope_key"), F.when(key % 41 == 0, 4).otherwise(3).alias("schema_version"), F.lit("tpch").alias("connector"), F.lit("w").alias("workspace_id"),
        F.when(key % 43 == 0, "rel").otherwise("/d").alias("destination"), when.alias("updated_at"),
        text("o_orderkey").alias("attempt_operation_id"), F.when(key % 47 == 0, "dance").otherwise("backup").alias("attempt_operation"), F.lit("scan").alias("attempt_stage"),
        outcome.alias("attempt_outcome"), when.alias("attempt_started_at"),
        F.when(customer % 3 > 0, F.when(customer % 7 == 0, when - F.expr("INTERVAL 1 HOUR")).otherwise(when)).alias("attempt_ended_at"),
        F.when(customer % 5 < 2, "NETWORK_FAILURE").when(customer % 5 == 2, "BAD_LUCK").alias("attempt_error_reason"),
        F.when(customer % 11 < 5, "busy").alias("attempt_skip_reason"), none.alias("attempt_archive_path"),
        F.when(key % 2 == 0, F.lit("s")).alias("success_operation_id"), F.lit("backup").alias("success_operation"), F.lit("finalize").alias("success_stage"),
        F.when(customer % 13 == 0, "STARTED").otherwise("SUCCEEDED").alias("success_outcome"),
        F.when(customer % 17 == 0, when + F.expr("INTERVAL 1 DAY")).otherwise(when - F.expr("INTERVAL 1 DAY")).alias("success_started_at"),
        F.when(customer % 19 != 0, when + F.expr("INTERVAL 2 DAYS")).alias("success_ended_at"), none.alias("success_error_reason"), none.alias("success_skip_reason"),
        F.when(customer % 23 != 0, "/a").alias("success_archive_path"),
        F.when(key % 3 == 0, F.when(key % 9 == 0, "FINE").otherwise("VERIFIED")).alias("verification_result"), when.alias("verification_at"), F.lit("/a").alias("verification_archive_path"),
        F.when(key % 15 == 0, "sha256:short").otherwise(F.concat(F.lit("sha256:"), F.sha2(text("o_orderkey"), 256))).alias("verification_checksum"))


STATE_RULES = [
    ("VERSION_UNSUPPORTED", "k % 41 = 0"), ("DESTINATION_NOT_ABSOLUTE", "k % 43 = 0"), ("ATTEMPT_OPERATION_UNKNOWN", "k % 47 = 0"), ("ATTEMPT_ENDED_BEFORE_START", "ended AND c % 7 = 0"),
    ("ATTEMPT_STARTED_BUT_ENDED", "o = 'STARTED' AND ended"), ("ATTEMPT_FAILED_WITHOUT_REASON", "o = 'FAILED' AND NOT err"), ("ATTEMPT_SUCCEEDED_WITH_ERROR", "o = 'SUCCEEDED' AND err"),
    ("ATTEMPT_SKIPPED_WITHOUT_END", "o = 'SKIPPED' AND NOT ended"), ("ATTEMPT_SKIPPED_WITH_ERROR", "o = 'SKIPPED' AND err"), ("ATTEMPT_SKIPPED_WITHOUT_REASON", "o = 'SKIPPED' AND c % 11 >= 5"),
    ("ATTEMPT_SKIP_REASON_WITHOUT_SKIP", "o <> 'SKIPPED' AND c % 11 < 5"), ("ATTEMPT_ERROR_REASON_UNKNOWN", "c % 5 = 2"),
    ("SUCCESS_STARTED_BUT_ENDED", "suc AND c % 13 = 0 AND c % 19 <> 0"), ("SUCCESS_NOT_SUCCEEDED", "suc AND c % 13 = 0"), ("SUCCESS_WITHOUT_END", "suc AND c % 19 = 0"),
    ("SUCCESS_WITHOUT_ARCHIVE", "suc AND c % 23 = 0"), ("ATTEMPT_OLDER_THAN_SUCCESS", "suc AND c % 17 = 0"), ("VERIFICATION_RESULT_UNKNOWN", "k % 9 = 0"),
    ("VERIFICATION_CHECKSUM_INVALID", "k % 15 = 0")]


@query("i08_validate_state", """st AS (SELECT CAST(o_orderkey AS VARCHAR) AS snapshot_id, o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 4 WHEN 0 THEN 'STARTED' WHEN 1 THEN 'SUCCEEDED' WHEN 2 THEN 'FAILED' ELSE 'SKIPPED' END AS o,
  o_custkey % 3 > 0 AS ended, o_custkey % 5 < 3 AS err, o_orderkey % 2 = 0 AS suc FROM orders)
---
""" + findings("validate_state", *[(f"'{code}'", "'state'", "snapshot_id", "NULL", f"st WHERE {when}") for code, when in STATE_RULES]))
def validate_state(m):
    return S.validate_state(state_records(m))


@query("i09_archive_condition", """SELECT CAST(doc_id AS VARCHAR) AS scope_key, CASE WHEN doc_id % 31 = 0 THEN '' ELSE '/a/' || doc_id END AS path, CASE WHEN doc_id % 31 = 0 THEN 'UNREADABLE' WHEN doc_id % 7 = 0 THEN 'MISSING'
  WHEN doc_id % 11 = 0 THEN 'UNREADABLE' WHEN doc_id % 5 = 0 THEN 'CHANGED' ELSE 'PRESENT' END AS condition FROM documents""")
def condition(m):
    key, path = F.col("doc_id"), F.concat(F.lit("/a/"), text("doc_id"))
    checksum = digest(F.col("text"))
    recorded = m.read("documents").select(text("doc_id").alias("scope_key"), F.when(key % 31 == 0, "").otherwise(path).alias("path"), checksum.alias("manifest_checksum"))
    current = m.read("documents").filter(key % 7 != 0).select(path.alias("path"), F.when(key % 5 == 0, "changed").otherwise(checksum).alias("manifest_checksum"), (key % 11 != 0).alias("readable"))
    return S.archive_condition(recorded, current)


NOW = "1999-06-01 00:00:00"
STATUS = f"""sc AS (SELECT CAST(o_orderkey AS VARCHAR) AS scope_key, o_orderkey AS k, o_custkey AS c, o_orderdate AS t, o_custkey % 10 = 9 AS nohealth FROM orders),
rs AS (SELECT scope_key, CASE r WHEN 1 THEN CASE WHEN NOT nohealth AND c % 10 = 0 THEN 'health DEGRADED RATE_LIMITED' WHEN NOT nohealth AND c % 10 = 1 THEN 'health UNAVAILABLE RATE_LIMITED' END
  WHEN 2 THEN CASE WHEN NOT nohealth AND c % 13 = 0 THEN 'authentication REJECTED' END
  WHEN 3 THEN CASE k % 16 WHEN 0 THEN 'last attempt interrupted' WHEN 2 THEN 'last attempt failed' WHEN 3 THEN 'last attempt skipped' END
  WHEN 4 THEN CASE WHEN k % 5 = 0 AND k % 25 = 0 THEN 'verification FAILED' END WHEN 5 THEN CASE WHEN k % 5 = 0 AND c % 7 = 0 THEN 'archive MISSING' END
  WHEN 6 THEN CASE WHEN k % 77 = 0 THEN 'notifications CONFIGURATION_INVALID' END ELSE CASE WHEN k % 55 = 0 THEN 'undelivered hook' END END AS reason FROM sc, (VALUES (1), (2), (3), (4), (5), (6), (7)) v(r)),
at AS (SELECT scope_key, string_agg(reason, '; ' ORDER BY reason) AS attention FROM rs GROUP BY 1),
"""


def scope_states(m):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    bare = customer % 10 == 9
    verified = key % 5 == 0
    return m.read("orders").select(
        text("o_orderkey").alias("scope_key"),
        F.when(~bare, F.when(customer % 10 == 0, "DEGRADED").when(customer % 10 == 1, "UNAVAILABLE").when(customer % 10 == 2, "UNKNOWN").otherwise("HEALTHY")).alias("health_state"),
        F.lit("RATE_LIMITED").alias("health_reason"), F.when(~bare, F.col("o_orderdate").cast("timestamp")).alias("health_observed_at"),
        F.when(~bare, F.when(customer % 13 == 0, "REJECTED").when(customer % 13 == 1, "UNKNOWN").otherwise("AUTHENTICATED")).alias("auth_state"),
        F.when(key % 16 == 0, "STARTED").when(key % 16 == 2, "FAILED").when(key % 16 == 3, "SKIPPED").when(key % 16 != 4, "SUCCEEDED").alias("attempt_outcome"),
        F.when(key % 2 == 0, text("o_orderkey")).alias("success_operation_id"),
        F.when(verified, F.when(key % 25 == 0, "FAILED").otherwise("VERIFIED")).alias("verification_result"),
        F.when(customer % 7 == 0, "MISSING").otherwise("PRESENT").alias("archive_condition"), F.when(key % 77 == 0, "CONFIGURATION_INVALID").alias("notification_problem"),
        F.when(key % 55 == 0, F.array(F.lit("hook"))).alias("undelivered"))


SCOPED = STATUS.replace("at AS (", "atn AS (") + """fin AS (SELECT sc.*, coalesce(attention, '') AS attention, nohealth OR c % 10 = 2 OR c % 13 = 1 OR k % 16 = 4 OR (k % 5 <> 0 AND k % 2 = 0) AS unknown FROM sc JOIN atn USING (scope_key)),
sts AS (SELECT scope_key, attention, CASE WHEN NOT nohealth THEN greatest(CAST(epoch(TIMESTAMP '""" + NOW + """') - epoch(t) AS BIGINT), 0) END AS health_age_seconds,
  coalesce(NOT nohealth AND epoch(TIMESTAMP '""" + NOW + """') - epoch(t) > 86400, FALSE) AS health_stale, CASE WHEN attention <> '' THEN 'ATTENTION' WHEN unknown THEN 'UNKNOWN' ELSE 'HEALTHY' END AS status FROM fin)
---
"""


def scope_status(m):
    return S.scope_status(scope_states(m), F.lit(NOW).cast("timestamp"))


@query("i10_scope_status", SCOPED + "SELECT * FROM sts")
def status(m):
    return scope_status(m).withColumn("attention", F.array_join("attention", "; "))


@query("i11_overall_status", SCOPED + "SELECT CASE WHEN (SELECT count(*) FROM events WHERE event_id % 1000 = 999) > 0 THEN 'UNREADABLE' ELSE arg_max(status, CASE status WHEN 'ATTENTION' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END) END AS status, count(*) AS n_scopes, (SELECT count(*) FROM events WHERE event_id % 1000 = 999) AS n_unreadable FROM sts")
def overall(m):
    return S.overall_status(scope_status(m), m.read("events").filter("event_id % 1000 = 999").select("event_id"))


HEALTH = """ob AS (SELECT 'p' || (p_partkey // 6) AS snapshot_id, 'cap_' || (p_partkey % 6) AS id, CASE WHEN p_size % 3 = 0 THEN 'OPTIONAL' ELSE 'REQUIRED' END AS requirement,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'HEALTHY' WHEN p_type = 'PROMO' THEN 'UNAVAILABLE' WHEN p_type = 'SMALL' THEN 'DEGRADED' ELSE 'UNKNOWN' END AS state,
  p_brand AS reason, p_size % 2 = 0 AS retryable FROM part)
---
"""


@query("i12_aggregate_health", HEALTH + sql_aggregate("ob"))
def aggregate(m):
    kind = F.col("p_type")
    rows = m.read("part").select(
        F.concat(F.lit("p"), F.expr("p_partkey div 6").cast("string")).alias("snapshot_id"), F.concat(F.lit("cap_"), (F.col("p_partkey") % 6).cast("string")).alias("id"),
        F.when(F.col("p_size") % 3 == 0, "OPTIONAL").otherwise("REQUIRED").alias("requirement"),
        F.when(kind.isin("ECONOMY", "LARGE", "MEDIUM"), "HEALTHY").when(kind == "PROMO", "UNAVAILABLE").when(kind == "SMALL", "DEGRADED").otherwise("UNKNOWN").alias("state"),
        F.col("p_brand").alias("reason"), (F.col("p_size") % 2 == 0).alias("retryable"))
    return H.aggregate_health(rows, rows.select("snapshot_id").distinct())


KINDS = ["authentication", "rate_limit", "network", "response", "api", "other"]
OPERATIONS = ["list Spaces", "list Tasks", "validate credential", "list Custom Fields"]


def failures(m, kinds=KINDS):
    key = F.col("event_id")
    return m.read("events").filter("event_type = 'error'").select(
        F.lit("s1").alias("snapshot_id"), (key + 1).alias("sequence"), F.element_at(F.array(*[F.lit(o) for o in OPERATIONS]), (F.col("user_id") % 4 + 1).cast("int")).alias("operation"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % len(kinds) + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*[F.lit(c) for c in (400, 401, 403, 404, 500, 503)]), (F.col("user_id") % 6 + 1).cast("int")).alias("status_code"), (key % 5 == 0).alias("cancelled"))


def kind_sql(kinds: list[str]) -> str:
    return f"list_value({', '.join(repr(k) for k in kinds)})[event_id % {len(kinds)} + 1]"


FAILED = f"""fl AS (SELECT event_id + 1 AS sequence, list_value({', '.join(repr(o) for o in OPERATIONS)})[user_id % 4 + 1] AS operation, {kind_sql(KINDS)} AS kind, list_value(400, 401, 403, 404, 500, 503)[user_id % 6 + 1] AS code,
  event_id % 5 = 0 AS cancelled FROM events WHERE event_type = 'error'),
jd AS (SELECT *, CASE WHEN kind = 'authentication' THEN CASE WHEN code IN (401, 403) THEN 'HEALTHY|NONE|false|REJECTED|AUTHENTICATION_REJECTED' ELSE 'UNKNOWN|AUTHENTICATION_REQUIRED|false|REQUIRED|AUTHENTICATION_REQUIRED' END
  WHEN kind = 'rate_limit' THEN 'DEGRADED|RATE_LIMITED|true|AUTHENTICATED|NONE' WHEN kind = 'network' AND cancelled THEN 'UNKNOWN|OPERATION_CANCELLED|false|UNKNOWN|OPERATION_CANCELLED'
  WHEN kind = 'network' THEN 'UNAVAILABLE|NETWORK_FAILURE|true|UNKNOWN|NETWORK_FAILURE' WHEN kind = 'response' THEN 'UNAVAILABLE|UNSUPPORTED_RESPONSE|false|AUTHENTICATED|NONE'
  WHEN kind = 'api' AND code = 404 THEN 'UNAVAILABLE|CAPABILITY_REMOVED|false|AUTHENTICATED|NONE' WHEN kind = 'api' AND code >= 500 THEN 'UNAVAILABLE|UPSTREAM_UNAVAILABLE|true|AUTHENTICATED|NONE'
  WHEN kind = 'api' THEN 'DEGRADED|API_BEHAVIOR_CHANGED|false|AUTHENTICATED|NONE' ELSE 'UNAVAILABLE|UNKNOWN_FAILURE|false|AUTHENTICATED|NONE' END AS j FROM fl),
ps AS (SELECT *, split_part(j, '|', 1) AS hs, split_part(j, '|', 2) AS rn, split_part(j, '|', 3) = 'true' AS rt, operation = 'validate credential' AND kind <> 'authentication' AS us, split_part(j, '|', 4) AS st, split_part(j, '|', 5) AS ar FROM jd),
af AS (SELECT * FROM (VALUES ('list Spaces', 'workspace_data'), ('list Tasks', 'items'), ('list Tasks', 'relationships'), ('list Custom Fields', 'custom_fields')) v(operation, capability))
---
SELECT 's1' AS snapshot_id, sequence, ps.operation, hs AS health_state, rn AS reason, rt AS retryable, CASE WHEN us THEN 'UNKNOWN' ELSE st END AS auth_state, CASE WHEN us THEN rn ELSE ar END AS auth_reason, capability,
  CASE WHEN capability IS NOT NULL THEN 'REQUIRED' END AS requirement FROM ps LEFT JOIN af ON af.operation = ps.operation"""


@query("i13_classify_failures", FAILED)
def classify(m):
    return clickup.classify_failures(failures(m))


SECOND = ["authentication", "forbidden", "not_found", "rate_limit", "network", "response", "api"]


@query("i13_classify_failures_second", f"""fl AS (SELECT event_id + 1 AS sequence, {kind_sql(SECOND)} AS kind, list_value(400, 401, 403, 404, 500, 503)[user_id % 6 + 1] AS code FROM events WHERE event_type = 'error')
---
SELECT sequence, CASE kind WHEN 'authentication' THEN 'HEALTHY' WHEN 'network' THEN 'UNAVAILABLE' WHEN 'api' THEN CASE WHEN code >= 500 THEN 'UNAVAILABLE' ELSE 'DEGRADED' END ELSE 'DEGRADED' END AS health_state,
  CASE kind WHEN 'authentication' THEN 'NONE' WHEN 'forbidden' THEN 'CAPABILITY_REMOVED' WHEN 'not_found' THEN 'CAPABILITY_REMOVED' WHEN 'rate_limit' THEN 'RATE_LIMITED' WHEN 'network' THEN 'NETWORK_FAILURE'
    WHEN 'response' THEN 'UNSUPPORTED_RESPONSE' ELSE CASE WHEN code >= 500 THEN 'UPSTREAM_UNAVAILABLE' ELSE 'API_BEHAVIOR_CHANGED' END END AS reason,
  kind IN ('rate_limit', 'network') OR (kind = 'api' AND code >= 500) AS retryable, CASE WHEN kind = 'authentication' THEN 'REJECTED' WHEN kind IN ('network', 'response', 'api') THEN 'UNKNOWN' ELSE 'AUTHENTICATED' END AS auth_state FROM fl""")
def classify_second(m):
    return notion.classify_failures(failures(m, SECOND)).select("sequence", "health_state", "reason", "retryable", "auth_state")


ARCHIVES = """ar AS (SELECT '/r/' || o_orderkey || CASE o_orderkey % 40 WHEN 1 THEN '.failed' WHEN 2 THEN '.partial-x' ELSE '' END AS path, o_orderkey AS k, o_custkey AS c, o_orderdate AS t, o_custkey % 11 = 0 AS unreadable,
  o_custkey % 13 = 0 AS undated, o_custkey % 17 = 0 AS nosource, CASE o_orderpriority WHEN '1-URGENT' THEN 'VERIFIED' WHEN '2-HIGH' THEN 'VERIFIED_WITH_LIMITATIONS' WHEN '3-MEDIUM' THEN 'INCOMPLETE' WHEN '5-LOW' THEN 'FAILED' END AS result FROM orders),
jd AS (SELECT *, CASE k % 40 WHEN 1 THEN 'FAILED_WORKING_STATE' WHEN 2 THEN 'ABANDONED_WORKING_STATE' ELSE CASE WHEN unreadable THEN 'MANIFEST_UNREADABLE' WHEN undated THEN 'NOT_DATED' WHEN nosource THEN 'SOURCE_UNKNOWN'
  WHEN result IS NULL THEN 'NOT_VERIFIABLE' ELSE 'RECORDED' END END AS outcome FROM ar)
---
"""


def archives(m):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    suffix = F.when(key % 40 == 1, ".failed").when(key % 40 == 2, ".partial-x").otherwise("")
    priority = F.col("o_orderpriority")
    return m.read("orders").select(
        F.concat(F.lit("/r/"), text("o_orderkey"), suffix).alias("path"), F.lit("tpch").alias("connector"),
        F.when(customer % 17 == 0, " ").otherwise(F.concat(F.lit("w"), (customer % 20).cast("string"))).alias("workspace_id"), F.lit("/r").alias("destination"),
        F.when(customer % 13 != 0, F.col("o_orderdate")).alias("completed_at"), (customer % 11 != 0).alias("readable"),
        F.when(priority == "1-URGENT", "VERIFIED").when(priority == "2-HIGH", "VERIFIED_WITH_LIMITATIONS").when(priority == "3-MEDIUM", "INCOMPLETE").when(priority == "5-LOW", "FAILED").alias("result"))


@query("i14_backup_catalogue", ARCHIVES + """SELECT 'tpch' AS connector, 'w' || (c % 20) AS workspace_id, '/r' AS destination, arg_max(path, strftime(t, '%Y%m%d%H%M%S') || path) FILTER (WHERE result LIKE 'VERIFIED%') AS success_archive_path,
  arg_max(path, strftime(t, '%Y%m%d%H%M%S') || path) AS verification_archive_path, arg_max(result, strftime(t, '%Y%m%d%H%M%S') || path) AS verification_result, count(*) AS n_archives,
  count(*) FILTER (WHERE result LIKE 'VERIFIED%') AS n_proven FROM jd WHERE outcome = 'RECORDED' GROUP BY 2""")
def catalogue(m):
    return S.backup_catalogue(archives(m))[0]


@query("i14_catalogue_outcomes", ARCHIVES + "SELECT path, outcome FROM jd")
def catalogue_outcomes(m):
    return S.backup_catalogue(archives(m))[1]


@query("i15_notifications_due", """sb AS (SELECT DISTINCT 'd' || (s_suppkey % 4) AS destination_id, type FROM supplier, (VALUES (0, 'operation.failed'), (1, 'operation.completed'), (2, 'connector.unhealthy'), (3, 'notification.problem')) v(k, type) WHERE s_suppkey % 4 <= k AND s_suppkey % 4 <> 3)
---
SELECT destination_id, e.type, operation_id, sequence, substr(sha256('1' || chr(0) || operation_id || chr(0) || sequence || chr(0) || e.type), 1, 32) AS idempotency_key FROM event_log e JOIN sb ON sb.type = e.type WHERE e.type <> 'notification.problem'""")
def due(m):
    place = F.col("s_suppkey") % 4
    types = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(
        ("operation.failed", "operation.completed", "connector.unhealthy", "notification.problem"))]))
    rows = m.read("supplier").select(place.alias("p"), types.alias("v")).filter("p <= v.k")
    subscriptions = rows.select(F.concat(F.lit("d"), text("p")).alias("destination_id"), F.col("v.t").alias("event_type"), (F.col("p") != 3).alias("enabled"))
    return E.notifications_due(m.event_log.withColumn("sequence", F.col("sequence").cast("long")), subscriptions)


@query("i16_bounded_limitations", """rk AS (SELECT source AS snapshot_id, 'limit ' || doc_id AS limitation, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE doc_id % 9 <> 0)
---
SELECT snapshot_id, position, limitation FROM rk WHERE n <= 32 OR position < 32
UNION ALL SELECT DISTINCT snapshot_id, 32, (n - 31) || ' further limitations are recorded in the archive' FROM rk WHERE n > 32""")
def bounded(m):
    return S.bounded_limitations(m.read("documents").select(F.col("source").alias("snapshot_id"), F.col("doc_id").alias("ordinal"), F.when(
        F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit("limit\t"), text("doc_id"))).alias("limitation")))


@query("i17_validate_health", HEALTH.replace("---\n", "").rstrip() + ",\nag AS (" + sql_aggregate("ob") + """),
hd AS (SELECT snapshot_id, CAST(snapshot_id[2:] AS BIGINT) AS g, state, reason, retryable FROM ag)
---
""" + findings("validate_health", ("'CAPABILITY_REASON_UNKNOWN'", "'capability'", "id", "NULL", "ob"), ("'REASON_UNKNOWN'", "'health'", "snapshot_id", "NULL", "hd WHERE reason LIKE 'Brand%' AND g % 7 <> 0"),
               ("'BASIS_UNKNOWN'", "'health'", "snapshot_id", "NULL", "hd WHERE g % 5 = 0"), ("'TIME_MISSING'", "'health'", "snapshot_id", "NULL", "hd WHERE g % 11 = 0"),
               ("'MESSAGE_INVALID'", "'health'", "snapshot_id", "NULL", "hd WHERE g % 13 = 0"), ("'HEADER_CONFLICTS'", "'health'", "snapshot_id", "NULL", "hd WHERE g % 7 = 0 AND reason <> 'NONE'")))
def validate_health(m):
    kind, key = F.col("p_type"), F.col("p_partkey")
    rows = m.read("part").select(
        F.concat(F.lit("p"), F.expr("p_partkey div 6").cast("string")).alias("snapshot_id"), F.concat(F.lit("cap_"), (key % 6).cast("string")).alias("id"),
        F.when(F.col("p_size") % 3 == 0, "OPTIONAL").otherwise("REQUIRED").alias("requirement"),
        F.when(kind.isin("ECONOMY", "LARGE", "MEDIUM"), "HEALTHY").when(kind == "PROMO", "UNAVAILABLE").when(kind == "SMALL", "DEGRADED").otherwise("UNKNOWN").alias("state"),
        F.col("p_brand").alias("reason"), (F.col("p_size") % 2 == 0).alias("retryable"), F.lit("ok").alias("message"))
    g = F.substring("snapshot_id", 2, 20).cast("long")
    when = F.lit(NOW).cast("timestamp")
    headers = H.aggregate_health(rows, rows.select("snapshot_id").distinct()).select(
        "snapshot_id", "state", F.when(g % 7 == 0, "NONE").otherwise(F.col("reason")).alias("reason"), "retryable", F.lit(1).alias("schema_version"), F.lit("tpch").alias("connector"),
        F.when(g % 5 == 0, "GUESS").otherwise("SCAN").alias("basis"), F.when(g % 11 != 0, when).alias("observed_at"), when.alias("authentication_observed_at"),
        F.when(g % 13 == 0, "").otherwise("m").alias("message"), F.lit("AUTHENTICATED").alias("authentication_state"), F.lit("NONE").alias("authentication_reason"), F.lit("m").alias("authentication_message"))
    return H.validate_health(headers, rows)


@query("i18_attach_verification", """rf AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS scope_key, '/a/' || (c_custkey % 300) AS path FROM customer UNION SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), '/a/' || (c_custkey % 170 + 200) FROM customer)
---
SELECT min(scope_key) AS scope_key, v.path, v.result FROM (SELECT '/a/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'VERIFIED' ELSE 'FAILED' END AS result FROM documents) v JOIN rf ON rf.path = v.path GROUP BY 2, 3""")
def attach(m):
    key = F.col("c_custkey")
    state = m.read("customer").select(F.concat(F.lit("c"), F.lpad(text("c_custkey"), 9, "0")).alias("scope_key"), F.concat(F.lit("/a/"), (key % 300).cast("string")).alias("success_archive_path"),
                                      F.lit(None).cast("string").alias("attempt_archive_path"), F.concat(F.lit("/a/"), (key % 170 + 200).cast("string")).alias("verification_archive_path"))
    verdicts = m.read("documents").select(F.concat(F.lit("/a/"), text("doc_id")).alias("path"), F.when(F.col("doc_id") % 2 == 0, "VERIFIED").otherwise("FAILED").alias("result"))
    return S.attach_verification(verdicts, state)


# --- readers and writers, over data written from the tables

@query("a06_portable_round_trip", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", snapshot_id, count(*) AS n FROM {t} GROUP BY 2" for t in PORTABLE_COLUMNS))
def round_trip(m):
    """All tables written and read back: nothing lost, and snapshots stay apart."""
    names = list(PORTABLE_COLUMNS)
    path = folder(m, "portable")
    SP.write_portable({name: m.tables[name] for name in names}, path)
    stored = SP.read_portable(m.spark, path, names)
    parts = [stored[n].groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "snapshot_id", "n") for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("a07_read_events", """SELECT operation_id, sequence, type, destination, coalesce(archive_path, '') AS archive_path, 2 AS version, 0 AS unreadable FROM event_log WHERE event_id % 40 > 3
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM event_log WHERE event_id % 40 <= 3""")
def read_events(m):
    events, unreadable = SE.read_events(m.spark, write_log(m, damaged=True))
    good = events.select("operation_id", F.col("sequence").cast("long").alias("sequence"), "type", "destination",
                         F.coalesce(F.try_element_at("metadata", F.lit("archive_path")), F.lit("")).alias("archive_path"), F.col("schema_version").alias("version"), F.lit(0).cast("long").alias("unreadable"))
    none = F.lit(None).cast("string")
    return good.unionByName(unreadable.select(none.alias("operation_id"), none.cast("long").alias("sequence"), none.alias("type"), none.alias("destination"),
                                              none.alias("archive_path"), none.cast("int").alias("version"), "unreadable"))


@query("a08_stream_events", "SELECT operation_id, sequence, type FROM event_log WHERE event_id % 40 > 3")
def stream_events(m):
    target = folder(m, "streamed")
    stream = SE.stream_events(m.spark, write_log(m, damaged=True), files_per_trigger=3).filter("NOT unreadable").select(
        "operation_id", F.col("sequence").cast("long").alias("sequence"), "type")
    ST.run_available(stream, target, folder(m, "offsets"), mode="append")
    return ST.read_appended(m.spark, target)


@query("a09_file_inventory", """SELECT 'events' AS snapshot_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS total_bytes, TRUE AS all_hashed FROM (
  SELECT concat_ws('|', event_id, user_id, event_type, props) AS line FROM events)""")
def inventory(m):
    """Files of one written folder: the bytes add up whatever the number of files."""
    path = folder(m, "files")
    m.read("events").select(F.concat_ws("|", text("event_id"), text("user_id"), "event_type", "props")).write.text(f"{path}/events")
    listed = SV.file_inventory(m.spark, path)
    return listed.groupBy("snapshot_id").agg(F.sum("bytes").alias("total_bytes"), F.bool_and(F.col("checksum").rlike("^sha256:[0-9a-f]{64}$")).alias("all_hashed"))


PLANTED = ["AKIA", "sk_live", "BEGIN RSA", "ghp_", "the password", "ündü", "zzzzz"]


@query("b12_secret_scan", f"""SELECT concat('s', doc_id % 97) AS snapshot_id, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS total_bytes,
  bool_or({" OR ".join(f"contains(coalesce(text, ''), '{secret}')" for secret in PLANTED)}) AS has_secret FROM documents GROUP BY 1""")
def secret_scan(m):
    """Documents as files of 97 archives, all searched for all secrets in one pass over the landed bytes."""
    path = folder(m, "secrets")
    m.read("documents").select(F.concat(F.lit("s"), (F.col("doc_id") % 97).cast("string")).alias("archive"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("archive").text(path)
    listed = SV.file_inventory(m.spark, path, PLANTED).withColumn("snapshot_id", F.substring_index("snapshot_id", "=", -1))
    return listed.groupBy("snapshot_id").agg(F.sum("bytes").alias("total_bytes"), F.bool_or("has_secret").alias("has_secret"))


def document_files(m, name: str, rows, document) -> DataFrame:
    """(path, bytes) of JSON documents of about 2000 rows each, written by many tasks, one document a file."""
    path = folder(m, name)
    parts = -(-rows.count() // 2000)
    packed = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(max(parts, 1))).alias("part")).agg(document.alias("value"))
    # Files of one folder: a folder for each would be a task for each when they are listed.
    packed.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return list_files(m.spark, path)


@query("a01_read_ledger", """SELECT l_orderkey * 10 + l_linenumber AS sequence, 'get "' || l_returnflag || '" },{ [' AS operation, '/x\\' || l_partkey || '"]},' AS path,
  CAST(l_linenumber AS INTEGER) AS attempt, CASE WHEN l_linestatus = 'F' THEN 'SUCCESS' ELSE 'FAILED_ATTEMPT' END AS outcome, CAST(l_suppkey AS BIGINT) AS bytes FROM lineitem""")
def ledger_rows(m):
    """Every line as a request attempt with quotes, brackets and backslashes in its texts, each ledger read in ranges of 64 KiB."""
    rows = m.read("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("sequence"), F.concat(F.lit('get "'), "l_returnflag", F.lit('" },{ [')).alias("operation"),
        F.concat(F.lit("/x\\"), text("l_partkey"), F.lit('"]},')).alias("path"), F.col("l_linenumber").cast("int").alias("attempt"),
        F.when(F.col("l_linestatus") == "F", "SUCCESS").otherwise("FAILED_ATTEMPT").alias("outcome"), F.col("l_suppkey").cast("long").alias("bytes"))
    files = document_files(m, "ledgers", rows, F.to_json(F.collect_list(F.struct(*rows.columns))))
    return read_array(files, LEDGER, range_bytes=1 << 16).select(*rows.columns)


@query("a03_read_source_objects", "SELECT snapshot_id, type, id, parent_type, parent_id, composite FROM source_index")
def object_files(m):
    """The whole object index through documents of another array, counts and the index, read in ranges of 64 KiB."""
    rows = m.index.select("snapshot_id", "type", "id", "parent_type", "parent_id", "composite")
    objects = F.collect_list(F.struct("snapshot_id", "type", "id", "parent_type", "parent_id", "composite"))
    other = F.array(*[F.struct(F.lit(c).alias("id"), F.lit('source_objects":[{"').alias("note")) for c in ("a", "b")])
    document = F.to_json(F.struct(F.lit(2).alias("schema_version"), other.alias("capabilities"), F.struct(F.array(F.lit(1), F.lit(2)).alias("n")).alias("counts"),
                                  objects.alias("source_objects"), F.array(F.lit("]")).alias("tail")))
    schema = StructType([*SOURCE_OBJECT.fields, StructField("snapshot_id", StringType())])
    return read_array(document_files(m, "inventories", rows, document), schema, "source_objects", 1 << 16).select(*rows.columns)


@query("a02_join_evidence", """SELECT page_id + 1 AS sequence, CASE WHEN page_id % 13 = 0 THEN 'PATH_UNSAFE' WHEN page_id % 7 = 0 THEN 'BODY_MISSING' WHEN page_id % 5 = 0 THEN 'BYTES_DIFFER' WHEN page_id % 3 = 0 THEN 'CHECKSUM_DIFFERS' ELSE 'SOUND' END AS outcome FROM pages""")
def evidence(m):
    """Pages as response bodies: unsafe paths, missing, resized and altered ones are told from sound ones."""
    key, html = F.col("page_id"), F.col("html")
    path = F.when(key % 13 == 0, F.concat(F.lit("../"), text("page_id"))).otherwise(F.concat(F.lit("p/"), text("page_id"), F.lit(".html")))
    none = F.lit(None).cast("string")
    ledger = m.read("pages").select(
        F.lit("s1").alias("snapshot_id"), (key + 1).alias("sequence"), F.lit("get").alias("operation"), F.lit("GET").alias("method"), F.col("url").alias("path"), none.alias("query"),
        F.lit("SUCCESS").alias("outcome"), path.alias("raw_path"), (F.octet_length(html) + F.when(key % 5 == 0, 1).otherwise(0)).cast("long").alias("bytes"),
        F.when(key % 3 == 0, "sha256:0").otherwise(digest(html)).alias("sha256"))
    bodies = m.read("pages").filter(key % 7 != 0).select(F.lit("s1").alias("snapshot_id"), path.alias("raw_path"), F.octet_length(html).cast("long").alias("got_bytes"), html.cast("binary").alias("content"))
    sound, found = SV.join_evidence(ledger, bodies)
    return sound.select("sequence", F.lit("SOUND").alias("outcome")).unionByName(found.select(F.col("detail").cast("long").alias("sequence"), F.col("code").alias("outcome")))


@query("a03_source_objects", "SELECT snapshot_id, type, id, parent_type, parent_id, composite FROM source_index")
def objects(m):
    """The object index through its document form. Documents are keyed by 48 bits of a hash, so each stays small."""
    packed = m.index.groupBy("snapshot_id", F.substring(F.sha2(F.concat_ws("/", "type", "id"), 256), 1, 12).alias("part")).agg(
        F.collect_list(F.struct("type", "id", "parent_type", "parent_id", "composite")).alias("source_objects"))
    return SV.source_objects(packed)


@query("a10_write_documents", DOCUMENTS)
def write_documents(m):
    """Every record document, written as parts in order and read back."""
    path = folder(m, "documents")
    SD.write_documents(O.record_documents(clean(m)), path)
    stored = m.spark.read.schema("snapshot_id string, collection_id string, record_id string, path string, part bigint, content string").json(path)
    return stored.withColumn("content", F.sha2("content", 256))
