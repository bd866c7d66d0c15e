"""Recovery report: what an archive proves, and what must not be claimed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealcheck import rules as R
from sealcheck.operators.verdict import finding_status


def _exploded(snapshots: DataFrame, rows: list[dict]) -> DataFrame:
    packed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])
    return snapshots.select("snapshot_id", F.explode(packed).alias("r")).select("snapshot_id", "r.*")


def recovery_claims(snapshots: DataFrame, checks: DataFrame) -> DataFrame:
    """Nine claims; each is proven only if every check it rests on passed. A check that did not run blocks."""
    rows = [{"claim_order": n, "claim": claim, "based_on": check, "check_pos": pos}
            for n, (claim, _, needed) in enumerate(R.CLAIMS, 1) for pos, check in enumerate(needed)]
    wanted = _exploded(snapshots, rows)
    joined = wanted.join(checks.select("snapshot_id", F.col("check_name").alias("based_on"), "status"),
                         ["snapshot_id", "based_on"], "left")
    blocked = F.when(F.col("status").isNull(), F.concat("based_on", F.lit(" was not run"))).when(
        F.col("status") != R.PASS, F.concat("based_on", F.lit(" is "), "status"))
    # At most two checks per claim, so the list is bounded.
    grouped = joined.groupBy("snapshot_id", "claim_order", "claim").agg(
        F.bool_and(F.coalesce(F.col("status") == R.PASS, F.lit(False))).alias("proven"),
        F.array_sort(F.collect_list(F.when(blocked.isNotNull(), F.struct("check_pos", blocked.alias("why"))))).alias("why"))
    reason = F.array_join(F.transform("why", lambda w: w["why"]), " and ")
    return grouped.select("snapshot_id", F.col("claim_order").cast("long").alias("claim_order"), "claim", "proven",
                          F.nullif(reason, F.lit("")).alias("reason"))


def claim_wording() -> dict[str, str]:
    return {claim: text for claim, text, _ in R.CLAIMS}


def content_statement(reconciled: DataFrame, checks: DataFrame) -> DataFrame:
    """Non-zero entity counts as one sentence, proven only if the counts are.

    The list is bounded by the connector's vocabulary of kinds.
    """
    held = reconciled.filter("archived <> 0 OR expected <> 0").groupBy("snapshot_id").agg(F.array_sort(F.collect_list(
        F.struct("entity", F.concat_ws(" ", F.col("archived").cast("string"), F.translate("entity", "_", " "))
                 .alias("part")))).alias("parts"))
    words = F.transform("parts", lambda p: p["part"])
    joined = F.when(F.size(words) == 1, words[0]).otherwise(F.concat(
        F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(words, -1)))
    rows = [{"based_on": c, "check_pos": n} for n, c in enumerate(R.CONTENT_CHECKS)]
    status = _exploded(held.select("snapshot_id"), rows).join(
        checks.select("snapshot_id", F.col("check_name").alias("based_on"), "status"), ["snapshot_id", "based_on"], "left")
    blocking = status.filter(F.coalesce(F.col("status") != R.PASS, F.lit(True))).groupBy("snapshot_id").agg(
        F.min_by(F.concat("based_on", F.lit(" is "), F.coalesce("status", F.lit("NOT_RUN"))), "check_pos").alias("reason"))
    return held.join(blocking, "snapshot_id", "left").select(
        "snapshot_id", F.concat(F.lit("The archive holds "), joined, F.lit(".")).alias("statement"),
        F.col("reason").isNull().alias("proven"), "reason")


def coverage(reconciled: DataFrame) -> DataFrame:
    return reconciled.select("snapshot_id", "entity", "expected", "archived", "unresolved", "status")


MEANING = {
    "SUPPORTED": "within scope; its data was collected",
    "PARTIAL": "only partly represented; do not treat as fully recoverable",
    "UNSUPPORTED": "not archived; reachable at the source but not implemented",
    "UNAVAILABLE": "not archived; the source interface does not expose enough",
    "UNKNOWN": "cannot be assessed; absence here is no evidence of absence at the source",
    "FAILED": "collection failed; nothing is archived or proven",
}
UNRECOGNISED = "unrecognised state; treat as not recoverable"
EVIDENCE = {  # (state, verdict) -> what this archive proves
    ("SUPPORTED", R.VERIFIED): "COPY_VERIFIED", ("SUPPORTED", R.LIMITED): "COPY_VERIFIED",
    ("SUPPORTED", R.INCOMPLETE): "ARCHIVE_INCOMPLETE", ("SUPPORTED", R.FAILED): "VERIFICATION_FAILED",
    ("PARTIAL", R.VERIFIED): "SUBSET_VERIFIED", ("PARTIAL", R.LIMITED): "SUBSET_VERIFIED",
    ("PARTIAL", R.INCOMPLETE): "SUBSET_INCOMPLETE", ("PARTIAL", R.FAILED): "SUBSET_FAILED",
}


def capability_report(capabilities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Meaning of each capability's state and what this archive proves about it; the two are kept apart."""
    joined = capabilities.join(verdicts, "snapshot_id")
    meaning = F.lit(UNRECOGNISED)
    for state, text in MEANING.items():
        meaning = F.when(F.col("state") == state, text).otherwise(meaning)
    evidence = F.lit("NOT_ARCHIVED")
    for (state, result), text in EVIDENCE.items():
        partial_legacy = F.col("id").isNotNull() if state == "PARTIAL" else F.lit(True)
        evidence = F.when((F.col("state") == state) & (F.col("result") == result) & partial_legacy, text).otherwise(evidence)
    evidence = F.when(F.col("id").isNotNull() & (F.col("availability") != "AVAILABLE"),
                      F.concat(F.lit("AVAILABILITY_"), "availability")).otherwise(evidence)
    return joined.select("snapshot_id", "id", "name", "state", meaning.alias("meaning"), evidence.alias("evidence"))


def attachment_summary(snapshots: DataFrame, reconciled: DataFrame, checks: DataFrame) -> DataFrame:
    counts = reconciled.filter("entity = 'attachments'").select(
        "snapshot_id", "expected", F.col("archived").alias("retrieved"), "unresolved")
    status = checks.filter("check_name = 'attachment_integrity'").select("snapshot_id", "status")
    return snapshots.select("snapshot_id").join(counts, "snapshot_id", "left").join(status, "snapshot_id", "left").select(
        "snapshot_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("expected", "retrieved", "unresolved")],
        F.coalesce("status", F.lit("NOT_RUN")).alias("integrity"))


def unresolved_attachments(manifest_attachments: DataFrame) -> DataFrame:
    return manifest_attachments.filter("status <> 'RETRIEVED'").select(
        "snapshot_id", "source_id", "filename", "expected_size",
        F.coalesce("error", F.lit("no reason recorded")).alias("reason"))


def report_discrepancies(declared: DataFrame, checks: DataFrame, findings: DataFrame) -> DataFrame:
    """What the manifest discloses, and every finding of each check that neither passed nor is unproven.

    Takes the findings themselves, not their shortened listing, so nothing is cut. A check without a finding of its
    own status (one that could not be evaluated) is stated once.
    """
    stated = declared.select("snapshot_id", "kind", "source_id", "message", F.lit("manifest").alias("origin"))
    bad = checks.filter(~F.col("status").isin(R.PASS, R.UNPROVEN)).select("snapshot_id", "check_name", "status")
    own = findings.select("snapshot_id", "check_name", finding_status(F.col("code")).alias("status"),
                          F.concat_ws(" ", "code", "entity", "key", "detail").alias("m"))
    listed = bad.join(own, ["snapshot_id", "check_name", "status"], "left")
    found = listed.select("snapshot_id", F.upper("check_name").alias("kind"), F.lit(None).cast("string").alias("source_id"),
                          F.coalesce("m", F.concat("check_name", F.lit(" is "), "status")).alias("message"),
                          F.lit("verification").alias("origin"))
    return stated.unionByName(found)


def must_not_claim(snapshots: DataFrame, verdicts: DataFrame, manifest: DataFrame, capabilities: DataFrame,
                   attachments: DataFrame, report_items: DataFrame, checks: DataFrame) -> DataFrame:
    """Things the archive does not support claiming, in fixed order, each stated once."""
    atomic = manifest.select("snapshot_id", "atomic", F.lit(True).alias("has_manifest"))
    external = report_items.filter("kind LIKE 'RELATIONSHIP\\\\_%' AND kind <> 'RELATIONSHIP_RESOLVED'").select(
        "snapshot_id").distinct().withColumn("external", F.lit(True))
    reconciled = checks.filter("check_name = 'source_object_reconciliation'").select(
        "snapshot_id", (F.col("status") == R.PASS).alias("all_there"))
    flags = (snapshots.select("snapshot_id").join(verdicts, "snapshot_id", "left").join(atomic, "snapshot_id", "left")
             .join(attachments.select("snapshot_id", "unresolved"), "snapshot_id", "left")
             .join(external, "snapshot_id", "left").join(reconciled, "snapshot_id", "left"))
    never = F.lit(True)
    passed = F.coalesce(F.col("result").isin(R.VERIFIED, R.LIMITED), F.lit(False))
    rules = [
        (10, "ARCHIVE_IS_PROVEN_SOURCE", ~passed),
        (20, "POINT_IN_TIME", F.coalesce(~F.col("atomic"), F.lit(False))),
        (30, "ANY_CONTENT", F.col("has_manifest").isNull()),
        (40, "EXECUTABLE_FIELD_SEMANTICS", never), (50, "REPRODUCES_SOURCE_APPLICATION", never),
        (70, "UNRESOLVED_ATTACHMENTS_PRESERVED", F.coalesce(F.col("unresolved") > 0, F.lit(False))),
        (80, "EVERY_LINK_ENDPOINT_ARCHIVED", F.coalesce("external", F.lit(False))),
        (90, "EVERYTHING_OBSERVED_IS_ARCHIVED", ~F.coalesce("all_there", F.lit(False))),
        (100, "SOURCE_TODAY", never)]
    codes = F.filter(F.array(*[F.when(when, F.struct(F.lit(n).alias("position"), F.lit(code).alias("claim")))
                               for n, code, when in rules]), lambda c: c.isNotNull())
    fixed = flags.select("snapshot_id", F.explode(codes).alias("c")).select("snapshot_id", "c.*")
    limited = capabilities.filter("state <> 'SUPPORTED'").select(
        "snapshot_id", F.lit(60).alias("position"), F.concat_ws(" ", F.lit("CAPABILITY"), F.coalesce("id", "name"), "state").alias("claim"))
    return fixed.unionByName(limited).groupBy("snapshot_id", "claim").agg(
        F.min("position").cast("long").alias("position"))


VERDICT_SENTENCE = {
    R.VERIFIED: "integrity is proven within the supported scope",
    R.LIMITED: "integrity is proven within the supported scope; source limitations remain",
    R.INCOMPLETE: "not a complete recovery source; expected data is missing",
    R.FAILED: "the archive cannot be proven intact; do not rely on it",
}


def conclusion(verdicts: DataFrame, checks: DataFrame, attachments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Verdict sentence, check outcomes, unresolved attachments, and the lag between snapshot and seal."""
    outcome = checks.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("status") == R.PASS).alias("n_established"),
        # Bounded by the 20 named checks.
        F.array_sort(F.collect_list(F.when(~F.col("status").isin(R.PASS, R.UNPROVEN), F.struct("check_order", "check_name"))))
        .alias("missed"))
    names = F.transform("missed", lambda c: c["check_name"])
    lag = F.unix_timestamp("archive_completed_at") - F.unix_timestamp("source_snapshot_completed_at")
    sentence = F.lit(None).cast("string")
    for result, text in VERDICT_SENTENCE.items():
        sentence = F.when(F.col("result") == result, text).otherwise(sentence)
    return (verdicts.join(outcome, "snapshot_id", "left").join(attachments.select("snapshot_id", "unresolved"), "snapshot_id", "left")
            .join(manifest.select("snapshot_id", "archive_completed_at", "source_snapshot_completed_at"), "snapshot_id", "left")
            .select("snapshot_id", "result", sentence.alias("sentence"), "n_checks", "n_established",
                    F.array_join(names, ", ").alias("not_established"), "unresolved", lag.alias("lag_seconds"),
                    F.coalesce(lag < 0, F.lit(False)).alias("lag_unexplained")))
