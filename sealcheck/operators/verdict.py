"""Findings to checks, checks to one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sealcheck import rules as R
from sealcheck.operators.findings import union_all

CHECK_KEY = ["snapshot_id", "check_name"]


def check_table(snapshots: DataFrame) -> DataFrame:
    """Every named check for every snapshot, so that silence is never read as a pass."""
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.lit(position).alias("check_order"))
                     for position, name in enumerate(R.CHECKS, 1)])
    return snapshots.select("snapshot_id", F.explode(rows).alias("c")).select("snapshot_id", "c.*")


def finding_status(code: Column) -> Column:
    """What one finding means for its check: a limitation, missing data, or a failure."""
    return (F.when(code.startswith("UNPROVEN_"), R.UNPROVEN).when(code == "UNRESOLVED_ATTACHMENT", R.INCOMPLETE)
            .otherwise(R.FAIL))


def collect_checks(findings: DataFrame, limit: int = R.MAX_FINDINGS) -> DataFrame:
    """The first `limit` findings of each check in order, and one row stating how many more there are.

    Only findings of the check's own status are listed. The rank filter is applied before the shuffle, so a
    check with a huge number of findings sends at most `limit` rows per task.
    """
    message = F.concat_ws(" ", "code", "entity", "key", "detail")
    ranked = findings.withColumns({"message": message, "_status": finding_status(F.col("code"))})
    severity = {R.UNPROVEN: 1, R.INCOMPLETE: 2, R.FAIL: 3}
    level = F.lit(0)
    for status, value in severity.items():
        level = F.when(F.col("_status") == status, value).otherwise(level)
    ranked = ranked.withColumn("_level", level)
    # One counting pass keeps every level apart, so the worst level and its count need no second scan.
    totals = ranked.groupBy(*CHECK_KEY).agg(F.max("_level").alias("_worst"), *[
        F.count_if(F.col("_level") == n).alias(f"_n{n}") for n in (1, 2, 3)])
    totals = totals.select(*CHECK_KEY, "_worst", F.when(F.col("_worst") == 3, F.col("_n3")).when(
        F.col("_worst") == 2, F.col("_n2")).otherwise(F.col("_n1")).alias("_n"))
    window = Window.partitionBy(*CHECK_KEY, "_level").orderBy("message")
    top = ranked.select(*CHECK_KEY, "_level", "message").withColumn("position", F.row_number().over(window)).filter(
        F.col("position") <= limit)
    kept = top.join(totals.select(*CHECK_KEY, F.col("_worst").alias("_level")), [*CHECK_KEY, "_level"]).select(
        *CHECK_KEY, F.col("position").cast("long").alias("position"), "message")
    more = totals.filter(F.col("_n") > limit).select(
        *CHECK_KEY, F.lit(limit + 1).cast("long").alias("position"),
        F.concat(F.lit("... and "), (F.col("_n") - limit).cast("string"), F.lit(" further findings")).alias("message"))
    return kept.unionByName(more)


def gate(snapshots: DataFrame, availability: DataFrame) -> DataFrame:
    """Whether each check could be evaluated, from the inputs that were readable.

    `availability` has (snapshot_id, input, readable); an input without a row counts as unreadable.
    """
    needs = F.array(*[F.struct(F.lit(check).alias("check_name"), F.lit(need).alias("input"))
                      for check, inputs in R.CHECK_INPUTS for need in inputs])
    wanted = snapshots.select("snapshot_id", F.explode(needs).alias("n")).select("snapshot_id", "n.*")
    known = availability.groupBy("snapshot_id", "input").agg(F.bool_and("readable").alias("readable"))
    blocked = wanted.join(known, ["snapshot_id", "input"], "left").groupBy(*CHECK_KEY).agg(
        F.bool_or(~F.coalesce("readable", F.lit(False))).alias("blocked"))
    return check_table(snapshots).join(blocked, CHECK_KEY, "left").select(
        *CHECK_KEY, "check_order", (~F.coalesce("blocked", F.lit(False))).alias("evaluated"))


def check_results(gated: DataFrame, findings: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Status of every check. A check that was not run or whose input was missing is NOT_EVALUATED."""
    counted = findings.groupBy(*CHECK_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(finding_status(F.col("code")) == R.FAIL).alias("failed"),
        F.bool_or(finding_status(F.col("code")) == R.INCOMPLETE).alias("incomplete"))
    ran = F.col("check_name").isin(run) if run is not None else F.lit(True)
    joined = gated.join(counted, CHECK_KEY, "left")
    status = (F.when(~F.col("evaluated") | ~ran, R.NOT_EVALUATED).when(F.col("failed"), R.FAIL)
              .when(F.col("incomplete"), R.INCOMPLETE).when(F.col("n") > 0, R.UNPROVEN).otherwise(R.PASS))
    return joined.select("snapshot_id", "check_name", "check_order", status.alias("status"),
                         F.coalesce("n", F.lit(0)).alias("n_findings"))


def verdict(checks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One result per snapshot; a snapshot without checks has failed."""
    status = F.col("status")
    folded = checks.groupBy("snapshot_id").agg(
        F.bool_or(status.isin(R.FAIL, R.NOT_EVALUATED)).alias("failed"),
        F.bool_or(status == R.INCOMPLETE).alias("incomplete"), F.bool_or(status == R.UNPROVEN).alias("limited"))
    joined = snapshots.select("snapshot_id").join(folded, "snapshot_id", "left")
    return joined.select("snapshot_id", F.when(F.coalesce("failed", F.lit(True)), R.FAILED).when(
        F.col("incomplete"), R.INCOMPLETE).when(F.col("limited"), R.LIMITED).otherwise(R.VERIFIED).alias("result"))


INTERNAL_ONLY = "integrity is established from archived evidence only; the live source was not read again"
UNPROVEN_SUMMARY = {
    "source_consistency_scope": "point-in-time consistency is not claimed because the extraction was not atomic",
    "access_scope_completeness": "whether the credential could see the whole workspace is not established",
    "limitation_preservation": "some source capabilities are not fully supported",
    "custom_field_evidence": "some custom field semantics cannot be proven from the archive",
}


def limitations(manifest_limitations: DataFrame, capabilities: DataFrame, checks: DataFrame) -> DataFrame:
    """Distinct limitations of each snapshot: stated, from capabilities, and unproven checks."""
    snapshots = checks.select("snapshot_id").distinct()
    general = snapshots.select("snapshot_id", F.lit(INTERNAL_ONLY).alias("limitation"))
    unsupported = capabilities.filter("state <> 'SUPPORTED'").select("snapshot_id", F.concat(
        F.lit("capability "), "name", F.lit(" remains "), "state", F.lit(": "), F.coalesce("note", F.lit(""))).alias("limitation"))
    unavailable = capabilities.filter("id IS NOT NULL AND availability <> 'AVAILABLE'").select("snapshot_id", F.concat(
        F.lit("capability "), "name", F.lit(" was "), "availability", F.lit(" for this archive")).alias("limitation"))
    summary = F.col("check_name")
    for name, text in UNPROVEN_SUMMARY.items():
        summary = F.when(F.col("check_name") == name, text).otherwise(summary)
    unproven = checks.filter(F.col("status") == R.UNPROVEN).select("snapshot_id", summary.alias("limitation"))
    return union_all([general, manifest_limitations.select("snapshot_id", "limitation"), unsupported, unavailable,
                      unproven]).distinct()
