"""Completeness of a paginated extraction, judged over the landed pages.

Page rows carry snapshot_id, operation, scope (one traversal), page_no, raw_path and body. A traversal may hold
a large share of all pages, so every rule is a partial aggregate or a join on (scope, page_no), never a window
over a whole traversal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.functions.ids import packed, unpacked
from sealcheck.functions.jsonfn import canonical_elements, exact_numbers, unwrapped
from sealcheck.operators.findings import coded, finding, union_findings
from sealcheck.session import cut_lineage
from sealcheck.sources.files import spread

SCOPE = ["snapshot_id", "scope"]


def explode_pages(pages: DataFrame, field: str, required: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(elements, findings): one row per array element as JSON text; a missing or null required array is a finding.

    `exact` keeps number literals as written, at the price of a pass through Python; there a body that is no JSON
    and an element that is none are findings of their own, and the other elements of the page are kept. Pages are dealt
    to all tasks, parsed once and written, so neither result parses them again.
    """
    kept = pages.drop("body").columns
    if not exact:
        parsed = pages.withColumn("_items", F.transform(F.from_json(exact_numbers(F.col("body")), f"struct<`{field}`:array<string>>")[field], unwrapped))
        elements = parsed.select(*kept, F.posexplode("_items").alias("position", "element"))
        missing = parsed.filter(F.col("_items").isNull()) if required else parsed.filter(F.lit(False))
        return elements, union_findings([finding(missing, "explode_pages", "REQUIRED_ARRAY_MISSING", field, F.col("raw_path"))])
    parsed = spread(pages, "raw_path", "body").withColumn("_parsed", canonical_elements(F.col("body"), F.lit(field)))
    # A page without elements keeps one row, without a position.
    rows = cut_lineage(parsed.select(
        *kept, F.coalesce("_parsed.readable", F.lit(False)).alias("_readable"), F.col("_parsed.items").isNull().alias("_absent"),
        F.posexplode_outer("_parsed.items").alias("position", "element")))
    elements = rows.filter("position IS NOT NULL").drop("_readable", "_absent")
    missing = rows.filter("_readable AND _absent") if required else rows.filter(F.lit(False))
    return elements.filter("element IS NOT NULL"), union_findings([
        finding(missing, "explode_pages", "REQUIRED_ARRAY_MISSING", field, F.col("raw_path")),
        finding(rows.filter("NOT _readable"), "explode_pages", "BODY_NOT_JSON", field, F.col("raw_path")),
        finding(elements.filter("element IS NULL"), "explode_pages", "ELEMENT_NOT_JSON", field, F.concat_ws("#", "raw_path", "position"))])


def first_or_conflict(frame: DataFrame, key: list[str], attrs: list[str], order: str) -> DataFrame:
    """First observation per key and whether repeats disagree with it."""
    packed = F.struct(*attrs)
    grouped = frame.groupBy(*key).agg(
        F.min_by(packed, F.col(order)).alias("_first"), F.count(F.lit(1)).alias("n_seen"),
        (~F.min(packed).eqNullSafe(F.max(packed))).alias("conflict"))
    return grouped.select(*key, *[F.col("_first")[name].alias(name) for name in attrs], "n_seen", "conflict")


def duplicates_across_pages(frame: DataFrame, key: list[str]) -> DataFrame:
    """Keys seen more than once within one traversal."""
    return frame.groupBy(*SCOPE, *key).agg(F.count(F.lit(1)).alias("n_seen")).filter("n_seen > 1")


def numbered_termination(pages: DataFrame) -> DataFrame:
    """Numbered pages start at 0, have no gap or repeat, and end with exactly one empty page. Needs `n_items`."""
    summary = pages.groupBy(*SCOPE).agg(
        F.min("page_no").alias("low"), F.max("page_no").alias("high"), F.count(F.lit(1)).alias("n"),
        F.max(F.struct("page_no", "n_items"))["n_items"].alias("last_items"))
    repeated = pages.groupBy(*SCOPE, "page_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    early = pages.filter("n_items = 0").join(summary.select(*SCOPE, "high"), SCOPE).filter("page_no < high")
    before = pages.select(*SCOPE, (F.col("page_no") + 1).alias("page_no")).distinct()
    gaps = pages.filter("page_no > 0").select(*SCOPE, "page_no").distinct().join(before, [*SCOPE, "page_no"], "left_anti")
    check = "page_termination"
    return union_findings([
        finding(summary.filter("low <> 0"), check, "FIRST_PAGE_MISSING", F.col("scope"), F.col("low")),
        finding(summary.filter("last_items > 0"), check, "NOT_TERMINATED", F.col("scope"), F.col("high")),
        finding(repeated, check, "PAGE_REPEATED", F.col("scope"), F.col("page_no")),
        finding(early, check, "PAGE_AFTER_END", F.col("scope"), F.col("page_no")),
        finding(gaps, check, "PAGE_GAP", F.col("scope"), F.col("page_no"))])


def cursor_termination(pages: DataFrame) -> DataFrame:
    """Cursor pages: `has_more` needs a cursor, no cursor repeats, and the last page has no more.

    Needs `has_more` and `next_cursor`.
    """
    from sealcheck.functions.text import is_blank
    last = pages.groupBy(*SCOPE).agg(F.max(F.struct("page_no", "has_more"))["has_more"].alias("has_more"),
                                     F.max("page_no").alias("page_no"))
    repeated = (pages.filter(F.col("has_more") & ~is_blank(F.col("next_cursor")))
                .groupBy(*SCOPE, "next_cursor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    check = "page_termination"
    return union_findings([
        finding(pages.filter(F.col("has_more") & is_blank(F.col("next_cursor"))), check, "CURSOR_MISSING",
                F.col("scope"), F.col("page_no")),
        finding(repeated, check, "CURSOR_REPEATED", F.col("scope"), F.col("next_cursor")),
        finding(last.filter("has_more"), check, "NOT_TERMINATED", F.col("scope"), F.col("page_no"))])


def chained_termination(pages: DataFrame) -> DataFrame:
    """Pages that start after the last row of the page before, until an empty page.

    Needs `start`, `start_id` (the request), `last_date`, `last_id` (the last row returned) and `n_items`.
    """
    previous = pages.select(*SCOPE, (F.col("page_no") + 1).alias("page_no"), F.col("last_date").alias("want_date"),
                            F.col("last_id").alias("want_id"), F.lit(True).alias("has_previous"))
    chained = pages.join(previous, [*SCOPE, "page_no"], "left")
    broken = chained.filter((F.col("page_no") > 0) & ~(
        F.coalesce("has_previous", F.lit(False)) & F.col("start").eqNullSafe(F.col("want_date"))
        & F.col("start_id").eqNullSafe(F.col("want_id"))))
    last = pages.groupBy(*SCOPE).agg(F.max(F.struct("page_no", "n_items"))["n_items"].alias("n_items"), F.max("page_no").alias("page_no"))
    check = "page_termination"
    return union_findings([
        finding(broken, check, "CHAIN_BROKEN", F.col("scope"), F.col("page_no")),
        finding(pages.filter("page_no = 0 AND (start IS NOT NULL OR start_id IS NOT NULL)"), check,
                "FIRST_PAGE_NOT_AT_START", F.col("scope"), F.col("page_no")),
        finding(last.filter("n_items > 0"), check, "NOT_TERMINATED", F.col("scope"), F.col("page_no"))])


def declared_vs_returned(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents (snapshot_id, parent_id, declared) whose declared number of children was not returned."""
    counted = children.groupBy("snapshot_id", "parent_id").agg(F.count(F.lit(1)).alias("returned"))
    return (parents.join(counted, ["snapshot_id", "parent_id"], "left")
            .withColumn("returned", F.coalesce("returned", F.lit(0)))
            .filter("declared <> returned").select("snapshot_id", "parent_id", "declared", "returned"))


def list_vs_detail(listed: DataFrame, detail: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where the detail view contradicts the list view, or only one of the two exists."""
    def short(frame: DataFrame, column: str) -> Column:
        return packed(column) if dict(frame.dtypes)[column] == "string" else F.col(column)

    left, right = (frame.select("snapshot_id", short(frame, "id").alias("id"), F.lit(True).alias(f"_{side}"), *[short(frame, c).alias(f"{side}_{c}") for c in columns])
                   for frame, side in ((listed, "l"), (detail, "d")))
    both = left.join(right, ["snapshot_id", "id"], "full")
    rules = [(F.col("_d").isNull(), "DETAIL_MISSING"), (F.col("_l").isNull(), "LIST_MISSING")]
    rules += [(F.col("_l") & F.col("_d") & ~F.col(f"l_{c}").eqNullSafe(F.col(f"d_{c}")), f"{c.upper()}_DIFFERS")
              for c in columns]
    return coded(both, "list_vs_detail", rules, "record", unpacked("id") if dict(both.dtypes)["id"] == "binary" else F.col("id"))


def truncation_limits(pages: DataFrame) -> DataFrame:
    """A limitation per traversal the source itself reported as incomplete. Needs `status_type`, `status_reason`."""
    from sealcheck.functions.text import or_else
    cut = pages.filter("status_type = 'incomplete'").groupBy(*SCOPE).agg(
        F.min_by(or_else(F.col("status_reason"), F.lit("query result limit reached")), "page_no").alias("reason"))
    return cut.select(*SCOPE, "reason", F.concat(
        F.lit("Source "), "scope", F.lit(" returned more rows than one query can page through ("), "reason",
        F.lit("); not all of its rows are archived.")).alias("limitation"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Attempts, successes, failures and retries; any unknown outcome counts as a failure."""
    failed = F.col("outcome") == "FAILED_ATTEMPT"
    return ledger.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("outcome") == "SUCCESS").alias("successful_responses"),
        F.count_if(F.coalesce(F.col("outcome") != "SUCCESS", F.lit(True))).alias("failed_attempts"),
        F.count_if(failed & F.coalesce("retrying", F.lit(False))).alias("retried_attempts"))


SUMMARY = ["attempts", "successful_responses", "failed_attempts", "retried_attempts"]


def ledger_contiguity(ledger: DataFrame, run: DataFrame) -> DataFrame:
    """Sequence is 1..n without gap or repeat, outcomes are resolved, and the summary equals the run record.

    Joins on (snapshot_id, sequence): one snapshot may hold a third of all attempts.
    """
    key = ["snapshot_id", "sequence"]
    seen = ledger.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = seen.select("snapshot_id", (F.col("sequence") + 1).alias("sequence"))
    gaps = seen.filter("sequence > 1").join(before, key, "left_anti")
    counted = ledger_summary(ledger).select("snapshot_id", *[F.col(c).alias(f"got_{c}") for c in SUMMARY])
    compared = run.select("snapshot_id", *SUMMARY).join(counted, "snapshot_id", "left")
    unresolved = ledger.filter(F.coalesce(~F.col("outcome").isin("SUCCESS", "FAILED_ATTEMPT"), F.lit(True)))
    check = "ledger_contiguity"
    return union_findings([
        finding(gaps, check, "SEQUENCE_GAP", "ledger", F.col("sequence")),
        finding(seen.filter("n > 1"), check, "SEQUENCE_REPEATED", "ledger", F.col("sequence")),
        finding(seen.filter("sequence < 1"), check, "SEQUENCE_OUT_OF_RANGE", "ledger", F.col("sequence")),
        finding(unresolved, check, "UNRESOLVED_OUTCOME", "ledger", F.col("sequence"), F.col("outcome")),
        coded(compared, check, [(F.col(c) != F.coalesce(f"got_{c}", F.lit(0)), f"{c.upper()}_DIFFERS")
                                for c in SUMMARY], "run", F.col("snapshot_id"))])


def required_membership(links: DataFrame, containing: str, endpoints: list[str]) -> DataFrame:
    """Links listed on a record that do not name that record as an endpoint."""
    named: Column = F.lit(False)
    for endpoint in endpoints:
        named = named | F.col(containing).eqNullSafe(F.col(endpoint))
    return links.filter(~named)
