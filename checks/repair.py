"""Cleansing with quarantine, comparison, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import ROW_ID
from assayer.functions.formats import FORMATS
from assayer.operators import cleanse, compare, crossfield as x, drift
from assayer.operators.cleanse import Step
from assayer.plans import reports
from checks.base import CUST_ALL, as_of, check, per_column, view, with_views
from checks.profiling import BASE, NUMERIC_BASE, OTHER_BASE

AT = "2024-06-01 00:00:00"
CUST, ORD = with_views("cust"), with_views("ord")
cust = lambda s, d: view(s, d, "cust")
ord_ = lambda s, d: view(s, d, "ord")
PAN = FORMATS["pan"]

STEPS = [
    Step("segment", "Clean", pattern=r"[.]", dimension="Standardisation"),
    Step("segment", "Replace", pattern=r"(\w)\s+(\w)", replace=r"\1-\2", dimension="Standardisation"),
    Step("segment", "Case", case="UPPERCASE", dimension="Standardisation"),
    Step("segment", "Validate", pattern=r"[A-Z]+$", name="Segment word", dimension="Validation"),
    Step("segment", "ManualReview", name="Look at it"),
    Step("code", "Validate", pattern=PAN, name="PAN format", dimension="Validation"),
    Step("email", "Length", length_mode="Range", min_length=1, max_length=21, name="Mail length", dimension="Validation"),
    Step("name", "Extract", pattern=r"\d+", name="Digits of name", dimension="Validation"),
]
REST = ", ".join(c for c in CUST_ALL if c not in ("segment", "name"))
FOLD = CUST.rstrip() + f""", a AS (SELECT * REPLACE (upper(regexp_replace(regexp_replace(segment, '[.]', '', 'g'), '(\\w)\\s+(\\w)', '\\1-\\2', 'g')) AS segment) FROM cust),
 b AS (SELECT *, CASE WHEN NOT coalesce(regexp_matches(segment, '^(?:[A-Z]+$)'), false) THEN 'Segment word - Does not match' WHEN NOT coalesce(regexp_matches(code, '{PAN}'), false) THEN 'PAN format - Does not match' WHEN length(email) < 1 OR length(email) > 21 THEN 'Mail length - Length check failed' END AS r1, array_to_string(regexp_extract_all(name, '\\d+'), '') AS digits FROM a),
 f AS (SELECT _row_id, segment, {REST}, CASE WHEN r1 IS NULL THEN coalesce(digits, '') ELSE name END AS name, coalesce(r1, CASE WHEN coalesce(digits, '') = '' THEN 'Digits of name - No matches' END) AS reason,
  CASE WHEN r1 LIKE 'Segment%' THEN 'segment' WHEN r1 LIKE 'PAN%' THEN 'code' WHEN r1 LIKE 'Mail%' THEN 'email' WHEN r1 IS NULL AND coalesce(digits, '') = '' THEN 'name' END AS col FROM b) """
COLUMNS = "_row_id, segment, " + REST + ", name"

check("C07_apply_clean", lambda s, d: cleanse.apply(cust(s, d), STEPS, AT)[0], FOLD + f"SELECT {COLUMNS} FROM f WHERE reason IS NULL")
check("C07_apply_quarantine", lambda s, d: cleanse.apply(cust(s, d), STEPS, AT)[1], FOLD + f"SELECT {COLUMNS}, reason AS \"Rejection_Reason\", col AS \"Rejected_Column\", '{AT}' AS \"Rejected_At\" FROM f WHERE reason IS NOT NULL")
check("C08_apply_all_summary", lambda s, d: cleanse.summary(cust(s, d), STEPS), FOLD + "SELECT col AS \"column\", reason, count(*) AS rejected FROM f WHERE reason IS NOT NULL GROUP BY ALL")
check("C08_apply_dimension", lambda s, d: cleanse.apply(cust(s, d), STEPS, AT, dimension="Standardisation")[0].select(ROW_ID, "segment", "name"), FOLD + "SELECT a._row_id, a.segment, cust.name FROM a JOIN cust USING (_row_id)")
check("C08_apply_rule", lambda s, d: cleanse.apply(cust(s, d), [STEPS[5]], AT)[1].select(ROW_ID, "code", "Rejection_Reason"), CUST + f"SELECT _row_id, code, 'PAN format - Does not match' AS \"Rejection_Reason\" FROM cust WHERE NOT coalesce(regexp_matches(code, '{PAN}'), false)")


def single(step, column):
    return lambda s, d: cleanse.apply(cust(s, d), [step], AT)[0].select(ROW_ID, column)


def rejects(step, column):
    return lambda s, d: cleanse.apply(cust(s, d), [step], AT)[1].select(ROW_ID, column, "Rejection_Reason")


check("C01_clean", single(Step("email", "Clean", pattern="[^a-z]"), "email"), CUST + "SELECT _row_id, regexp_replace(email, '[^a-z]', '', 'g') AS email FROM cust")
check("C02_replace", single(Step("email", "Replace", pattern=r"user(\d+)@", replace=r"\1$ at "), "email"), CUST + "SELECT _row_id, regexp_replace(email, 'user(\\d+)@', '\\1$ at ', 'g') AS email FROM cust")
check("C03_extract", single(Step("email", "Extract", pattern=r"\d"), "email"), CUST + "SELECT _row_id, array_to_string(regexp_extract_all(email, '\\d'), '') AS email FROM cust WHERE regexp_matches(email, '\\d')")
check("C03_extract_rejects", rejects(Step("email", "Extract", pattern=r"\d", name="digits"), "email"), CUST + "SELECT _row_id, '' AS email, 'digits - No matches' AS \"Rejection_Reason\" FROM cust WHERE NOT coalesce(regexp_matches(email, '\\d'), false)")
check("C04_validate_rejects", rejects(Step("amount_text", "Validate", pattern=r"-?\d+", name="number"), "amount_text"), CUST + "SELECT _row_id, amount_text, 'number - Does not match' AS \"Rejection_Reason\" FROM cust WHERE NOT coalesce(regexp_matches(amount_text, '^(?:-?\\d+)'), false)")
check("C04_validate_number", lambda s, d: cleanse.apply(cust(s, d), [Step("acctbal", "Validate", pattern=r"^\d+(\.\d+)?$")], AT)[0].select(ROW_ID, "acctbal"), CUST + "SELECT _row_id, acctbal FROM cust WHERE acctbal >= 0")
check("C05_case_upper", single(Step("segment", "Case", case="UPPERCASE"), "segment"), CUST + "SELECT _row_id, upper(segment) AS segment FROM cust")
check("C05_case_lower", single(Step("segment", "Case", case="lowercase"), "segment"), CUST + "SELECT _row_id, lower(segment) AS segment FROM cust")
check("C05_case_title", single(Step("segment", "Case", case="Title Case"), "segment"), CUST + "SELECT _row_id, array_to_string(list_transform(regexp_extract_all(segment, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS segment FROM cust")
for mode, step, condition in [
    ("exact", Step("code", "Length", length_mode="Exact", exact_length=10, name="len"), "length(code) = 10"), ("minimum", Step("code", "Length", length_mode="Minimum", min_length=6, name="len"), "coalesce(length(code) >= 6, true)"),
    ("maximum", Step("name", "Length", length_mode="Maximum", max_length=5, name="len"), "coalesce(length(name) <= 5, true)"), ("range", Step("email", "Length", length_mode="Range", min_length=13, max_length=20, name="len"), "length(email) BETWEEN 13 AND 20"),
]:
    check(f"C06_length_{mode}", lambda s, d, q=step: cleanse.apply(cust(s, d), [q], AT)[0].select(ROW_ID, q.column), CUST + f"SELECT _row_id, {step.column} FROM cust WHERE coalesce({condition}, false)")

check("C09_preview", lambda s, d: cleanse.preview(cust(s, d), Step("code", "Validate", pattern=PAN)),
      CUST + f"SELECT _row_id, code AS before, CASE WHEN regexp_matches(code, '{PAN}') THEN code ELSE '[REJECT]' END AS after, CASE WHEN regexp_matches(code, '{PAN}') THEN 'Valid' ELSE 'Rejected' END AS status FROM cust WHERE code IS NOT NULL ORDER BY _row_id LIMIT 10")
check("C10_preview_failing", lambda s, d: cleanse.preview_failing(cust(s, d), Step("code", "Validate", pattern=PAN)).select(ROW_ID, "name", "code", "email", "_before", "_after", "_status"),
      CUST + f"SELECT _row_id, coalesce(name, '') AS name, coalesce(code, '') AS code, email, code AS _before, '[REJECT]' AS _after, 'Rejected' AS _status FROM cust WHERE NOT coalesce(regexp_matches(code, '{PAN}'), false) ORDER BY _row_id LIMIT 20")
check("C10_preview_transform", lambda s, d: cleanse.preview_failing(cust(s, d), Step("segment", "Case")).select(ROW_ID, "_before", "_after", "_status"), CUST + "SELECT _row_id, segment AS _before, upper(segment) AS _after, 'Transform' AS _status FROM cust ORDER BY _row_id LIMIT 20")
check("C10_failing_total", lambda s, d: cleanse.count_failing(cust(s, d), Step("code", "Validate", pattern=PAN)), CUST + f"SELECT count(*) FILTER (NOT coalesce(regexp_matches(code, '{PAN}'), false)) AS total_failing, count(*) AS total_rows FROM cust")


def versions(s, d, moves):
    """Two cleansing steps stored as versions, then undo or reset."""
    from assayer.sources.stores import VersionStore
    from checks.tables import scratch

    store = VersionStore(s, scratch(s, "versions"))
    store.start(cust(s, d))
    for step in (STEPS[5], STEPS[6]):
        store.commit(*cleanse.apply(store.working(), [step], AT), step.label)
    for move in moves:
        getattr(store, move)()
    rejected = store.rejected()
    lost = rejected.count() if rejected is not None else 0
    return store.working().agg(F.count(F.lit(1)).alias("rows")).withColumn("rejected", F.lit(lost).cast("bigint")).withColumn("step", F.lit(store.current_step()))


BADPAN, BADMAIL = f"NOT coalesce(regexp_matches(code, '{PAN}'), false)", "length(email) < 1 OR length(email) > 21"
check("C12_versions", lambda s, d: versions(s, d, []), CUST + f"SELECT count(*) FILTER (NOT ({BADPAN} OR {BADMAIL})) AS rows, count(*) FILTER ({BADPAN} OR {BADMAIL}) AS rejected, 2 AS step FROM cust")
check("C12_undo", lambda s, d: versions(s, d, ["undo"]), CUST + f"SELECT count(*) FILTER (NOT {BADPAN}) AS rows, count(*) FILTER ({BADPAN}) AS rejected, 1 AS step FROM cust" .replace("NOT NOT", ""))
check("C13_reset", lambda s, d: versions(s, d, ["reset"]), CUST + "SELECT count(*) AS rows, 0 AS rejected, 0 AS step FROM cust")

PRESENCE = x.conditional_presence("priority", "status", ["F"], statement="priority must be present when status is F")
MISSING = "(lower(trim(status)) = 'f' AND (priority IS NULL OR trim(priority) = ''))"
check("C14_drop_kept", lambda s, d: x.fix(ord_(s, d), PRESENCE, "drop", AT)[0].select(ROW_ID, "status", "priority"), ORD + f"SELECT _row_id, status, priority FROM ord WHERE NOT {MISSING} OR {MISSING} IS NULL")
check("C14_drop_quarantine", lambda s, d: x.fix(ord_(s, d), PRESENCE, "drop", AT)[1].select(ROW_ID, "Rejection_Reason", "Rejected_Column"),
      ORD + f"SELECT _row_id, 'Cross-field · priority must be present when status is F — drop' AS \"Rejection_Reason\", 'priority + status' AS \"Rejected_Column\" FROM ord WHERE {MISSING}")
TUPLE = x.composite_unique("custkey", "status", "priority")
check("C14_deduplicate_kept", lambda s, d: x.fix(ord_(s, d), TUPLE, "deduplicate", AT)[0].select(ROW_ID, "custkey", "status", "priority"),
      ORD + "SELECT _row_id, custkey, status, priority FROM ord QUALIFY row_number() OVER (PARTITION BY custkey, status, priority ORDER BY _row_id) = 1")
FIVE = x.composite_unique("custkey", "status", "priority", "shipped", "orderkey")
check("C14_deduplicate_five_columns", lambda s, d: x.fix(ord_(s, d), FIVE, "deduplicate", AT)[0].select(ROW_ID, "orderkey"), ORD + "SELECT _row_id, orderkey FROM ord")
check("C14_deduplicate_quarantine", lambda s, d: x.fix(ord_(s, d), TUPLE, "deduplicate", AT)[1].select(ROW_ID), ORD + "SELECT _row_id FROM ord QUALIFY row_number() OVER (PARTITION BY custkey, status, priority ORDER BY _row_id) > 1")
check("D33_rejection_reasons", lambda s, d: reports.rejection_reasons(cleanse.apply(cust(s, d), STEPS, AT)[1]), FOLD + "SELECT reason AS \"Rejection_Reason\", count(*) AS rows FROM f WHERE reason IS NOT NULL GROUP BY ALL ORDER BY rows DESC, reason LIMIT 15")

# M: compare
BOTH = with_views("cust", "cust_after")
SHARED = ["acctbal", "custkey", "email", "name", "nationkey", "segment"]
before = lambda s, d: cust(s, d).drop("code", "since", "amount_text")
after = lambda s, d: view(s, d, "cust_after")
JOIN = "FROM cust o JOIN cust_after c USING (_row_id)"
DIFF = lambda c: f"(o.{c} IS DISTINCT FROM c.{c})"
check("J02_identity_join", lambda s, d: compare.membership_counts(before(s, d), after(s, d)),
      BOTH + "SELECT count(*) FILTER (o._row_id IS NOT NULL AND c._row_id IS NOT NULL) AS matched, count(*) FILTER (c._row_id IS NULL) AS only_before, count(*) FILTER (o._row_id IS NULL) AS only_after FROM cust o FULL JOIN cust_after c ON o._row_id = c._row_id")
check("M01_stats", lambda s, d: compare.stats(before(s, d), after(s, d)),
      BOTH + f"SELECT (SELECT count(*) FROM cust) AS original_rows, (SELECT count(*) FROM cust_after) AS modified_rows, (SELECT count(*) FROM cust_after) - (SELECT count(*) FROM cust) AS row_change, 6 AS original_columns, 7 AS modified_columns, 1 AS column_change, ({' + '.join(f'count(*) FILTER {DIFF(c)}' for c in SHARED)}) AS modified_cells, '{','.join(SHARED)}' AS common_columns, 'added' AS columns_added, '' AS columns_removed {JOIN}")
check("M02_modified_cells", lambda s, d: compare.stats(before(s, d), after(s, d)).select("modified_cells"), BOTH + f"SELECT ({' + '.join(f'count(*) FILTER {DIFF(c)}' for c in SHARED)}) AS modified_cells {JOIN}")
CHANGES = "SELECT '{c}' AS \"column\", count(*) FILTER (o.{c} IS DISTINCT FROM c.{c}) AS changed, count(*) FILTER (o.{c} IS NOT NULL AND c.{c} IS NULL) AS nulled, count(*) FILTER (o.{c} IS NULL AND c.{c} IS NOT NULL) AS filled, count(*) FILTER (o.{c} IS DISTINCT FROM c.{c} AND lower(o.{c}::VARCHAR) = lower(c.{c}::VARCHAR)) AS standardised " + JOIN
check("M03_column_changes", lambda s, d: compare.column_changes(before(s, d), after(s, d)),
      BOTH + "SELECT *, CASE WHEN nulled = changed THEN 'Cleared' WHEN filled = changed THEN 'Backfilled' WHEN standardised = changed THEN 'Standardised' WHEN standardised > changed / 2 THEN 'Standardised (mostly)' ELSE 'Modified' END AS change_type FROM (" + per_column(CHANGES, SHARED) + ") WHERE changed > 0")
check("M03_change_samples", lambda s, d: compare.change_samples(before(s, d), after(s, d)),
      BOTH + per_column("SELECT '{c}' AS \"column\", _row_id, o.{c}::VARCHAR AS before, c.{c}::VARCHAR AS after " + JOIN + " WHERE o.{c} IS DISTINCT FROM c.{c} ORDER BY _row_id LIMIT 3", SHARED))
CELL = "SELECT _row_id, CASE WHEN NOT in_c THEN 'removed' WHEN NOT in_o THEN 'added' ELSE 'normal' END AS row_status, '{c}' AS \"column\", o_{c}::VARCHAR AS original, c_{c}::VARCHAR AS modified, CASE WHEN NOT in_c THEN 'removed' WHEN NOT in_o THEN 'added' WHEN o_{c} IS DISTINCT FROM c_{c} THEN 'modified' END AS cell_flag FROM w"
check("M04_cell_diff", lambda s, d: compare.cell_diff(before(s, d), after(s, d), ["name", "segment", "nationkey"], 5, 40),
      BOTH.rstrip() + ", w AS (SELECT coalesce(o._row_id, c._row_id) AS _row_id, o._row_id IS NOT NULL AS in_o, c._row_id IS NOT NULL AS in_c, o.name AS o_name, c.name AS c_name, o.segment AS o_segment, c.segment AS c_segment, o.nationkey AS o_nationkey, c.nationkey AS c_nationkey FROM cust o FULL JOIN cust_after c ON o._row_id = c._row_id ORDER BY 1 LIMIT 40 OFFSET 5) " + per_column(CELL, ["name", "segment", "nationkey"]))

# G: drift of the edited table against a baseline of the first
NUMS = ["custkey", "nationkey", "acctbal"]


def alerts(s, d):
    shifted = after(s, d).withColumn("nationkey", F.col("nationkey") + 50)
    return drift.detect(drift.baseline(shifted), drift.baseline(before(s, d)), null_threshold=2.0).select(
        "column", "type", F.round("baseline", 3).alias("baseline"), F.round("current", 3).alias("current"))


STATS = "SELECT '{c}' AS \"column\", (count(*) - count({c})) * 100.0 / count(*) AS nulls, count(DISTINCT {c}) * 100.0 / count(*) AS uniq, {m} FROM {t}"
stat = lambda t, c: STATS.replace("{t}", t).replace("{m}", f"avg({c}) AS mean, stddev_samp({c}) AS std" if c in NUMS + ["added"] else "NULL AS mean, NULL AS std").replace("{c}", c)
check("G01_drift_alerts", alerts, BOTH.rstrip() + ", shifted AS (SELECT * REPLACE (nationkey + 50 AS nationkey) FROM cust_after), b AS (" + " UNION ALL ".join(stat("cust", c) for c in SHARED) + "), n AS (" + " UNION ALL ".join(stat("shifted", c) for c in SHARED + ["added"]) + """)
 SELECT "column", 'new_column' AS type, NULL AS baseline, NULL AS current FROM n WHERE "column" NOT IN (SELECT "column" FROM b) UNION ALL SELECT "column", 'missing_column', NULL, NULL FROM b WHERE "column" NOT IN (SELECT "column" FROM n)
 UNION ALL SELECT "column", 'null_rate', round(b.nulls, 3), round(n.nulls, 3) FROM b JOIN n USING ("column") WHERE abs(n.nulls - b.nulls) > 2 UNION ALL SELECT "column", 'cardinality', round(b.uniq, 3), round(n.uniq, 3) FROM b JOIN n USING ("column") WHERE abs(n.uniq - b.uniq) > 10
 UNION ALL SELECT "column", 'mean_shift', round(b.mean, 3), round(n.mean, 3) FROM b JOIN n USING ("column") WHERE b.std > 0 AND abs(n.mean - b.mean) > 2 * b.std""")


def saved_baseline(s, d):
    """Save two baselines, replace one, list, load and delete."""
    from assayer.sources.stores import BaselineStore
    from checks.tables import scratch

    store = BaselineStore(s, scratch(s, "baselines"))
    store.save("first", drift.baseline(before(s, d)))
    store.save("second", drift.baseline(after(s, d)))
    store.save("first", drift.baseline(after(s, d)))
    newest = store.list().first()["name"]
    store.delete("second")
    return store.load("first").agg(F.count(F.lit(1)).alias("columns"), F.max("row_count").alias("rows")).withColumn("newest", F.lit(newest)).withColumn("left", F.lit(store.list().count()).cast("bigint"))


check("K11_baseline_store", saved_baseline, BOTH + "SELECT 7 AS columns, count(*) AS rows, 'first' AS newest, 1 AS \"left\" FROM cust_after")
