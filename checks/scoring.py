"""Six-dimension scorecard, detail reports, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.formats import FORMATS, Glossary, registry
from assayer.operators import crossfield as x, rules as r
from assayer.plans import dashboard, reports, scorecard
from checks.base import AS_OF, CUST_ALL, CUST_NUMBERS, CUST_TEXT, WS, as_of, check, per_column, view, with_views

GLOSSARY = Glossary({
    "custkey": {"semantic_type": "numeric_id", "recommended": True},
    "name": {"semantic_type": "free_text_name", "recommended": True},
    "code": {"semantic_type": "PAN", "recommended": True},
    "email": {"semantic_type": "email"},
    "segment": {"semantic_type": "enum code"},
    "since": {"semantic_type": "date", "regex": r"^(19|20)\d{2}-\d{2}-\d{2}$"},
    "amount_text": {"semantic_type": "amount"},
})
CUST, ORD = with_views("cust"), with_views("ord")
KIND = {"custkey": "numeric_id", "name": "free_text_name", "code": "pan", "email": "email", "segment": "enum_code", "since": "date", "amount_text": "amount"}
KEYS = ["custkey", "name", "code"]
PATTERN = {"code": FORMATS["pan"], "email": FORMATS["email"], "since": GLOSSARY["since"]["regex"]}
none_or = lambda value: f"'{value}'" if value else "NULL"
cust = lambda s, d: view(s, d, "cust")

SCORE_COMPLETE = "SELECT 'Completeness' AS dimension, round((" + " + ".join(f"count({c})" for c in CUST_ALL) + f") * 1.0 / (count(*) * {len(CUST_ALL)}), 3) AS score, count(*) FILTER (" + " OR ".join(f"{c} IS NULL" for c in CUST_ALL) + ") AS records_impacted FROM cust"


def one(scores):
    return scores.select("dimension", F.round("score", 3).alias("score"), "records_impacted")


check("D01_completeness_score", lambda s, d: one(scorecard.completeness(scorecard.field_counts(cust(s, d), GLOSSARY), scorecard.rows_with_any_null(cust(s, d)))), CUST + SCORE_COMPLETE)

FILL = "count({c}) * 1.0 / count(*)"
FIELD = "SELECT '{c}' AS \"column\", count(*) AS total, count({c}) AS filled, count(*) - count({c}) AS blank, " + FILL + " AS rate FROM cust"
META = "(VALUES " + ", ".join(f"('{c}', {none_or(KIND.get(c))}, {str(c in KEYS).lower()})" for c in CUST_ALL) + ') AS m("column", semantic_type, is_cde)'
STATUS = "CASE WHEN rate >= 0.999 THEN 'Complete' WHEN rate <= 0 THEN 'Empty' WHEN rate < 0.5 THEN 'Critical' WHEN rate < 0.9 THEN 'Low' WHEN rate < 0.95 AND is_cde THEN 'Watch' ELSE 'Acceptable' END"
FIELDS_SQL = CUST.rstrip() + ", f AS (SELECT * FROM (" + per_column(FIELD, CUST_ALL) + f") JOIN {META} USING (\"column\")) "
check("D02_completeness_fields", lambda s, d: reports.completeness_fields(cust(s, d), GLOSSARY),
      FIELDS_SQL + f'SELECT "column", total, filled, blank, round(rate, 4) AS fill_rate, {STATUS} AS status, semantic_type, is_cde, row_number() OVER (ORDER BY round(rate, 4), "column") AS rank FROM f')
check("D02_completeness_buckets", lambda s, d: reports.completeness_buckets(reports.completeness_fields(cust(s, d), GLOSSARY)),
      FIELDS_SQL + "SELECT CASE WHEN round(rate, 4) >= 1 THEN 'Complete (100%)' WHEN rate >= 0.95 THEN 'Acceptable (95-99%)' WHEN rate >= 0.5 THEN 'Low (50-94%)' WHEN rate > 0 THEN 'Critical (<50%)' ELSE 'Empty (0%)' END AS bucket, count(*) AS fields FROM f GROUP BY ALL")
check("D02_completeness_summary", lambda s, d: reports.completeness_summary(reports.completeness_fields(cust(s, d), GLOSSARY)),
      FIELDS_SQL + "SELECT count(*) AS total_fields, max(total) AS rows, round(sum(filled) * 1.0 / sum(total), 4) AS overall_fill_rate, count(*) FILTER (is_cde) AS cde_count, round(sum(filled) FILTER (is_cde) * 1.0 / sum(total) FILTER (is_cde), 4) AS cde_fill_rate FROM f")
check("D02_blank_samples", lambda s, d: reports.blank_samples(cust(s, d)), CUST + per_column("SELECT '{c}' AS \"column\", _row_id FROM cust WHERE {c} IS NULL ORDER BY _row_id LIMIT 5", CUST_ALL))

VALID = " + ".join(f"count(*) FILTER (regexp_matches({c}, '{p}'))" for c, p in PATTERN.items())
CHECKED = " + ".join(f"count({c})" for c in PATTERN)
SCORE_VALID = f"SELECT 'Validation' AS dimension, round(({VALID}) * 1.0 / ({CHECKED}), 3) AS score, ({CHECKED}) - ({VALID}) AS records_impacted FROM cust"
check("D03_validation_score", lambda s, d: one(scorecard.validation(scorecard.field_counts(cust(s, d), GLOSSARY))), CUST + SCORE_VALID)

VFIELD = "SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER ({c} IS NOT NULL AND trim({c}) <> '') AS with_value, count(*) FILTER (trim({c}) <> '' AND regexp_matches({c}, '{p}')) AS valid FROM cust"
VSQL = CUST.rstrip() + ", v AS (" + " UNION ALL ".join(VFIELD.replace("{c}", c).replace("{p}", p) for c, p in PATTERN.items()) + ") "
VROWS = "SELECT \"column\", CASE \"column\" WHEN 'code' THEN 'pan' WHEN 'email' THEN 'email' ELSE 'date' END AS semantic_type, with_value AS records_with_value, valid, round(valid * 1.0 / total, 4) AS valid_pct, with_value - valid AS invalid, round((with_value - valid) * 1.0 / total, 4) AS invalid_pct, total - with_value AS blank, round((total - with_value) * 1.0 / total, 4) AS blank_pct, round(valid * 1.0 / with_value, 4) AS validity_rate FROM v"
check("D04_validation_fields", lambda s, d: reports.validation_fields(cust(s, d), GLOSSARY), VSQL + VROWS)
check("D04_validation_summary", lambda s, d: reports.validation_summary(reports.validation_fields(cust(s, d), GLOSSARY)),
      VSQL + "SELECT count(*) AS typed_columns, sum(valid)::BIGINT AS valid_values, sum(with_value - valid)::BIGINT AS invalid_values, sum(total - with_value)::BIGINT AS blank_values, round(sum(valid) * 1.0 / sum(with_value), 4) AS overall_validity_rate FROM v")
check("D04_invalid_samples", lambda s, d: reports.invalid_samples(cust(s, d), GLOSSARY).select("column", "_row_id", "value"),
      CUST + " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", _row_id, {c} AS value FROM cust WHERE trim({c}) <> '' AND NOT regexp_matches({c}, '{p}') ORDER BY _row_id LIMIT 10)" for c, p in PATTERN.items()))
check("D04_skipped_columns", lambda s, d: reports.skipped_columns(cust(s, d), GLOSSARY),
      CUST + "SELECT column_name AS \"column\", semantic_type, CASE WHEN semantic_type IS NULL THEN 'no semantic type assigned' ELSE 'no canonical format check defined for this type' END AS reason FROM (SELECT unnest(['" + "','".join(CUST_ALL) + f"']) AS column_name, count(*) AS n FROM cust GROUP BY 1) JOIN {META} ON column_name = m.\"column\" WHERE column_name NOT IN ('code', 'email', 'since') AND n >= 0")
check("D04_semantic_breakdown", lambda s, d: reports.semantic_breakdown(scorecard.field_counts(cust(s, d), GLOSSARY)), FIELDS_SQL + "SELECT coalesce(semantic_type, '(unclassified)') AS semantic_type, count(*) AS fields FROM f GROUP BY ALL")


def format_checks(s, d):
    """Every registered format against every page address and customer code."""
    from assayer.functions import text
    from assayer.operators.values import union_all

    values = view(s, d, "pg").select(F.col("url").alias("value")).unionByName(cust(s, d).select(F.col("code").alias("value"))).unionByName(cust(s, d).select(F.col("email").alias("value")))
    row = values.agg(*[F.count_if(text.matches(F.col("value"), p)).alias(k) for k, p in FORMATS.items()])
    return row.unpivot([], list(FORMATS), "semantic_type", "matching").withColumn("matching", F.col("matching").cast("bigint"))


check("D05_format_registry", format_checks, with_views("pg", "cust").rstrip() + ", v AS (SELECT url AS value FROM pg UNION ALL SELECT code FROM cust UNION ALL SELECT email FROM cust) "
      + " UNION ALL ".join(f"SELECT '{k}' AS semantic_type, count(*) FILTER (regexp_matches(value, '{p}')) AS matching FROM v" for k, p in FORMATS.items()))


def identifier_rows(s, d):
    found = scorecard.identifiers(cust(s, d), GLOSSARY)
    return s.createDataFrame(found, "column string, rate double").select("column", F.round("rate", 6).alias("rate"))


RATE = "SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) * 1.0 / count({c}), 6) AS rate FROM cust"
check("D06_identifier_columns", identifier_rows, CUST + 'SELECT "column", rate FROM (' + per_column(RATE, ["custkey", "code"]) + ") WHERE rate >= 0.95")

DUP = with_views("dup")
dup = lambda s, d: view(s, d, "dup")
REPEATED = lambda table, keys, where="": f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {table} {where} GROUP BY {', '.join(keys)} HAVING count(*) > 1))"
IDS_SQL = "coalesce((SELECT max(n) FROM (SELECT {r} AS n FROM (SELECT count(DISTINCT {c}) * 1.0 / count({c}) AS rate FROM dup) WHERE rate >= 0.95)), 0)"
WORST = f"greatest({REPEATED('dup', CUST_ALL)}, " + ", ".join(IDS_SQL.replace("{c}", c).replace("{r}", REPEATED("dup", [c], f"WHERE {c} IS NOT NULL")) for c in ("custkey", "code")) + ")"
check("D07_uniqueness_score", lambda s, d: one(scorecard.uniqueness(dup(s, d), GLOSSARY)), DUP + f"SELECT 'Uniqueness' AS dimension, round(1 - {WORST} * 1.0 / count(*), 3) AS score, {WORST}::BIGINT AS records_impacted FROM dup")
check("D07_uniqueness_repeats_expected", lambda s, d: one(scorecard.uniqueness(dup(s, d), GLOSSARY, repeats_expected=True)),
      DUP + f"SELECT 'Uniqueness' AS dimension, round(1 - {REPEATED('dup', CUST_ALL)} * 1.0 / count(*), 3) AS score, {REPEATED('dup', CUST_ALL)}::BIGINT AS records_impacted FROM dup")


def identifier_order(s, d):
    return s.createDataFrame(list(enumerate(scorecard.ordered_identifiers(cust(s, d), GLOSSARY))), "place int, column string")


check("D08_identifier_order", identifier_order, CUST + "SELECT (row_number() OVER (ORDER BY tier, rate DESC) - 1)::INT AS place, \"column\" FROM (SELECT *, CASE \"column\" WHEN 'custkey' THEN 0 ELSE 2 END AS tier FROM (" + per_column(RATE, ["custkey", "code"]) + ") WHERE rate >= 0.95)")


def key_choice(s, d):
    return s.createDataFrame([(reports.composite_key(cust(s, d), GLOSSARY),)], "k array<string>").select(F.array_join("k", ",").alias("composite_key"))


# The glossary as a table: place, column, type, recommended; the key is chosen in SQL from it and the measured rates.
TERMS = ", ".join(f"({i}, '{c}', '{GLOSSARY.semantic_type(c) or ''}', {str(bool(GLOSSARY.recommended(c))).lower()})" for i, c in enumerate(CUST_ALL))
KEY_SQL = CUST.rstrip() + f""", g(place, col, kind, wanted) AS (VALUES {TERMS}), rates AS ({per_column(RATE, ["custkey", "code"])}),
 ids AS (SELECT "column" AS col, row_number() OVER (ORDER BY CASE "column" WHEN 'custkey' THEN 0 ELSE 2 END, rate DESC) AS k FROM rates WHERE rate >= 0.95),
 others AS (SELECT * FROM g WHERE col NOT IN (SELECT col FROM ids WHERE k = 1)),
 chosen AS (SELECT col, place, 0 AS part FROM (SELECT * FROM others WHERE kind = 'free_text_name' AND wanted ORDER BY place LIMIT 1)
  UNION ALL SELECT col, place, 1 FROM (SELECT * FROM others WHERE kind IN ('pan', 'gstin', 'tan', 'cin', 'ein', 'ssn', 'aadhaar', 'vat') ORDER BY place LIMIT 2))
 SELECT coalesce((SELECT string_agg(col, ',' ORDER BY part, place) FROM chosen), (SELECT string_agg(col, ',' ORDER BY k) FROM ids WHERE k <= 3)) AS composite_key"""
check("D09_attribute_key", key_choice, KEY_SQL)
check("D10_composite_duplicates", lambda s, d: reports.composite_duplicates(dup(s, d), ["name", "code"]),
      DUP + "SELECT 'name + code' AS key, count(*) AS duplicate_combos, sum(n)::BIGINT AS rows_in_duplicates, round(sum(n) * 1.0 / (SELECT count(*) FROM dup), 4) AS duplicate_rate FROM (SELECT count(*) AS n FROM dup WHERE name IS NOT NULL OR code IS NOT NULL GROUP BY name, code HAVING count(*) > 1)")
check("D10_top_duplicates", lambda s, d: reports.top_duplicates(view(s, d, "prt"), ["name", "type"]),
      with_views("prt") + "SELECT name, type, count(*) AS rows FROM prt GROUP BY ALL HAVING count(*) > 1 ORDER BY rows DESC, name, type LIMIT 10")
ENT = ", ".join(c for c in CUST_ALL)
SHARED = f"SELECT CAST({{c}} AS VARCHAR) AS value, count(*) AS distinct_entities, sum(n) AS rows FROM (SELECT {ENT}, count(*) AS n FROM dup WHERE {{c}} IS NOT NULL GROUP BY {ENT}) GROUP BY {{c}} HAVING count(*) > 1"
check("D11_shared_identifier_risk", lambda s, d: reports.shared_risk(dup(s, d).drop("_row_id"), ["code", "email"]),
      DUP + per_column(f"SELECT '{{c}}' AS \"column\", count(*) AS shared_values, coalesce(sum(rows), 0)::BIGINT AS rows_affected, 'high' AS severity FROM ({SHARED})", ["code", "email"]))
check("D11_shared_samples", lambda s, d: reports.shared_samples(view(s, d, "prt").drop("_row_id"), "name"),
      "SELECT p_name AS value, count(DISTINCT p_partkey) AS distinct_entities FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1 ORDER BY distinct_entities DESC, value LIMIT 10")
check("D12_identifier_uniqueness", lambda s, d: reports.identifier_uniqueness(cust(s, d), GLOSSARY),
      CUST + 'SELECT "column", non_null, distinct_count, non_null - distinct_count AS duplicates, round(rate, 4) AS uniqueness_rate FROM (' + per_column(RATE, ["custkey", "code"]) + ") WHERE rate >= 0.95")
check("D13_uniqueness_summary", lambda s, d: reports.uniqueness_summary(dup(s, d), GLOSSARY).select("rows", "distinct_rows", "full_row_duplicates", "composite_key"),
      DUP + f"SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS full_row_duplicates, 'name,code' AS composite_key FROM (SELECT count(*) AS n FROM dup GROUP BY {ENT})")

CASE = "CASE WHEN NOT regexp_matches({c}, '\\p{L}') THEN 'other' WHEN regexp_matches({c}, '\\p{Lu}') AND NOT regexp_matches({c}, '\\p{Ll}') THEN 'upper' WHEN regexp_matches({c}, '\\p{Ll}') AND NOT regexp_matches({c}, '\\p{Lu}') THEN 'lower' WHEN NOT regexp_matches({c}, '(^|[^\\p{Lu}\\p{Ll}\\p{Lt}])\\p{Ll}|[\\p{Lu}\\p{Ll}\\p{Lt}][\\p{Lu}\\p{Lt}]') THEN 'title' ELSE 'mixed' END"
CASES = ["upper", "lower", "title", "mixed", "other"]
CASE_COUNTS = "SELECT '{c}' AS \"column\", " + ", ".join(f"count(*) FILTER (k = '{k}') AS \"{k}\"" for k in CASES) + ", count({c}) AS filled FROM (SELECT {c}, CASE WHEN {c} IS NOT NULL THEN " + CASE + " END AS k FROM cust)"
SCOPED = ["name", "segment"]
BEST = "greatest(upper, lower, title, mixed, other)"
check("D14_standardisation_score", lambda s, d: one(scorecard.standardisation(scorecard.field_counts(cust(s, d), GLOSSARY), GLOSSARY)),
      CUST + f"SELECT 'Standardisation' AS dimension, round(sum({BEST}) * 1.0 / sum(filled), 3) AS score, (sum(filled) - sum({BEST}))::BIGINT AS records_impacted FROM (" + per_column(CASE_COUNTS, SCOPED) + ")")
DOMINANT = "CASE " + " ".join(f"WHEN {k} = {BEST} THEN '{k}'" for k in CASES) + " END"
PATTERNS_SQL = f"SELECT \"column\", upper, lower, title, mixed, other, {DOMINANT} AS dominant, filled - {BEST} AS off_pattern, round({BEST} * 1.0 / filled, 4) AS consistency_rate FROM (" + per_column(CASE_COUNTS, CUST_TEXT) + ")"
check("D15_case_patterns", lambda s, d: reports.case_patterns(cust(s, d), Glossary()), CUST + PATTERNS_SQL)


def off_samples(s, d):
    df = cust(s, d)
    return reports.off_pattern_samples(df, reports.case_patterns(df, GLOSSARY)).select("column", "_row_id", "value")


check("D15_off_pattern_samples", off_samples, CUST.rstrip() + ", p AS (" + PATTERNS_SQL + ") " + per_column("SELECT '{c}' AS \"column\", _row_id, substr({c}, 1, 60) AS value FROM cust WHERE {c} IS NOT NULL AND " + CASE + " <> (SELECT dominant FROM p WHERE \"column\" = '{c}') ORDER BY _row_id LIMIT 5", SCOPED))

VARIANTS = """SELECT '{c}' AS "column", key, count(*) AS distinct_spellings, sum(n)::BIGINT AS total_rows, string_agg(v || '(' || n || ')', ', ' ORDER BY n DESC, v) AS variants FROM (SELECT {c} AS v, regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '', 'g') AS key, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL) WHERE key <> '' GROUP BY key HAVING count(*) > 1 ORDER BY distinct_spellings DESC, total_rows DESC, key LIMIT 20"""
check("D16_spellings", lambda s, d: reports.spellings(cust(s, d), "segment").select("key", "value", "rows"), CUST + """SELECT key, v AS value, n AS rows FROM (SELECT *, count(*) OVER (PARTITION BY key) AS spelled FROM (SELECT segment AS v, regexp_replace(lower(strip_accents(segment)), '[^a-z0-9]+', '', 'g') AS key, count(*) AS n FROM cust WHERE segment IS NOT NULL GROUP BY ALL) WHERE key <> '') WHERE spelled > 1""")
check("D16_spelling_variants", lambda s, d: reports.spelling_variants(cust(s, d), "segment"), CUST + VARIANTS.replace("{c}", "segment").replace("{t}", "cust"))
ISSUES = "SELECT '{c}' AS \"column\", count(*) FILTER (regexp_matches({c}, '^\\s')) AS \"leading\", count(*) FILTER (regexp_matches({c}, '\\s$')) AS \"trailing\", count(*) FILTER (regexp_matches({c}, '\\s{2,}')) AS doublespace, count(*) FILTER (regexp_matches({c}, '[\\x00-\\x1f\\x7f]')) AS control_chars FROM {t}"
check("D17_whitespace_issues", lambda s, d: reports.whitespace(view(s, d, "docs"), Glossary()), with_views("docs") + "SELECT * FROM (" + per_column(ISSUES.replace("{t}", "docs"), ["text", "lang", "source"]) + ") WHERE \"leading\" + \"trailing\" + doublespace + control_chars > 0")
check("D18_standardisation_summary", lambda s, d: reports.standardisation_summary(reports.case_patterns(cust(s, d), GLOSSARY)),
      CUST + f"SELECT count(*) AS text_columns, sum(filled - {BEST})::BIGINT AS off_pattern_values, round(sum({BEST}) * 1.0 / sum(filled), 4) AS overall_consistency FROM (" + per_column(CASE_COUNTS, SCOPED) + ")")

CROSS = [
    x.conditional_presence("priority", "status", ["F", "o"], rule_id=1), x.composite_unique("custkey", "status", rule_id=2),
    x.expression("ordered IS NOT NULL AND shipped IS NOT NULL AND ordered > shipped", ["ordered", "shipped"], rule_id=3),
    x.expression("price < 0", ["price"], rule_id=4),
]
ord_ = lambda s, d: view(s, d, "ord")
CROSS_SQL = f"""SELECT 1 AS rule_id, count(*) FILTER (lower(trim(status)) IN ('f', 'o') AND (priority IS NULL OR trim(priority) = '')) AS issues FROM ord UNION ALL SELECT 2, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM ord WHERE custkey IS NOT NULL OR status IS NOT NULL GROUP BY custkey, status HAVING count(*) > 1))
 UNION ALL SELECT 3, count(*) FILTER (ordered > shipped) FROM ord UNION ALL SELECT 4, count(*) FILTER (price < 0) FROM ord"""
check("D19_accuracy_score", lambda s, d: one(scorecard.accuracy(r.evaluate(ord_(s, d), CROSS))),
      ORD + f"SELECT 'Accuracy' AS dimension, round(count(*) FILTER (issues = 0) * 1.0 / count(*), 3) AS score, sum(issues)::BIGINT AS records_impacted FROM ({CROSS_SQL})")
check("D20_accuracy_rules", lambda s, d: reports.accuracy_rules(ord_(s, d), CROSS).select("rule_id", "issues", "validity_rate", "status"),
      ORD + f"SELECT rule_id, issues::BIGINT AS issues, round(((SELECT count(*) FROM ord) - issues) * 1.0 / (SELECT count(*) FROM ord), 4) AS validity_rate, CASE WHEN issues = 0 THEN 'Passing' ELSE 'Failing' END AS status FROM ({CROSS_SQL})")
check("D20_accuracy_summary", lambda s, d: reports.accuracy_summary(reports.accuracy_rules(ord_(s, d), CROSS)),
      ORD + f"SELECT count(*) AS total_rules, count(*) FILTER (issues = 0) AS rules_passing, count(*) FILTER (issues > 0) AS rules_failing, sum(issues)::BIGINT AS total_violations, round(count(*) FILTER (issues = 0) * 1.0 / count(*), 4) AS pass_rate FROM ({CROSS_SQL})")

NOW = f"TIMESTAMP '{AS_OF}'"
SCORE_TIME = f"SELECT 'Timeliness' AS dimension, round(1 - (count(*) FILTER (ordered > {NOW}) + count(*) FILTER (shipped > {NOW})) * 1.0 / (count(ordered) + count(shipped)), 3) AS score, count(*) FILTER (ordered > {NOW}) + count(*) FILTER (shipped > {NOW}) AS records_impacted FROM ord"
check("D21_timeliness_score", lambda s, d: one(scorecard.timeliness(ord_(s, d), as_of())), ORD + SCORE_TIME)
TIMES = f"SELECT '{{c}}' AS \"column\", count(*) AS total, count({{c}}) AS populated, count(*) - count({{c}}) AS blank, count(*) FILTER ({{c}} > {NOW}) AS future_dated, count(*) FILTER ({{c}} < TIMESTAMP '1990-01-01') AS very_old, strftime(min({{c}}), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max({{c}}), '%Y-%m-%d %H:%M:%S') AS newest, round((count({{c}}) - count(*) FILTER ({{c}} > {NOW} OR {{c}} < TIMESTAMP '1990-01-01')) * 1.0 / count({{c}}), 4) AS timeliness_rate FROM ord"
check("D22_timeliness_columns", lambda s, d: reports.timeliness_columns(ord_(s, d), as_of()), ORD + per_column(TIMES, ["ordered", "shipped"]))
check("D22_untimely_samples", lambda s, d: reports.untimely_samples(ord_(s, d), as_of()).select("column", "_row_id", "value", "issue"),
      ORD + per_column(f"SELECT '{{c}}' AS \"column\", _row_id, strftime({{c}}, '%Y-%m-%d %H:%M:%S') AS value, 'future' AS issue FROM ord WHERE {{c}} > {NOW} ORDER BY _row_id LIMIT 5", ["ordered", "shipped"]) + " UNION ALL "
      + per_column("SELECT '{c}' AS \"column\", _row_id, strftime({c}, '%Y-%m-%d %H:%M:%S') AS value, 'very_old' AS issue FROM ord WHERE {c} < TIMESTAMP '1990-01-01' ORDER BY _row_id LIMIT 5", ["ordered", "shipped"]))
check("D22_timeliness_summary", lambda s, d: reports.timeliness_summary(reports.timeliness_columns(ord_(s, d), as_of())),
      ORD + f"SELECT count(*) AS date_columns, sum(future_dated)::BIGINT AS total_future, sum(very_old)::BIGINT AS total_very_old, round((sum(populated) - sum(future_dated) - sum(very_old)) * 1.0 / sum(populated), 4) AS overall_timeliness FROM (" + per_column(TIMES, ["ordered", "shipped"]) + ")")

# Executive summary of the orders table.
OG = Glossary({"orderkey": {"semantic_type": "numeric_id", "recommended": True}, "status": {"semantic_type": "enum_code"}, "priority": {"semantic_type": "enum_code", "regex": r"^\d-[A-Z ]+$"}})
ORD_ALL = ["orderkey", "custkey", "status", "price", "priority", "ordered", "shipped"]
ORD_CASES = " UNION ALL ".join("(" + CASE_COUNTS.replace("cust", "ord").replace("{c}", c) + ")" for c in ["status", "priority"])
EXEC = f"""s AS (SELECT 'Completeness' AS dimension, ({' + '.join(f'count({c})' for c in ORD_ALL)}) * 1.0 / (count(*) * 7) AS score, count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in ORD_ALL)}) AS records_impacted FROM ord
 UNION ALL SELECT 'Validation', count(*) FILTER (regexp_matches(priority, '^\\d-[A-Z ]+$')) * 1.0 / count(priority), count(priority) - count(*) FILTER (regexp_matches(priority, '^\\d-[A-Z ]+$')) FROM ord
 UNION ALL SELECT 'Uniqueness', 1 - greatest({REPEATED('ord', ORD_ALL)}, {REPEATED('ord', ['orderkey'])}) * 1.0 / count(*), greatest({REPEATED('ord', ORD_ALL)}, {REPEATED('ord', ['orderkey'])}) FROM ord
 UNION ALL SELECT 'Standardisation', sum({BEST}) * 1.0 / sum(filled), sum(filled) - sum({BEST}) FROM ({ORD_CASES})
 UNION ALL SELECT 'Accuracy', count(*) FILTER (issues = 0) * 1.0 / count(*), sum(issues) FROM ({CROSS_SQL})
 UNION ALL SELECT 'Timeliness', 1 - (count(*) FILTER (ordered > {NOW}) + count(*) FILTER (shipped > {NOW})) * 1.0 / (count(ordered) + count(shipped)), count(*) FILTER (ordered > {NOW}) + count(*) FILTER (shipped > {NOW}) FROM ord),
 e AS (SELECT dimension, round(score, 3) AS score, records_impacted::BIGINT AS records_impacted, true AS enabled, CASE WHEN score >= 0.95 THEN 'Strong' WHEN score >= 0.85 THEN 'Moderate' WHEN score >= 0.7 THEN 'Needs Attention' ELSE 'Critical' END AS rating, CASE WHEN score >= 0.95 THEN 'Low' WHEN score >= 0.8 THEN 'Medium' ELSE 'High' END AS risk_level FROM s) """
EXEC_SQL = ORD.rstrip() + ", " + EXEC
executive = lambda s, d: scorecard.dimension_scores(ord_(s, d), OG, as_of(), CROSS)
check("D23_executive_summary", executive, EXEC_SQL + "SELECT * FROM e")
check("D23_overall_score", lambda s, d: scorecard.overall(executive(s, d)).select("overall_score", "overall_rating", "dimensions"),
      EXEC_SQL + "SELECT round(avg(score), 3) AS overall_score, CASE WHEN round(avg(score), 3) >= 0.95 THEN 'Strong' WHEN round(avg(score), 3) >= 0.85 THEN 'Moderate' WHEN round(avg(score), 3) >= 0.7 THEN 'Needs Attention' ELSE 'Critical' END AS overall_rating, count(*) AS dimensions FROM e")
check("D24_key_statistics", lambda s, d: scorecard.key_statistics(cust(s, d), GLOSSARY, ["nationkey"]),
      CUST + "SELECT 'Total Records' AS label, count(*)::DOUBLE AS value FROM cust UNION ALL SELECT 'Total Fields', 9 UNION ALL SELECT 'Overall Fill Rate', round((" + " + ".join(f"count({c})" for c in CUST_ALL) + ") * 1.0 / (count(*) * 9), 3) FROM cust UNION ALL SELECT 'Unique custkey values', count(DISTINCT custkey) FROM cust UNION ALL SELECT 'nationkey distinct values', count(DISTINCT nationkey) FROM cust")
check("D25_remediation", lambda s, d: scorecard.remediation(executive(s, d)).select("priority", "dimension", "score", "records_impacted"),
      EXEC_SQL + "SELECT 'P' || row_number() OVER (ORDER BY score, CASE dimension WHEN 'Completeness' THEN 0 WHEN 'Validation' THEN 1 WHEN 'Uniqueness' THEN 2 WHEN 'Standardisation' THEN 3 WHEN 'Accuracy' THEN 4 ELSE 5 END) AS priority, dimension, score, records_impacted FROM e WHERE score < 1")

# Per-field dashboard.
FS = "SELECT '{c}' AS \"column\", {k} AS semantic_type, {cde} AS is_cde, count(*) AS total, count({c}) AS filled, {v} AS validation, {u} AS uniqueness, {st} AS standardisation, {bad} AS invalid FROM cust"


def field_sql(c):
    kind = KIND.get(c)
    valid = f"count(*) FILTER (regexp_matches({c}, '{PATTERN[c]}'))" if c in PATTERN else None
    upper, lower = f"count(*) FILTER (upper({c}) = {c})", f"count(*) FILTER (lower({c}) = {c})"
    parts = {
        "{c}": c, "{k}": none_or(kind), "{cde}": str(c in KEYS).lower(), "{v}": f"{valid} * 1.0 / count({c})" if valid else "NULL",
        "{u}": f"count(DISTINCT {c}) * 1.0 / count({c})" if kind in ("numeric_id", "pan") else "NULL",
        "{st}": f"greatest({upper}, {lower}, count({c}) - {upper} - {lower}) * 1.0 / count({c})" if kind in ("free_text_name", "enum_code") else "NULL",
        "{bad}": f"count({c}) - {valid}" if valid else "0",
    }
    out = FS
    for k, v in parts.items():
        out = out.replace(k, v)
    return out


MEAN = "(filled * 1.0 / total + coalesce(validation, 0) + coalesce(uniqueness, 0) + coalesce(standardisation, 0)) / (1 + (validation IS NOT NULL)::INT + (uniqueness IS NOT NULL)::INT + (standardisation IS NOT NULL)::INT)"
LEVEL = "CASE WHEN m IS NULL THEN 'Unscored' WHEN m >= 0.95 THEN 'High' WHEN m >= 0.7 THEN 'Medium' ELSE 'Low' END"
FIELD_SCORES = CUST.rstrip() + ", fs AS (SELECT *, " + MEAN + " AS m FROM (" + " UNION ALL ".join(f"({field_sql(c)})" for c in CUST_ALL) + f')), q AS (SELECT "column", semantic_type, is_cde, round(filled * 1.0 / total, 4) AS completeness, round(validation, 4) AS validation, round(uniqueness, 4) AS uniqueness, round(standardisation, 4) AS standardisation, round(m, 4) AS overall_score, greatest(total - filled, invalid) AS non_compliant, {LEVEL} AS threshold FROM fs) '
field_rows = lambda s, d: dashboard.field_scores(cust(s, d), GLOSSARY)
check("D26_field_scores", field_rows, FIELD_SCORES + "SELECT * FROM q")
check("D27_threshold_distribution", lambda s, d: dashboard.threshold_distribution(field_rows(s, d)), FIELD_SCORES + "SELECT threshold, count(*) AS fields FROM q GROUP BY ALL")
check("D27_semantic_distribution", lambda s, d: dashboard.semantic_distribution(field_rows(s, d)), FIELD_SCORES + "SELECT coalesce(semantic_type, 'other') AS semantic_type, count(*) AS fields FROM q GROUP BY ALL")
BUCKET = "SELECT '{D}' AS dimension, count({d}) AS applicable_fields, count(*) FILTER ({d} >= 0.95) AS high, count(*) FILTER ({d} >= 0.7 AND {d} < 0.95) AS medium, count(*) FILTER ({d} < 0.7) AS low FROM q"


def buckets(s, d):
    return dashboard.dimension_buckets(field_rows(s, d), executive(s, d))


check("D28_dimension_buckets", buckets, FIELD_SCORES.rstrip() + ", " + with_views("ord")[5:].rstrip() + ", " + EXEC + " UNION ALL ".join(BUCKET.replace("{D}", x).replace("{d}", x.lower()) for x in ["Completeness", "Validation", "Uniqueness", "Standardisation"])
      + " UNION ALL SELECT dimension, 1, (score >= 0.95)::INT, (score >= 0.7 AND score < 0.95)::INT, (score < 0.7)::INT FROM e WHERE dimension IN ('Accuracy', 'Timeliness')")


def rule_rows(s, d):
    """Rules suggested for the customer table, under a legacy dimension name for text rules."""
    from assayer.operators import profile, suggest

    found = suggest.quality_rules(profile.profile(cust(s, d), with_outliers=False))
    return dashboard.rules_by_dimension(found.withColumn("dimension", F.when(F.col("kind") == "max_length", "Validity").otherwise(F.col("dimension"))))


KEYNAME = "regexp_matches(\"column\", '(?i)\\b(id|uid|code|key|number|no\\.?)\\b')"
RULE_FACTS = "SELECT '{c}' AS \"column\", count(*) AS total, count({c}) AS filled, count(DISTINCT {c}) AS uniq, {t} AS is_text, {e} AS emails, {l} AS max_len FROM cust"
fact = lambda c: RULE_FACTS.replace("{c}", c).replace("{t}", str(c in CUST_TEXT).lower()).replace("{e}", f"count(*) FILTER (regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$'))" if c in CUST_TEXT else "0").replace("{l}", f"max(length({c}))" if c in CUST_TEXT else "NULL")
RULES_SQL = CUST.rstrip() + ", rf AS (" + " UNION ALL ".join(fact(c) for c in CUST_ALL) + f"""), qr AS (SELECT "column", 'Completeness' AS dimension, 'not_blank' AS kind, NULL AS argument FROM rf WHERE filled < total OR {KEYNAME} UNION ALL SELECT "column", 'Uniqueness', 'unique', NULL FROM rf WHERE {KEYNAME} OR uniq * 100.0 / total > 95
 UNION ALL SELECT "column", 'Validation', 'numeric', NULL FROM rf WHERE NOT is_text UNION ALL SELECT "column", 'Validation', 'email', NULL FROM rf WHERE is_text AND emails > 0 AND emails = filled UNION ALL SELECT "column", 'Validation', 'max_length', CAST(max_len AS VARCHAR) FROM rf WHERE is_text AND NOT (emails > 0 AND emails = filled)) """
check("D29_rules_by_dimension", rule_rows, RULES_SQL + "SELECT dimension, count(*) AS rule_count FROM qr GROUP BY ALL")


def both_versions(s, d):
    before, after = cust(s, d), view(s, d, "cust_after")
    shared = ["_row_id", "custkey", "name", "email", "segment", "nationkey", "acctbal"]
    return dashboard.quality_dashboard(after.select(*shared), before.select(*shared), GLOSSARY, as_of())


SIX = ["custkey", "name", "email", "segment", "nationkey", "acctbal"]


def version_sql(t, column):
    cases = " UNION ALL ".join("(" + CASE_COUNTS.replace("cust)", f"{t})").replace("{c}", c) + ")" for c in SCOPED)
    return f"""SELECT dimension, round(score, 3) AS {column} FROM (SELECT 'Completeness' AS dimension, ({' + '.join(f'count({c})' for c in SIX)}) * 1.0 / (count(*) * 6) AS score FROM {t}
 UNION ALL SELECT 'Validation', count(*) FILTER (regexp_matches(email, '{FORMATS['email']}')) * 1.0 / count(email) FROM {t}
 UNION ALL SELECT 'Uniqueness', 1 - greatest({REPEATED(t, SIX)}, {REPEATED(t, ['custkey'])}) * 1.0 / count(*) FROM {t}
 UNION ALL SELECT 'Standardisation', sum({BEST}) * 1.0 / sum(filled) FROM ({cases}))"""


check("D30_quality_dashboard", both_versions, with_views("cust", "cust_after").rstrip() + f", o AS ({version_sql('cust', 'original_score')}), c AS ({version_sql('cust_after', 'current_score')}), o2 AS (SELECT * FROM o UNION ALL SELECT 'Overall', round(avg(original_score), 3) FROM o), c2 AS (SELECT * FROM c UNION ALL SELECT 'Overall', round(avg(current_score), 3) FROM c) SELECT dimension, original_score, current_score, round(current_score - original_score, 3) AS change FROM o2 JOIN c2 USING (dimension)")
check("D32_field_scorecard", lambda s, d: dashboard.field_scorecard(cust(s, d)),
      CUST + per_column("SELECT '{c}' AS \"column\", count({c}) AS filled, round(count({c}) * 1.0 / count(*), 4) AS fill_pct, count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) * 1.0 / count(*), 4) AS distinct_pct FROM cust", CUST_ALL))
