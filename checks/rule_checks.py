"""Rules: single-column, multi-column, cross-field, status; projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import ROW_ID
from assayer.functions import text
from assayer.functions.formats import FORMATS, resolve_patterns
from assayer.operators import crossfield as x, profile, rules as r, select, suggest
from assayer.operators.rules import Rule
from assayer.operators.skew import members_of_repeated
from assayer.plans import lifecycle
from assayer.schema import data_columns
from checks.base import AS_OF, CUST_ALL, CUST_NUMBERS, CUST_TEXT, ORD_ALL, WS, as_of, check, per_column, read, view, with_views
from checks.scoring import RULES_SQL

CUST, ORD, PRT = with_views("cust"), with_views("ord"), with_views("prt")
cust = lambda s, d: view(s, d, "cust")
strip = lambda c: f"trim({c}, {WS})"
BLANK = lambda c: f"({c} IS NULL OR {strip(c)} = '')"

# P: projections, predicates, sampling
check("P01_scoped_columns", lambda s, d: select.scoped(cust(s, d), ["segment", "name"]), CUST + "SELECT _row_id, name, segment FROM cust")


def dropped(s, d):
    rules = s.createDataFrame([("name", "not_blank"), ("code", "unique"), ("email", "email")], "column string, kind string")
    df, kept = select.drop_columns(cust(s, d), rules, ["code", "since"])
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(data_columns(df)))).withColumn("rules", F.lit(kept.count()))


check("P03_drop_columns", dropped, CUST + "SELECT count(*) AS rows, 7 AS columns, 2 AS rules FROM cust")


def indexed_search(s, d):
    """Three needles, in one, several and no values, through the index of a stored table; the union tells them apart."""
    from assayer.sources.search import SearchStore
    from checks.tables import scratch

    store = SearchStore(s, scratch(s, "search"), block=64)
    store.save("cust", cust(s, d))
    parts = [store.search("cust", needle, columns).select(F.lit(needle).alias("needle"), ROW_ID, "segment") for needle, columns in (("BUILDing", None), ("001", ["name"]), ("no such text", None), ("-1", ["acctbal"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


check("P05_indexed_search", indexed_search, CUST + "SELECT 'BUILDing' AS needle, _row_id, segment FROM cust WHERE contains(lower(concat_ws(chr(1), custkey::VARCHAR, name, code, email, segment, since, amount_text, nationkey::VARCHAR, acctbal::VARCHAR)), 'building') UNION ALL SELECT '001', _row_id, segment FROM cust WHERE contains(lower(name), '001') UNION ALL SELECT '-1', _row_id, segment FROM cust WHERE contains(acctbal::VARCHAR, '-1')")
check("P05_search", lambda s, d: select.search(cust(s, d), "BUILD").select(ROW_ID, "segment"),
      CUST + "SELECT _row_id, segment FROM cust WHERE " + " OR ".join(f"contains(lower(coalesce({c}::VARCHAR, '')), 'build')" for c in CUST_ALL))
check("P06_sample", lambda s, d: select.sample_percent(view(s, d, "ord"), 30).select(ROW_ID, "price"), with_views("ord") + "SELECT _row_id, price FROM ord WHERE CAST('0x' || substr(md5('42:' || _row_id), 1, 8) AS UBIGINT) % 100 < 30")
check("P08_column_summary", lambda s, d: select.column_summary(read(s, d, "customer")).select("column", "non_null", F.round("null_percentage", 4).alias("null_percentage"), "distinct_count"),
      per_column("SELECT '{c}' AS \"column\", count({c}) AS non_null, round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_percentage, count(DISTINCT {c}) AS distinct_count FROM customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
check("P10_stringify", lambda s, d: read(s, d, "part").select("p_partkey", text.stringify(F.col("p_retailprice"), read(s, d, "part").schema["p_retailprice"].dataType).alias("shown")),
      "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS shown FROM part")
check("P11_blank", lambda s, d: cust(s, d).select(ROW_ID, text.blank(F.col("name")).alias("blank")), CUST + f"SELECT _row_id, {BLANK('name')} AS blank FROM cust")
NA = "replace(amount_text, 'abc', ' n/a ')"
check("P12_placeholder", lambda s, d: cust(s, d).select(ROW_ID, text.meaningful(F.col("name")).alias("a"), text.meaningful(F.regexp_replace("amount_text", "abc", " n/a ")).alias("b")),
      CUST + f"SELECT _row_id, coalesce(upper({strip('name')}) NOT IN ('', 'NULL', 'NONE', 'NA', 'N/A', 'NAN', 'BLANK', '-', '--', '---'), false) AS a, coalesce(upper({strip(NA)}) NOT IN ('', 'NULL', 'NONE', 'NA', 'N/A', 'NAN', 'BLANK', '-', '--', '---'), false) AS b FROM cust")
check("P13_failing_pattern", lambda s, d: r.failing_rows(cust(s, d), Rule("pattern", "code", params={"pattern": FORMATS["pan"]})).select(ROW_ID, "code"),
      CUST + f"SELECT _row_id, code FROM cust WHERE trim(code) <> '' AND NOT regexp_matches(code, '{FORMATS['pan']}')")
check("P13_failing_complete", lambda s, d: r.failing_rows(cust(s, d), Rule("not_blank", "name")).select(ROW_ID, "name"), CUST + f"SELECT _row_id, name FROM cust WHERE {BLANK('name')}")
check("P13_failing_duplicate", lambda s, d: r.failing_rows(view(s, d, "ord"), Rule("unique", "custkey")).select(ROW_ID, "custkey"),
      ORD + "SELECT _row_id, custkey FROM ord WHERE custkey IN (SELECT custkey FROM ord GROUP BY custkey HAVING count(*) > 1)")
check("P13_failing_limited", lambda s, d: r.failing_rows(cust(s, d), Rule("not_blank", "name"), 7).select(ROW_ID), CUST + f"SELECT _row_id FROM cust WHERE {BLANK('name')} ORDER BY _row_id LIMIT 7")

# R: one entry per rule kind
FILLED = lambda c: f"nullif({strip(c)}, '')"
number = lambda c: f"TRY_CAST({c} AS DOUBLE)"
DECIMALS = lambda c: f"CASE WHEN contains(printf('%.15g', {c}), '.') THEN length(split_part(printf('%.15g', {c}), '.', 2)) ELSE 0 END"
COLLIDE = lambda t, c: f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM (SELECT DISTINCT {strip(c)} AS v FROM {t} WHERE {c} IS NOT NULL) GROUP BY lower(v) HAVING count(*) > 1))"
REPEATS = lambda t, keys, where="true": f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {t} WHERE {where} GROUP BY {keys} HAVING count(*) > 1))"
RULES: list[tuple[str, Rule, str]] = [
    ("R01_not_blank", Rule("not_blank", "name"), f"count(*) FILTER ({BLANK('name')})"),
    ("R02_unique", Rule("unique", "segment"), REPEATS("cust", "segment", "segment IS NOT NULL")),
    ("R03_allowed_values", Rule("allowed_values", "segment", params={"values": ["BUILDING", "machinery", "Household"]}), f"count(*) FILTER (lower({strip('segment')}) NOT IN ('building', 'machinery', 'household'))"),
    ("R04_max_decimals", Rule("max_decimals", "acctbal", params={"digits": 1}), f"count(*) FILTER (acctbal IS NOT NULL AND {DECIMALS('acctbal')} > 1)"),
    ("R05_numeric", Rule("numeric", "amount_text"), f"count(*) FILTER (amount_text IS NOT NULL AND {number('amount_text')} IS NULL)"),
    ("R06_valid_string", Rule("valid_string", "email"), f"count(*) FILTER ({BLANK('email')})"),
    ("R07_max_length", Rule("max_length", "email", params={"length": 18}), "count(*) FILTER (length(email) > 18)"),
    ("R08_uppercase", Rule("uppercase", "segment"), f"count(*) FILTER ({FILLED('segment')} <> upper({FILLED('segment')}))"),
    ("R09_lowercase", Rule("lowercase", "name"), f"count(*) FILTER ({FILLED('name')} <> lower({FILLED('name')}))"),
    ("R10_alphanumeric", Rule("alphanumeric", "segment"), f"count(*) FILTER (NOT regexp_matches({FILLED('segment')}, '^[A-Za-z0-9\\s]+$'))"),
    ("R11_no_special", Rule("no_special", "email"), f"count(*) FILTER (NOT regexp_matches({FILLED('email')}, '^[A-Za-z0-9\\s\\-_.]+$'))"),
    ("R12_reasonable_length", Rule("reasonable_length", "name"), "count(*) FILTER (length(name) > 255)"),
    ("R13_consistent_casing", Rule("consistent_casing", "segment"), COLLIDE("cust", "segment")),
    ("R14_range", Rule("range", "acctbal", params={"low": 0, "high": 5000}), "count(*) FILTER (acctbal < 0 OR acctbal > 5000)"),
    ("R15_format_mask", Rule("format_mask_consistent", "code"), f"(SELECT CASE WHEN count(DISTINCT regexp_replace({strip('code')}, '[A-Za-z0-9]', 'A', 'g')) > 1 THEN count(code) ELSE 0 END FROM cust)"),
    ("R17_not_null", Rule("not_null", "since"), "count(*) FILTER (since IS NULL)"),
    ("R18_unique_incl_null", Rule("unique_incl_null", "name"), REPEATS("cust", "name")),
    ("R19_valid_date", Rule("valid_date", "since"), "count(*) FILTER (since IS NOT NULL AND TRY_CAST(since AS TIMESTAMP) IS NULL)"),
    ("R20_not_future", Rule("not_future", "since", params={"as_of": AS_OF}), f"count(*) FILTER (TRY_CAST(since AS TIMESTAMP) > TIMESTAMP '{AS_OF}')"),
    ("R21_not_negative", Rule("not_negative", "acctbal"), "count(*) FILTER (acctbal < 0)"),
    ("R22_digits_only", Rule("digits_only", "nationkey"), "count(*) FILTER (NOT regexp_matches(coalesce(nationkey::VARCHAR, ''), '^\\d+$'))"),
    ("R22_email", Rule("email", "email"), "count(*) FILTER (NOT regexp_matches(coalesce(email, ''), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$'))"),
    ("R22_alnum_strict", Rule("alnum_strict", "code"), "count(*) FILTER (NOT regexp_matches(coalesce(code, ''), '^[a-zA-Z0-9]+$'))"),
    ("R25_multi_unique_and", Rule("multi_unique", columns=("segment", "nationkey"), dimension="Uniqueness"), REPEATS("cust", "segment, nationkey")),
    ("R25_multi_unique_or", Rule("multi_unique", columns=("name", "code"), params={"operator": "OR"}, dimension="Uniqueness"),
     "count(*) FILTER (name IN (SELECT name FROM cust WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1) OR code IN (SELECT code FROM cust WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1))"),
    ("R26_multi_complete_and", Rule("multi_complete", columns=("name", "code", "acctbal"), dimension="Completeness"), "count(*) FILTER (name IS NULL OR code IS NULL OR acctbal IS NULL)"),
    ("R26_multi_complete_or", Rule("multi_complete", columns=("name", "code"), params={"operator": "OR"}, dimension="Completeness"), "count(*) FILTER (name IS NULL AND code IS NULL)"),
    ("R27_multi_pattern_and", Rule("multi_pattern", columns=("name", "segment"), params={"pattern": "[A-Z#0-9]+$"}), "count(*) FILTER (NOT (regexp_matches(coalesce(name, ''), '^(?:[A-Z#0-9]+$)') AND regexp_matches(coalesce(segment, ''), '^(?:[A-Z#0-9]+$)')))"),
    ("R27_multi_pattern_or", Rule("multi_pattern", columns=("name", "segment"), params={"pattern": "[A-Z#0-9]+$", "operator": "OR"}), "count(*) FILTER (NOT (regexp_matches(coalesce(name, ''), '^(?:[A-Z#0-9]+$)') OR regexp_matches(coalesce(segment, ''), '^(?:[A-Z#0-9]+$)')))"),
    ("R28_multi_present", Rule("multi_present", columns=("since", "acctbal"), dimension="Timeliness"), "count(*) FILTER (since IS NULL OR acctbal IS NULL)"),
]
for i, (name, rule, sql) in enumerate(RULES):
    numbered = Rule(rule.kind, rule.column, rule.dimension, rule.columns, rule.params, rule.source, rule.statement, i)
    check(name, lambda s, d, one=numbered: r.evaluate(cust(s, d), [one]).select("rule_id", "kind", "issues"), CUST + f"SELECT {i} AS rule_id, '{rule.kind}' AS kind, ({sql})::BIGINT AS issues FROM cust" if sql.startswith("count") else CUST + f"SELECT {i} AS rule_id, '{rule.kind}' AS kind, {sql}::BIGINT AS issues")

ALL_RULES = [Rule(q.kind, q.column, q.dimension, q.columns, q.params, q.source, q.statement, i) for i, (_, q, _) in enumerate(RULES)]
issue_sql = lambda wanted: " UNION ALL ".join(f"SELECT {i} AS rule_id, ({sql})::BIGINT AS issues FROM cust" if sql.startswith("count") else f"SELECT {i}, {sql}::BIGINT" for i, (_, _, sql) in enumerate(RULES) if i in wanted)
check("R16_all_rules_one_scan", lambda s, d: r.evaluate(cust(s, d), ALL_RULES).select("rule_id", "issues"), CUST + issue_sql(range(len(RULES))))

EXAMPLE_RULES = [Rule("pattern", "code", params={"pattern": FORMATS["pan"]}, rule_id=1), Rule("email", "email", rule_id=2), Rule("numeric", "amount_text", rule_id=3), Rule("range", "acctbal", params={"low": 0, "high": 9_000_000}, rule_id=4),
                 Rule("max_length", "segment", params={"length": 400}, rule_id=5)]
EX = lambda i, c, cond: f"SELECT {i} AS rule_id, count(*) FILTER ({cond}) AS issues, CASE WHEN count(*) FILTER ({cond}) = 0 THEN 'no issues' ELSE (SELECT string_agg(v, '; ' ORDER BY first_id) FROM (SELECT substr(coalesce({c}::VARCHAR, ''), 1, 50) AS v, min(_row_id) AS first_id FROM cust WHERE {cond} GROUP BY 1 ORDER BY first_id LIMIT 5)) END AS example FROM cust"
EX_SQL = " UNION ALL ".join([
    EX(1, "code", f"trim(code) <> '' AND NOT regexp_matches(code, '{FORMATS['pan']}')"), EX(2, "email", "NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')"),
    EX(3, "amount_text", "amount_text IS NOT NULL AND TRY_CAST(amount_text AS DOUBLE) IS NULL"), EX(4, "acctbal", "acctbal < 0 OR acctbal > 9000000"), EX(5, "segment", "length(segment) > 400")])
check("R16_rules_with_examples", lambda s, d: r.evaluate_with_examples(cust(s, d), EXAMPLE_RULES).select("rule_id", "issues", "example"), CUST + EX_SQL)

SOURCED = [Rule("numeric", "amount_text", "Validation", source="A", statement="must be numeric", rule_id=3), Rule("max_length", "amount_text", "Validation", params={"length": 90}, source="A", statement="at most 90", rule_id=6),
           Rule("email", "email", "Validation", source="B", statement="must be an e-mail", rule_id=2)]
check("R23_results_by_dimension", lambda s, d: r.merge_results(r.evaluate_with_examples(cust(s, d), SOURCED)),
      CUST + "SELECT 'amount_text' AS \"column\", 'Validation' AS dimension, 'A' AS source, 'must be numeric; at most 90' AS statements, issues, example FROM (" + EX(3, "amount_text", "amount_text IS NOT NULL AND TRY_CAST(amount_text AS DOUBLE) IS NULL") + ") UNION ALL SELECT 'email', 'Validation', 'B', 'must be an e-mail', issues, example FROM ("
      + EX(2, "email", "NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')") + ")")
check("J06_rules_with_results", lambda s, d: r.merge_results(r.evaluate_with_examples(cust(s, d), SOURCED)).groupBy("dimension").agg(F.sum("issues").alias("issues"), F.count(F.lit(1)).alias("groups")),
      CUST + "SELECT 'Validation' AS dimension, (count(*) FILTER (amount_text IS NOT NULL AND TRY_CAST(amount_text AS DOUBLE) IS NULL) + count(*) FILTER (NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')))::BIGINT AS issues, 2 AS groups FROM cust")

ISSUE_KINDS = [Rule("not_blank", "name", "Completeness", rule_id=1), Rule("pattern", "code", params={"pattern": FORMATS["pan"]}, rule_id=2), Rule("unique", "name", "Uniqueness", rule_id=3), Rule("numeric", "amount_text", rule_id=4),
               Rule("valid_date", "since", rule_id=5), Rule("transform", "segment", "Standardisation", rule_id=6)]
check("R24_issue_counts", lambda s, d: r.evaluate(cust(s, d), ISSUE_KINDS).select("rule_id", "issues"),
      CUST + f"SELECT 1 AS rule_id, count(*) FILTER ({BLANK('name')}) AS issues FROM cust UNION ALL SELECT 2, count(*) FILTER (trim(code) <> '' AND NOT regexp_matches(code, '{FORMATS['pan']}')) FROM cust UNION ALL SELECT 3, {REPEATS('cust', 'name', 'name IS NOT NULL')} UNION ALL SELECT 4, count(*) FILTER (amount_text IS NOT NULL AND TRY_CAST(amount_text AS DOUBLE) IS NULL) FROM cust"
      " UNION ALL SELECT 5, count(*) FILTER (since IS NOT NULL AND TRY_CAST(since AS TIMESTAMP) IS NULL) FROM cust UNION ALL SELECT 6, count(segment) FROM cust")


def resolved(s, d):
    """Rules for every column of the customer table; patterns from the rule or the registry."""
    columns = cust(s, d).agg(*[F.count(c).alias(c) for c in CUST_TEXT]).unpivot([], CUST_TEXT, "column", "filled")
    rules = columns.select("column", F.when(F.col("column") == "since", r"^\d{4}-\d{2}-\d{2}$").otherwise("").alias("pattern"), "filled")
    glossary = s.createDataFrame([("code", "PAN", None), ("email", "email", None), ("since", "date", None), ("name", "free_text_name", None), ("segment", "enum_code", "^[A-Z]+$")], "column string, semantic_type string, regex string")
    return resolve_patterns(rules, glossary).select("column", "filled", "semantic_type", "resolved_pattern", "resolved_by")


RESOLVED = CUST + "SELECT \"column\", filled, semantic_type, pattern AS resolved_pattern, how AS resolved_by FROM (" + per_column("SELECT '{c}' AS \"column\", count({c}) AS filled FROM cust", CUST_TEXT) + f") LEFT JOIN (VALUES ('code', 'pan', '{FORMATS['pan']}', 'registry'), ('email', 'email', '{FORMATS['email']}', 'registry'), ('since', 'date', '^\\d{{4}}-\\d{{2}}-\\d{{2}}$', 'explicit'), ('name', 'free_text_name', NULL, 'none'), ('segment', 'enum_code', '^[A-Z]+$', 'glossary'), ('amount_text', NULL, NULL, 'none')) AS v(\"column\", semantic_type, pattern, how) USING (\"column\")"
check("R31_pattern_resolution", resolved, RESOLVED)


def type_patterns(s, d):
    """The pattern each typed column resolves to and how many values it accepts."""
    from assayer.operators.values import union_all
    from checks.scoring import GLOSSARY, PATTERN

    df = cust(s, d)
    return union_all([df.agg(F.count_if(text.matches(F.col(c), GLOSSARY.pattern(c))).alias("accepted")).select(F.lit(c).alias("column"), F.lit(GLOSSARY.pattern(c)).alias("pattern"), "accepted") for c in PATTERN])


check("J07_semantic_type_patterns", type_patterns, CUST + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{p}' AS pattern, count(*) FILTER (regexp_matches({c}, '{p}')) AS accepted FROM cust" for c, p in {"code": FORMATS["pan"], "email": FORMATS["email"], "since": r"^(19|20)\d{2}-\d{2}-\d{2}$"}.items()))

CARRIED = "CASE WHEN custkey % 3 = 0 THEN 'code: must not be blank' WHEN custkey % 3 = 1 THEN 'name - must be unique' ELSE concat('none: rule ', CAST(custkey AS STRING)) END"
check("R35_rules_in_data", lambda s, d: r.rules_in_data(cust(s, d).withColumn("dq_rules", F.expr(CARRIED)), "dq_rules"),
      CUST + f"SELECT DISTINCT \"column\", statement FROM (SELECT trim(split_part(cell, sep, 1)) AS \"column\", trim(substr(cell, instr(cell, sep) + 1)) AS statement FROM (SELECT cell, CASE WHEN contains(cell, ':') THEN ':' ELSE '-' END AS sep FROM (SELECT {CARRIED} AS cell FROM cust))) WHERE \"column\" IN ('code', 'name')")
check("R36_suggested_rules", lambda s, d: suggest.quality_rules(profile.profile(cust(s, d), with_outliers=False)).withColumn("argument", F.when(F.col("kind") == "max_length", F.col("argument"))), RULES_SQL + "SELECT * FROM qr")

LIFE = [
    Rule("pattern", "code", "Validation", params={"pattern": FORMATS["pan"]}, rule_id=1), Rule("not_blank", "missing", "Completeness", rule_id=2), Rule("multi_unique", columns=("name", "code"), dimension="Uniqueness", rule_id=3),
    Rule("max_length", "empty_col", "Validation", params={"length": 5}, rule_id=4), Rule("max_length", "sparse", "Validation", params={"length": 5}, rule_id=5), Rule("manual", "email", "Accuracy", rule_id=6),
    Rule("pattern", "email", "Validation", params={"pattern": "^done$"}, rule_id=7), Rule("max_length", "email", "Validation", params={"length": 400}, rule_id=8), Rule("not_blank", "empty_col", "Completeness", rule_id=9), Rule("uppercase", "segment", "Standardisation", rule_id=10)]


def life(s, d):
    df = cust(s, d).withColumn("empty_col", F.lit(None).cast("string")).withColumn("sparse", F.expr("CASE WHEN custkey % 10 = 1 THEN 'x' END"))
    applied = s.createDataFrame([("email", "pattern", "^done$")], "column string, kind string, pattern string")
    return lifecycle.statuses(df, LIFE, applied)


LIFE_SQL = CUST.rstrip() + f""", life AS (SELECT 1 AS rule_id, 'code' AS "column", 'Validation' AS dimension, CASE WHEN n > 0 THEN 'actionable' ELSE 'passed' END AS status, n AS issues, CASE WHEN n > 0 THEN 'Reject row' END AS suggested_action FROM (SELECT count(*) FILTER (trim(code) <> '' AND NOT regexp_matches(code, '{FORMATS['pan']}')) AS n FROM cust)
 UNION ALL SELECT 2, 'missing', 'Completeness', 'invalid', 0, NULL UNION ALL SELECT 3, 'name,code', 'Uniqueness', 'multi_cde', 0, NULL UNION ALL SELECT 4, 'empty_col', 'Validation', 'blocked_empty', 0, NULL
 UNION ALL SELECT 5, 'sparse', 'Validation', CASE WHEN count(*) FILTER (custkey % 10 = 1) * 1.0 / count(*) < 0.2 THEN 'blocked_incomplete' ELSE 'passed' END, 0, NULL FROM cust UNION ALL SELECT 6, 'email', 'Accuracy', 'unmapped', 0, NULL UNION ALL SELECT 7, 'email', 'Validation', 'applied', 0, NULL
 UNION ALL SELECT 8, 'email', 'Validation', 'passed', count(*) FILTER (length(email) > 400), NULL FROM cust UNION ALL SELECT 9, 'empty_col', 'Completeness', 'actionable', count(*), 'Fix value' FROM cust
 UNION ALL SELECT 10, 'segment', 'Standardisation', 'actionable', count(*) FILTER ({FILLED('segment')} <> upper({FILLED('segment')})), 'Fix value' FROM cust) """
check("R39_rule_status", life, LIFE_SQL + "SELECT * FROM life")
check("R40_totals_by_dimension", lambda s, d: lifecycle.by_dimension(life(s, d)),
      LIFE_SQL + "SELECT dimension, count(*) AS generated, sum(CASE WHEN status = 'actionable' THEN issues ELSE 0 END)::BIGINT AS failing_rows, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in lifecycle.STATUSES) + " FROM life GROUP BY dimension")

# X: cross-field rules
ord_ = lambda s, d: view(s, d, "ord")
line = lambda s, d: read(s, d, "lineitem")
CROSS: list[tuple[str, str, Rule, str]] = [
    ("X01_arithmetic", "ord", x.arithmetic("price", ["orderkey", "custkey"], 100000), "count(*) FILTER (abs(price - (orderkey + custkey)) > 100000)"),
    ("X02_conditional_presence", "ord", x.conditional_presence("priority", "status", ["F", "o"]), "count(*) FILTER (lower(trim(status)) IN ('f', 'o') AND (priority IS NULL OR trim(priority) = ''))"),
    ("X03_starts_with", "cust", x.prefix_from_sibling("name", "segment"), f"count(*) FILTER ({FILLED('name')} IS NOT NULL AND {FILLED('segment')} IS NOT NULL AND NOT starts_with(upper({FILLED('name')}), upper({FILLED('segment')})))"),
    ("X03_contains", "cust", x.prefix_from_sibling("name", "nationkey", contains=True), f"count(*) FILTER ({FILLED('name')} IS NOT NULL AND nationkey IS NOT NULL AND NOT contains(upper({FILLED('name')}), nationkey::VARCHAR))"),
    ("X04_composite_unique", "ord", x.composite_unique("custkey", "status", "priority"), "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM ord WHERE custkey IS NOT NULL OR status IS NOT NULL OR priority IS NOT NULL GROUP BY custkey, status, priority HAVING count(*) > 1))"),
    ("X04_five_columns", "ord", x.composite_unique("custkey", "status", "priority", "ordered", "orderkey"), "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM ord GROUP BY custkey, status, priority, ordered, orderkey HAVING count(*) > 1))"),
    ("X05_expression", "ord", x.expression("ordered > shipped OR (status = 'P' AND price > 400000)", ["ordered", "shipped", "status", "price"]), "count(*) FILTER (ordered > shipped OR (status = 'P' AND price > 400000))"),
]
for name, table, rule, sql in CROSS:
    where = f" FROM {table}" if sql.startswith("count") else ""
    check(name, lambda s, d, t=table, q=rule: r.evaluate(view(s, d, t), [q]).select("kind", "issues"), with_views(table) + f"SELECT '{rule.kind}' AS kind, ({sql})::BIGINT AS issues{where}")
check("X01_arithmetic_lineitem", lambda s, d: r.evaluate(line(s, d), [x.arithmetic("l_extendedprice", ["l_quantity", "l_linenumber"], 50000)]).select("kind", "issues"),
      "SELECT 'cross_arithmetic' AS kind, count(*) FILTER (abs(l_extendedprice - (l_quantity + l_linenumber)) > 50000) AS issues FROM lineitem")
ORD_CROSS = [Rule(q.kind, q.column, q.dimension, q.columns, q.params, rule_id=i) for i, (_, t, q, _) in enumerate(CROSS) if t == "ord"]
check("X07_all_cross_rules", lambda s, d: r.evaluate(ord_(s, d), ORD_CROSS).select("rule_id", "issues"),
      ORD + " UNION ALL ".join(f"SELECT {i} AS rule_id, ({sql})::BIGINT AS issues" + (" FROM ord" if sql.startswith("count") else "") for i, (_, t, _, sql) in enumerate(CROSS) if t == "ord"))
check("X08_failing_cross_rows", lambda s, d: r.failing_rows(ord_(s, d), CROSS[1][2], 25).select(ROW_ID, "status", "priority"),
      ORD + "SELECT _row_id, status, priority FROM ord WHERE lower(trim(status)) IN ('f', 'o') AND (priority IS NULL OR trim(priority) = '') ORDER BY _row_id LIMIT 25")
check("X08_failing_composite", lambda s, d: r.failing_rows(ord_(s, d), CROSS[4][2]).select(ROW_ID, "custkey"),
      ORD + "SELECT _row_id, custkey FROM (SELECT *, count(*) OVER (PARTITION BY custkey, status, priority) AS n FROM ord) WHERE n > 1")
check("J03_duplicate_members", lambda s, d: members_of_repeated(view(s, d, "prt").select(ROW_ID, "name"), ["name"], ROW_ID), PRT + "SELECT _row_id, name FROM prt WHERE name IN (SELECT name FROM prt GROUP BY name HAVING count(*) > 1)")

# F: scalar functions
check("F01_patterns", lambda s, d: cust(s, d).select(ROW_ID, text.matches(F.col("code"), "[A-Z]{5}").alias("at_start"), F.col("code").rlike("Z").alias("anywhere"), F.array_join(F.regexp_extract_all("email", F.lit(r"\d"), F.lit(0)), "").alias("found"), F.regexp_replace("segment", "[AEIOU]", "_").alias("replaced")),
      CUST + "SELECT _row_id, regexp_matches(code, '^(?:[A-Z]{5})') AS at_start, regexp_matches(code, 'Z') AS anywhere, array_to_string(regexp_extract_all(email, '\\d'), '') AS found, regexp_replace(segment, '[AEIOU]', '_', 'g') AS replaced FROM cust")
check("F02_strip", lambda s, d: cust(s, d).select(ROW_ID, text.strip(F.concat(F.lit("\t "), F.col("segment"), F.lit("\n"))).alias("stripped")), CUST + f"SELECT _row_id, {strip('segment')} AS stripped FROM cust")
check("F03_basic_text", lambda s, d: cust(s, d).select(ROW_ID, F.upper("name").alias("u"), F.lower("name").alias("l"), F.char_length("name").alias("n"), F.col("code").startswith("ABC").alias("s"), F.contains("email", F.lit("user1")).alias("c")),
      CUST + "SELECT _row_id, upper(name) AS u, lower(name) AS l, length(name) AS n, starts_with(code, 'ABC') AS s, contains(email, 'user1') AS c FROM cust")
TITLED = "concat(segment, '''s new-', segment)"
check("F04_title_case", lambda s, d: cust(s, d).select(ROW_ID, text.title_case(F.concat(F.col("segment"), F.lit("'s new-"), F.col("segment"))).alias("titled")),
      CUST + f"SELECT _row_id, array_to_string(list_transform(regexp_extract_all({TITLED}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS titled FROM cust")
CASE_SQL = "CASE WHEN name IS NULL THEN NULL WHEN NOT regexp_matches(name, '\\p{L}') THEN 'other' WHEN NOT regexp_matches(name, '\\p{Ll}') THEN 'upper' WHEN NOT regexp_matches(name, '\\p{Lu}') THEN 'lower' WHEN NOT regexp_matches(name, '(^|[^\\p{L}])\\p{Ll}|\\p{L}\\p{Lu}') THEN 'title' ELSE 'mixed' END"
check("F05_case_class", lambda s, d: cust(s, d).select(ROW_ID, text.case_class(F.col("name")).alias("k")), CUST + f"SELECT _row_id, {CASE_SQL} AS k FROM cust")
ACCENTED = "concat('Éà ü-', segment, 'ñ Çø')"
check("F06_fold_key", lambda s, d: cust(s, d).select(ROW_ID, text.fold_key(F.expr(ACCENTED)).alias("k")), CUST + f"SELECT _row_id, regexp_replace(lower(strip_accents({ACCENTED})), '[^a-z0-9]+', '', 'g') AS k FROM cust")
check("F07_conversions", lambda s, d: cust(s, d).select(ROW_ID, text.to_number(F.col("amount_text")).alias("n"), F.date_format(text.to_time(F.col("since"), cust(s, d).schema["since"].dataType), "yyyy-MM-dd").alias("t")),
      CUST + "SELECT _row_id, TRY_CAST(amount_text AS DOUBLE) AS n, strftime(TRY_CAST(since AS TIMESTAMP), '%Y-%m-%d') AS t FROM cust")
check("F08_decimals", lambda s, d: line(s, d).groupBy(text.decimals(F.col("l_extendedprice")).alias("digits")).agg(F.count(F.lit(1)).alias("rows")), f"SELECT {DECIMALS('l_extendedprice')} AS digits, count(*) AS rows FROM lineitem GROUP BY ALL")
check("F09_mask", lambda s, d: cust(s, d).groupBy(text.mask(F.col("email")).alias("mask")).agg(F.count(F.lit(1)).alias("rows")), CUST + "SELECT regexp_replace(email, '[A-Za-z0-9]', 'A', 'g') AS mask, count(*) AS rows FROM cust GROUP BY ALL")


def banded(s, d):
    from assayer.functions import bands

    score = F.col("l_discount") * 10
    return line(s, d).groupBy(bands.rating(score).alias("rating"), bands.risk(score).alias("risk"), bands.threshold(score).alias("threshold"), bands.fill_status(score, F.lit(True)).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


SC = "(l_discount * 10)"
check("F10_bands", banded, f"SELECT CASE WHEN {SC} >= 0.95 THEN 'Strong' WHEN {SC} >= 0.85 THEN 'Moderate' WHEN {SC} >= 0.7 THEN 'Needs Attention' ELSE 'Critical' END AS rating, CASE WHEN {SC} >= 0.95 THEN 'Low' WHEN {SC} >= 0.8 THEN 'Medium' ELSE 'High' END AS risk, CASE WHEN {SC} >= 0.95 THEN 'High' WHEN {SC} >= 0.7 THEN 'Medium' ELSE 'Low' END AS threshold,"
      f" CASE WHEN {SC} >= 0.999 THEN 'Complete' WHEN {SC} <= 0 THEN 'Empty' WHEN {SC} < 0.5 THEN 'Critical' WHEN {SC} < 0.9 THEN 'Low' WHEN {SC} < 0.95 THEN 'Watch' ELSE 'Acceptable' END AS status, count(*) AS rows FROM lineitem GROUP BY ALL")
check("F11_time_bounds", lambda s, d: ord_(s, d).agg(F.count_if(F.col("ordered") > as_of()).alias("future"), F.count_if(F.col("ordered") < F.to_timestamp(F.lit("1990-01-01"))).alias("old")),
      ORD + f"SELECT count(*) FILTER (ordered > TIMESTAMP '{AS_OF}') AS future, count(*) FILTER (ordered < TIMESTAMP '1990-01-01') AS old FROM ord")
