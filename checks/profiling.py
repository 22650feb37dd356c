"""Column profiling."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from assayer.operators import correlation, drift, profile as p, suggest, values
from assayer.operators.dedup import categorize
from assayer.plans import dashboard
from checks.base import AS_OF, CUST_ALL, CUST_NUMBERS, CUST_TEXT, ORD_ALL, WS, as_of, check, per_column, read, view, with_views

CUST, ORD, PRT, DOCS = with_views("cust"), with_views("ord"), with_views("prt"), with_views("docs")


def scanned(name, *measures):
    return lambda s, d: p.scan(view(s, d, name), as_of=as_of()).select("column", *measures)


def shares(name):
    def query(s, d):
        df = view(s, d, name)
        return p.with_shares(p.scan(df).drop("distinct_count").join(values.distinct_counts(df), "column"))
    return query


rounded = lambda c, n=6: F.round(c, n).alias(c)

check("A01_null_counts", lambda s, d: shares("cust")(s, d).select("column", "null_count", "non_null_count", rounded("null_percentage"), rounded("non_null_percentage")),
      CUST + per_column("SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count({c}) AS non_null_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage, round(100 - (count(*) - count({c})) * 100.0 / count(*), 6) AS non_null_percentage FROM cust", CUST_ALL))

check("A02_distinct_counts", lambda s, d: shares("ord")(s, d).select("column", "distinct_count", rounded("distinct_percentage")),
      ORD + per_column("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS distinct_percentage FROM ord", ORD_ALL))

check("A03_duplicate_counts", lambda s, d: shares("ord")(s, d).select("column", "duplicate_count", rounded("duplicate_percentage")),
      ORD + per_column("SELECT '{c}' AS \"column\", count(*) - count(DISTINCT {c}) AS duplicate_count, round((count(*) - count(DISTINCT {c})) * 100.0 / count(*), 6) AS duplicate_percentage FROM ord", ORD_ALL))

check("A04_text_lengths", lambda s, d: p.scan(view(s, d, "docs"), ["text", "lang", "source"]).select("column", "min_length", "max_length", rounded("avg_length"), "out_of_bounds"),
      DOCS + per_column("SELECT '{c}' AS \"column\", min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length, count(*) FILTER (length({c}) > 255 OR length({c}) = 0) AS out_of_bounds FROM docs", ["text", "lang", "source"]))

PATTERN_SQL = """SELECT '{c}' AS "column",
 concat_ws(',', CASE WHEN bool_or(regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')) THEN 'Email' END,
  CASE WHEN bool_or(regexp_matches({c}, '^[\\d\\s\\-+()]{7,20}$')) AND bool_or(NOT regexp_matches({c}, '^\\pN+$')) THEN 'Phone' END,
  CASE WHEN bool_or(regexp_matches({c}, '^\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}$') OR regexp_matches({c}, '^\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}$')) THEN 'Date' END,
  CASE WHEN bool_or(regexp_matches({c}, '^https?://[^\\s<>"{}|^`\\[\\]\\\\]+$')) THEN 'URL' END) AS patterns,
 min({c}) FILTER (regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')) AS email_example,
 min({c}) FILTER (regexp_matches({c}, '^\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}$') OR regexp_matches({c}, '^\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}$')) AS date_example FROM cust"""


def full(s, d, name="cust", **kw):
    return p.profile(view(s, d, name), as_of=as_of(), **kw)


check("A05_pattern_presence", lambda s, d: full(s, d, with_outliers=False).where("family = 'text'").select("column", "patterns", "email_example", "date_example"), CUST + per_column(PATTERN_SQL, CUST_TEXT))
check("A05_url_presence", lambda s, d: full(s, d, "pg", with_outliers=False).where("family = 'text'").select("column", "patterns", "url_example"),
      with_views("pg") + per_column("""SELECT '{c}' AS "column", concat_ws(',', CASE WHEN count(*) FILTER (regexp_matches({c}, '^https?://[^\\s<>"{}|^`\\[\\]\\\\]+$')) > 0 THEN 'URL' END) AS patterns, min({c}) FILTER (regexp_matches({c}, '^https?://[^\\s<>"{}|^`\\[\\]\\\\]+$')) AS url_example FROM pg""", ["url", "html"]))

check("A06_pattern_lengths", scanned("conv", "min_length", "max_length"),
      with_views("conv") + per_column("SELECT '{c}' AS \"column\", NULL::INT AS min_length, NULL::INT AS max_length", ["conv_id", "turn"]) + " UNION ALL " + per_column("SELECT '{c}' AS \"column\", min(length({c})) AS min_length, max(length({c})) AS max_length FROM conv", ["role", "text"]))

check("A07_numeric_range", lambda s, d: p.scan(read(s, d, "lineitem")).where("family = 'numeric'").select("column", "min_number", "max_number", "negative_count", "zero_count"),
      per_column("SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min_number, max({c})::DOUBLE AS max_number, count(*) FILTER ({c} < 0) AS negative_count, count(*) FILTER ({c} = 0) AS zero_count FROM lineitem",
                 ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))

check("A08_time_range", lambda s, d: p.scan(view(s, d, "ord"), ["ordered", "shipped"], as_of()).select("column", "oldest", "newest", "future_count"),
      ORD + per_column(f"SELECT '{{c}}' AS \"column\", strftime(min({{c}}), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max({{c}}), '%Y-%m-%d %H:%M:%S') AS newest, count(*) FILTER ({{c}} > TIMESTAMP '{AS_OF}') AS future_count FROM ord", ["ordered", "shipped"]))

IQR = """SELECT '{c}' AS "column", round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound, count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count
 FROM {t}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t}))"""
check("A09_outliers", lambda s, d: p.outliers(read(s, d, "lineitem")).select("column", F.round("lower_bound", 4).alias("lower_bound"), F.round("upper_bound", 4).alias("upper_bound"), "outlier_count"),
      per_column(IQR.replace("{t}", "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def outlier_samples(s, d):
    df = view(s, d, "cust")
    return p.outlier_samples(df, p.outliers(df, ["acctbal"])).select("column", "_row_id", F.col("value").cast("double").alias("value"))


check("A09_outlier_samples", outlier_samples,
      CUST + "SELECT 'acctbal' AS \"column\", _row_id, acctbal AS value FROM cust, (SELECT quantile_cont(acctbal, 0.25) AS q1, quantile_cont(acctbal, 0.75) AS q3 FROM cust) WHERE acctbal < q1 - 1.5 * (q3 - q1) OR acctbal > q3 + 1.5 * (q3 - q1) ORDER BY _row_id LIMIT 3")

SPECIAL = "SELECT '{c}' AS \"column\", symbol, display_name, count(*) AS rows FROM {t}, symbols WHERE CASE symbol WHEN '  ' THEN regexp_matches({c}, '\\s{2,}') WHEN '__' THEN regexp_matches({c}, '_{2,}') ELSE contains({c}, symbol) END GROUP BY ALL"
quoted = lambda text: "'" + text.replace("'", "''") + "'"
SYMBOLS = "symbols AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in [("  ", "multiple spaces"), ("__", "multiple underscores"), *p.SYMBOLS]) + ") AS v(symbol, display_name))"
check("A10_special_characters", lambda s, d: p.special_characters(view(s, d, "docs"), ["text", "source"]),
      DOCS.rstrip() + ", " + SYMBOLS + per_column(SPECIAL.replace("{t}", "docs"), ["text", "source"]))

check("A11_special_rows", scanned("cust", "special_rows"),
      CUST + per_column("SELECT '{c}' AS \"column\", count(*) FILTER (regexp_matches({c}, '[!@#$%^&*()+=\\[\\]{}|\\\\:;\"''<>,.?/]|  |__')) AS special_rows FROM cust", CUST_TEXT) + " UNION ALL " + per_column("SELECT '{c}' AS \"column\", NULL AS special_rows", CUST_NUMBERS))

check("A12_character_frequency", lambda s, d: p.character_frequency(view(s, d, "docs"), ["text"]).select("column", "character", "occurrences", "code_point"),
      DOCS + "SELECT 'text' AS \"column\", ch AS character, count(*) AS occurrences, unicode(ch) AS code_point FROM (SELECT unnest(string_split(regexp_replace(text, '[A-Za-z0-9 \\t\\n\\x0b\\f\\r]', '', 'g'), '')) AS ch FROM docs) WHERE ch <> '' GROUP BY ch")
# Names of the Latin, Greek, Cyrillic, punctuation and kana blocks from the Unicode table; others are compared as UNKNOWN on the SQL side only if they have no name.
BLOCKS = [*range(0x20, 0x530), *range(0x2000, 0x2070), *range(0x3000, 0x3100)]
NAMES = "names(code_point, unicode_name) AS (VALUES " + ", ".join(f"({c}, {quoted(unicodedata.name(chr(c)))})" for c in BLOCKS if unicodedata.name(chr(c), None)) + ")"
check("A12_character_names", lambda s, d: p.character_frequency(view(s, d, "conv"), ["text"]).select("column", "character", "unicode_name"),
      with_views("conv").rstrip() + ", " + NAMES + " SELECT 'text' AS \"column\", ch AS character, coalesce(unicode_name, 'UNKNOWN') AS unicode_name FROM (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[A-Za-z0-9 \\t\\n\\x0b\\f\\r]', '', 'g'), '')) AS ch FROM conv) LEFT JOIN names ON unicode(ch) = code_point WHERE ch <> ''")

strip = lambda c: f"trim({c}, {WS})"
check("A13_accuracy_score", lambda s, d: full(s, d, with_outliers=False).where("family = 'text'").select("column", "multi_space", "edge_space", rounded("accuracy_score", 4)),
      CUST + per_column(f"SELECT '{{c}}' AS \"column\", count(*) FILTER (regexp_matches({{c}}, '\\s{{2,}}')) AS multi_space, count(*) FILTER ({{c}} <> {strip('{c}')}) AS edge_space, round(100 - least(10, count(*) FILTER (regexp_matches({{c}}, '\\s{{2,}}')) * 100.0 / count({{c}})) - least(15, count(*) FILTER ({{c}} <> {strip('{c}')}) * 100.0 / count({{c}})), 4) AS accuracy_score FROM cust", CUST_TEXT))

check("A14_validity_score", lambda s, d: full(s, d, with_outliers=False).select("column", rounded("validity_score", 4)),
      CUST + per_column("SELECT '{c}' AS \"column\", round(100 - least(10, count(*) FILTER ({c} = '') * 100.0 / count(*)), 4) AS validity_score FROM cust", CUST_TEXT) + " UNION ALL " + per_column("SELECT '{c}' AS \"column\", round(100 - least(20, count(*) FILTER (isinf({c}::DOUBLE)) * 100.0 / count(*)), 4) AS validity_score FROM cust", CUST_NUMBERS))

check("A15_blank_breakdown", lambda s, d: full(s, d, with_outliers=False).where("family = 'text'").select("column", "null_count", "empty_strings", "whitespace_only", "total_missing"),
      CUST + per_column("SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) FILTER ({c} = '') AS empty_strings, count(*) FILTER (regexp_full_match({c}, '\\s+')) AS whitespace_only, count(*) FILTER ({c} IS NULL OR regexp_full_match({c}, '\\s*')) AS total_missing FROM cust", CUST_TEXT))

UPPER, LOWER = "(regexp_matches({c}, '\\p{Lu}') AND NOT regexp_matches({c}, '[\\p{Ll}\\p{Lt}]'))", "(regexp_matches({c}, '\\p{Ll}') AND NOT regexp_matches({c}, '[\\p{Lu}\\p{Lt}]'))"
NOT_TITLE = "regexp_matches({c}, '(^|[^\\p{Lu}\\p{Ll}\\p{Lt}])\\p{Ll}|[\\p{Lu}\\p{Ll}\\p{Lt}][\\p{Lu}\\p{Lt}]')"
TITLE = "(regexp_matches({c}, '[\\p{Lu}\\p{Ll}\\p{Lt}]') AND NOT " + NOT_TITLE + ")"
CASE_SQL = f"""SELECT '{{c}}' AS "column", u AS upper_count, l AS lower_count, t AS title_count, n - u - l - t AS mixed_count,
 CASE WHEN u * 1.0 / n > 0.8 THEN 'UPPER' WHEN l * 1.0 / n > 0.8 THEN 'lower' WHEN t * 1.0 / n > 0.8 THEN 'Title' ELSE 'Mixed' END AS case_type
 FROM (SELECT count({{c}}) AS n, count(*) FILTER {UPPER} AS u, count(*) FILTER {LOWER} AS l, count(*) FILTER {TITLE} AS t FROM cust)"""
check("A16_case_distribution", lambda s, d: full(s, d, with_outliers=False).where("family = 'text'").select("column", "upper_count", "lower_count", "title_count", "mixed_count", "case_type"), CUST + per_column(CASE_SQL, CUST_TEXT))

check("A17_business_checks", lambda s, d: full(s, d, with_outliers=False).select("column", F.concat_ws("; ", "violations").alias("violations")),
      CUST + per_column("SELECT '{c}' AS \"column\", CASE WHEN count(*) FILTER ({c} < 0) > 0 THEN 'negative_values (' || count(*) FILTER ({c} < 0) || ')' ELSE '' END AS violations FROM cust", CUST_NUMBERS) + " UNION ALL "
      + per_column("SELECT '{c}' AS \"column\", CASE WHEN bad > 0 AND bad < n / 2 THEN 'invalid_emails (' || bad || ')' ELSE '' END AS violations FROM (SELECT count({c}) AS n, count(*) FILTER (NOT regexp_matches({c}, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$')) AS bad FROM cust)", CUST_TEXT))
check("A17_future_dates", lambda s, d: full(s, d, "ord", with_outliers=False).where("family = 'temporal'").select("column", F.concat_ws("; ", "violations").alias("violations")),
      ORD + per_column(f"SELECT '{{c}}' AS \"column\", CASE WHEN count(*) FILTER ({{c}} > TIMESTAMP '{AS_OF}') > 0 THEN 'future_dates (' || count(*) FILTER ({{c}} > TIMESTAMP '{AS_OF}') || ')' ELSE '' END AS violations FROM ord", ["ordered", "shipped"]))

# Risk, recommendations and suggestions share one SQL profile.
SPECIAL_ROWS = "regexp_matches({c}::VARCHAR, '[!@#$%^&*()+=\\[\\]{}|\\\\:;\"''<>,.?/]|  |__')"
KINDS = " + ".join(f"max(CASE WHEN contains({{c}}::VARCHAR, {quoted(a)}) THEN 1 ELSE 0 END)" for a, _ in p.SYMBOLS) + " + max(CASE WHEN regexp_matches({c}::VARCHAR, '\\s{2,}') THEN 1 ELSE 0 END) + max(CASE WHEN regexp_matches({c}::VARCHAR, '_{2,}') THEN 1 ELSE 0 END)"


def facts(view_name, column, kind, position):
    text = kind == "text"
    fill = lambda sql: sql.replace("{c}", column)
    outlier = f"(SELECT outlier_count FROM ({fill(IQR).replace('{t}', view_name)}))" if kind == "numeric" else "0"
    return f"""SELECT '{column}' AS "column", {position} AS position, '{kind}' AS family, count(*) AS total, count(*) - count({column}) AS nulls, count(DISTINCT {column}) AS uniq,
 {fill('count(*) FILTER ' + '(' + SPECIAL_ROWS + ')') if text else '0'} AS special, {fill(KINDS) if text else '0'} AS kinds, {outlier} AS outliers,
 {fill('min(length({c}))') if text else 'NULL'} AS min_len, {fill('max(length({c}))') if text else 'NULL'} AS max_len, {fill('avg(length({c}))') if text else 'NULL'} AS avg_len,
 {fill("count(*) FILTER ({c} = '')") if text else '0'} AS empties, {fill("count(*) FILTER (regexp_full_match({c}, '\\s+'))") if text else '0'} AS whites,
 {fill('count(*) FILTER ({c} <> ' + strip('{c}') + ')') if text else '0'} AS edges,
 {fill('count(*) FILTER ({c} <> lower({c}) AND {c} <> upper({c}) AND ' + NOT_TITLE + ')') if text else '0'} AS irregular,
 {fill('count(*) FILTER ' + UPPER) if text else '0'} AS ups, {fill('count(*) FILTER ' + LOWER) if text else '0'} AS lows, {fill('count(*) FILTER ' + TITLE) if text else '0'} AS titles,
 {fill("count(*) FILTER (regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$'))") if text else '0'} AS emails,
 {fill('count(*) FILTER ({c} < 0)') if kind == 'numeric' else '0'} AS negatives, {fill(f"count(*) FILTER ({{c}} > TIMESTAMP '{AS_OF}')") if kind == 'temporal' else '0'} AS futures
 FROM {view_name}"""


CUST_KINDS = {c: "numeric" if c in CUST_NUMBERS else "text" for c in CUST_ALL}
ORD_KINDS = {"orderkey": "numeric", "custkey": "numeric", "status": "text", "price": "numeric", "priority": "text", "ordered": "temporal", "shipped": "temporal"}
PRT_KINDS = {"partkey": "numeric", "name": "text", "brand": "text", "type": "text", "size": "numeric", "price": "numeric"}


def fact_cte(view_name, kinds):
    parts = " UNION ALL ".join(facts(view_name, c, k, i) for i, (c, k) in enumerate(kinds.items()))
    return with_views(view_name).rstrip() + f""", facts AS ({parts}), risk AS (SELECT *, nulls * 100.0 / total AS null_pct, uniq * 100.0 / total AS uniq_pct, (total - uniq) * 100.0 / total AS dup_pct,
 CASE WHEN family <> 'text' THEN FALSE ELSE NOT (ups > 0.8 * (total - nulls) OR lows > 0.8 * (total - nulls) OR titles > 0.8 * (total - nulls)) END AS mixed,
 least(100, CASE WHEN nulls * 100.0 / total > 50 THEN 40 WHEN nulls * 100.0 / total > 20 THEN 20 ELSE 0 END + CASE WHEN (total - uniq) * 100.0 / total > 50 AND uniq > 5 THEN 30 ELSE 0 END
  + CASE WHEN special * 100.0 / total > 10 THEN 15 ELSE 0 END + CASE WHEN outliers > 0 THEN 10 ELSE 0 END) AS score FROM facts) """


LEVEL = "CASE WHEN score >= 60 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END"
for label, name, kinds in (("cust", "cust", CUST_KINDS), ("ord", "ord", ORD_KINDS)):
    check(f"A18_risk_{label}", lambda s, d, n=name: full(s, d, n).select("column", "risk_score", "risk_level", F.concat_ws("; ", "key_issues").alias("key_issues")),
          fact_cte(name, kinds) + f"""SELECT "column", score AS risk_score, {LEVEL} AS risk_level, concat_ws('; ', CASE WHEN null_pct > 50 THEN 'mostly_missing' WHEN null_pct > 20 THEN 'often_missing' END,
 CASE WHEN dup_pct > 50 AND uniq > 5 THEN 'repeated_identifier' END, CASE WHEN special * 100.0 / total > 10 THEN 'special_characters' END, CASE WHEN outliers > 0 THEN 'outliers' END) AS key_issues FROM risk""")

check("A19_recommendations", lambda s, d: full(s, d).select("column", F.array_join(F.transform("recommendations", lambda r: F.concat(r["action"], F.lit(": "), r["impact"])), "; ").alias("recommendations")),
      fact_cte("cust", CUST_KINDS) + """SELECT "column", concat_ws('; ', CASE WHEN nulls > 0 AND null_pct < 5 THEN 'drop_rows: ' || nulls || ' rows; impute: ' || nulls || ' rows' END, CASE WHEN null_pct >= 5 THEN 'impute_or_flag: ' || nulls || ' rows' END,
 CASE WHEN special > 0 THEN 'clean_text: ' || special || ' rows' END, CASE WHEN mixed THEN 'unify_case: All rows' END) AS recommendations FROM risk""")

check("A20_suggestions", lambda s, d: full(s, d).select("column", "fuzzy_candidate", F.concat_ws("; ", "suggestions").alias("suggestions")),
      fact_cte("cust", CUST_KINDS) + """SELECT "column", family = 'text' AND uniq * 1.0 / total < 0.9 AS fuzzy_candidate, concat_ws('; ',
 CASE WHEN nulls > 0 THEN '[' || CASE WHEN null_pct > 50 THEN 'Critical' WHEN null_pct > 10 THEN 'Warning' ELSE 'OK' END || '] ' || printf('%.1f', null_pct::DOUBLE) || '% missing' END,
 CASE WHEN empties > 0 THEN empties || ' empty' END, CASE WHEN whites > 0 THEN whites || ' blank' END, CASE WHEN kinds > 0 THEN kinds || ' special characters' END,
 CASE WHEN outliers > 0 THEN outliers || ' outliers' END, CASE WHEN family = 'text' AND uniq * 1.0 / total < 0.9 THEN 'fuzzy_candidate' END,
 CASE WHEN uniq = total AND nulls = 0 THEN 'key_candidate' END, CASE WHEN uniq_pct < 5 THEN 'categorical_candidate' END,
 CASE WHEN edges > 0 THEN 'outer_whitespace' END, CASE WHEN irregular > 0 THEN 'mixed_case' END) AS suggestions FROM risk""")

check("A21_sample_values", lambda s, d: p.sample_values(view(s, d, "cust"), CUST_TEXT).select("column", "_row_id", "value"),
      CUST + per_column("SELECT '{c}' AS \"column\", _row_id, {c} AS value FROM cust WHERE {c} IS NOT NULL ORDER BY _row_id LIMIT 3", CUST_TEXT))

check("A22_column_profile", lambda s, d: full(s, d, "ord").select("column", "total_rows", "null_count", "distinct_count", "duplicate_count", rounded("null_percentage"), rounded("distinct_percentage"), "min_length", "max_length", rounded("avg_length"), "special_rows", "outlier_count", "future_count", "risk_score", "risk_level"),
      fact_cte("ord", ORD_KINDS) + f"""SELECT "column", total AS total_rows, nulls AS null_count, uniq AS distinct_count, total - uniq AS duplicate_count, round(null_pct, 6) AS null_percentage, round(uniq_pct, 6) AS distinct_percentage, min_len AS min_length, max_len AS max_length, round(avg_len, 6) AS avg_length,
 CASE WHEN family = 'text' THEN special END AS special_rows, CASE WHEN family = 'numeric' THEN outliers END AS outlier_count, CASE WHEN family = 'temporal' THEN futures END AS future_count, score AS risk_score, {LEVEL} AS risk_level FROM risk""")


def quality_report(s, d):
    df = view(s, d, "dup").drop("_row_id").withColumn("acctbal", F.lit(None).cast("double"))
    return p.quality_report(df, p.profile(df, as_of=as_of())).select(
        "total_rows", "total_columns", "total_cells", "missing_cells", F.round("missing_percentage", 4).alias("missing_percentage"),
        "exact_duplicate_rows", F.round("exact_duplicate_percentage", 4).alias("exact_duplicate_percentage"), "columns_with_issues", F.round("overall_score", 4).alias("overall_score"))


DUPX_KINDS = {c: ("numeric" if c in CUST_NUMBERS else "text") for c in CUST_ALL}
check("A23_quality_report", quality_report,
      with_views("dup").rstrip() + ", dupx AS (SELECT * REPLACE (NULL::DOUBLE AS acctbal) FROM dup), facts AS (" + " UNION ALL ".join(facts("dupx", c, k, i) for i, (c, k) in enumerate(DUPX_KINDS.items()) if c != "acctbal")
      + """ UNION ALL SELECT 'acctbal', 8, 'numeric', count(*), count(*), 0, 0, 0, 0, NULL, NULL, NULL, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM dupx),
 g AS (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM dupx GROUP BY """ + ", ".join(CUST_ALL) + """ HAVING count(*) > 1)),
 x AS (SELECT max(total) AS total_rows, count(*) AS total_columns, sum(nulls)::BIGINT AS missing_cells, count(*) FILTER (nulls > 0 OR kinds > 0 OR outliers > 0) AS columns_with_issues FROM facts)
 SELECT total_rows, total_columns, total_rows * total_columns AS total_cells, missing_cells, round(missing_cells * 100.0 / (total_rows * total_columns), 4) AS missing_percentage, d::BIGINT AS exact_duplicate_rows, round(d * 100.0 / total_rows, 4) AS exact_duplicate_percentage, columns_with_issues,
 round(100 - least(missing_cells * 150.0 / (total_rows * total_columns), 25) - least(d * 50.0 / total_rows, 20) - least(columns_with_issues * 20.0 / total_columns, 20), 4) AS overall_score FROM x, g""")


def dashboard_summary(s, d):
    df = view(s, d, "dup").drop("_row_id")
    return dashboard.summary(p.profile(df, as_of=as_of()), dashboard.extra_copies(df))


DUP_KINDS = {c: CUST_KINDS[c] for c in CUST_ALL}
check("A24_dashboard_summary", dashboard_summary,
      fact_cte("dup", DUP_KINDS) + f"""SELECT max(total) AS rows, count(*) AS columns, sum(nulls)::BIGINT AS missing_cells, round(sum(nulls) * 100.0 / sum(total), 2) AS missing_percentage, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM dup GROUP BY {', '.join(CUST_ALL)})) AS duplicate_rows,
 count(*) FILTER ({LEVEL} = 'Low') AS low_risk, count(*) FILTER ({LEVEL} = 'Medium') AS medium_risk, count(*) FILTER ({LEVEL} = 'High') AS high_risk FROM risk""")
check("A24_top_null_columns", lambda s, d: dashboard.top_null_columns(full(s, d, with_outliers=False)),
      fact_cte("cust", CUST_KINDS) + 'SELECT "column", round(null_pct, 1) AS null_pct FROM risk WHERE nulls > 0 ORDER BY null_pct DESC, "column" LIMIT 10')
check("A24_type_distribution", lambda s, d: dashboard.type_distribution(p.scan(view(s, d, "cust"))),
      CUST + "SELECT CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE lower(t) END AS dtype, count(*) AS columns FROM (" + " UNION ALL ".join(f"SELECT max(typeof({c})) AS t FROM cust" for c in CUST_ALL) + ") GROUP BY 1")


def issues(s, d):
    df = view(s, d, "cust")
    return dashboard.top_issues(p.profile(df, as_of=as_of()), 6.5, 75, 1000)


check("A25_top_issues", issues, fact_cte("cust", CUST_KINDS) + f"""SELECT severity, message FROM (SELECT 'warning' AS severity, 'Missing data: 6.5% of cells are empty' AS message, 1 AS sev, -2 AS place UNION ALL SELECT 'warning', '75 duplicate rows (7.5%)', 1, -1
 UNION ALL SELECT 'critical', 'Column ''' || "column" || ''' has HIGH risk (score ' || score || ')', 0, position FROM risk WHERE score >= 60
 UNION ALL SELECT 'warning', 'Column ''' || "column" || ''' is more than 50% null', 1, position FROM risk WHERE null_pct > 50
 UNION ALL SELECT 'info', '''' || "column" || ''': negative_values (' || negatives || ')', 2, position FROM risk WHERE negatives > 0
 UNION ALL SELECT 'info', '''email'': invalid_emails (' || (SELECT count(*) FILTER (NOT regexp_matches(email, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$')) FROM cust) || ')', 2, 3) ORDER BY sev, place, message LIMIT 8""")
check("A25_risk_counts", lambda s, d: dashboard.risk_counts(full(s, d, "ord")), fact_cte("ord", ORD_KINDS) + f"SELECT {LEVEL} AS risk_level, count(*) AS columns FROM risk GROUP BY ALL")

UNIQ = "CASE WHEN uniq_pct < 100 THEN least(100, uniq_pct * 1.2) ELSE 90 END"
check("A26_kpi", lambda s, d: dashboard.kpi(full(s, d, with_outliers=False)),
      fact_cte("cust", CUST_KINDS) + f"SELECT max(total) AS rows, count(*) AS columns, round(avg((100 - null_pct) * 0.4 + {UNIQ} * 0.3 + CASE WHEN mixed THEN 80 ELSE 100 END * 0.2 + (100 - least(20, kinds * 2)) * 0.1), 1) AS quality_pct, round((sum(total) - sum(nulls)) * 100.0 / sum(total), 2) AS completeness_pct, sum(nulls)::BIGINT AS missing_cells FROM risk")
check("A27_overview_gauges", lambda s, d: dashboard.gauges(full(s, d, "ord")).select("quality_gauge", "duplicate_risk_gauge", F.round("mean_min_length", 4).alias("mean_min_length"), F.round("mean_avg_length", 4).alias("mean_avg_length"), F.round("mean_max_length", 4).alias("mean_max_length")),
      fact_cte("ord", ORD_KINDS) + f"SELECT round(avg((100 - null_pct) * 0.5 + {UNIQ} * 0.3 + (100 - score) * 0.2), 1) AS quality_gauge, round(count(*) FILTER (total > uniq) * 100.0 / count(*), 1) AS duplicate_risk_gauge, round(avg(min_len), 4) AS mean_min_length, round(avg(avg_len), 4) AS mean_avg_length, round(avg(max_len), 4) AS mean_max_length FROM risk")
check("A27_most_distinct", lambda s, d: dashboard.most_distinct(full(s, d, "ord", with_outliers=False), 5), fact_cte("ord", ORD_KINDS) + 'SELECT "column", uniq AS distinct_count, total - uniq AS duplicate_count FROM risk ORDER BY uniq DESC, position LIMIT 5')
check("A27_type_buckets", lambda s, d: dashboard.type_buckets(p.scan(view(s, d, "ord"))), fact_cte("ord", ORD_KINDS) + "SELECT CASE family WHEN 'numeric' THEN 'Numeric' WHEN 'temporal' THEN 'DateTime' ELSE 'Text' END AS bucket, count(*) AS columns FROM risk GROUP BY ALL")

DUP_TEXT = """SELECT '{c}' AS "column", coalesce(string_agg(CASE WHEN v IS NULL OR trim(v) = '' THEN 'Missing Values(' || n || ')' ELSE trim(v) || '(' || n || ')' END, ', ' ORDER BY n DESC, v NULLS FIRST) FILTER (n > 1), 'No duplicates') AS duplicate_values, count(*) FILTER (n > 1) AS repeated_values FROM (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY {c})"""
check("A28_repeated_values", lambda s, d: values.repeated_values(view(s, d, "cust"), ["name", "segment", "since", "nationkey"]), CUST + per_column("SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS rows FROM cust GROUP BY ALL HAVING count(*) > 1", ["name", "segment", "since", "nationkey"]))
check("A28_profile_table", lambda s, d: dashboard.profile_table(view(s, d, "prt"), full(s, d, "prt", with_outliers=False)).where("column in ('name', 'brand', 'type')").select("column", "distinct_count", "duplicate_values", "repeated_values"),
      PRT + "SELECT a.*, b.distinct_count FROM (" + per_column(DUP_TEXT.replace("{t}", "prt"), ["name", "brand", "type"]) + ") a JOIN (" + per_column("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM prt", ["name", "brand", "type"]) + ') b USING ("column")')

GROUPS = """SELECT '{c}' AS "column", rank, substr(v, 1, 50) AS value, n AS rows, round(n * 100.0 / (SELECT count(*) FROM prt), 2) AS percentage, (SELECT string_agg(_row_id, ',' ORDER BY _row_id) FROM (SELECT _row_id FROM prt WHERE {c} = v ORDER BY _row_id LIMIT 5)) AS row_ids
 FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM prt WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1) WHERE rank <= 10"""


def value_groups(s, d):
    df = view(s, d, "prt")
    return values.repeated_value_groups(df, ["name", "brand", "type"], df.count())


check("A29_repeated_value_groups", value_groups, PRT + per_column(GROUPS, ["name", "brand", "type"]))


def cards(s, d):
    df = view(s, d, "prt")
    cards = dashboard.column_cards(df, full(s, d, "prt", with_outliers=False), df.count())
    return cards.where("column in ('name', 'brand', 'type')").select("column", "total_rows", "null_count", "distinct_count", "duplicate_values", F.size("groups").alias("groups"), F.element_at("groups", 1)["value"].alias("top_value"), F.element_at("groups", 1)["rows"].alias("top_rows"))


check("A30_column_cards", cards, PRT + "SELECT a.\"column\", f.total_rows, f.null_count, f.distinct_count, a.duplicate_values, g.groups, g.top_value, g.top_rows FROM (" + per_column(DUP_TEXT.replace("{t}", "prt"), ["name", "brand", "type"]) + ') a JOIN ('
      + per_column("SELECT '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM prt", ["name", "brand", "type"]) + ') f USING ("column") JOIN (SELECT "column", count(*) AS groups, max(value) FILTER (rank = 1) AS top_value, max(rows) FILTER (rank = 1) AS top_rows FROM (' + per_column(GROUPS, ["name", "brand", "type"]) + ') GROUP BY "column") g USING ("column")')

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
check("A31_pearson", lambda s, d: correlation.pearson(read(s, d, "lineitem"), NUM).select("column_a", "column_b", F.round("correlation", 5).alias("correlation"), "strong"),
      " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(corr({a}, {b}), 0), 5) AS correlation, abs(coalesce(corr({a}, {b}), 0)) >= 0.8 AS strong FROM lineitem" for a, b in PAIRS))
check("A31_pearson_missing", lambda s, d: correlation.pearson(view(s, d, "cust"), CUST_NUMBERS).select("column_a", "column_b", F.round("correlation", 5).alias("correlation")),
      CUST + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(corr({a}, {b}), 0), 5) AS correlation FROM cust" for a, b in [("custkey", "nationkey"), ("custkey", "acctbal"), ("nationkey", "acctbal")]))
RANKED = "SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(corr(ra, rb), 0), 5) AS correlation FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
SPEAR = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
check("A32_spearman", lambda s, d: correlation.spearman(read(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("column_a", "column_b", F.round("correlation", 5).alias("correlation")),
      " UNION ALL ".join(RANKED.replace("{a}", a).replace("{b}", b).replace("{t}", "lineitem") for a, b in SPEAR))

MATCH_SQL = """, e AS (SELECT *, row_number() OVER (ORDER BY s DESC, position) AS n FROM (SELECT "column", position, CASE WHEN uniq_pct >= 95 AND uniq_pct < 100 THEN 35 WHEN uniq_pct >= 80 AND uniq_pct < 95 THEN 25 ELSE 0 END + CASE WHEN null_pct < 1 THEN 20 WHEN null_pct < 5 THEN 15 ELSE 0 END
  + CASE WHEN family = 'text' AND max_len = min_len AND avg_len BETWEEN 4 AND 20 THEN 25 ELSE 0 END + CASE WHEN dup_pct > 0 AND dup_pct < 5 THEN 15 ELSE 0 END AS s FROM risk WHERE uniq < total) WHERE s >= 50),
 f AS (SELECT *, row_number() OVER (ORDER BY s DESC, position) AS n FROM (SELECT "column", position, CASE WHEN uniq_pct BETWEEN 30 AND 90 THEN 35 WHEN uniq_pct >= 10 AND uniq_pct < 30 THEN 20 ELSE 0 END + CASE WHEN avg_len BETWEEN 10 AND 100 THEN 25 WHEN avg_len > 100 THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches("column", 'name|desc|title|product|customer|company|vendor|supplier|brand|item') THEN 25 ELSE 0 END + CASE WHEN total - uniq > 1 THEN 15 ELSE 0 END AS s FROM risk WHERE family = 'text') WHERE s >= 45),
 c AS (SELECT 'Exact' AS rule_type, "column" AS columns, CASE WHEN s >= 85 THEN 'Strongest' WHEN s >= 75 THEN 'Very Strong' WHEN s >= 65 THEN 'Strong' ELSE 'Good' END AS probability, s::DOUBLE AS confidence, 0 AS k, n AS seq FROM e WHERE n <= 4
  UNION ALL SELECT 'Fuzzy', "column", CASE WHEN s >= 70 THEN 'Strong' WHEN s >= 60 THEN 'Good' ELSE 'Medium' END, s, 1, n FROM f WHERE n <= 4
  UNION ALL SELECT 'Combined', e."column" || ' (Exact) + ' || f."column" || ' (Fuzzy)', CASE WHEN (e.s + f.s) / 2.0 >= 75 THEN 'Enterprise' WHEN (e.s + f.s) / 2.0 >= 65 THEN 'Strong' ELSE 'Good' END, (e.s + f.s) / 2.0, 2, (e.n - 1) * 3 + f.n FROM e, f WHERE e.n <= 2 AND f.n <= 3 AND e."column" <> f."column"),
 t AS (SELECT *, row_number() OVER (ORDER BY k, seq) AS place FROM c)
 SELECT printf('R%02d', row_number() OVER (ORDER BY confidence DESC, place)) AS rule_no, rule_type, columns, probability, confidence FROM t WHERE place <= 10"""
for label, kinds in (("cust", CUST_KINDS), ("dup", DUP_KINDS)):
    check(f"A33_match_rules_{label}", lambda s, d, n=label: suggest.match_rules(full(s, d, n, with_outliers=False)), fact_cte(label, kinds).rstrip() + MATCH_SQL)

check("A34_column_categories", lambda s, d: categorize(full(s, d, with_outliers=False)).select("column", "category"),
      fact_cte("cust", CUST_KINDS) + """SELECT "column", CASE WHEN regexp_matches("column", '_id|id|key|uuid|guid|serial|sequence') AND uniq_pct > 95 THEN 'unique_identifiers' WHEN regexp_matches("column", 'name|number|email|phone|mobile|tax|pan|gstin|account|code|vendor|supplier|customer') THEN 'critical_business'
 WHEN regexp_matches("column", 'batch|import|action|status|created|updated|modified|date|time|user') THEN 'metadata' ELSE 'descriptive' END AS category FROM risk""")

BASE = """SELECT '{c}' AS "column", round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_percentage, round(count(DISTINCT {c}) * 100.0 / count(*), 4) AS distinct_percentage, count(DISTINCT {c}) AS distinct_count, {n} AS row_count FROM {t}"""
NUMERIC_BASE = BASE.replace("{n}", "round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, count(*)")
OTHER_BASE = BASE.replace("{n}", "NULL AS mean, NULL AS std, NULL AS min, NULL AS max, NULL AS median, count(*)")


def stats_rounded(df):
    return df.select("column", F.round("null_percentage", 4).alias("null_percentage"), F.round("distinct_percentage", 4).alias("distinct_percentage"), "distinct_count",
                     F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "min", "max", F.round("median", 4).alias("median"), "row_count")


check("A35_baseline_statistics", lambda s, d: stats_rounded(drift.baseline(view(s, d, "cust"))),
      CUST + per_column(NUMERIC_BASE.replace("{t}", "cust"), CUST_NUMBERS) + " UNION ALL " + per_column(OTHER_BASE.replace("{t}", "cust"), CUST_TEXT))

EVIDENCE = """SELECT '{c}' AS "column", count(*) AS total, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, (SELECT string_agg({c}, '|' ORDER BY _row_id) FROM (SELECT {c}, _row_id FROM cust WHERE {c} IS NOT NULL ORDER BY _row_id LIMIT 3)) AS samples,
 (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM cust WHERE {c} IS NOT NULL ORDER BY v LIMIT 50)) AS distinct_values, 'string' AS dtype FROM cust"""
check("A36_evidence", lambda s, d: p.evidence(view(s, d, "cust"), CUST_TEXT), CUST + per_column(EVIDENCE, CUST_TEXT))
