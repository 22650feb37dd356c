"""Exact, linked and fuzzy duplicates; golden records."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import ROW_ID
from assayer.functions import text
from assayer.operators import clusters, dedup, fuzzy, golden, profile
from assayer.plans import library
from checks.base import CUST_ALL, as_of, check, read, view, with_views

DUP, PRT, EV = with_views("dup"), with_views("prt"), with_views("ev")
dup = lambda s, d: view(s, d, "dup")
prt = lambda s, d: view(s, d, "prt")
ev = lambda s, d: view(s, d, "ev")
KEY = ["name", "code", "email"]
KEYS = "name, code, email"
WIN = "OVER (PARTITION BY name, code, email)"
GROUPED = DUP.rstrip() + f", m AS (SELECT *, min(_row_id) {WIN} AS group_id, count(*) {WIN} AS n FROM dup WHERE name IS NOT NULL OR code IS NOT NULL OR email IS NOT NULL), g AS (SELECT * FROM m WHERE n > 1) "


def found(s, d):
    df = dup(s, d)
    return df, dedup.members(df, dedup.exact_groups(df, KEY), KEY)


def with_members(use):
    return lambda s, d: use(*found(s, d))


check("U01_exact_groups", lambda s, d: dedup.exact_groups(dup(s, d), KEY), GROUPED + f"SELECT group_id, {KEYS}, count(*) AS rows FROM g GROUP BY ALL")
check("U01_exact_members", with_members(lambda df, m: m), GROUPED + "SELECT group_id, _row_id, _row_id = group_id AS is_leader, 100.0::DOUBLE AS score FROM g")
check("U01_full_row_lineitem", lambda s, d: dedup.exact_groups(read(s, d, "lineitem").withColumn(ROW_ID, F.col("l_orderkey") * 8 + F.col("l_linenumber")), ["l_orderkey", "l_linenumber"]).groupBy("rows").agg(F.count(F.lit(1)).alias("groups")),
      "SELECT n AS rows, count(*) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY n")
check("U01_document_texts", lambda s, d: dedup.members(view(s, d, "docs"), dedup.exact_groups(view(s, d, "docs"), ["text"], by_digest=True), ["text"]).select("group_id", ROW_ID),
      with_views("docs") + "SELECT group_id, _row_id FROM (SELECT _row_id, min(_row_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS n FROM docs) WHERE n > 1")
check("U02_normal_form", lambda s, d: view(s, d, "cust").select(ROW_ID, text.normal_form(F.col("segment")).alias("a"), text.normal_form(F.col("email")).alias("b")),
      with_views("cust") + "SELECT _row_id, " + ", ".join(f"strip_accents(trim(regexp_replace(regexp_replace(trim(lower({c})), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS {n}" for c, n in (("segment", "a"), ("email", "b"))) + " FROM cust")

LCS = "list_reduce(string_split({a}, ''), lambda prev, ch: list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN substr({b}, j, 1) = ch THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0::BIGINT]), list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT))[-1]"
RATIO = "(200.0 * " + LCS + " / (length({a}) + length({b})))"
lcs_of = lambda a, b, form=RATIO: form.replace("{a}", a).replace("{b}", b)
PAIRS = "SELECT a, b, count(*) AS rows FROM (SELECT p_name AS a, lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS b FROM part) GROUP BY ALL"
pairs = lambda s, d: read(s, d, "part").select(F.col("p_name").alias("a"), F.concat(F.lower("p_type"), F.lit(" "), F.split("p_name", " ")[1]).alias("b"))
check("U03_ratio", lambda s, d: fuzzy.score_pairs(pairs(s, d), "a", "b", ["ratio"]).withColumn("ratio", F.round("ratio", 6)), f"SELECT a, b, rows, round({lcs_of('a', 'b')}, 6) AS ratio FROM ({PAIRS})")
check("U04_block_ratio", lambda s, d: fuzzy.score_pairs(pairs(s, d), "a", "b", ["difflib"]))
check("U05_jaro_winkler", lambda s, d: fuzzy.score_pairs(pairs(s, d), "a", "b", ["jaro_winkler"]).withColumn("jaro_winkler", F.round("jaro_winkler", 4)), f"SELECT a, b, rows, round(100 * jaro_winkler_similarity(a, b), 4) AS jaro_winkler FROM ({PAIRS})")
check("U06_metaphone", lambda s, d: fuzzy.score_pairs(pairs(s, d), "a", "b", ["metaphone"]))
check("U07_combined", lambda s, d: fuzzy.score_pairs(pairs(s, d), "a", "b", ["combined", "ratio", "jaro_winkler", "metaphone"]))

# Greedy leader clustering over the distinct names in row order.
FORMS = PRT.rstrip() + ", v AS (SELECT lower(name) AS f, min(_row_id) AS id FROM prt GROUP BY 1), l AS (SELECT list_reduce(list(f ORDER BY id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {sim})) > 0 THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS leaders FROM v), o AS (SELECT v.f, list_filter(leaders, lambda x: {own})[1] AS leader FROM v, l), r AS (SELECT prt._row_id, v.id AS group_id FROM prt JOIN o ON lower(prt.name) = o.f JOIN v ON v.f = o.leader) "
forms = lambda sim: FORMS.replace("{sim}", sim("y", "x")).replace("{own}", sim("x", "v.f"))
at_least = lambda t: lambda a, b: f"{lcs_of(a, b)} >= {t}"
members_sql = "SELECT group_id, _row_id, _row_id = group_id AS is_leader FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM r) WHERE n > 1"
for t in (85, 70):
    check(f"U08_fuzzy_groups_{t}", lambda s, d, t=t: fuzzy.fuzzy_groups(prt(s, d), "name", float(t)).select("group_id", ROW_ID, "is_leader"), forms(at_least(t)) + members_sql)
check("U08_fuzzy_groups_jaro_winkler", lambda s, d: fuzzy.fuzzy_groups(prt(s, d), "name", 88.0, "jaro_winkler").select("group_id", ROW_ID, "is_leader"), forms(lambda a, b: f"100 * jaro_winkler_similarity({a}, {b}) >= 88") + members_sql)
check("J04_fuzzy_self_join", lambda s, d: fuzzy.fuzzy_groups(prt(s, d), "name", 60.0).groupBy("group_id").agg(F.count(F.lit(1)).alias("rows")), forms(at_least(60)) + "SELECT group_id, count(*) AS rows FROM r GROUP BY group_id HAVING count(*) > 1")
check("U08_customer_names", lambda s, d: fuzzy.fuzzy_groups(view(s, d, "cust"), "email", 92.0, "difflib").groupBy("group_id").agg(F.count(F.lit(1)).alias("rows")))
SECOND = f"SELECT g.group_id, g.rows, CASE WHEN lower(p.name) = v.f THEN 100.0 ELSE {lcs_of('v.f', 'lower(p.name)')} END AS score FROM (SELECT group_id, count(*) AS rows, min(_row_id) FILTER (_row_id <> group_id) AS second FROM r GROUP BY group_id HAVING count(*) > 1) g JOIN prt p ON p._row_id = g.second JOIN v ON v.id = g.group_id"
check("U08_group_scores", lambda s, d: fuzzy.group_scores(fuzzy.fuzzy_groups(prt(s, d), "name", 70.0)), forms(at_least(70)) + SECOND)

WITHIN = PRT.rstrip() + """, v AS (SELECT brand, lower(name) AS f, min(_row_id) AS id FROM prt GROUP BY 1, 2), l AS (SELECT brand, list_reduce(list(f ORDER BY id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {sim})) > 0 THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS leaders FROM v GROUP BY brand),
 o AS (SELECT v.brand, v.f, list_filter(leaders, lambda x: {own})[1] AS leader FROM v JOIN l USING (brand)), r AS (SELECT prt._row_id, v.id AS group_id FROM prt JOIN o ON prt.brand = o.brand AND lower(prt.name) = o.f JOIN v ON v.brand = o.brand AND v.f = o.leader) """
within = WITHIN.replace("{sim}", at_least(80)("y", "x")).replace("{own}", at_least(80)("x", "v.f"))
check("U09_combined_groups", lambda s, d: fuzzy.fuzzy_groups(prt(s, d), "name", 80.0, within=["brand"]).select("group_id", ROW_ID, "is_leader"), within + members_sql)
check("J05_exact_block_then_fuzzy", lambda s, d: fuzzy.group_scores(fuzzy.fuzzy_groups(prt(s, d), "name", 80.0, within=["brand"])).select("group_id", "rows"), within + "SELECT group_id, count(*) AS rows FROM r GROUP BY group_id HAVING count(*) > 1")


# All words of all conversations, told apart by a digest that SQL has, inside their first two letters: thousands of values, hundreds of scopes.
def words(s, d):
    found = read(s, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("word")).distinct()
    return found.select(F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 15), 16, 10).cast("bigint").alias(ROW_ID), "word", F.substring("word", 1, 2).alias("initials"))


WORDS = "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS f FROM conversations), v AS (SELECT f, substr(f, 1, 2) AS initials, ('0x' || substr(md5(f), 1, 15))::BIGINT AS id FROM w), l AS (SELECT initials, list_reduce(list(f ORDER BY id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {sim})) > 0 THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS leaders FROM v GROUP BY initials), o AS (SELECT v.f, v.id, list_filter(leaders, lambda x: {own})[1] AS leader FROM v JOIN l USING (initials)), r AS (SELECT o.id AS _row_id, v.id AS group_id FROM o JOIN v ON v.f = o.leader) "
word_sql = lambda sim: WORDS.replace("{sim}", sim("y", "x")).replace("{own}", sim("x", "v.f")) + members_sql
check("U08_word_groups_70", lambda s, d: fuzzy.fuzzy_groups(words(s, d), "word", 70.0, within=["initials"]).select("group_id", ROW_ID, "is_leader"), word_sql(at_least(70)))
check("U08_word_groups_jaro_winkler", lambda s, d: fuzzy.fuzzy_groups(words(s, d), "word", 90.0, "jaro_winkler", within=["initials"]).select("group_id", ROW_ID, "is_leader"), word_sql(lambda a, b: f"100 * jaro_winkler_similarity({a}, {b}) >= 90"))
check("U06_metaphone_groups", lambda s, d: fuzzy.fuzzy_groups(prt(s, d), "name", 85.0, "metaphone"))
check("U07_combined_score_groups", lambda s, d: fuzzy.fuzzy_groups(prt(s, d), "name", 80.0, "combined"))

check("U10_all_columns_equal", lambda s, d: dedup.groups_all_present(dup(s, d), KEY).select("group_id", "rows"),
      DUP + f"SELECT min(_row_id) AS group_id, count(*) AS rows FROM dup WHERE name IS NOT NULL AND code IS NOT NULL AND email IS NOT NULL GROUP BY {KEYS} HAVING count(*) > 1")

LINKS = EV.rstrip() + """, e AS (SELECT DISTINCT _row_id AS u, min(_row_id) OVER (PARTITION BY who) AS v FROM ev WHERE who IS NOT NULL UNION SELECT _row_id, min(_row_id) OVER (PARTITION BY device) FROM ev WHERE device IS NOT NULL), b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v) """
CC = LINKS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, cc(node, root) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION (SELECT b.u AS node, min(cc.root) AS root FROM cc JOIN b ON cc.node = b.v JOIN recurring.cc AS mine ON mine.node = b.u WHERE cc.root < mine.root GROUP BY b.u)) """
check("U11_any_column_equal", lambda s, d: clusters.or_groups(ev(s, d), ["who", "device"]).select("group_id", ROW_ID), CC + "SELECT root AS group_id, node AS _row_id FROM cc")


def or_summary(s, d):
    df = ev(s, d)
    return dedup.summaries(df, clusters.or_groups(df, ["who", "device"]), ["who", "device"], "custom_or").select("group_id", "rows", "match_type")


check("U11_cluster_sizes", or_summary, CC + "SELECT root AS group_id, count(*) AS rows, 'custom_or' AS match_type FROM cc GROUP BY root")

check("U12_group_summary", with_members(lambda df, m: dedup.summaries(df, m, KEY, "exact")),
      GROUPED + "SELECT g.group_id, count(*) AS rows, 100.0::DOUBLE AS similarity, 'exact' AS match_type, 'name, code, email' AS key_columns, any_value(CASE WHEN length(s) > 50 THEN substr(s, 1, 50) || '...' ELSE s END) AS representative FROM g JOIN (SELECT _row_id AS group_id, concat_ws(' | ', name, code, email) AS s FROM dup) USING (group_id) GROUP BY g.group_id")
check("U12_group_details", lambda s, d: dedup.details(prt(s, d), dedup.members(prt(s, d), dedup.exact_groups(prt(s, d), ["name"]), ["name"]), 5).select("group_id", ROW_ID, "name", "brand"),
      PRT + "SELECT group_id, _row_id, name, brand FROM (SELECT *, min(_row_id) OVER (PARTITION BY name) AS group_id, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY _row_id) AS k FROM prt) WHERE n > 1 AND k <= 5")

for keep, condition in (("first", "row_number() OVER (PARTITION BY name, code, email ORDER BY _row_id) = 1"), ("last", "row_number() OVER (PARTITION BY name, code, email ORDER BY _row_id DESC) = 1"), ("none", f"count(*) {WIN} = 1")):
    check(f"U13_remove_exact_{keep}", lambda s, d, k=keep: dedup.remove_exact(dup(s, d), KEY, k).select(ROW_ID, "name"), DUP + f"SELECT _row_id, name FROM dup QUALIFY {condition}")
REST = "SELECT _row_id, acctbal, since FROM dup WHERE _row_id NOT IN (SELECT _row_id FROM g)"
for strategy, order in (("keep_first", "_row_id"), ("keep_last", "_row_id DESC")):
    check(f"U14_{strategy}", with_members(lambda df, m, k=strategy: dedup.remove_groups(df, m, k).select(ROW_ID, "acctbal", "since")),
          GROUPED + f"{REST} UNION ALL SELECT _row_id, acctbal, since FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS k FROM g) WHERE k = 1")
check("U14_merge", with_members(lambda df, m: dedup.remove_groups(df, m, "merge").select(ROW_ID, "acctbal", "since")),
      GROUPED + f"{REST} UNION ALL SELECT group_id, arg_min(acctbal, _row_id) FILTER (acctbal IS NOT NULL), arg_min(since, _row_id) FILTER (since IS NOT NULL) FROM g GROUP BY group_id")
check("U14_keep_selected", with_members(lambda df, m: dedup.remove_groups(df, m, "keep_selected", m.where("not is_leader and group_id % 40 = 0")).select(ROW_ID)),
      GROUPED + "SELECT _row_id FROM dup WHERE _row_id NOT IN (SELECT _row_id FROM g) UNION ALL SELECT max(_row_id) FROM g GROUP BY group_id HAVING group_id % 40 = 0 UNION ALL SELECT group_id FROM g GROUP BY group_id HAVING group_id % 40 <> 0")
check("U14_keep_multiple", with_members(lambda df, m: dedup.remove_groups(df, m, "keep_multiple", m.where("group_id % 40 = 0")).select(ROW_ID)),
      GROUPED + "SELECT _row_id FROM dup WHERE _row_id NOT IN (SELECT _row_id FROM g) UNION ALL SELECT _row_id FROM g WHERE group_id % 40 = 0 UNION ALL SELECT group_id FROM g GROUP BY group_id HAVING group_id % 40 <> 0")
check("U15_bulk_merge", with_members(lambda df, m: dedup.remove_chosen_groups(df, m, m.where("group_id % 40 = 0"), "merge").select(ROW_ID, "acctbal", "since")),
      GROUPED + f"{REST} UNION ALL SELECT _row_id, acctbal, since FROM g WHERE group_id % 40 <> 0 UNION ALL SELECT group_id, arg_min(acctbal, _row_id) FILTER (acctbal IS NOT NULL), arg_min(since, _row_id) FILTER (since IS NOT NULL) FROM g WHERE group_id % 40 = 0 GROUP BY group_id")

NON_NULL = " + ".join(f"({c} IS NOT NULL)::INT" for c in CUST_ALL)
LATEST = "TRY_CAST(since AS TIMESTAMP)"
check("U16_most_complete", with_members(lambda df, m: golden.golden_records(df, m).select("group_id", "survivor_id", "acctbal", "since")),
      GROUPED + f"SELECT group_id, _row_id AS survivor_id, acctbal, since FROM g QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {NON_NULL} DESC, _row_id) = 1")
check("U17_most_recent", with_members(lambda df, m: golden.golden_records(df, m, "most_recent", "since").select("group_id", "survivor_id", "acctbal", "since")),
      GROUPED + f"SELECT group_id, _row_id AS survivor_id, acctbal, since FROM g QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {LATEST} DESC NULLS LAST, _row_id) = 1")
MERGE = GROUPED.rstrip() + f", lead AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {LATEST} DESC NULLS LAST, _row_id) = 1), first AS (SELECT group_id, arg_min(acctbal, _row_id) FILTER (acctbal IS NOT NULL) AS a, min(_row_id) FILTER (acctbal IS NOT NULL) AS a_id, arg_min(since, _row_id) FILTER (since IS NOT NULL) AS s, min(_row_id) FILTER (since IS NOT NULL) AS s_id FROM g GROUP BY group_id) "
merged = lambda df, m: golden.golden_records(df, m, "field_level_merge", "since", ["most_recent", "most_complete"])
check("U18_field_level_merge", with_members(lambda df, m: merged(df, m).select("group_id", "survivor_id", "acctbal", "since")),
      MERGE + "SELECT group_id, _row_id AS survivor_id, coalesce(acctbal, a) AS acctbal, coalesce(since, s) AS since FROM lead JOIN first USING (group_id)")
ORIGIN = lambda c, value, source: f"SELECT group_id, '{c}' AS \"column\", CASE WHEN {c} IS NOT NULL THEN _row_id ELSE {source} END AS source_row_id, CASE WHEN {c} IS NOT NULL THEN 'leader_non_null' WHEN {source} IS NULL THEN 'all_null' ELSE 'first_non_null_in_group' END AS reason FROM lead JOIN first USING (group_id)"
check("U19_provenance", with_members(lambda df, m: golden.provenance_rows(merged(df, m)).where("column in ('acctbal', 'since')")), MERGE + ORIGIN("acctbal", "a", "a_id") + " UNION ALL " + ORIGIN("since", "s", "s_id"))


def survivors(df, m):
    overrides = m.where("is_leader").select("group_id", F.lit("email").alias("column"), F.concat(F.lit("fixed-"), F.col("group_id").cast("string")).alias("value"))
    return golden.apply_survivors(df, m, merged(df, m), overrides).select(ROW_ID, "email", "acctbal")


check("U20_apply_survivors", with_members(survivors), MERGE + "SELECT _row_id, email, acctbal FROM dup WHERE _row_id NOT IN (SELECT _row_id FROM g) UNION ALL SELECT _row_id, 'fixed-' || group_id, coalesce(acctbal, a) FROM lead JOIN first USING (group_id)")


def library_exact(s, d):
    df = dup(s, d).withColumnsRenamed({"name": "vendor_name", "code": "pan_no", "email": "gst_no", "since": "updated_at"})
    found = library.scan(df, "vendor-domestic-name-pan-gst")
    return library.golden(df, "vendor-domestic-name-pan-gst", found).select("group_id", "survivor_id", "acctbal")


LIB = GROUPED.rstrip() + f", lead AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {NON_NULL} DESC, _row_id) = 1), first AS (SELECT group_id, arg_min(acctbal, _row_id) FILTER (acctbal IS NOT NULL) AS a FROM g GROUP BY group_id) "
check("U21_library_exact", library_exact, LIB + "SELECT group_id, _row_id AS survivor_id, coalesce(acctbal, a) AS acctbal FROM lead JOIN first USING (group_id)")


def library_fuzzy(s, d):
    df = prt(s, d).select(ROW_ID, F.col("name").alias("description"), F.col("type").alias("category"))
    return library.scan(df, "material-fuzzy-description-category").select("group_id", ROW_ID)


SORTED = within.replace("brand", "type").replace("lower(name)", "array_to_string(list_sort(string_split(lower(name), ' ')), ' ')").replace("lower(prt.name)", "array_to_string(list_sort(string_split(lower(prt.name), ' ')), ' ')")
check("U21_library_fuzzy", library_fuzzy, SORTED + "SELECT group_id, _row_id FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM r) WHERE n > 1")
MATRIX = [("Single: name", ["name"]), ("Single: code", ["code"]), ("Pair: email+segment", ["email", "segment"]), ("Triple: name+code+email", ["name", "code", "email"]), ("Complete Match", ["name", "code", "email", "segment", "nationkey"])]
PLACE = "('', 'NULL', 'NONE', 'NA', 'N/A', 'NAN', 'BLANK', '-', '--', '---')"
OK = lambda keys: " AND ".join(f"upper(trim({k}::VARCHAR)) NOT IN {PLACE}" for k in keys)
check("U22_duplicate_matrix", lambda s, d: dedup.duplicate_matrix(dup(s, d), MATRIX),
      DUP + "SELECT _row_id, min(k) AS match_order, arg_min(l, k) AS matched_by FROM (" + " UNION ALL ".join(f"SELECT _row_id, {i} AS k, '{label}' AS l FROM dup WHERE {OK(keys)} QUALIFY count(*) OVER (PARTITION BY {', '.join(keys)}) > 1" for i, (label, keys) in enumerate(MATRIX)) + ") GROUP BY _row_id")


def matrix_sets(s, d):
    df = dup(s, d)
    kinds = {r["column"]: r["category"] for r in dedup.categorize(profile.profile(df, with_outliers=False)).orderBy("position").collect()}
    return dedup.duplicate_matrix(df, dedup.matrix_key_sets(kinds)).groupBy("matched_by").agg(F.count(F.lit(1)).alias("rows"))


KINDS = {"custkey": "unique_identifiers", "name": "critical_business", "code": "critical_business", "email": "critical_business", "segment": "descriptive", "since": "descriptive", "amount_text": "descriptive", "nationkey": "descriptive", "acctbal": "descriptive"}
IMPORTANT = ["name", "code", "email", "segment", "since", "amount_text", "nationkey", "acctbal"]   # business columns, then the first five descriptive ones
ALL_SETS = [(f"Single: {a}", [a]) for a in IMPORTANT]
ALL_SETS += [(f"Pair: {a}+{b}", [a, b]) for i, a in enumerate(IMPORTANT) for b in IMPORTANT[i + 1:]]
ALL_SETS += [(f"Triple: {a}+{b}+{c}", [a, b, c]) for i, a in enumerate(IMPORTANT[:6]) for j, b in enumerate(IMPORTANT[:6]) for c in IMPORTANT[j + 1:6] if j > i]
ALL_SETS += [("Business Keys", ["name", "code", "email"]), ("Complete Match", [c for c in KINDS if c != "custkey"])]
check("U22_matrix_by_category", matrix_sets,
      DUP + "SELECT matched_by, count(*) AS rows FROM (SELECT _row_id, arg_min(l, k) AS matched_by FROM (" + " UNION ALL ".join(f"SELECT _row_id, {i} AS k, '{label}' AS l FROM dup WHERE {OK(keys)} QUALIFY count(*) OVER (PARTITION BY {', '.join(keys)}) > 1" for i, (label, keys) in enumerate(ALL_SETS)) + ") GROUP BY _row_id) GROUP BY matched_by")
check("U23_repeated_values", lambda s, d: fuzzy.repeated_or_similar(view(s, d, "cust"), "segment").where("kind = 'repeated'"),
      with_views("cust") + f"SELECT 'segment' AS \"column\", 'repeated' AS kind, min(_row_id) AS group_id, segment AS value, count(*) AS rows FROM cust WHERE upper(trim(segment)) NOT IN {PLACE} GROUP BY segment HAVING count(*) > 1")
check("U23_similar_values", lambda s, d: fuzzy.repeated_or_similar(view(s, d, "cust"), "email", 95.0).where("kind = 'similar'"))


def labels(s, d):
    """Supplier labels: some shared by several rows, the others unlike in a few digits."""
    return read(s, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias(ROW_ID), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat('shared ', s_suppkey % 5) WHEN s_suppkey % 10 = 1 THEN 'NULL' ELSE concat(lower(replace(s_name, '#', ' ')), ' ', s_nationkey) END").alias("label"))


LABELS = f"""WITH b AS (SELECT s_suppkey::BIGINT AS _row_id, CASE WHEN s_suppkey % 3 = 0 THEN 'shared ' || (s_suppkey % 5) WHEN s_suppkey % 10 = 1 THEN 'NULL' ELSE lower(replace(s_name, '#', ' ')) || ' ' || s_nationkey END AS label FROM supplier),
 c AS (SELECT label, count(*) AS n, min(_row_id) AS id FROM b WHERE upper(trim(label)) NOT IN {PLACE} GROUP BY label), v AS (SELECT label AS f, id FROM c WHERE n = 1),
 l AS (SELECT list_reduce(list(f ORDER BY id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {{sim}})) > 0 THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS leaders FROM v),
 o AS (SELECT v.f, list_filter(leaders, lambda x: {{own}})[1] AS leader FROM v, l), g AS (SELECT o.f, v.id AS group_id, count(*) OVER (PARTITION BY v.id) AS n FROM o JOIN v ON v.f = o.leader)
 SELECT 'label' AS "column", 'repeated' AS kind, id AS group_id, label AS value, n AS rows FROM c WHERE n > 1 UNION ALL SELECT 'label', 'similar', group_id, f, 1 FROM g WHERE n > 1"""
check("U23_repeated_or_similar", lambda s, d: fuzzy.repeated_or_similar(labels(s, d), "label", 94.0), LABELS.replace("{sim}", at_least(94)("y", "x")).replace("{own}", at_least(94)("x", "v.f")))
