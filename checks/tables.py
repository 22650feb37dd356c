"""Sources, sinks and joins of whole tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from assayer import ROW_ID
from assayer.operators import joins
from assayer.operators.joins import EntityTable
from assayer.operators.rules import Rule
from assayer.session import checkpoint_dir
from assayer.sources import readers, writers
from assayer.sources.stores import TableStore
from checks.base import check, read, view, with_views

cust = lambda s, d: view(s, d, "cust")
CUST = with_views("cust")


def scratch(spark, label: str) -> str:
    """A new folder on the storage the cluster shares."""
    return f"{checkpoint_dir(spark)}/checks/{label}-{uuid.uuid4().hex}"


def totals(df, number, texts):
    """Order-free digest of a table: rows, a rounded sum, lengths of texts."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col(number).cast("double")), 2).alias("total"), *[F.sum(F.char_length(t)).alias(f"{t}_chars") for t in texts])


DIGEST = "SELECT count(*) AS rows, round(sum(price), 2) AS total, sum(length(status))::BIGINT AS status_chars, sum(length(priority))::BIGINT AS priority_chars FROM ord"
ORD_SQL = with_views("ord") + DIGEST
ord_ = lambda s, d: view(s, d, "ord")


def round_trip(write, suffix, **read_options):
    def query(s, d):
        path = scratch(s, suffix.strip("."))
        write(ord_(s, d), path)
        return totals(readers.read_table(s, path, suffix, **read_options), "price", ["status", "priority"])
    return query


SCHEMA = "orderkey BIGINT, custkey BIGINT, status STRING, price DOUBLE, priority STRING, ordered TIMESTAMP, shipped TIMESTAMP"
check("S01_read_csv", round_trip(writers.write_csv, ".csv", schema=SCHEMA), ORD_SQL)
check("S02_read_tsv", round_trip(lambda df, p: writers.write_csv(df, p, delimiter="\t"), ".tsv"), ORD_SQL)


def text_round_trip(table, key, delimiter=",", head=False):
    """A table whose texts hold quotes and line breaks, written as delimited text and read back value by value."""
    def query(s, d):
        path = scratch(s, "texts")
        rows = read(s, d, table)
        if head:   # two records above the names of every file
            names = rows.columns
            top = [("made by hand", *[None] * (len(names) - 1)), ("second", "line\nbroken", *[None] * (len(names) - 2)), tuple(names)]
            body = rows.select(*[F.col(c).cast("string") for c in names])
            body = body.repartition(max(3, rows.rdd.getNumPartitions()), key)   # files grow in number with the table
            body.mapInPandas(_with_rows(top, names), ", ".join(f"{c} string" for c in names)).write.csv(path, sep=delimiter, quote='"', escape='"')
            back = readers.read_after_header(s, path, 2, delimiter)
        else:
            writers.write_csv(rows, path, delimiter=delimiter)
            back = readers.read_table(s, path, ".tsv" if delimiter == "\t" else ".csv", schema=rows.schema)
        return back.select(*[F.col(c).cast("bigint").alias(c) for c in key.split(",")], F.md5(F.col("text").cast("binary")).alias("digest"))
    return query


def _with_rows(top, names):
    def prepend(batches):
        yield pd.DataFrame(top, columns=names)
        yield from batches
    return prepend


check("S01_texts_with_line_breaks", text_round_trip("documents", "doc_id"), "SELECT doc_id, md5(text) AS digest FROM documents")
check("S02_texts_with_line_breaks", text_round_trip("conversations", "conv_id,turn", "\t"), "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
check("S06_texts_below_a_header", text_round_trip("documents", "doc_id", head=True), "SELECT doc_id, md5(text) AS digest FROM documents")
check("S03_read_parquet", lambda s, d: totals(readers.read_table(s, f"{d}/orders.parquet"), "o_totalprice", ["o_orderstatus"]), "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total, sum(length(o_orderstatus))::BIGINT AS o_orderstatus_chars FROM orders")


def read_json_array(s, d):
    path = scratch(s, "json")
    records = ord_(s, d).select(F.to_json(F.struct("price", "status", "priority")).alias("value"))
    # Every part file becomes one array document.
    records.repartition(8, "value").mapInPandas(_as_array, "value string").write.text(path)
    return totals(readers.read_table(s, path, ".json", schema="price DOUBLE, status STRING, priority STRING"), "price", ["status", "priority"])


def _as_array(batches):
    yield pd.DataFrame({"value": ["["]})
    comma = False
    for batch in batches:
        lines = batch["value"].tolist()
        yield pd.DataFrame({"value": [("," if comma or i else "") + line for i, line in enumerate(lines)]})
        comma = comma or bool(lines)
    yield pd.DataFrame({"value": ["]"]})


check("S04_read_json_array", read_json_array, ORD_SQL)
check("S05_read_json_lines", round_trip(writers.write_json, ".jsonl"), ORD_SQL)


def after_header(s, d):
    """Files whose names stand on the third line of each file."""
    path = scratch(s, "header")
    lines = ord_(s, d).select(F.concat_ws(",", F.col("orderkey").cast("string"), F.col("price").cast("string"), "status").alias("value"))
    head = ["report of orders", "printed for review,,", "orderkey,price,status"]
    # Lines are written in partitions; every partition starts with the two title lines and the names.
    lines.repartition(4, "value").mapInPandas(_with_head(head), "value string").write.text(path)
    return readers.read_after_header(s, path, 2).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("price").cast("double")), 2).alias("total"), F.sum(F.char_length("status")).alias("status_chars"))


def _with_head(head):
    def prepend(batches):
        yield pd.DataFrame({"value": head})
        yield from batches
    return prepend


check("S06_header_offset", after_header, with_views("ord") + "SELECT count(*) AS rows, round(sum(price), 2) AS total, sum(length(status))::BIGINT AS status_chars FROM ord")


def raw_preview(s, d):
    path = scratch(s, "raw")
    writers.write_csv(ord_(s, d).orderBy(ROW_ID).coalesce(1), path, ["orderkey", "status"])
    return readers.preview_raw(s, path, 5)


check("S06_raw_preview", raw_preview, with_views("ord") + "SELECT 'orderkey' AS c0, 'status' AS c1 UNION ALL (SELECT orderkey::VARCHAR, status FROM ord ORDER BY _row_id LIMIT 4)")


def stored(s, d):
    store = TableStore(s, scratch(s, "tables"))
    for name in ("customer", "nation", "region"):
        store.save(name, read(s, d, name))
    return store.load("customer").agg(F.count(F.lit(1)).alias("rows")).withColumn("names", F.lit(",".join(store.names())))




def rewritten(s, d):
    """A table saved from itself, twice."""
    store = TableStore(s, scratch(s, "rewritten"))
    store.save("customer", read(s, d, "customer").select("c_custkey", "c_name"))
    for _ in range(2):
        store.save("customer", store.load("customer").withColumn("c_name", F.concat("c_name", F.lit("+"))))
    return store.load("customer")


check("S10_rewrite_loaded_table", rewritten, "SELECT c_custkey, c_name || '++' AS c_name FROM customer")
check("S10_table_store", stored, "SELECT count(*) AS rows, 'customer,nation,region' AS names FROM customer")


def snapshot(s, d):
    from assayer.sources.stores import VersionStore

    store = VersionStore(s, scratch(s, "snapshot"))
    store.start(cust(s, d))
    try:
        store.start(cust(s, d))
        written_twice = True
    except Exception:
        written_twice = False
    return store.original().agg(F.count(F.lit(1)).alias("rows"), F.count("name").alias("names")).withColumn("written_twice", F.lit(written_twice))


check("S11_original_snapshot", snapshot, CUST + "SELECT count(*) AS rows, count(name) AS names, false AS written_twice FROM cust")


def quarantine(s, d):
    from assayer.operators import cleanse
    from checks.repair import AT, STEPS

    path = scratch(s, "quarantine")
    for step in (STEPS[5], STEPS[6]):
        writers.write_quarantine(cleanse.apply(cust(s, d), [step], AT)[1], path)
    return s.read.parquet(path).groupBy("Rejected_Column").agg(F.count(F.lit(1)).alias("rows"))


def quarantine_sql():
    from assayer.functions.formats import FORMATS

    return CUST + f"SELECT 'code' AS \"Rejected_Column\", count(*) FILTER (NOT coalesce(regexp_matches(code, '{FORMATS['pan']}'), false)) AS rows FROM cust UNION ALL SELECT 'email', count(*) FILTER (length(email) < 1 OR length(email) > 21) FROM cust"


check("S12_quarantine_store", quarantine, quarantine_sql())


def exported_quarantine(s, d):
    """The rejected rows as delimited text, value by value."""
    from assayer.operators import cleanse
    from checks.repair import AT, STEPS

    path = scratch(s, "rejected")
    writers.write_csv(cleanse.apply(cust(s, d), [STEPS[5]], AT)[1], path, ["custkey", "code", "Rejected_Column"])
    return readers.read_table(s, path, ".csv", schema="custkey BIGINT, code STRING, Rejected_Column STRING")


def exported_sql():
    from assayer.functions.formats import FORMATS

    return CUST + f"SELECT custkey, code, 'code' AS \"Rejected_Column\" FROM cust WHERE NOT coalesce(regexp_matches(code, '{FORMATS['pan']}'), false)"


check("K07_quarantine_export", exported_quarantine, exported_sql())

def _csv_options(s, d):
    path = scratch(s, "csv")
    writers.write_csv(ord_(s, d), path, ["orderkey", "status", "price", "priority"], delimiter="|", quote="'", compression="gzip")
    back = s.read.csv(path, sep="|", header=True, quote="'", schema="orderkey BIGINT, status STRING, price DOUBLE, priority STRING")
    return totals(back, "price", ["status", "priority"])


check("K01_write_csv", _csv_options, ORD_SQL)
check("K02_write_parquet", round_trip(writers.write_parquet, ".parquet"), ORD_SQL)
check("K03_write_json", round_trip(lambda df, p: writers.write_json(df, p, compression="gzip"), ".jsonl"), ORD_SQL)


def batches(s, d):
    path = scratch(s, "batches")
    writers.write_batches(ord_(s, d), path, 500, ["orderkey", "price"], "parquet")
    written = s.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    return written.groupBy("batch").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("rows"), F.min("orderkey").alias("first"), F.max("orderkey").alias("last"), F.round(F.sum("price"), 2).alias("price"))


check("K04_write_batches", batches, "SELECT batch, 1 AS files, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last, round(sum(o_totalprice), 2) AS price FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch FROM orders) GROUP BY batch")


def group_files(s, d):
    from assayer.operators import dedup

    df, path = view(s, d, "prt"), scratch(s, "groups")
    found = dedup.members(df, dedup.exact_groups(df, ["name", "brand"]), ["name", "brand"])
    writers.write_groups(df, found, ["name", "brand"], "exact", path)
    return s.read.parquet(f"{path}/members").agg(F.count(F.lit(1)).alias("members")).withColumn("groups", F.lit(s.read.parquet(f"{path}/summary").count()).cast("bigint"))


check("K06_group_export", group_files, with_views("prt") + "SELECT sum(n)::BIGINT AS members, count(*) AS groups FROM (SELECT count(*) AS n FROM prt GROUP BY name, brand HAVING count(*) > 1)")


def failing_file(s, d):
    path = scratch(s, "failing")
    writers.write_failing(cust(s, d), Rule("not_blank", "name"), path)
    return s.read.csv(path, header=True).select(F.col("row_index").cast("bigint").alias("row_index"), "custkey")


check("K08_failing_export", failing_file, CUST + "SELECT _row_id AS row_index, custkey::VARCHAR AS custkey FROM cust WHERE name IS NULL OR trim(name) = ''")


def joined(s, d):
    """Customer with nation as extension, a clashing column, and a lookup that stays out."""
    primary = cust(s, d).withColumnRenamed("nationkey", "n_nationkey")
    nation = read(s, d, "nation").withColumnRenamed("n_name", "name")
    return joins.working_view([EntityTable("customer", primary, "primary"), EntityTable("nation", nation, "extension", "n_nationkey"), EntityTable("region", read(s, d, "region"), "lookup", "r_regionkey"),
                               EntityTable("orders", read(s, d, "orders"), "extension", "no_such_key")]).select(ROW_ID, "name", "name__nation", "n_regionkey")


check("J01_working_view", joined, CUST + "SELECT _row_id, name, n_name AS name__nation, n_regionkey FROM cust LEFT JOIN nation ON n_nationkey = nationkey")


def documents_with_labels(s, d):
    return joins.working_view([EntityTable("documents", read(s, d, "documents"), "primary"), EntityTable("labels", read(s, d, "labels"), "extension", "doc_id")]).select("doc_id", "lang", "quality", "toxic")


check("J01_optional_extension", documents_with_labels, "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
# Every 50th line and every 30th order refers to a key that no parent has.
STRAY_LINE, STRAY_ORDER = "CASE WHEN l_orderkey % 50 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END", "CASE WHEN o_orderkey % 30 = 0 THEN -1 - o_custkey ELSE o_custkey END"
check("J09_orphans", lambda s, d: joins.orphans(read(s, d, "lineitem").selectExpr(f"{STRAY_LINE} AS orderkey", "l_linenumber"), "orderkey", read(s, d, "orders"), "o_orderkey").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows")),
      "SELECT l_linenumber, count(*) AS rows FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY ALL")
check("J09_orders_without_customer", lambda s, d: joins.orphans(read(s, d, "orders").selectExpr("o_orderkey", f"{STRAY_ORDER} AS custkey"), "custkey", read(s, d, "customer"), "c_custkey"),
      "SELECT o_orderkey, -1 - o_custkey AS custkey FROM orders WHERE o_orderkey % 30 = 0")
