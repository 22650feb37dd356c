"""One registered query per operator, over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import agenda, counts, fingerprint, forest, leaks, lexicon, lines, manifest, merkle, quality, simple8b, toxicity, whitening

END = 2   # id after every document in the files of op4


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def op1_compression_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document."""
    docs = documents(spark, sf)
    return quality.score(docs, quality.fit(docs, table(spark, sf, "labels"))).drop("body")


def op2_merkle_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Where a replica of the archive of all pages is damaged.

    The replica has other bytes in every 97th page, has lost every 211th record and has an
    extra one after every 307th, all at the offsets of the archive.
    """
    pages = table(spark, sf, "pages")
    primary = merkle.archive(pages)
    rotten = merkle.archive(pages.withColumn("html", F.when(F.col("page_id") % 97 == 13, F.translate("html", "aeiou", "eioua")).otherwise(F.col("html"))))
    stray = primary.where("id % 307 = 9").select("file", (F.col("offset") + 1).alias("offset"), "length", "digest")
    replica = rotten.where("id % 211 != 5").select("file", "offset", "length", "digest").unionByName(stray)
    return merkle.audit(primary, replica)


def op3_minhash_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and of their edits."""
    return fingerprint.edit_likeness(documents(spark, sf))


def op4_simple8b(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents written in Simple-8b segments, read back and digested."""
    path = simple8b.new_folder(spark)
    simple8b.write(documents(spark, sf), tokenizer_path(), path, end=END)
    return simple8b.audit(spark, path)


def op5_edit_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that stand in documents, with up to 5 % of edits."""
    return leaks.contaminated(documents(spark, sf), table(spark, sf, "benchmark"))


def op6_lexicon_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return lexicon.round_trip(documents(spark, sf), tokenizer_path())


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document."""
    return counts.token_counts(documents(spark, sf), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, sf)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op9_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the runs of words that stand earlier, too."""
    return lines.deduplicate(documents(spark, sf), lines_only=False).select("doc_id", "text", "removed_lines", "removed_words")


def op10_forest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of documents whose 3-word shingle sets are alike to 85 % or more."""
    return forest.near_duplicates(documents(spark, sf), size=3, percent=85).drop("body")


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings on their first 16 whitened components."""
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of all documents; in a fifth of them the text's capitals are made small after the root was taken."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(documents(spark, sf).withColumn("tampered_text", F.when(fifth, small)))


def op13_agenda_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded by the merge-type vocabulary and decoded again."""
    return agenda.round_trip(documents(spark, sf), tokenizer_path("piece_bpe_32k.model"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n, list(doc_id) AS members FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS other FROM classes WHERE rep IN (SELECT a FROM both_ways) UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
placed AS (SELECT unnest(c.members) AS doc_id, coalesce(r.root, c.rep) AS component_id FROM classes c LEFT JOIN roots r ON r.node = c.rep)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(p.component_id, s.doc_id) AS component_id, coalesce(p.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN placed p USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": op1_compression_quality,
    "op2_merkle_audit": op2_merkle_audit,
    "op3_minhash_fingerprints": op3_minhash_fingerprints,
    "op4_simple8b": op4_simple8b,
    "op5_edit_leaks": op5_edit_leaks,
    "op6_lexicon_bpe": op6_lexicon_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_line_runs": op9_line_runs,
    "op10_forest_dedup": op10_forest_dedup,
    "op11_whitening": op11_whitening,
    "op12_manifest": op12_manifest,
    "op13_agenda_pieces": op13_agenda_pieces,
}
OP2_SQL = r"""
WITH records AS (
  SELECT page_id AS id, page_id // 512 AS file, h AS kind,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body
    || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT page_id, url, 0 AS h, coalesce(html, '') AS body FROM pages
        UNION ALL SELECT page_id, url, 1 AS h, CASE WHEN page_id % 97 = 13 THEN translate(coalesce(html, ''), 'aeiou', 'eioua') ELSE coalesce(html, '') END FROM pages)),
leaves AS (
  SELECT kind, id, file, strlen(record) AS length, sha256(record) AS digest,
    CAST(sum(strlen(record)) OVER (PARTITION BY kind, file ORDER BY id ROWS UNBOUNDED PRECEDING) - strlen(record) AS BIGINT) AS "offset" FROM records),
a AS (SELECT file, "offset", length, digest FROM leaves WHERE kind = 0),
b AS (SELECT file, "offset", length, digest FROM leaves WHERE kind = 1 AND id % 211 != 5
      UNION ALL SELECT file, "offset" + 1, length, digest FROM leaves WHERE kind = 0 AND id % 307 = 9)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") AS "offset",
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS status,
  a.length, a.digest, b.length AS replica_length, b.digest AS replica_digest
FROM a FULL JOIN b ON a.file = b.file AND a."offset" = b."offset"
WHERE a.digest IS DISTINCT FROM b.digest OR a.length IS DISTINCT FROM b.length
"""


def op12_sql(inner: int = 6, upper: int = 5) -> str:
    """SQL of the manifest, with levels for trees of up to 16 to the power of ``inner`` leaves and of ``upper`` sources."""
    field = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')".format
    head, small = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")), "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    parts = [f"""hashed AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({head} || {field("text")}) AS h,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({head} || {field(small)}) END AS changed FROM documents)""",
             """n0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM hashed)"""]

    def side(bounds: str) -> str:
        return f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN {bounds}), '')"

    def levels(name: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{name}{k}s AS (SELECT tree, place, size, {side("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS l, {side("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS r FROM {name}{k})""")
            parts.append(f"""{name}{k + 1} AS (SELECT tree, place // 16 AS place, (max(size) + 15) // 16 AS size, CASE WHEN max(size) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h
  FROM {name}{k} GROUP BY tree, place // 16)""")

    def climb(start: str, name: str, count: int, key: str, place: str) -> str:
        for k in range(count):
            step = f"{start.split('_')[0]}_{name}{k}"
            parts.append(f"""{step} AS (SELECT x.* EXCLUDE (f, p), CASE WHEN s.size = 1 THEN f ELSE sha256(l || f || r) END AS f, CASE WHEN s.size = 1 THEN p ELSE p || l || r END AS p
  FROM {start} x JOIN {name}{k}s s ON s.tree = x.{key} AND s.place = x.{place} // {16 ** k})""")
            start = step
        return start
    levels("n", inner)
    parts.append(f"m0 AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM n{inner})")
    levels("m", upper)
    parts.append("c AS (SELECT n0.doc_id, n0.tree, n0.place, n0.h, m0.place AS top, m0.h AS subroot, '' AS one, coalesce(n0.changed, n0.h) AS f, '' AS p FROM n0 JOIN m0 ON m0.name = n0.tree)")
    last = climb(climb("c", "n", inner, "tree", "place"), "m", upper, "one", "top")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, h AS leaf, subroot, (SELECT h FROM m{upper}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM m{upper}) AS verified FROM {last}
"""


SQL = {
    "op2_merkle_audit": OP2_SQL,
    "op10_forest_dedup": OP10_SQL,
    "op12_manifest": op12_sql(),
}
