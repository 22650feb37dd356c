"""Documents to token ids: quality, repeated lines, near duplicates, benchmark leaks, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import forest, leaks, lexicon, lines, quality
from assayer.llm.queries import table, tokenizer_path
from assayer.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on these documents' labels, does not reject. Each row is judged by its own text."""
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return without(docs, scored.where("predicted = 0"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of 30 words or more; ``n_chars`` follows. A document of which nothing but white space is left goes."""
    cleaned = lines.deduplicate(docs, lines_only=False)
    changed = F.col("removed_words") > 0
    return cleaned.where(~(changed & (F.trim(F.regexp_replace("text", r"\s", "")) == ""))).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once.

    Rows with equal id and text are one document: the first by (lang, source, n_chars), null first,
    stays. Rows of one id with different texts are judged apart. Rows without an id stay.
    """
    named = docs.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_row")).select("doc_id", "text", "_row.*")
    whole = named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))
    return without(whole, forest.near_duplicates(docs).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Each row is judged by its own text."""
    return without(docs, leaks.contaminated(docs, table(spark, sf_dir, "benchmark"), with_body=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return lexicon.encode(docs, tokenizer_path())


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and text are rejected; ``rejected`` has ``doc_id`` and ``body``, the text's hash."""
    gone = rejected.select(F.col("doc_id").alias("_gone_id"), F.col("body").alias("_gone_body")).distinct()
    body = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (body == gone["_gone_body"]), "left_anti").select(*COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
