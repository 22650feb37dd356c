"""Readers: delimited text, JSON, parquet, databases; header offset; stable row ids."""

from __future__ import annotations

import csv
from itertools import islice
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from assayer import ROW_ID
from assayer.operators.values import union_all
from assayer.schema import col, nan_to_null
from assayer.session import cut

DELIMITERS = {".csv": ",", ".txt": ",", ".tsv": "\t"}


def read_table(spark: SparkSession, path: str, suffix: str | None = None, header_row: int = 0,
               schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Read by file suffix. Pass ``schema`` for large text files; inferring costs a second read.

    Quoted values of delimited text may hold line breaks; a file is then one task. With
    ``multi_line=False`` files are split, and a value with a line break is an error.
    """
    kind = suffix or PurePosixPath(path).suffix.lower()
    if kind in (".parquet", ".pq"):
        return nan_to_null(spark.read.parquet(path))
    if kind == ".jsonl":
        return spark.read.json(path, schema=schema)
    if kind == ".json":
        return spark.read.json(path, schema=schema, multiLine=True)
    if kind in DELIMITERS:
        if header_row:
            return read_after_header(spark, path, header_row, DELIMITERS[kind], multi_line)
        rows = spark.read.csv(path, sep=DELIMITERS[kind], header=True, schema=schema, inferSchema=schema is None,
                              quote='"', escape='"', enforceSchema=False, multiLine=multi_line)
        return rows if multi_line else _unbroken(spark, path, rows)
    raise ValueError(f"unsupported file type {kind}")


def _unbroken(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` if no line of the files at ``path`` leaves a quote open, else an error."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"')))
    if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
        raise ValueError("a quoted value holds a line break; read with multi_line=True")
    return rows


def _records(spark: SparkSession, path: str, width: int, sep: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    return spark.read.csv(path, sep=sep, schema=schema, quote='"', escape='"', multiLine=multi_line)


def preview_raw(spark: SparkSession, path: str, rows: int = 20, sep: str = ",") -> DataFrame:
    """First records of a delimited file with no header applied; stops reading after ``rows``."""
    width = len(spark.read.csv(path, sep=sep, quote='"', escape='"', multiLine=True).columns)
    return _records(spark, path, width, sep, True).limit(rows)


FEW_FILES = 100_000  # up to this many files the skipped record ids are under 10 MB and are broadcast


def _record(lines: DataFrame, number: int, sep: str) -> list[str]:
    """Record ``number`` of a file of lines; as many lines are read as its and the earlier records' line breaks ask for."""
    wanted = 16 * (number + 1)
    while True:
        found = lines.take(wanted)
        records = list(islice(csv.reader((r["value"] + "\n" for r in found), delimiter=sep), number + 2))
        # The last record may go on behind the lines that were read.
        if len(records) > number + 1 or len(found) < wanted:
            return records[number] if len(records) > number else []
        wanted *= 8


def read_after_header(spark: SparkSession, path: str, header_row: int, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Delimited read where record ``header_row`` (0-based, empty lines not counted) of every file holds the names.

    All files must have the same names. Columns are text. With ``multi_line`` files are split as well, see
    ``_split_records``; only files whose lines end in a carriage return alone are one task each.
    """
    first = sorted(spark.read.text(path).inputFiles())[0]
    titled = _record(spark.read.text(first).where("value != ''"), header_row, sep)
    width = max(1, len(titled))
    found = _split_records(spark, path, header_row, sep) if multi_line else None
    if found is None:
        return _after_ids(spark, path, header_row, sep, multi_line, width)
    top, records = found
    schema = ", ".join(f"c{i} string" for i in range(width))
    values = lambda df: df.select(F.from_csv("text", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*")
    titles = _titles(path, values(top).select(F.array(*[f"c{i}" for i in range(width)]).alias("names")))
    return values(records).toDF(*titles)


def _titles(path: str, names: DataFrame) -> list[str]:
    found = names.distinct().take(2)
    if len(found) != 1:
        raise ValueError(f"the files at {path} do not share one line of names")
    return [(t or "").strip() or f"column_{i}" for i, t in enumerate(found[0]["names"])]


def _still_open(line: bytes, inside: bool, opening: bytes) -> bool:
    """Whether a quoted value is open behind ``line``; ``opening`` is a delimiter and a quote.

    Quotes open a value only at its first character; what follows a closing quote belongs to the value up to the delimiter.
    """
    size = len(opening)
    at = 0
    if not inside:
        at = 1 if line[:1] == b'"' else line.find(opening) + size
        if at < size and line[:1] != b'"':
            return False
    while True:   # ``at`` is inside a quoted value
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1:at + 2] == b'"':
            at += 2
            continue
        at = line.find(opening[:-1], at + 1)
        if at >= 0:
            at = line.find(opening, at)
        if at < 0:
            return False
        at += size


def _without_mark(line: bytes) -> bytes:
    """The first line of a file without its byte order mark."""
    return line.removeprefix(b"\xef\xbb\xbf")


def _measure(opening: bytes):
    """One row per split: is a value open behind it, and how many records begin in it, if none (0) or one (1) is open before."""
    def measure(batches):
        key, ends, counts, odd = None, [False, True], [0, 0], False
        row = lambda: pd.DataFrame([(*key, *ends, *counts, odd)], columns=["file", "block", "open0", "open1", "records0", "records1", "odd"])
        for batch in batches:
            for file, block, line in zip(batch["file"].tolist(), batch["block"].tolist(), batch["line"]):
                if (file, block) != key:
                    if key:
                        yield row()
                    key, ends, counts, odd = (file, block), [False, True], [0, 0], block == 0 and b"\r" in line[:-1]
                    line = line if block else _without_mark(line)
                quoted, blank = b'"' in line, line in (b"", b"\r")
                for i, inside in enumerate(ends):
                    counts[i] += not inside and not blank
                if quoted:
                    ends = [_still_open(line, inside, opening) for inside in ends]
        if key:
            yield row()
    return measure


def _stitch(opening: bytes, top: int, whole: bool):
    """Records ``(file, record, block, whole, text)`` behind ``top`` that lie in one split, or else pieces of the others, and all records up to ``top``."""
    def stitch(batches):
        key, inside, record, lines, complete, out = None, False, -1, [], True, []

        def flush(complete):
            text = b"\n".join(lines)
            if lines and (complete and record > top) == whole:
                out.append((*key, record, complete, text if not complete or text[-1:] != b"\r" else text[:-1]))
            lines.clear()

        for batch in batches:
            for file, block, opened, before, line in zip(batch["file"].tolist(), batch["block"].tolist(), batch["inside"], batch["before"], batch["line"]):
                if (file, block) != key:
                    if key:
                        flush(complete and not inside)
                    if pd.isna(before):
                        raise ValueError("files were split in another way on a second read")
                    key, inside, record, complete = (file, block), bool(opened), int(before) - 1, not opened
                    line = line if block else _without_mark(line)
                if not inside:
                    if line in (b"", b"\r"):
                        continue
                    record, complete = record + 1, True
                lines.append(line)
                if b'"' in line:
                    inside = _still_open(line, inside, opening)
                if not inside:
                    flush(complete)
            yield pd.DataFrame(out, columns=["file", "block", "record", "whole", "text"])
            out.clear()
        if key:
            flush(complete and not inside)
            yield pd.DataFrame(out, columns=["file", "block", "record", "whole", "text"])
    return stitch


def _split_records(spark: SparkSession, path: str, top: int, sep: str) -> tuple[DataFrame, DataFrame] | None:
    """``text`` of record ``top`` of every file, and of all records behind it; ``None`` where lines end in a carriage return alone.

    Files are split at lines. Whether a quoted value is open where a split begins follows from all splits before it, so a
    first scan finds for each split what it does to an open and to a closed value; these rows are few. Records that
    lie in several splits are put together from one piece a split. A carriage return before the line break
    that ends a record belongs to it; line breaks inside quotes stay as written.
    """
    opening = (sep + '"').encode()
    lines = spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    splits = cut(lines.mapInPandas(_measure(opening), "file bigint, block bigint, open0 boolean, open1 boolean, records0 bigint, records1 bigint, odd boolean"))
    if not splits.where("odd").isEmpty():
        return None
    upto = Window.partitionBy("file").orderBy("block")
    # A split leaves one state whatever was before, or turns the state over, or keeps it.
    turned = splits.withColumn("turns", F.sum(F.expr("int(open0 AND NOT open1)")).over(upto) % 2)
    fixed = turned.withColumn("fixed", F.expr("CASE WHEN open0 = open1 THEN (int(open0) + turns) % 2 END"))
    behind = fixed.withColumn("behind", (F.coalesce(F.last("fixed", ignorenulls=True).over(upto), F.lit(0)) + F.col("turns")) % 2)
    opened = behind.withColumn("inside", F.coalesce(F.lag("behind").over(upto), F.lit(0)) == 1)
    begun = opened.withColumn("records", F.expr("if(inside, records1, records0)"))
    starts = cut(begun.select("file", "block", "inside", (F.sum("records").over(upto) - F.col("records")).alias("before")))
    placed = lines.join(F.broadcast(starts), ["file", "block"], "left").select("file", "block", "inside", "before", "line")
    pieces = lambda whole: placed.mapInPandas(_stitch(opening, top, whole), "file bigint, block bigint, record bigint, whole boolean, text binary").withColumn("text", F.col("text").cast("string"))
    joined = cut(pieces(False).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p")).select(
        "record", F.regexp_replace(F.array_join("p.text", "\n"), "\\r\\z", "").alias("text")))
    return joined.where(F.col("record") == top).select("text"), union_all([pieces(True).select("text"), joined.where(F.col("record") > top).select("text")])


def _after_ids(spark: SparkSession, path: str, header_row: int, sep: str, multi_line: bool, width: int) -> DataFrame:
    """``read_after_header`` by row ids: they follow the order of a file's records, so the records to skip are a short run of ids at the start of each file."""
    records = _records(spark, path, width, sep, multi_line).withColumns({
        "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    starts = records.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("first"))
    heads = starts.select((F.col("first") + header_row).alias("_at"))
    titles = _titles(path, records.join(F.broadcast(heads), "_at", "left_semi").select(F.array(*[f"c{i}" for i in range(width)]).alias("names")))
    skipped = starts.select(F.explode(F.sequence("first", F.col("first") + header_row)).alias("_at"))
    if len(spark.read.text(path).inputFiles()) <= FEW_FILES:
        skipped = F.broadcast(skipped)
    body = records.join(skipped, "_at", "left_anti").select(*[col(f"c{i}").alias(t) for i, t in enumerate(titles)])
    return body if multi_line else _unbroken(spark, path, body)


def read_jdbc(spark: SparkSession, url: str, table: str, max_rows: int | None = None, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 16, properties: dict[str, str] | None = None) -> DataFrame:
    """Database table, all rows unless ``max_rows`` says otherwise; with a partition column the read runs as parallel range scans."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition_column and bounds:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", partitions))
    rows = reader.load()
    return rows.limit(max_rows) if max_rows else rows


def read_query(spark: SparkSession, url: str, query: str, max_rows: int | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    rows = spark.read.format("jdbc").option("url", url).option("query", query).options(**(properties or {})).load()
    return rows.limit(max_rows) if max_rows else rows


def with_row_ids(df: DataFrame, key: str | None = None, path: str | None = None) -> DataFrame:
    """Adds ``_row_id``.

    A long key of the table serves as is. Otherwise ids are assigned once and written to
    ``path``; the table read back has them for good, while ids recomputed on a second read
    of the source could differ.
    """
    if key:
        return df.withColumn(ROW_ID, col(key).cast("bigint"))
    if not path:
        raise ValueError("a table without a key needs a path to store its row ids")
    df.withColumn(ROW_ID, F.monotonically_increasing_id()).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
