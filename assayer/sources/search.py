"""Search in stored tables through an inverted index of trigrams.

A table is stored in blocks of ``BLOCK`` consecutive rows. For every block the index holds the
three-byte sequences of its lower-cased values, in the order of the sequences. A needle's sequences
must all be in a block that holds it: their posting lists are intersected, only the row groups of
the blocks that are left are read, and every row is compared as a scan would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer import ROW_ID
from assayer.operators.order import numbered
from assayer.operators.select import search as scan
from assayer.schema import as_text, cols, comparable

BLOCK = 4096                # rows
ROW_GROUP = 1 << 20         # bytes, so that a row group holds few blocks
MOST_BLOCKS = 10_000        # that an index answers for; a needle in more of them is searched by a scan
MOST_RANGES = 64            # of neighbouring blocks that are pushed to the reader
GRAM = 3                    # bytes
PLACE, BLOCK_NUMBER = "_place", "_block"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ``(gram, block)`` of each batch, whose columns are the block and the lower-cased cells."""
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        found = []
        for column in batch.columns[1:]:
            column = pc.fill_null(column, "").cast(pa.large_string())
            _, ends, data = column.buffers()
            offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
            flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].astype(np.int64) if data is not None else np.zeros(0, np.int64)
            offsets = offsets - offsets[0]
            if len(flat) < GRAM:
                continue
            gram = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
            row = np.searchsorted(offsets, np.arange(len(gram)), "right") - 1
            inside = np.arange(len(gram)) + GRAM <= offsets[row + 1]
            found.append(np.unique(block[row[inside]] << 24 | gram[inside]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array((both & 0xFFFFFF).astype(np.int32)), pa.array(both >> 24)], names=["gram", "block"])


def grams_of(needle: str) -> list[int]:
    raw = needle.encode("utf-8")
    return sorted({raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2] for k in range(len(raw) - 2)})


@dataclass(frozen=True)
class SearchStore:
    """Tables with a search index, one folder per name."""

    spark: SparkSession
    root: str
    block: int = BLOCK

    def save(self, name: str, df: DataFrame) -> None:
        """Store ``df``, which has a ``_row_id``, in its order, and index all comparable columns."""
        placed = numbered(df, [ROW_ID], PLACE).withColumn(BLOCK_NUMBER, F.floor(F.col(PLACE) / self.block).cast("bigint"))
        placed.write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/{name}/rows")
        stored = self._rows(name)
        cells = stored.select(BLOCK_NUMBER, *[F.lower(as_text(df, c)).alias(f"c{i}") for i, c in enumerate(comparable(df))])
        postings = cells.mapInArrow(_grams, "gram int, block bigint").distinct()
        postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/{name}/grams")

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/rows")

    def load(self, name: str) -> DataFrame:
        return self._rows(name).drop(PLACE, BLOCK_NUMBER)

    def blocks(self, name: str, needle: str) -> list[int] | None:
        """Blocks that may hold the needle, or None where the index does not narrow them down: short needles and very common ones."""
        wanted = grams_of(self.spark.range(1).select(F.lower(F.lit(needle))).first()[0])
        if not wanted:
            return None
        postings = self.spark.read.parquet(f"{self.root}/{name}/grams").where(F.col("gram").isin(wanted) & F.col("gram").between(wanted[0], wanted[-1]))
        both = postings.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("block").limit(MOST_BLOCKS + 1)
        found = sorted(r["block"] for r in both.collect())
        return found if len(found) <= MOST_BLOCKS else None

    def search(self, name: str, needle: str, columns: list[str] | None = None) -> DataFrame:
        """The rows with the literal text in any of the columns, letter case ignored, as ``select.search`` finds them."""
        found, rows = self.blocks(name, needle), self._rows(name)
        if found is not None:
            within = F.lit(False)
            for low, high in ranges(found, MOST_RANGES):
                within = within | F.col(BLOCK_NUMBER).between(low, high)
            rows = rows.where(within)
        return scan(rows.drop(PLACE, BLOCK_NUMBER), needle, columns)


def ranges(blocks: list[int], most: int) -> list[tuple[int, int]]:
    """Ascending blocks as at most ``most`` ranges, joined over the smallest gaps."""
    if not blocks:
        return []
    gaps = sorted(range(1, len(blocks)), key=lambda k: blocks[k - 1] - blocks[k])[:most - 1]
    cuts = [0, *sorted(k for k in gaps if blocks[k] - blocks[k - 1] > 1), len(blocks)]
    return [(blocks[a], blocks[b - 1]) for a, b in zip(cuts, cuts[1:])]
