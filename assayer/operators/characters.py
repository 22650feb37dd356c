"""Characters of text columns: one vectorised pass over the bytes of all columns.

Every task counts the code points of each column in one table and, for each symbol looked for,
the rows that hold it; only these counts are shuffled.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.schema import TEXT, cols, families

PART = 1 << 22              # bytes handled at once
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PLAIN = np.zeros(128, bool)        # ASCII letters, digits and white space
_PLAIN[[c for c in range(128) if chr(c).isalnum() or _BLANK[c]]] = True
_COUNTS = "i int, kind string, code int, n bigint"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def _rows_with(places: np.ndarray, offsets: np.ndarray) -> int:
    """How many rows hold one of the ascending ``places``."""
    return len(np.unique(np.searchsorted(offsets, places, "right"))) if len(places) else 0


def _runs(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places whose byte and the next one of the same row are marked."""
    both = np.flatnonzero(flags[:-1] & flags[1:])
    return both[~np.isin(both + 1, offsets)]


def _pass(symbols: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: dict[tuple[int, int], int] = Counter()
        rows: dict[tuple[int, int], int] = {}
        for batch in batches:
            for i in range(batch.num_columns):
                column = batch.column(i)
                sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
                at = 0
                while at < len(column):
                    stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART, "right")))
                    data, offsets = _bytes(column.slice(at, stop - at))
                    at = stop
                    if not len(data):
                        continue
                    plain = np.bincount(data, minlength=256)
                    for c in np.flatnonzero(plain[:128] * ~_PLAIN).tolist():
                        points[i, c] += int(plain[c])
                    if plain[128:].any():
                        code, n = np.unique(np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), return_counts=True)
                        for c, k in zip(code[code > 127].tolist(), n[code > 127].tolist()):
                            points[i, c] += k
                    found = {s: np.flatnonzero(data == s) for s in symbols if plain[s]}
                    found[-1], found[-2] = _runs(_BLANK[data], offsets), _runs(data == 95, offsets)
                    for s, places in found.items():
                        rows[i, s] = rows.get((i, s), 0) + _rows_with(places, offsets)
        made = [(i, "character", c, n) for (i, c), n in points.items()]
        made += [(i, "rows", s, n) for (i, s), n in rows.items() if n]
        if made:
            number, kind, code, n = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(kind), pa.array(code, pa.int32()), pa.array(n, pa.int64())], names=["i", "kind", "code", "n"])
    return run


def counts(df: DataFrame, columns: list[str] | None = None, symbols: str = "") -> DataFrame:
    """``(column, kind, code, n)``: occurrences of every ``character`` that is no ASCII letter, digit or white space, and ``rows``
    with each of the ASCII ``symbols``, with two blanks (-1) or two underscores (-2) in a row."""
    fams = families(df)
    names = [c for c in (columns or list(fams)) if fams[c] == TEXT]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, kind string, code int, n bigint")
    counted = df.select(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(cols(names))]).mapInArrow(_pass([ord(s) for s in symbols]), _COUNTS)
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)
    return counted.groupBy("i", "kind", "code").agg(F.sum("n").alias("n")).select(name.alias("column"), "kind", "code", "n")


def named(counted: DataFrame) -> DataFrame:
    """``code`` as ``character`` with its Unicode name, one Arrow call per batch of already counted characters."""
    @F.pandas_udf("character string, unicode_name string")
    def spell(codes: pd.Series) -> pd.DataFrame:
        chars = codes.map(chr)
        return pd.DataFrame({"character": chars, "unicode_name": chars.map(lambda c: unicodedata.name(c, "UNKNOWN"))})

    return counted.withColumn("_c", spell("code")).select("column", "_c.character", F.col("n").alias("occurrences"), F.col("code").alias("code_point"), "_c.unicode_name")
