"""Benchmark passages in documents, also with a few edits.

An item of ``m`` characters may differ in ``e = floor(rate * m)`` characters. Cut into
``e + 1`` pieces, at least one piece stands unchanged in any such copy (pigeonhole). All pieces
of a block of items are searched at once; every hit fixes where the item would lie, and that
stretch of the document is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.batches import pieces, texts

RATE = 0.05
BLOCK = 8 << 20   # characters of items that one pass over the documents searches; its automaton is what is broadcast


def normal(text: str) -> str:
    """Lower case, white space as single blanks, none at the ends."""
    return " ".join(text.lower().split())


def cuts(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places."""
    bounds = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        found[c] |= 1 << i
    return found


def nearest(text: str, item: str, peq: dict[str, int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and the first end of such a stretch (Myers 1999)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for k, c in enumerate(text, 1):
        x = peq.get(c, 0) | minus
        diagonal = (((x & plus) + plus) ^ plus) | x
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full   # the lowest bit stays 0: a stretch may start anywhere
        minus = up & diagonal
        plus = ((down << 1) & full) | (full & ~(up | diagonal))
        if score < best:
            best, at = score, k
    return best, at


class Search:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text, budget) in enumerate(self.items):
            for place, piece in cuts(text, budget):
                owners[piece].append((number, place))
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(item number, distance, end)`` for each item within its budget somewhere in ``text``: the least distance, its first end."""
        places: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(text):
            for number, place in where:
                places[number].add(end + 1 - size - place)
        for number, begins in places.items():
            _, item, budget = self.items[number]
            peq = self.masks.get(number) or self.masks.setdefault(number, masks(item))
            best, at, stretch = budget + 1, 0, None
            for begin in [*sorted(begins), None]:
                if stretch and (begin is None or begin - budget > stretch[1]):
                    low = max(0, stretch[0])
                    distance, end = nearest(text[low:stretch[1]], item, peq)
                    if distance < best:
                        best, at = distance, low + end
                    stretch = None
                if begin is not None:
                    stretch = (stretch[0] if stretch else begin - budget, begin + len(item) + budget)
            if best <= budget:
                yield number, best, at


def _matcher(items, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items.value, rate)
        for batch in pieces(batches):
            found = [(k, *hit) for k, text in enumerate(batch.column("text").to_pylist()) for hit in search.hits(normal(text))]
            if found:
                rows, numbers, distances, ends = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(rows)), batch.column("body").take(pa.array(rows)), pa.array([search.items[n][0] for n in numbers], pa.int64()),
                    pa.array(distances, pa.int32()), pa.array(ends, pa.int64())], names=["doc_id", "body", "item_id", "distance", "end"])
    return run


def _blocks(benchmark: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """Normal forms of the items that are not empty, in blocks of at most ``size`` characters or one item."""
    block, held = [], 0
    rows = benchmark.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull())
    for item, raw in rows.toLocalIterator():
        form = normal(raw)
        if not form:
            continue
        if block and held + len(form) > size:
            yield block
            block, held = [], 0
        block.append((item, form))
        held += len(form)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", block: int = BLOCK, with_body: bool = False) -> DataFrame:
    """``(doc_id, item_id, distance, end)`` for every item that stands in a document with at most ``floor(rate * length)`` edits.

    ``with_body`` adds ``body``, the text's xxhash64. Both sides are compared in lower case with single blanks. ``distance`` is the least one,
    ``end`` the first place in the document's normal form where a stretch of that distance ends.
    Items that are null, empty or blank match nothing, and so do such texts. Equal items, equal
    rows and null ids give a row each. Very short items (under ``1 / rate`` characters) must
    stand unchanged. Items beyond ``block`` characters are searched in further passes.
    """
    source = texts(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text).select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("body"), "text")
    schema, out = "doc_id bigint, body bigint, item_id bigint, distance int, end bigint", None
    for items in _blocks(benchmark, item_key, item_text, block):
        found = source.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(items), rate), schema)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else docs.sparkSession.createDataFrame([], schema)
    return out if with_body else out.drop("body")
