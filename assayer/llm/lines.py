"""Repeated runs of words or of whole lines, found by winnowing over hashes.

Runs of words (``lines_only=False``) begin and end at any word, inside of lines, too. A window is
``least`` words in a row, and its fingerprint is the smallest hash of the ``GRAM`` words in a row
that it holds.

1. Neighbouring windows with the same fingerprint are a stretch. Stretches whose fingerprint
   occurs once are dropped; equal windows choose equal fingerprints, so no repeated one is lost.
2. A stretch that is not the first of its kind has earlier windows only and goes as a whole.
3. Where stretches of one fingerprint differ, the single windows of the first of each kind are
   compared with the first place of each. The first place of a window always lies in a stretch
   that is the first of its kind: nothing is missed. A fingerprint with one kind of stretch has
   no such windows, its copies went in step 2.
4. The words of windows that are not the first are deleted.

Runs of whole lines (``lines_only=True``) are found in the same way over lines.

A line is a stretch of words up to a line feed or to the end of a sentence, so that one-line
paragraphs have several. Its hash ignores white space. From every line on, the shortest run of
whole lines with ``least`` words or more is a window; so is the shortest run up to every line.

1. Winnowing: of each window the line with the smallest hash is its fingerprint (of equal ones
   the last). Two equal windows choose the same line, so every repeated run of ``least`` words
   shares a fingerprint: no run of whole lines that long is missed. What such a run shares with
   the lines before and after it stays.
2. Positions are joined by fingerprint; those that occur once are dropped with their windows.
3. The windows around the others are the match extended both ways: a line belongs to a repeated
   run exactly if a window that holds it stands at an earlier place, too. Every window is
   compared with its first place only, never with all.
4. The lines of windows that are not the first are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.llm import hashing
from assayer.llm.batches import pieces, utf8
from assayer.session import cut, discard

LEAST = 30   # words
GRAM = 10    # words of a fingerprint where runs may begin and end inside of lines

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class Lines:
    """The lines of a batch of texts: first word, byte span and hash of each, and how many come before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, words = hashing.word_spans(data, offsets)
        n = len(starts)
        if not n:
            self.first = self.begin = np.zeros(0, np.int64)
            self.hash, self.words, self.counts, self.end = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
            return
        feeds = np.flatnonzero(data == 10)
        between = np.searchsorted(feeds, starts)
        opens = np.zeros(n, bool)
        opens[1:] = (between[1:] != between[:-1]) | _ENDS[data[ends[:-1] - 1]]
        opens[words[:-1][words[:-1] < words[1:]]] = True
        self.first = np.flatnonzero(opens)
        self.words = np.append(self.first, n)                    # words before each line
        self.counts = np.searchsorted(self.first, words)         # lines before each text
        hashes = hashing.span_hashes(data, starts, ends)
        self.hash = _runs(hashes, self.first, self.words[1:])
        self.begin = starts[self.first]
        text = np.searchsorted(offsets, self.begin, "right")     # a line ends where the next begins, or with its text
        self.end = np.minimum(np.append(self.begin[1:], len(data)), offsets[text])

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last line of every window, each window once."""
        n = len(self.hash)
        if not n:
            return self.first, self.first
        text = np.searchsorted(self.counts, np.arange(n), "right") - 1
        low, high = self.counts[text], self.counts[text + 1]
        stop = np.searchsorted(self.words, self.words[:-1] + least)
        onward = np.flatnonzero(stop <= high)
        start = np.searchsorted(self.words, self.words[1:] - least, "right") - 1
        backward = np.flatnonzero(start >= low)
        i = np.concatenate((onward, start[backward]))
        j = np.concatenate((stop[onward] - 1, backward))
        code = np.unique(i * (n + 1) + j)
        return code // (n + 1), code % (n + 1)


def _runs(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[first:stop]``; runs may overlap. Works on stretches of 1 M values."""
    out = np.zeros(len(first), np.uint64)
    at = 0
    while at < len(first):
        base = int(first[at])
        until = int(np.searchsorted(first, base + (1 << 20), "left"))
        end = int(stop[at:until].max())
        power, inverse = hashing._powers(end - base + 1)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum(values[base:end] * power[:end - base], out=sums[1:])
        a, b = first[at:until] - base, stop[at:until] - base
        out[at:until] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = until
    return hashing.mix(out)


def _smallest(hashes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The line with the smallest hash in each window ``i .. j``, of equal ones the last."""
    best, out, reach = np.arange(len(hashes)), np.zeros(len(i), np.int64), 1
    lengths = j - i + 1
    while True:
        mine = np.flatnonzero((lengths >= reach) & (lengths < 2 * reach))
        a, b = best[i[mine]], best[j[mine] - reach + 1]
        out[mine] = np.where(hashes[a] < hashes[b], a, b)
        if not (lengths >= 2 * reach).any():
            return out
        later = best[reach:]
        head = best[:len(later)]
        best = np.where(hashes[head] < hashes[later], head, later)
        reach *= 2


_PRINTS = "h bigint, doc_id bigint, body bigint, windows binary"


def _prints(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lines = Lines(*utf8(batch.column("text")))
            i, j = lines.windows(least)
            if not len(i):
                continue
            chosen = _smallest(lines.hash, i, j)
            whole = _runs(lines.hash, i, j + 1)
            order = np.argsort(chosen, kind="stable")
            chosen, i, j, whole = chosen[order], i[order], j[order], whole[order]
            cuts = np.append(np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]]), len(chosen))
            text = np.searchsorted(lines.counts, chosen[cuts[:-1]], "right") - 1
            base = lines.counts[np.searchsorted(lines.counts, i, "right") - 1]
            record = np.zeros(len(i), np.dtype([("g", "<u8"), ("i", "<u4"), ("n", "<u2")]))
            record["g"], record["i"], record["n"] = whole, i - base, j - i
            raw = record.tobytes()
            size = record.dtype.itemsize
            yield pa.RecordBatch.from_arrays([
                pa.array(lines.hash[chosen[cuts[:-1]]].view(np.int64)), batch.column("doc_id").take(pa.array(text)), batch.column("body").take(pa.array(text)),
                pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(raw)]),
            ], names=["h", "doc_id", "body", "windows"])
    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = np.dtype([("g", "<u8"), ("i", "<u4"), ("n", "<u2")])
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column("windows").to_pylist()
        record = np.frombuffer(b"".join(raw), kind)
        row = pa.array(np.repeat(np.arange(len(raw)), [len(r) // kind.itemsize for r in raw]))
        i = record["i"].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(record["g"].astype(np.uint64).view(np.int64)), batch.column("doc_id").take(row), batch.column("body").take(row),
                                          pa.array(i), pa.array(i + record["n"].astype(np.int32))], names=["g", "doc_id", "body", "i", "j"])


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, body, runs)``: for each text with lines to delete, the windows of lines that stand earlier, too.

    ``docs`` has ``doc_id``, ``body`` (a hash of the text) and ``text``. Earlier is the smaller
    ``(doc_id, body, line)``; of a run that overlaps its own first place only the rest counts.
    """
    prints = cut(docs.mapInArrow(_prints(least), _PRINTS))
    often = cut(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    windows = cut(prints.join(often, "h").select("doc_id", "body", "windows").mapInArrow(_opened, "g bigint, doc_id bigint, body bigint, i int, j int"))
    discard(prints, often)
    first = cut(windows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "body", "i", "j")).alias("first")).where("n > 1").select("g", "first"))
    later = windows.join(first, "g").where("NOT (doc_id <=> first.doc_id AND body = first.body AND i = first.i)")
    rest = F.when(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body")), F.greatest(F.col("i"), F.col("first.j") + 1)).otherwise(F.col("i"))
    return later.withColumn("i", rest).where("i <= j").groupBy("doc_id", "body").agg(F.collect_set(F.struct("i", "j")).alias("runs"))   # at most two windows a line


_STRETCHES = "h bigint, whole bigint, doc_id bigint, body bigint, i int, n int"


def _stretches(least: int):
    size = min(GRAM, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            starts, ends, words = hashing.word_spans(data, offsets)
            text = np.repeat(np.arange(batch.num_rows), np.diff(words))
            i = np.flatnonzero(np.arange(len(text)) + least <= words[1:][text])
            if not len(i):
                continue
            hashes = hashing.span_hashes(data, starts, ends)
            every = np.arange(len(hashes) - size + 1)
            grams = _runs(hashes, every, every + size)
            chosen = _smallest(grams, i, i + least - size)
            cuts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
            n, i = np.diff(np.append(cuts, len(i))), i[cuts]
            whole, row = _runs(hashes, i, i + n + least - 1), text[i]
            yield pa.RecordBatch.from_arrays([
                pa.array(grams[chosen[cuts]].view(np.int64)), pa.array(whole.view(np.int64)), batch.column("doc_id").take(pa.array(row)), batch.column("body").take(pa.array(row)),
                pa.array((i - words[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
            ], names=["h", "whole", "doc_id", "body", "i", "n"])
    return run


def _single(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            starts, ends, words = hashing.word_spans(data, offsets)
            text = np.repeat(np.arange(batch.num_rows), np.diff(words))
            spans = batch.column("spans")
            row = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            n = flat.field("n").to_numpy()
            begin = words[row] + flat.field("i").to_numpy()
            i = np.sort(np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            g, row = _runs(hashing.span_hashes(data, starts, ends), i, i + least), text[i]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column("doc_id").take(pa.array(row)), batch.column("body").take(pa.array(row)),
                                              pa.array((i - words[row]).astype(np.int32))], names=["g", "doc_id", "body", "i"])
    return run


def _hashed(rows: DataFrame) -> DataFrame:
    """The side of a join with a row per key, a few numbers each: kept as a hash table in each task, so that the texts and windows it meets are not sorted."""
    return rows.hint("shuffle_hash")


def repeated_words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, body, runs)`` as of ``repeated_runs``, but of words: the runs hold the numbers of the first and last word."""
    here = F.struct("doc_id", "body", "i")
    elsewhere = "NOT (doc_id <=> first.doc_id AND body = first.body AND i = first.i)"
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))
    rest = F.when(same, F.greatest(F.col("i"), F.col("first.i") + least)).otherwise(F.col("i")).alias("i")

    prints = cut(docs.mapInArrow(_stretches(least), _STRETCHES))
    often = cut(prints.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    stretches = cut(prints.join(_hashed(often), "h"))
    discard(prints, often)
    # Equal stretches have one fingerprint, so a kind of stretch is a pair (h, whole).
    kinds = cut(stretches.groupBy("h", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(here).alias("first"), F.max("n").alias("n")))
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h")
    later = cut(stretches.drop("h").join(_hashed(kinds.where("c > 1").select("whole", "first")), "whole").where(elsewhere)
                .select("doc_id", "body", rest, (F.col("i") + F.col("n") + (least - 2)).alias("j")))
    discard(stretches)
    spans = kinds.join(mixed, "h").groupBy(F.col("first.doc_id").alias("_id"), F.col("first.body").alias("_body")).agg(F.collect_list(F.struct(F.col("first.i").alias("i"), "n")).alias("spans"))
    held = docs.join(_hashed(spans), docs["doc_id"].eqNullSafe(spans["_id"]) & (docs["body"] == spans["_body"])).select("doc_id", "body", "text", "spans")
    windows = cut(held.mapInArrow(_single(least), "g bigint, doc_id bigint, body bigint, i int"))
    discard(kinds)
    first = cut(windows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min(here).alias("first")).where("c > 1").select("g", "first"))
    single = windows.join(_hashed(first), "g").where(elsewhere).select("doc_id", "body", rest, (F.col("i") + (least - 1)).alias("j"))
    found = cut(later.unionByName(single).where("i <= j").groupBy("doc_id", "body").agg(F.collect_set(F.struct("i", "j")).alias("runs")))
    discard(later, windows, first)
    return found


def _marked(n: int, pairs: pa.Array) -> np.ndarray:
    """Which of ``n`` lines or words lie in a run."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, pairs.field("i").to_numpy(), 1)
    np.add.at(gone, pairs.field("j").to_numpy() + 1, -1)
    return np.cumsum(gone)[:-1] > 0


def _word_spans(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words to delete with the white space after them, or before them where a line ends with them but does not begin."""
    starts, ends, _ = hashing.word_spans(data, offsets)
    a, b = np.flatnonzero(gone & ~np.r_[False, gone[:-1]]), np.flatnonzero(gone & ~np.r_[gone[1:], False])
    begin, end = starts[a], np.append(starts, len(data))[b + 1]
    before = np.where(a > 0, ends[a - 1], begin)
    feeds = np.flatnonzero(data == 10)
    inside = (a > 0) & (np.searchsorted(feeds, before) == np.searchsorted(feeds, begin)) & (np.searchsorted(feeds, ends[b]) < np.searchsorted(feeds, end))
    return np.where(inside, before, begin), np.where(inside, ends[b], end)


def _without(text: str, runs: str, names: list[str], lines_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            column, spans = batch.column(text), batch.column(runs)
            n = batch.num_rows
            removed_lines, removed_words, new = np.zeros(n, np.int64), np.zeros(n, np.int64), []
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            for k in hit.tolist():
                data, offsets = utf8(column[k:k + 1])
                lines = Lines(data, offsets)
                if lines_only:
                    gone = _marked(len(lines.hash), spans[k].values)
                    begin, end, words = lines.begin[gone], lines.end[gone], np.diff(lines.words)[gone].sum()
                else:
                    marked = _marked(lines.words[-1], spans[k].values)
                    gone = np.unique(np.searchsorted(lines.words, np.flatnonzero(marked), "right"))
                    begin, end = _word_spans(data, offsets, marked)
                    words = marked.sum()
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, begin, 1)
                np.add.at(edge, end, -1)
                keep = np.cumsum(edge)[:-1] == 0
                new.append(data[keep].tobytes().decode("utf-8"))
                removed_lines[k], removed_words[k] = gone.sum() if lines_only else len(gone), words
            changed = pc.replace_with_mask(column, spans.is_valid(), pa.array(new, column.type)) if new else column
            made = {text: changed, "removed_lines": pa.array(removed_lines), "removed_words": pa.array(removed_words)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)
    return run


def deduplicate(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", lines_only: bool = True) -> DataFrame:
    """``docs`` without the runs that stand earlier, too, plus ``removed_lines`` and ``removed_words``.

    A run is a sequence of whole lines with ``least`` words or more, or unless ``lines_only`` of any
    words; it is deleted wherever it follows its first place (smallest id, then position). Of a line
    that loses some of its words the others stay, and it counts in ``removed_lines``. All columns and rows stay; an input
    column named like one of the two added ones is replaced. Null, empty and blank texts stay
    as they are. A null id counts as the smallest. Rows with equal id and text are one document
    and get the same text. An empty table stays empty. Ids are whole numbers.
    """
    names = [c for c in docs.columns if c not in ("removed_lines", "removed_words")]
    runs = "runs"
    while runs in names:
        runs += "_"
    body = F.xxhash64(F.col(f"`{text}`"))
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), body.alias("body"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = (repeated_runs if lines_only else repeated_words)(source, least).select(F.col("doc_id").alias("_found_id"), F.col("body").alias("_found_body"), F.col("runs").alias("_found_runs"))
    joined = docs.join(_hashed(found), docs[f"`{key}`"].cast("bigint").eqNullSafe(found["_found_id"]) & (F.xxhash64(docs[f"`{text}`"]) == found["_found_body"]), "left").select(
        *[docs[f"`{c}`"] for c in names], found["_found_runs"].alias(runs))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in names]).schema]
    out = names + ["removed_lines", "removed_words"]
    return joined.mapInArrow(_without(text, runs, out, lines_only), ", ".join([*fields, "removed_lines bigint", "removed_words bigint"]))
