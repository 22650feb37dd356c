"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

1. Every task counts the words of its texts and reports its most frequent ones; the sums give
   the words of the lexicon. The lexicon decides speed only, never a result.
2. The words, sorted, become a minimal acyclic automaton (states with equal right languages are
   shared). Each transition carries a number; their sum along a word is the word's rank, which
   points to its ids. Transitions lie in one double array.
3. Every worker maps the compiled file and walks all distinct words of a batch side by side,
   one byte a step. Words that leave the automaton are merged exactly by the merge list.
4. Decoding puts the bytes of the ids together again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.llm import words
from assayer.llm.batches import pieces, texts

LEXICON = 1 << 15    # words in the automaton
REPORTED = 1 << 14   # words that one task reports
HELD = 1 << 19       # words that a task counts at once; when there are more, the rarest half goes


class Merges:
    """The merge list of a byte-level BPE tokenizer, applied to single words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in seen]
        shown = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}   # a byte that can be seen stands for itself
        vocabulary = model["vocab"]
        self.bytes = {i: bytes(shown[c] for c in token) for token, i in vocabulary.items() if all(c in shown for c in token)}
        byte_id = {self.bytes[i][0]: i for i in self.bytes if len(self.bytes[i]) == 1}
        self.first = [byte_id.get(b, -1) for b in range(256)]
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word: of all neighbours the pair that comes first in the list is merged, the leftmost first."""
        ids, pairs = [self.first[b] for b in word], self.pairs
        if len(ids) > 48:
            return self._encode_long(ids)
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                found = pairs.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at:at + 2] = [best[1]]
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[ids[i], ids[i + 1]][:1], i, ids[i], ids[i + 1]) for i in range(n - 1) if (ids[i], ids[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = pairs[left, right][1], -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (found := pairs.get((ids[a], ids[after[a]]))):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[after[a]]))
        return [x for x in ids if x != -2]


def automaton(vocabulary: Sequence[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Transitions and final marks of the minimal automaton of sorted distinct words; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    free: list[int] = []
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(moves[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                moves[path[-1]][last[len(path) - 1]] = same
                free.append(state)

    for word in vocabulary:
        common = len(os.path.commonprefix((word, last)))
        settle(common)
        for byte in word[common:]:
            state = free.pop() if free else len(moves)
            if state == len(moves):
                moves.append({})
                final.append(False)
            else:
                moves[state], final[state] = {}, False
            moves[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(0)
    return moves, final


class Transducer:
    """The compiled automaton: ``base`` and ``final`` by state, owner, target and added rank by cell, ids by rank."""

    NAMES = ("base", "cells", "final", "ends", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, vocabulary: Sequence[bytes], ids: Sequence[Sequence[int]]) -> Transducer:
        moves, final = automaton(vocabulary)
        paths: dict[int, int] = {}
        stack = [(0, False)]
        while stack:   # words that each state accepts, children first
            state, ready = stack.pop()
            if ready:
                paths[state] = final[state] + sum(paths[t] for t in moves[state].values())
            elif state not in paths:
                stack.append((state, True))
                stack.extend((t, False) for t in moves[state].values() if t not in paths)
        order, seen = [0], {0}
        for state in order:
            for target in moves[state].values():
                if target not in seen:
                    seen.add(target)
                    order.append(target)
        size = 256 + 4 * (len(order) + sum(len(moves[s]) for s in order))
        check, step, goal = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        base_of, low = {}, 0
        for state in sorted(order, key=lambda s: -len(moves[s])):
            labels = np.array(sorted(moves[state]), np.int64)
            if not len(labels):
                base_of[state] = 0
                continue
            begin = low
            while True:
                if begin + 512 > len(check):
                    grow = len(check)
                    check, step, goal = (np.concatenate((x, np.full(grow, fill, np.int32))) for x, fill in ((check, -1), (step, 0), (goal, 0)))
                spots = np.flatnonzero(check[begin:begin + 256] < 0) + begin - labels[0]
                spots = spots[spots >= 0]
                fits = spots[(check[spots[:, None] + labels] < 0).all(axis=1)] if len(spots) else spots
                if len(fits):
                    break
                begin += 256
            base = int(fits[0])
            base_of[state] = base
            added = int(final[state])
            for label in labels.tolist():
                target = moves[state][label]
                check[base + label], goal[base + label], step[base + label] = state, target, added
                added += paths[target]
            while low < len(check) and check[low] >= 0:
                low += 1
        number = {s: i for i, s in enumerate(order)}
        used = int(np.flatnonzero(check >= 0)[-1]) + 1 if (check >= 0).any() else 0
        size = used + 256
        owner = np.full(size, -1, np.int32)
        target = np.zeros(size, np.int32)
        cells = np.flatnonzero(check[:size] >= 0)
        owner[cells] = [number[s] for s in check[cells].tolist()]
        target[cells] = [number[s] for s in goal[cells].tolist()]
        base = np.array([base_of[s] for s in order], np.int32)
        added = np.zeros(size, np.int32)
        added[cells] = step[cells]
        packed = np.stack((owner, target, added))
        flat = [x for row in ids for x in row]
        return cls({"base": base, "cells": packed, "final": np.array([final[s] for s in order], np.int32),
                    "ends": np.append(0, np.cumsum([len(r) for r in ids])).astype(np.int32), "ids": np.array(flat, np.int32)})

    def save(self) -> bytes:
        """All arrays in one block: five counts, then the arrays, 32 bits each."""
        arrays = [np.ascontiguousarray(getattr(self, n), np.int32).ravel() for n in self.NAMES]
        return np.concatenate([np.array([len(a) for a in arrays], np.int32), *arrays]).astype("<i4").tobytes()

    @classmethod
    def map(cls, block: bytes) -> Transducer:
        """Write the block to the worker's own temporary folder and map it; the file goes with the process."""
        with tempfile.NamedTemporaryFile(prefix="lexicon-") as file:
            file.write(block)
            file.flush()
            flat = np.memmap(file.name, "<i4", "r")
        ends = np.append(0, np.cumsum(flat[:5])) + 5
        arrays = {n: flat[a:b] for n, a, b in zip(cls.NAMES, ends[:-1], ends[1:])}
        arrays["cells"] = arrays["cells"].reshape(3, -1)
        return cls(arrays)

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks of the words ``data[begin:end]``, -1 for those not in the lexicon; all words take a step at once."""
        rank = np.full(len(begin), -1, np.int64)
        owner, target, added = self.cells
        alive, at = np.arange(len(begin)), begin.copy()
        state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        while len(alive):
            done = at == end[alive]
            if done.any():
                ended = done & (self.final[state] == 1)
                rank[alive[ended]] = total[ended]
                alive, at, state, total = (x[~done] for x in (alive, at, state, total))
            cell = self.base[state] + data[at]
            fits = owner[cell] == state
            cell = cell[fits]
            alive, at, state, total = alive[fits], at[fits] + 1, target[cell].astype(np.int64), total[fits] + added[cell]
        return rank


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    for batch in pieces(batches):
        for part in words.safe_parts(batch.column("text")) if words._long(batch.column("text")) else [batch.column("text")]:
            made = words.Batch(part)
            times = np.bincount(made.which, minlength=len(made.hashes))
            often = np.flatnonzero(times > 1)   # a word met once in 2 MB is not worth a place
            for word, n in zip(made.spell(often), times[often].tolist()):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > HELD:
                counts = dict(heapq.nlargest(HELD // 2, counts.items(), key=lambda x: (x[1], x[0])))
    best = heapq.nlargest(REPORTED, counts.items(), key=lambda x: (x[1], x[0]))
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[bytes]:
    """The ``most`` most frequent words over all texts, in byte order."""
    counted = docs.select("text").mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.where("word IS NOT NULL AND length(word) BETWEEN 1 AND 64").orderBy(F.col("n").desc(), "word").limit(most)
    return sorted(bytes(r.word) for r in top.collect())


def compiled(docs: DataFrame, path: str, most: int = LEXICON) -> bytes:
    """The transducer of the frequent words of ``docs`` for the tokenizer at ``path``, as one block."""
    merges = Merges(path)
    vocabulary = frequent_words(docs, most)
    return Transducer.compile(vocabulary, [merges.encode(w) for w in vocabulary]).save()


class Codec:
    """Encodes and decodes batches of texts: lexicon first, the merge list for the rest."""

    def __init__(self, path: str, block: bytes):
        self.merges, self.library, self.lexicon = Merges(path), words.load(path), Transducer.map(block)
        if not words.is_byte_level(self.library):
            raise ValueError(f"{path} is no byte-level BPE tokenizer")
        self.known = words.met(f"{path} merged", lambda unseen: [self.merges.encode(w) for w in unseen])
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        table = dict(self.merges.bytes) | {i: t.encode("utf-8") for t, i in self.special.items()}
        spelled = [table.get(i, b"") for i in range(max(table) + 1)]
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.append(0, np.cumsum(self.lengths))[:-1]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and the ``n + 1`` offsets between them."""
        column = pc.fill_null(column, "")
        if words.with_special(column, self.library).any():
            return self._with_special(column)
        if words._long(column):
            ids = np.concatenate([self._words(part)[0] for part in words.safe_parts(column)])
            return ids, np.array([0, len(ids)])
        return self._words(column)

    def _words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        batch = words.Batch(column)
        rank = self.lexicon.find(batch.data, batch.begin, batch.end)
        unseen = np.flatnonzero(rank < 0)
        place = self.known.find(batch.hashes[unseen], lambda new: batch.spell(unseen[new]))
        ends = self.known.rows.offsets()
        flat = np.concatenate((self.lexicon.ids, self.known.rows.flat[:self.known.rows.size]))
        begin = np.where(rank >= 0, self.lexicon.ends[rank], 0).astype(np.int64)
        length = np.where(rank >= 0, self.lexicon.ends[rank + 1] - self.lexicon.ends[rank], 0).astype(np.int64)
        begin[unseen], length[unseen] = ends[place] + len(self.lexicon.ids), ends[place + 1] - ends[place]
        lengths = length[batch.which]
        return flat[words._spread(lengths, begin[batch.which])], np.append(0, np.cumsum(lengths))[batch.counts]

    def _with_special(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Special strings stand for their ids, the text between them is encoded as usual; at one place the longest counts."""
        import re

        split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=lambda t: (-len(t), t))) + ")")
        rows = [split.split(t) for t in column.to_pylist()]
        ids, offsets = self._words(pa.array([p for r in rows for p in r[::2]], pa.large_string()))
        out, at = [], 0
        for row in rows:
            parts = []
            for k, part in enumerate(row):
                if k % 2:
                    parts.append(np.array([self.special[part]], ids.dtype))
                else:
                    parts.append(ids[offsets[at]:offsets[at + 1]])
                    at += 1
            out.append(np.concatenate(parts))
        return np.concatenate(out), np.append(0, np.cumsum([len(r) for r in out]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after another and the offsets between them."""
        lengths = self.lengths[ids]
        data = self.spelling[words._spread(lengths, self.begins[ids])]
        return data, np.append(0, np.cumsum(lengths))[offsets]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, block: bytes) -> Codec:
    """The worker process's codec, made once for all its tasks."""
    name = (path, hashlib.sha256(block).hexdigest())
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(path, block)
    return _CODECS[name]


def _coded(path: str, block, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, block.value)
        decimal = [b"%d" % i for i in range(len(codec.lengths))]
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            ids, offsets = codec.encode(batch.column("text"))
            counts = pa.array(np.diff(offsets).astype(np.int64))
            if digest:
                data, ends = codec.decode(ids, offsets)
                listed, plain = ids.tolist(), data.tobytes()
                spelled = [decimal[i] for i in listed]
                bounds = list(zip(offsets.tolist(), offsets[1:].tolist()))
                columns = [pa.array([hashlib.sha256(b",".join(spelled[a:b])).hexdigest() for a, b in bounds]), pa.array([
                    _sha(plain[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())])]
                names = ["ids_sha256", "decoded_sha256"]
            else:
                columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                names = ["ids"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, *columns], names=["doc_id", "n_tokens", *names])
    return run


def _sha(data: bytes) -> str:
    """Digest of a decoded text; bytes that are no UTF-8 become the replacement character, as in the library."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        data = data.decode("utf-8", "replace").encode("utf-8")
    return hashlib.sha256(data).hexdigest()


def _apply(docs: DataFrame, path: str, block: bytes | None, key: str, text: str, digest: bool, schema: str) -> DataFrame:
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(compiled(source, path) if block is None else block)   # under 4 MB for LEXICON words
    return source.mapInArrow(_coded(path, shared, digest), f"doc_id {kind}, n_tokens bigint, {schema}")


def encode(docs: DataFrame, path: str, block: bytes | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)``, one row per row of ``docs``.

    The ids are those of the tokenizers library for the file at ``path`` without added special
    tokens, truncation or padding. ``block`` is a compiled lexicon; without one it is made from
    the texts. A null or empty text has no ids. Ids of rows may be null or repeat; other columns
    are not read; an empty table gives no rows.
    """
    return _apply(docs, path, block, key, text, False, "ids array<int>")


def round_trip(docs: DataFrame, path: str, block: bytes | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the decimal ids joined by commas and of the decoded text."""
    return _apply(docs, path, block, key, text, True, "ids_sha256 string, decoded_sha256 string")
