"""The words that a byte-level BPE tokenizer merges on their own, found for whole batches at once.

The tokenizer's pattern cuts a text into runs of letters, of digits and of other signs, each
with the blank before it, into English contractions and into runs of white space. Which
characters are letters, digits and white space is asked of the tokenizers library itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a Spark task has one core

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

from assayer.llm.batches import PIECE, utf8
from assayer.llm.hashing import span_hashes

LETTER, DIGIT, OTHER, SPACE, NONE, UNKNOWN = range(6)
_KINDS = np.full(0x110000, UNKNOWN, np.uint8)
_SPLITTER = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def _kind(char: str) -> int:
    for sign, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)):
        if len(_SPLITTER.pre_tokenize_str(sign + char)) == 1:
            return kind
    return SPACE


def kinds(points: np.ndarray) -> np.ndarray:
    found = _KINDS[points]
    if (found == UNKNOWN).any():
        for point in np.unique(points[found == UNKNOWN]).tolist():
            _KINDS[point] = _kind(chr(point))
        found = _KINDS[points]
    return found


def starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start, and how many words come before each text; the words cover all bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.arange(len(data)) if len(points) == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
    full = offsets[1:] > offsets[:-1]
    first = np.searchsorted(place, offsets[:-1][full])
    kind = kinds(points)
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first] = NONE
    after[first[1:] - 1] = NONE
    after[-1] = NONE
    blank = np.zeros(len(points), bool)
    blank[1:] = points[:-1] == 32
    blank[first] = False
    start = np.where(kind == SPACE, (before != SPACE) | ((after != SPACE) & (after != NONE)), (before != kind) & ~blank)

    quote = np.flatnonzero((points == 39) & start & (after == LETTER))
    if len(quote):
        padded = np.append(points, [0, 0])
        ends = np.append(first, len(points))
        end = ends[np.searchsorted(first, quote, "right")]
        one, two = padded[quote + 1], np.where(quote + 2 < end, padded[quote + 2], 0)
        size = np.isin(one, [ord(c) for c in "stmd"]) * 1
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        quote, size, end = quote[size > 0], size[size > 0], end[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        start[rest[rest < end]] = True
    at = place[np.flatnonzero(start)]
    return at, np.searchsorted(at, offsets)


def _spread(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions ``begin .. begin + length`` of every entry, one after another."""
    total = np.cumsum(lengths)
    return np.repeat(begins - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


class Ragged:
    """Growing list of integer rows in one flat array."""

    def __init__(self):
        self.flat, self.ends, self.size = np.zeros(1024, np.int32), [np.zeros(1, np.int64)], 0

    def extend(self, rows: Sequence[Sequence[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        add = int(lengths.sum())
        if self.size + add > len(self.flat):
            self.flat = np.concatenate((self.flat[:self.size], np.zeros(max(add, self.size) + 1024, np.int32)))
        self.flat[self.size:self.size + add] = np.fromiter((x for row in rows for x in row), np.int32, add)
        self.ends.append(self.size + np.cumsum(lengths))
        self.size += add

    def offsets(self) -> np.ndarray:
        if len(self.ends) > 1:
            self.ends = [np.concatenate(self.ends)]
        return self.ends[0]


class Known:
    """Token ids of the words met so far, by the word's 64-bit hash; at ``most`` words it starts again empty."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]], most: int = 1 << 20):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.place, self.rows, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), Ragged(), 0

    def find(self, hashes: np.ndarray, spell: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Row numbers of distinct ascending ``hashes``; ``spell`` gives the bytes of those not met before."""
        if self.count > self.most:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        hit[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            self.rows.extend(self.encode(spell(new)))
            numbers = np.arange(self.count, self.count + len(new))
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.place = np.insert(self.place, at[new], numbers)
            self.count += len(new)
            at = np.searchsorted(self.hashes, hashes)
        return self.place[at]


class Batch:
    """The words of a batch of texts: each distinct word once, and which word stands where."""

    def __init__(self, column: pa.Array):
        self.data, offsets = utf8(column)
        at, self.counts = starts(self.data, offsets)
        ends = np.append(at[1:], len(self.data))
        self.hashes, first, self.which = np.unique(span_hashes(self.data, at, ends), return_index=True, return_inverse=True)
        self.begin, self.end = at[first], ends[first]
        self.bytes = self.data.tobytes()

    def spell(self, chosen: np.ndarray) -> list[bytes]:
        return [self.bytes[b:e] for b, e in zip(self.begin[chosen].tolist(), self.end[chosen].tolist())]


def library_encoder(tokenizer: tokenizers.Tokenizer) -> Callable[[list[bytes]], list[list[int]]]:
    """Words to ids by the library, all in one call."""
    def encode(words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
    return encode


_MET: dict[str, Known] = {}


def met(name: str, encode: Callable[[list[bytes]], Sequence[Sequence[int]]]) -> Known:
    """The words that this worker process has met under ``name``, in earlier tasks too."""
    if name not in _MET:
        _MET.clear()
        _MET[name] = Known(encode)
    _MET[name].encode = encode
    return _MET[name]


def load(path: str) -> tokenizers.Tokenizer:
    """The tokenizer of a .json file, without truncation or padding."""
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def is_byte_level(tokenizer: tokenizers.Tokenizer) -> bool:
    """Whether the words above are the ones that this tokenizer merges on their own."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and spec["model"].get("dropout") is None
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"]))


def with_special(column: pa.Array, tokenizer: tokenizers.Tokenizer) -> np.ndarray:
    """Which texts hold the string of an added token; those are given to the library whole."""
    found = np.zeros(len(column), bool)
    for token in tokenizer.get_added_tokens_decoder().values():
        found |= pc.fill_null(pc.match_substring(column, token.content), False).to_numpy(zero_copy_only=False)
    return found


_SAFE = re.compile(rb"[A-Za-z0-9] (?=[A-Za-z0-9])")


def safe_parts(column: pa.Array, limit: int = 2 * PIECE) -> Iterator[pa.Array]:
    """One text in parts of about ``limit`` bytes, each but the first starting with a lone blank between
    two ASCII letters or digits: a word starts there whatever stands around, so the parts have the text's words."""
    data, begin = utf8(column)[0].tobytes(), 0
    while len(data) - begin > limit:
        found = _SAFE.search(data, begin + limit)
        if not found:
            break
        yield pa.array([data[begin:found.start() + 1].decode("utf-8")], pa.large_string())
        begin = found.start() + 1
    yield pa.array([data[begin:].decode("utf-8")], pa.large_string())


def _rows(column: pa.Array, known: Known) -> tuple[Batch, np.ndarray, np.ndarray]:
    batch = Batch(column)
    rows = known.find(batch.hashes, batch.spell)
    return batch, rows, known.rows.offsets()


def _long(column: pa.Array) -> bool:
    return len(column) == 1 and pc.binary_length(column)[0].as_py() > 2 * PIECE


def encode(column: pa.Array, tokenizer: tokenizers.Tokenizer, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the ``n + 1`` offsets between texts, as the library gives them."""
    column = pc.fill_null(column, "")
    special = with_special(column, tokenizer)
    if _long(column) and not special.any():
        ids = np.concatenate([_plain_ids(part, known)[0] for part in safe_parts(column)])
        return ids, np.array([0, len(ids)])
    ids, offsets = _plain_ids(pc.if_else(pa.array(special), "", column) if special.any() else column, known)
    if special.any():
        whole = {i: np.array(tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(special).tolist()}
        parts = [whole[i] if i in whole else ids[offsets[i]:offsets[i + 1]] for i in range(len(column))]
        ids, offsets = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    return ids, offsets


def _plain_ids(column: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray]:
    batch, rows, ends = _rows(column, known)
    rows = rows[batch.which]
    begin = ends[rows]
    lengths = ends[rows + 1] - begin
    return known.rows.flat[_spread(lengths, begin)], np.append(0, np.cumsum(lengths))[batch.counts]


def token_counts(column: pa.Array, tokenizer: tokenizers.Tokenizer, known: Known) -> np.ndarray:
    """How many ids each text has; no ids are put together."""
    column = pc.fill_null(column, "")
    special = with_special(column, tokenizer)
    if _long(column) and not special.any():
        return np.sum([_plain_counts(part, known) for part in safe_parts(column)], axis=0)
    counts = _plain_counts(pc.if_else(pa.array(special), "", column) if special.any() else column, known)
    for i in np.flatnonzero(special).tolist():
        counts[i] = len(tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids)
    return counts


def _plain_counts(column: pa.Array, known: Known) -> np.ndarray:
    batch, rows, ends = _rows(column, known)
    totals = np.append(0, np.cumsum((ends[rows + 1] - ends[rows])[batch.which]))[batch.counts]
    return totals[1:] - totals[:-1]
