"""Fuzzy duplicate groups: greedy leader clustering in row order.

Reading rows in order, a row joins the first earlier leader it resembles, or becomes a leader.
That is the lexicographically first maximal independent set of the similarity graph, with
every other row attached to its smallest adjacent leader. It is computed in waves:

1. Equal normal forms resemble the same rows, so one vertex stands for all of them.
2. Each vertex keeps its rarest tokens, as many as a pair above the threshold must share at
   least one of (prefix filtering), so common tokens seldom form a block. It also carries a
   sketch of its characters and of its character pairs; two sketches that differ in more bits
   than the edits allowed could explain never leave the block as a pair.
3. In every block only the first ``HEADS`` undecided vertices are compared with each other. A
   vertex that is a head in all its blocks has met every smaller undecided vertex it could
   resemble, so its fate can be decided; the smallest vertex always can.
4. New leaders, and only they, meet the other members of their blocks.

No wave compares all pairs of a block, and a block of similar texts is settled by its leader.

Short texts at high thresholds differ in very few characters, while the numbers, domains and
prefixes they share make their q-grams frequent. Two texts of lengths a and b reach a ratio only
with a common subsequence of some length, so they agree after a - n and b - n deletions. Where these are
few, the hashes of all such subsequences are keys by which texts meet (``functions.subsequences``).
What nine texts of ten begin and end with stays whole: deletions lie in between, and only a pair with
one of the other texts may delete anywhere.

1. The first undecided vertices of every scope are clustered row by row in one task; a leader meets
   the later rows that share a key with it.
2. The other members are dealt into tiles; every tile looks its keys up among those of the new leaders.
   Keys are made where they are needed and never shuffled. Only pairs that reach the ratio meet.
3. Where sweeps settle little, texts that share no key with another are found once and left out.

Low thresholds and Jaro-Winkler scores leave no token of two characters that both texts of a pair
must have; single characters are no index. There the waves are sweeps over a whole scope:

1. The first ``SWEEP`` undecided vertices of every scope are clustered row by row in one task.
2. The other members are dealt into tiles of ``TILE`` vertices; every tile meets the new leaders
   and sends back only matches. No pair is ever a row. Inside a tile one leader is compared with
   all members at once: shared characters bound the score, then a bit-parallel subsequence runs
   until the threshold is out of reach (``functions.many``).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import ROW_ID
from assayer.functions import text
from assayer.functions.many import Many
from assayer.functions.similarity import SCORERS, metaphone_codes, ratio, score
from assayer.functions.subsequences import Index, Lookup, common_start, gathered
from assayer.operators.order import numbered
from assayer.operators.skew import attach
from assayer.operators.values import union_all
from assayer.schema import as_text, col, cols, quoted
from assayer.session import cut, discard

HEADS = 1024
SWEEP = 1000                # heads of a sweep: as many rows of a scope as Spark limits inside each task
TILE = 4096                 # members that meet the leaders of a sweep in one group
SKETCH_WORDS = 8            # 64-bit words of a sketch: half for characters, half for pairs of characters
FREQUENCY_BUCKETS = 65_536  # size bound of the broadcast token frequencies
MOST_VARIANTS = 1000        # index entries of one text
SWEEP_KEYS = 4_000_000      # index entries of the heads of one scope
INDEX_TILE = 32_768         # members that look up the leaders of a sweep in one group
MEETING = 4096              # of them at once
SLOW = 16                   # sweeps that texts are worth before those that share no entry are looked for
COMMON = 0.9                # of the texts begin or end alike where deletions are kept out of that part


class SharedTokens:
    """How many q-grams two texts must share to reach a threshold (``need``, 0..1)."""

    def __init__(self, algorithm: str, threshold: float):
        self.algorithm = algorithm
        need = threshold / 100.0
        if algorithm == "combined":
            # The other two scores add at most 60, the rest must come from the ratio.
            need = max(0.0, (threshold - 60.0) / 40.0)
        if algorithm == "jaro_winkler":
            self.jaro = (need - 0.4) / 0.6  # the prefix bonus adds at most 0.4 * (1 - jaro)
            self.q = 1
        else:
            self.need = need
            self.q = next((q for q in (3, 2) if self._holds(q)), 1)

    def _holds(self, q: int) -> bool:
        """Every pair of different texts over the threshold shares a q-gram (longer texts share more)."""
        return self.need > 0.5 and all(
            self._common(length, other, q) >= 1
            for length in range(1, 300) for other in self._partners(length) if self._may_differ(length, other)
        )

    def _lcs(self, a: int, b: int) -> int:
        return math.ceil(self.need * (a + b) / 2 - 1e-9)

    def _may_differ(self, a: int, b: int) -> bool:
        return self._lcs(a, b) <= min(a, b) and not (a == b == self._lcs(a, b))

    def _partners(self, length: int) -> range:
        return range(max(1, math.floor(length * self.need / (2 - self.need))), math.ceil(length * (2 - self.need) / max(self.need, 0.01)) + 1)

    def _common(self, a: int, b: int, q: int) -> int:
        """A removed character destroys q of a text's q-grams, an inserted one breaks q - 1."""
        lcs = self._lcs(a, b)
        kept = lambda x, y: x - q + 1 - q * (x - lcs) - (q - 1) * (y - lcs)
        return max(kept(a, b), kept(b, a))

    def at_least(self, length: int) -> int:
        """Tokens a text of this length shares with any partner over the threshold."""
        if self.algorithm == "jaro_winkler":
            share = 3 * self.jaro - 1
            if share <= 0:
                return 1
            low = max(1, math.ceil((share - 1) * length - 1e-9))
            return max(1, min(math.ceil(share * length * other / (length + other) - 1e-9) for other in {low, max(low, length)}))
        if self.need <= 0:
            return 1
        shared = [self._common(length, other, self.q) for other in self._partners(length) if self._may_differ(length, other)]
        return max(1, min(shared)) if shared else 0


def _token_function(shared: SharedTokens):
    """Column function: all q-grams of a text, the k-th copy of a gram being its own token."""
    q = shared.q

    @F.pandas_udf("array<string>")
    def tokens(values: pd.Series) -> pd.Series:
        def grams(value: str) -> list[str]:
            seen: Counter = Counter()
            out = []
            for i in range(len(value) - q + 1):
                gram = value[i:i + q]
                seen[gram] += 1
                out.append(f"{gram}{seen[gram]}")
            return out
        return values.map(grams)

    return tokens


def _keep_function(shared: SharedTokens):
    """Column function: how many of its tokens a text of some length must keep."""

    @F.pandas_udf("int")
    def keep(lengths: pd.Series) -> pd.Series:
        needed = {length: shared.at_least(length) for length in lengths.unique().tolist()}
        return lengths.map({length: max(0, length - shared.q + 2 - n) if n else 0 for length, n in needed.items()})

    return keep


def _sketch(values: Column) -> Column:
    """Unary counts up to 8 of the characters in 32 buckets, then the distinct copies of character pairs in 256 buckets."""
    def bits(value: str) -> list[int]:
        out = 0
        for bucket, n in Counter(ord(c) * 0x9E37 % 8191 % 32 for c in value).items():
            out |= ((1 << min(n, 8)) - 1) << 8 * bucket
        seen: Counter = Counter()
        for x, y in zip(value, value[1:]):
            seen[x, y] += 1
            out |= 1 << 256 + ((ord(x) * 0x1F3 + ord(y)) * 0x2545 + seen[x, y] * 0x9D) % 65521 % 256
        words = [out >> 64 * i & (1 << 64) - 1 for i in range(SKETCH_WORDS)]
        return [w - (1 << 64) if w >> 63 else w for w in words]

    @F.pandas_udf("array<bigint>")
    def sketch(texts: pd.Series) -> pd.Series:
        return texts.map(bits)

    return sketch(values)


def _may_match(algorithm: str, threshold: float, left: str, right: str) -> Column:
    """False where lengths and sketches rule the score out.

    An edit changes the character counts by one and the character pairs by three at most. The
    ratio allows ``(1 - need) * (a + b)`` edits; a Jaro score needs so many common characters.
    """
    a, b = col(f"{left}length"), col(f"{right}length")
    half = SKETCH_WORDS // 2
    differing = lambda words: sum((F.bit_count(col(f"{left}sketch")[i].bitwiseXOR(col(f"{right}sketch")[i])) for i in words), F.lit(0))
    if algorithm == "metaphone":
        return F.lit(True)
    shared = SharedTokens(algorithm, threshold)
    if algorithm == "jaro_winkler":
        common = (3 * shared.jaro - 1) * a * b / (a + b)
        return differing(range(half)) <= a + b - 2 * common + 1e-6
    edits = (1 - shared.need) * (a + b) + 1e-6
    return (F.abs(a - b) <= edits) & (differing(range(half)) <= edits) & (differing(range(half, SKETCH_WORDS)) <= 3 * edits)


def _rare_tokens(vertices: DataFrame, first: str, algorithm: str, threshold: float) -> DataFrame:
    """``(id, block)``: the tokens of each vertex that can witness a match."""
    inside = F.xxhash64("within")
    if algorithm == "metaphone":
        return vertices.select("id", "within", F.explode(metaphone_codes(col(first))).alias("token")).select(
            "id", F.xxhash64(inside, "token").alias("block"))
    shared = SharedTokens(algorithm, threshold)
    tokens = vertices.select("id", "within", F.char_length(first).alias("length"), F.explode(_token_function(shared)(col(first))).alias("token"))
    # Frequency inside the block scope decides rarity; buckets bound the size of the table.
    bucketed = tokens.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(FREQUENCY_BUCKETS)))
    frequency = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("frequency"))
    ranked = bucketed.join(F.broadcast(frequency), "bucket").groupBy("id", "within", "length").agg(
        F.array_sort(F.collect_list(F.struct("frequency", "token"))).alias("tokens"))
    kept = ranked.withColumn("keep", _keep_function(shared)(F.col("length"))).where("keep > 0")
    return kept.select("id", "within", F.explode(F.slice("tokens", F.lit(1), F.col("keep"))).alias("t")).select(
        "id", F.xxhash64(inside, F.col("t.token")).alias("block"))


def _scored(pairs: DataFrame, vertices: DataFrame, checks: dict[str, tuple[str, float]]) -> DataFrame:
    """Pairs ``(low, high)`` that pass every check, with the lowest score."""
    shown = list(checks)
    left = vertices.select(F.col("id").alias("low"), F.col("within").alias("_w1"), *[col(c).alias(f"_l_{c}") for c in shown])
    right = vertices.select(F.col("id").alias("high"), F.col("within").alias("_w2"), *[col(c).alias(f"_r_{c}") for c in shown])
    # Pairs are few bytes and much work: spread them by number, which adaptive execution keeps.
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pairs.repartition(spread, "low", "high").join(left, "low").join(right, "high").where(F.col("_w1").eqNullSafe(F.col("_w2")))
    names = []
    for n, (c, (algorithm, threshold)) in enumerate(checks.items()):
        bound = _length_bound(algorithm, threshold, F.char_length(f"_l_{c}"), F.char_length(f"_r_{c}"))
        texts = texts.where(bound).withColumn(f"_s{n}", score(algorithm, col(f"_l_{c}"), col(f"_r_{c}"), threshold))
        texts = texts.where(col(f"_s{n}") >= threshold)
        names.append(col(f"_s{n}"))
    return texts.select("low", "high", (F.least(*names) if len(names) > 1 else names[0]).alias("score"))


def _length_bound(algorithm: str, threshold: float, a: Column, b: Column) -> Column:
    """A common subsequence is no longer than the shorter text."""
    if algorithm not in ("ratio", "difflib"):
        return F.lit(True)
    return 200.0 * F.least(a, b) >= threshold * (a + b)


def leader_pairs(vertices: DataFrame, checks: dict[str, tuple[str, float]], heads: int = HEADS) -> DataFrame:
    """``(low, high, score)``: every non-leader vertex with its leader.

    ``vertices`` has ``id``, ``within`` (a struct that must be equal) and one text per check.
    """
    first, (algorithm, threshold) = next(iter(checks.items()))
    found = _index(vertices, first, threshold) if algorithm in ("ratio", "difflib") and threshold > 50 else None
    if found:
        index, most = found
        return _indexed(vertices, checks, index, max(1, min(128 * heads, SWEEP_KEYS // most)))
    if algorithm != "metaphone" and SharedTokens(algorithm, threshold).q == 1:
        return _swept(vertices, checks, min(heads, SWEEP))
    return _joined(vertices, checks, heads)


def _swept(vertices: DataFrame, checks: dict[str, tuple[str, float]], heads: int) -> DataFrame:
    """``leader_pairs`` by sweeps over whole scopes."""
    shown = list(checks)
    undecided = cut(vertices.select(F.md5(F.to_json("within").cast("binary")).alias("scope"), "id", *cols(shown)))
    kept = ", ".join(f"{quoted(c)} string" for c in shown)
    found: list[DataFrame] = []
    order = Window.partitionBy("scope").orderBy("id")
    # Texts are few bytes and much work: scopes and tiles are spread by number, which adaptive execution keeps.
    spread = 4 * int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not undecided.isEmpty():
        head = undecided.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= heads).drop("_n").repartition(spread, "scope")
        decided = cut(head.groupBy("scope").applyInPandas(_cluster(checks), f"scope string, low bigint, id bigint, score double, {kept}"))
        rest = cut(undecided.join(decided.select("id"), "id", "left_anti"))
        sizes = cut(rest.groupBy("scope").agg(F.count(F.lit(1)).alias("rows")))
        tiles = F.ceil(F.col("rows") / TILE)
        members = attach(rest, sizes, ["scope"]).withColumn("tile", F.pmod(F.xxhash64("id"), tiles)).drop("rows").repartition(spread, "scope", "tile")
        leaders = attach(decided.where("low = id").drop("low", "score"), sizes, ["scope"]).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))).drop("rows").repartition(spread, "scope", "tile")
        met = cut(members.groupBy("scope", "tile").cogroup(leaders.groupBy("scope", "tile")).applyInPandas(_meet_tile(checks), "low bigint, high bigint, score double"))
        found += [decided.where("low <> id").select("low", F.col("id").alias("high"), "score"), met]
        before, undecided = undecided, cut(rest.join(met.select(F.col("high").alias("id")), "id", "left_anti"))
        discard(before, rest, sizes)
    return union_all(found) if found else vertices.sparkSession.createDataFrame([], "low bigint, high bigint, score double")


def _resembling(many: dict[str, Many], texts: dict[str, str], alive: np.ndarray, checks: dict[str, tuple[str, float]]) -> list[tuple[int, float]]:
    """Numbers of the vertices that pass every check with ``texts``, and their lowest scores."""
    best: dict[int, float] | None = None
    for column, (algorithm, threshold) in checks.items():
        hits = dict(many[column].reach(texts[column], alive, algorithm, threshold))
        best = hits if best is None else {k: min(best[k], v) for k, v in hits.items()}
        alive = np.zeros(len(alive), bool)
        alive[list(best)] = True
        if not best:
            break
    return sorted(best.items())


def _cluster(checks: dict[str, tuple[str, float]]):
    """Greedy clusters of the heads of one scope, at most ``SWEEP`` rows, in the order of ids."""
    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        many = {c: Many(frame[c].tolist()) for c in checks}
        ids, low, score = frame["id"].to_numpy(), frame["id"].to_numpy().copy(), np.full(len(frame), 100.0)
        alive = np.ones(len(frame), bool)
        for k in range(len(frame)):
            if alive[k]:
                alive[k] = False
                for other, value in _resembling(many, {c: frame[c].iloc[k] for c in checks}, alive, checks):
                    alive[other], low[other], score[other] = False, ids[k], value
        return frame.assign(low=low, score=score)[["scope", "low", "id", "score", *checks]]
    return cluster


def _meet_tile(checks: dict[str, tuple[str, float]]):
    """The members of a tile with the first leader each resembles."""
    def meet(members: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("id")
        many = {c: Many(members[c].tolist()) for c in checks}
        alive, out, ids = np.ones(len(members), bool), [], members["id"].tolist()
        for leader in leaders.to_dict("records") if len(members) else []:
            for k, value in _resembling(many, leader, alive, checks):
                alive[k] = False
                out.append((leader["id"], ids[k], value))
            if not alive.any():
                break
        return pd.DataFrame(out, columns=["low", "high", "score"])
    return meet


def _deletions(threshold: float, shortest: int, longest: int) -> dict[int, dict[int, list[int]]] | None:
    """``_plan`` of texts of all lengths between two."""
    return _plan(threshold, range(shortest, longest + 1))


def _plan(threshold: float, kinds: Iterable[int], fixed: int = 0) -> dict[int, dict[int, list[int]]] | None:
    """Per kind of text (see ``Index``), numbers of deletions with the kinds over the threshold that then may agree; ``None`` beyond ``MOST_VARIANTS``.

    ``fixed`` is the length of prefix and suffix, which two texts of negative kind share.
    """
    shared = SharedTokens("ratio", threshold)
    plan: dict[int, dict[int, list[int]]] = {}
    kinds = sorted(kinds, key=abs, reverse=True)
    for kind in kinds:
        a, by = abs(kind), {}
        low, high = (f(shared._partners(a)) for f in (min, max))
        for other in kinds:
            b = abs(other)
            if low <= b <= high and shared._may_differ(a, b):
                by.setdefault(a - max(shared._lcs(a, b), fixed if kind < 0 and other < 0 else 0), []).append(other)
        if _entries_of(kind, by, fixed) > MOST_VARIANTS:
            return None
        plan[kind] = by
    return plan


def _variants_of(length: int, by: dict[int, list[int]]) -> int:
    return sum(math.comb(length, k) * len(others) for k, others in by.items())


def _entries_of(kind: int, by: dict[int, list[int]], fixed: int) -> int:
    """Index entries of a text of some kind: both kinds negative, deletions lie between prefix and suffix."""
    return sum(math.comb(-kind - fixed if kind < 0 and other < 0 else abs(kind), k) for k, others in by.items() for other in others)


def _index(vertices: DataFrame, first: str, threshold: float) -> tuple[Index, int] | None:
    """The index that the lengths of the texts, and what most of them begin and end with, allow, and the most entries of a text; ``None`` without one."""
    def ends(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            if texts:
                yield pd.DataFrame({"prefix": [common_start(texts, COMMON)], "suffix": [common_start([t[::-1] for t in texts], COMMON)[::-1]], "rows": [len(texts)]})

    spread = 4 * int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = vertices.select("id", col(first).alias("text"))
    usual = texts.repartition(spread, "id").select("text").mapInPandas(ends, "prefix string, suffix string, rows bigint").groupBy("prefix", "suffix").agg(F.sum("rows").alias("rows"))
    most = usual.orderBy(F.desc("rows"), "prefix", "suffix").first()
    if most is None:
        return None
    prefix, suffix = most["prefix"], most["suffix"]
    length = F.char_length("text")
    inner = F.col("text").startswith(prefix) & F.col("text").endswith(suffix) & (length >= len(prefix) + len(suffix))
    rows = {(r["inner"], r["length"]): r["rows"] for r in texts.groupBy(inner.alias("inner"), length.alias("length")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    options = [({n for _, n in rows}, "", "")]
    if prefix or suffix:
        options.append(({-n if inside else n for inside, n in rows}, prefix, suffix))
    found = []
    for kinds, start, end in options:
        fixed = len(start) + len(end)
        plan = _plan(threshold, kinds, fixed)
        if plan is not None:
            entries = {kind: _entries_of(kind, by, fixed) for kind, by in plan.items()}
            total = sum(n * entries[-length if inside and fixed else length] for (inside, length), n in rows.items())
            found.append((total, Index(plan, start, end), max([1, *entries.values()])))
    return min(found, key=lambda f: f[0])[1:] if found else None


def _variants(vertices: DataFrame, first: str, plan: Index | dict[int, dict[int, list[int]]]) -> DataFrame:
    """``(id, own, meets)``: hashes of a text's subsequences with its own kind and a partner's, and the hash that such a partner has as its own."""
    index = plan if isinstance(plan, Index) else Index(plan)

    def entries(frames):
        for frame in frames:
            ids = frame["id"].to_numpy()
            texts = frame["text"].tolist()
            for numbers, own, meets in index.keys(texts, index.kinds(texts)):
                yield pd.DataFrame({"id": ids[numbers], "scope": frame["scope"].to_numpy()[numbers], "own": own.view(np.int64), "meets": meets.view(np.int64)})

    made = vertices.select("id", F.xxhash64("scope").alias("scope"), col(first).alias("text")).mapInPandas(entries, "id bigint, scope bigint, own bigint, meets bigint")
    return made.select("id", F.xxhash64("scope", "own").alias("own"), F.xxhash64("scope", "meets").alias("meets"))


def _indexed(vertices: DataFrame, checks: dict[str, tuple[str, float]], index: Index, heads: int) -> DataFrame:
    """``leader_pairs`` by an index of subsequences."""
    none = vertices.sparkSession.createDataFrame([], "low bigint, high bigint, score double")
    if not any(index.plan.values()):
        return none
    first, shown = next(iter(checks)), list(checks)
    placed = numbered(vertices.select(F.md5(F.to_json("within").cast("binary")).alias("scope"), "id", *cols(shown)), ["scope", "id"], "_place")
    # Heads are chosen by chunks of places, whose sizes are a small table.
    undecided = cut(placed.withColumn("chunk", F.floor(F.col("_place") / max(1, heads // 8))).select("scope", "chunk", "id", *cols(shown)))
    kept = "scope string, chunk bigint, id bigint, " + ", ".join(f"{quoted(c)} string" for c in shown) + ", low bigint, score double"
    spread = 4 * int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto, everywhere = Window.partitionBy("scope").orderBy("chunk"), Window.partitionBy("scope")
    found: list[DataFrame] = []
    before, met, narrowed = None, undecided, False
    while True:
        sizes = undecided.groupBy("scope", "chunk").agg(F.count(F.lit(1)).alias("n"))
        placing = sizes.withColumns({"upto": F.sum("n").over(upto), "place": F.row_number().over(upto)}).withColumn("now", (F.col("upto") <= heads) | (F.col("place") == 1))
        scopes = cut(placing.groupBy("scope").agg(F.sum("n").alias("rows"), F.max(F.when(F.col("now"), F.col("chunk"))).alias("last"), F.sum(F.when(~F.col("now"), F.col("n")).otherwise(0)).alias("behind")))
        left, behind = scopes.agg(F.sum("rows"), F.sum("behind")).first()
        if not left:
            break
        if not narrowed and before is not None and left > SLOW * heads and SLOW * (before - left) < left:
            # Sweeps that settle little go on with texts that share an entry.
            narrowed = True
            undecided = cut(undecided.join(_sharing(undecided, first, index, spread), "id", "left_semi"))
            discard(met)
            met = undecided
            continue
        placed = attach(undecided, scopes, ["scope"], total=left)
        head = placed.where("chunk <= last").select(*cols(undecided.columns)).repartition(spread, "scope")
        decided = cut(head.groupBy("scope").applyInPandas(_cluster_indexed(checks, index), kept))
        found.append(decided.where("low <> id").select("low", F.col("id").alias("high"), "score"))
        if not behind:
            break
        tiles = F.ceil(F.col("behind") / INDEX_TILE)
        members = placed.where("chunk > last").withColumn("tile", F.pmod(F.xxhash64("id"), tiles)).select(*cols(undecided.columns), "tile").repartition(spread, "scope", "tile")
        leading = attach(decided.where("low = id").select("scope", "id", *cols(shown)), scopes.where("behind > 0"), ["scope"], total=left)
        leaders = leading.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))).select("scope", "id", *cols(shown), "tile").repartition(spread, "scope", "tile")
        past, met = met, cut(members.groupBy("scope", "tile").cogroup(leaders.groupBy("scope", "tile")).applyInPandas(_meet_indexed(checks, index), kept))
        found.append(cut(met.where("low IS NOT NULL").select("low", F.col("id").alias("high"), "score")))
        before, undecided = left, met.where("low IS NULL").select(*cols(undecided.columns))
        discard(past)
    return union_all(found) if found else none


def _sharing(vertices: DataFrame, first: str, index: Index, spread: int) -> DataFrame:
    """Ids of the vertices that share an index entry with another."""
    # A short text has many entries: texts are dealt out before, and entries meet in one shuffle.
    every = _variants(vertices.repartition(spread, "id"), first, index).select("id", F.least("own", "meets").alias("pair"))
    alike = Window.partitionBy("pair")
    several = every.withColumns({"a": F.min("id").over(alike), "b": F.max("id").over(alike)}).where("a <> b")
    return several.select("id").distinct()


def _passing(checks: dict[str, tuple[str, float]], leader: list[str], text: list[str]) -> float | None:
    """The lowest score of a leader and another text, if every check is passed."""
    values = []
    for (algorithm, threshold), a, b in zip(checks.values(), leader, text):
        if algorithm == "difflib" and ratio(a, b) < threshold - 1e-9:
            return None   # matching blocks are a common subsequence
        values.append(SCORERS[algorithm](a, b))
        if values[-1] < threshold:
            return None
    return min(values)


def _cluster_indexed(checks: dict[str, tuple[str, float]], index: Index):
    """Greedy clusters of the heads of one scope in the order of ids; a leader meets the rows that share an entry with it."""
    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        texts = list(zip(*[frame[c].tolist() for c in checks]))
        ids, low, score = frame["id"].to_numpy(), frame["id"].to_numpy().copy(), np.full(len(frame), 100.0)
        firsts = [t[0] for t in texts]
        blocks = list(index.keys(firsts, index.kinds(firsts)))
        own, rows = gathered(blocks, 1)
        meets, others = gathered(blocks, 2)
        start, stop = np.searchsorted(meets, own, "left"), np.searchsorted(meets, own, "right")
        some = np.flatnonzero(stop > start)
        some = some[np.argsort(rows[some], kind="stable")]
        start, stop = start[some], stop[some]
        first = np.searchsorted(rows[some], np.arange(len(texts) + 1)).tolist()
        alive = np.ones(len(texts), bool)
        for k in range(len(texts)):
            if alive[k] and first[k] < first[k + 1]:
                near = np.concatenate([others[start[e]:stop[e]] for e in range(first[k], first[k + 1])])
                for other in np.unique(near[(near > k) & alive[near]]).tolist():
                    value = _passing(checks, texts[k], texts[other])
                    if value is not None:
                        alive[other], low[other], score[other] = False, ids[k], value
        return frame.assign(low=low, score=score)[["scope", "chunk", "id", *checks, "low", "score"]]
    return cluster


def _meet_indexed(checks: dict[str, tuple[str, float]], index: Index):
    """The members of a tile with the first leader each resembles, if any."""
    def meet(members: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("id", ignore_index=True)
        texts, leading = (list(zip(*[frame[c].tolist() for c in checks])) for frame in (members, leaders))
        firsts, leads = [t[0] for t in texts], [t[0] for t in leading]
        kinds, met = index.kinds(firsts), index.kinds(leads)
        lookup = Lookup(*gathered(list(index.keys(leads, met, set(kinds))), 1))
        partners = set(met)
        ids = leaders["id"].tolist()
        low, score = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
        for at in range(0, len(texts), MEETING):
            blocks = [lookup.near(b[0], b[2]) for b in index.keys(firsts[at:at + MEETING], kinds[at:at + MEETING], partners)]
            done = -1
            for number, leader in (p for pairs in lookup.pairs(blocks) for p in zip(*(x.tolist() for x in pairs))):
                if number != done:
                    value = _passing(checks, leading[leader], texts[at + number])
                    if value is not None:
                        done, low[at + number], score[at + number] = number, ids[leader], value
        found = ~np.isnan(score)
        return members.assign(low=pd.Series(low, members.index, "Int64").where(found), score=score)[["scope", "chunk", "id", *checks, "low", "score"]]
    return meet


def _joined(vertices: DataFrame, checks: dict[str, tuple[str, float]], heads: int) -> DataFrame:
    """``leader_pairs`` by blocks of shared tokens."""
    first, (algorithm, threshold) = next(iter(checks.items()))
    vertices = cut(vertices)
    entries = cut(_rare_tokens(vertices, first, algorithm, threshold).distinct())
    sizes = entries.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    # A vertex alone in all its blocks resembles nobody.
    entries = attach(entries, sizes.where("rows > 1"), ["block"], total=entries.count())
    marks = vertices.select("id", F.char_length(first).alias("length"), _sketch(col(first)).alias("sketch"))
    entries = cut(entries.join(marks, "id"))
    undecided = cut(entries.select("id").distinct())
    found: list[DataFrame] = []
    while not undecided.isEmpty():
        leaders, covered, met, head = _decide(entries, undecided, vertices, checks, heads)
        # Heads have met already; new leaders still meet the members behind them.
        among = met.join(leaders.withColumnRenamed("id", "low"), "low", "left_semi").select("low", "high", "score")
        behind = entries.join(head.select("block", "id"), ["block", "id"], "left_anti")
        matches = cut(among.unionByName(_meet_members(entries, behind, leaders, vertices, checks)))
        found.append(matches)
        settled = leaders.select("id").unionByName(covered).unionByName(matches.select(F.col("high").alias("id")))
        undecided = cut(undecided.join(settled.distinct(), "id", "left_anti"))
    if not found:
        return vertices.sparkSession.createDataFrame([], "low bigint, high bigint, score double")
    best = union_all(found).groupBy("high").agg(F.min(F.struct("low", "score")).alias("m"))
    return best.select("m.low", "high", "m.score")


def _decide(entries: DataFrame, undecided: DataFrame, vertices: DataFrame, checks, heads: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Leaders and covered vertices that the heads of all blocks determine, the heads' matches, and the heads."""
    algorithm, threshold = next(iter(checks.values()))
    waiting = entries.join(undecided, "id", "left_semi")
    order = Window.partitionBy("block").orderBy("id")
    head = cut(waiting.withColumn("n", F.row_number().over(order)).where(F.col("n") <= heads).select("block", "id", "length", "sketch"))
    seen = head.groupBy("id").agg(F.count(F.lit(1)).alias("seen"))
    all_blocks = waiting.groupBy("id").agg(F.count(F.lit(1)).alias("blocks"))
    visible = cut(all_blocks.join(seen, "id").where("seen = blocks").select("id"))
    other = head.select("block", F.col("id").alias("high"), F.col("length").alias("r_length"), F.col("sketch").alias("r_sketch"))
    low = head.select("block", F.col("id").alias("low"), F.col("length").alias("l_length"), F.col("sketch").alias("l_sketch"))
    pairs = low.join(other, "block").where(F.col("low") < F.col("high")).where(_may_match(algorithm, threshold, "l_", "r_")).select("low", "high").distinct()
    met = cut(_scored(pairs, vertices, checks))
    edges = met.select("low", "high")
    # A visible vertex without a smaller living neighbour leads; its neighbours are covered and
    # no longer hold anybody back.
    fates = undecided.where("false").withColumn("leads", F.lit(True))
    while True:
        leaders = visible.join(edges.select(F.col("high").alias("id")), "id", "left_anti")
        gone = edges.join(leaders.withColumnRenamed("id", "low"), "low", "left_semi").select(F.col("high").alias("id")).distinct()
        settled = cut(leaders.withColumn("leads", F.lit(True)).unionByName(gone.withColumn("leads", F.lit(False))))
        if settled.isEmpty():
            return fates.where("leads").select("id"), fates.where("NOT leads").select("id"), met, head
        fates = fates.unionByName(settled)
        ids = settled.select("id")
        edges = cut(edges.join(ids.withColumnRenamed("id", "low"), "low", "left_anti").join(ids.withColumnRenamed("id", "high"), "high", "left_anti"))
        visible = cut(visible.join(ids, "id", "left_anti"))


def _meet_members(entries: DataFrame, members: DataFrame, leaders: DataFrame, vertices: DataFrame, checks) -> DataFrame:
    """Leaders scored against the later members of their blocks."""
    algorithm, threshold = next(iter(checks.values()))
    leading = entries.join(leaders, "id", "left_semi").select("block", F.col("id").alias("low"), F.col("length").alias("l_length"), F.col("sketch").alias("l_sketch"))
    members = members.select("block", F.col("id").alias("high"), F.col("length").alias("r_length"), F.col("sketch").alias("r_sketch"))
    # Both sides are plain tables, so adaptive execution splits a frequent block.
    pairs = members.join(leading, "block").where("low < high").where(_may_match(algorithm, threshold, "l_", "r_")).select("low", "high").distinct()
    return _scored(pairs, vertices, checks)


def fuzzy_groups(df: DataFrame, column: str, threshold: float = 85.0, algorithm: str = "ratio",
                 within: list[str] | None = None, sort_words: bool = False, heads: int = HEADS) -> DataFrame:
    """Membership ``(group_id, _row_id, is_leader, score)`` of groups with two rows or more.

    ``score`` compares a row with its leader. ``within`` columns must be equal and present
    (the exact part of a combined match). Rows whose normal form is empty stay out.
    """
    return fuzzy_groups_on(df, {column: (algorithm, threshold)}, within, {column} if sort_words else set(), heads)


def fuzzy_groups_on(df: DataFrame, checks: dict[str, tuple[str, float]], within: list[str] | None = None,
                    sort_words: set[str] = frozenset(), heads: int = HEADS) -> DataFrame:
    """As ``fuzzy_groups`` over several text columns, all of which must reach their thresholds."""
    unknown = [a for a, _ in checks.values() if a not in SCORERS]
    if unknown:
        raise ValueError(f"unknown algorithm {unknown[0]}")
    keys = within or []
    inside = F.struct(*[col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.na.drop("all", subset=[quoted(n) for n in keys]) if keys else df
    rows = rows.select(F.col(ROW_ID), inside.alias("within"), *[as_text(df, c).alias(f"t_{c}") for c in checks])
    # Texts are few bytes and much work: they are spread by number, and written before a filter would make each form again.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ROW_ID, *cols([f"t_{c}" for c in checks]))
    form = lambda c: _word_order(text.normal_form(col(f"t_{c}"))) if c in sort_words else text.normal_form(col(f"t_{c}"))
    rows = cut(rows.select(ROW_ID, "within", *[form(c).alias(f"t_{c}") for c in checks]))
    for c in checks:
        rows = rows.where(col(f"t_{c}") != "")
    forms = ["within", *[f"t_{c}" for c in checks]]
    sized = rows.groupBy(*cols(forms)).agg(F.min(ROW_ID).alias("id"), F.count(F.lit(1)).alias("rows"))
    sized = cut(sized)
    pairs = leader_pairs(sized.drop("rows"), {f"t_{c}": check for c, check in checks.items()}, heads)
    # Vertex -> leader, then every row through its normal form.
    owner = sized.join(pairs.withColumnRenamed("high", "id"), "id", "left").select(
        *cols(forms), "rows", F.coalesce("low", "id").alias("group_id"), F.coalesce("score", F.lit(100.0)).alias("score"))
    total = rows.count()
    members = attach(rows, owner, forms, total=total).select("group_id", ROW_ID, (F.col(ROW_ID) == F.col("group_id")).alias("is_leader"), "score")
    large = owner.groupBy("group_id").agg(F.sum("rows").alias("rows")).where("rows > 1")
    return attach(members, large, ["group_id"], total=total).select("group_id", ROW_ID, "is_leader", "score")


def _word_order(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def group_scores(membership: DataFrame) -> DataFrame:
    """``(group_id, rows, score)``: the score of a group compares its leader with its second row."""
    others = membership.where("not is_leader").groupBy("group_id").agg(F.min(F.struct(ROW_ID, "score")).alias("second"))
    sizes = membership.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.join(others, "group_id").select("group_id", "rows", F.col("second.score").alias("score"))


def repeated_or_similar(df: DataFrame, column: str, threshold: float = 85.0) -> DataFrame:
    """Values held by several rows, and groups of similar values among the rest.

    ``(column, kind, group_id, value, rows)``; placeholders are left out.
    """
    counts = df.where(text.meaningful(col(column))).groupBy(column).agg(F.count(F.lit(1)).alias("rows"), F.min(ROW_ID).alias(ROW_ID))
    repeated = counts.where("rows > 1").select(F.lit(column).alias("column"), F.lit("repeated").alias("kind"), F.col(ROW_ID).alias("group_id"), col(column).alias("value"), "rows")
    single = counts.where("rows = 1").select(ROW_ID, column)
    groups = fuzzy_groups(single, column, threshold)
    similar = groups.join(single, ROW_ID).select(F.lit(column).alias("column"), F.lit("similar").alias("kind"), "group_id", col(column).alias("value"), F.lit(1).cast("bigint").alias("rows"))
    return repeated.unionByName(similar)


def score_pairs(pairs: DataFrame, left: str, right: str, algorithms: list[str] | None = None) -> DataFrame:
    """Adds one score column per algorithm for two text columns; each distinct pair is scored once."""
    names = algorithms or list(SCORERS)
    distinct = pairs.groupBy(left, right).agg(F.count(F.lit(1)).alias("rows"))
    a, b = text.normal_form(col(left)), text.normal_form(col(right))
    return distinct.withColumns({name: score(name, a, b) for name in names})
