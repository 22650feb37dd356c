"""Merkle manifest of a dataset, built by self-joins of siblings, in DataFrame operations alone.

Every row is a leaf. The leaves of one source form a tree in the order of their ids: up to
``fan`` neighbouring nodes are a run, and a run's nodes hash to the node above, until one is left,
the source's subroot. The subroots form one more tree, whose last node is the dataset's root.

1. Leaves are hashed where their text is read; only digests and keys move on. A global sort
   numbers them inside of their source: the rows of each task are counted, and prefix sums of the
   counts give the number of the task's first row. No task holds a source.
2. On every level each node asks for the places of its run: the place with the lowest bit flipped
   where ``fan`` is two, else the slots at all offsets from its own. The places are joined with
   the nodes of the level, and each node has its siblings on both sides.
3. The nodes in slot zero emit the parents.
4. From the root down each node takes its parent's path and puts its own siblings before it, so
   every leaf ends up with its proof, and can be folded to a root with any digest in its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import cut

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def spelled(value: Column) -> Column:
    """A digest, or several in a row, as lowercase hex text."""
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place 0, 1, ... inside their ``tree`` by ``order``, and ``size``, the tree's rows.

    Rows that ``order`` does not tell apart are dealt by where they were read, so that one key
    does not have to fit a task.
    """
    by = ["tree", *order, "_read"]
    lined = cut(rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
                .withColumn("_line", F.monotonically_increasing_id()).drop("_read")).withColumn("_task", F.shiftright("_line", 33))
    runs = lined.groupBy("tree", "_task").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("tree").orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = runs.select("tree", "_task", (F.sum("_rows").over(earlier) - F.col("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy("tree")).alias("size"))
    return lined.join(starts, ["tree", "_task"]).withColumn("at", F.col("_line") + F.col("_shift")).drop("_line", "_task", "_shift")


def siblings(nodes: DataFrame, fan: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(tree, at, size, hash, before, after)`` of the nodes in trees of several: the digests of the run's others on both sides.

    ``keep`` are columns that each node keeps for itself.
    """
    several = nodes.where("size > 1")
    own, slot = F.col("at"), F.col("at") % fan
    if fan == 2:
        places = F.array(own, own.bitwiseXOR(F.lit(1).cast("bigint")))
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda shift: own - slot + (slot + shift) % fan)
    asked = several.select("tree", "at", "size", F.explode(F.filter(places, lambda place: place < F.col("size"))).alias("_place"))
    found = several.select(F.col("tree").alias("_tree"), F.col("at").alias("_place"), F.struct("at", "hash").alias("_node"), F.struct("hash", *keep).alias("_self"))
    met = asked.join(found.withColumnRenamed("_place", "_there"), (F.col("tree") == F.col("_tree")) & (F.col("_place") == F.col("_there")))
    run = met.groupBy("tree", "at").agg(F.first("size").alias("size"), F.first(F.when(F.col("_place") == F.col("at"), F.col("_self")), ignorenulls=True).alias("_self"),
                                       F.array_sort(F.collect_list("_node")).alias("_run"))   # at most ``fan`` digests

    def joined(side) -> Column:
        return F.aggregate(F.filter("_run", side), F.lit(bytearray()), lambda sofar, node: F.concat(sofar, node["hash"]))
    return run.select("tree", "at", "size", "_self.*", joined(lambda node: node["at"] < F.col("at")).alias("before"), joined(lambda node: node["at"] > F.col("at")).alias("after"))


@dataclass
class Forest:
    """``levels``: nodes (tree, at, size, hash) from the leaves up; ``runs``: those with siblings or in a tree of several, per level."""

    levels: list[DataFrame]
    runs: list[DataFrame]

    def roots(self) -> DataFrame:
        """``(tree, hash)``: the last node of every tree."""
        out = self.levels[0].where("size = 1").select("tree", "hash")
        for level in self.levels[1:]:
            out = out.unionByName(level.where("size = 1").select("tree", "hash"))
        return out


def grow(leaves: DataFrame, fan: int = FAN, keep: tuple[str, ...] = ()) -> Forest:
    """All trees over ``leaves`` (tree, at, size, hash and the kept columns); every level is a table of its own."""
    if fan < 2:
        raise ValueError("a run has two nodes or more")
    levels, runs = [leaves], []
    largest = leaves.agg(F.max("size")).first()[0] or 1
    while largest > 1:
        met = cut(siblings(levels[-1], fan, () if runs else keep))
        runs.append(met)
        levels.append(cut(met.where(F.col("at") % fan == 0).select(
            "tree", F.floor(F.col("at") / fan).cast("bigint").alias("at"), F.ceil(F.col("size") / fan).cast("bigint").alias("size"),
            digest(spelled(F.concat("before", "hash", "after"))).alias("hash"))))
        largest = -(-largest // fan)
    return Forest(levels, runs)


def paths(forest: Forest, above: DataFrame, fan: int = FAN, keep: tuple[str, ...] = ()) -> DataFrame:
    """The leaves with their ``path``: the siblings (before, after) from the leaf's level up.

    ``above`` has the path of every tree's root and further columns, which all of its leaves get.
    """
    given = [c for c in above.columns if c not in ("tree", "path")]
    higher = None
    for k in range(len(forest.levels) - 1, -1, -1):
        own = ["hash", *keep] if k == 0 else []
        done = forest.levels[k].where("size = 1").join(above, "tree").select("tree", "at", *own, "path", *given)
        if higher is not None:
            parents = higher.withColumnRenamed("at", "_parent").withColumnRenamed("path", "_above")
            met = forest.runs[k].withColumn("_parent", F.floor(F.col("at") / fan).cast("bigint")).join(parents, ["tree", "_parent"])
            done = done.unionByName(met.select("tree", "at", *own, F.concat(F.array(F.struct("before", "after")), F.col("_above")).alias("path"), *given))
        higher = cut(done) if k else done
    return higher


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf up and from left to right."""
    return F.sha2(spelled(F.aggregate(path, F.lit(bytearray()), lambda sofar, step: F.concat(sofar, step["before"], step["after"]))).cast("binary"), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that follows from the digest ``start`` and the siblings on a path, as hex text."""
    return F.aggregate(path, spelled(start), lambda sofar, step: F.sha2(F.concat(spelled(step["before"]), sofar, spelled(step["after"])).cast("binary"), 256))


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row per row of ``docs``.

    ``docs`` has the columns ``FIELDS``; others are not read, but for ``tampered_text`` if it is
    there: where it differs from null, the leaf is folded with that text in place of the row's
    own, and ``verified`` tells whether the root is still met. Inside a source leaves go by id
    (null first), rows with equal ids by digest; equal rows are leaves of their own. The source
    null is a source like others, and so is the empty one. An empty table gives no rows.
    """
    values = [F.col(c) for c in FIELDS]
    changed = F.when(F.col("tampered_text").isNotNull(), leaf(*values[:-1], F.col("tampered_text"))) if "tampered_text" in docs.columns else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))   # null before all others
    hashed = cut(docs.select("doc_id", tree.alias("tree"), leaf(*values).alias("hash"), changed.alias("changed")))
    leaves = cut(numbered(hashed, ["doc_id", "hash"]).select("tree", "at", "size", "hash", "doc_id", "changed"))
    forest = grow(leaves, fan, ("doc_id", "changed"))
    roots = cut(forest.roots())
    top = cut(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"]).select("tree", "at", "size", "hash", "name"))
    whole = grow(top, fan, ("name",))
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    root = whole.roots().select("tree", none.alias("path"), F.col("hash").alias("root"))
    above = cut(paths(whole, root, fan, ("name",)).select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot"), "root"))
    rows = paths(forest, above, fan, ("doc_id", "changed"))
    found = folded(F.col("path"), F.coalesce("changed", "hash"))
    return rows.select("doc_id", spelled(F.col("hash")).alias("leaf"), spelled(F.col("subroot")).alias("subroot"), spelled(F.col("root")).alias("root"),
                       proof(F.col("path")).alias("proof_sha256"), found.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
