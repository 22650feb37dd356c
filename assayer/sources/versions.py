"""Versions of a working table, merged when they are read.

A step stores what it changed: the changed cells by row id, new rows, and the ids of rows that are
gone. Reading takes the newest full copy on the way back to the original and lays the steps after
it over its rows. A full copy is written for the original, where a step changes the table's
columns, and after ``COMPACT_AFTER`` steps, so that reading never merges more than that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer import ROW_ID
from assayer.schema import OTHER, col, cols, data_columns, families

COMPACT_AFTER = 16
BEFORE = "_before_step"     # struct of a row's values before a step; travels with the row through the step


def _names(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if c != BEFORE]


def _shape(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, df.schema[c].dataType.simpleString()) for c in _names(df)]


def _old(name: str) -> Column:
    return F.col(BEFORE).getField(name)


def _same(kind: str, old: Column, new: Column) -> Column:
    """Values of a type without an order are compared by their JSON text."""
    return F.to_json(F.struct(old.alias("v"))).eqNullSafe(F.to_json(F.struct(new.alias("v")))) if kind == OTHER else old.eqNullSafe(new)


def changes(before: DataFrame, carried: DataFrame) -> DataFrame:
    """What a step changed: ``(_row_id, gone, changed, cells)``.

    ``carried`` are the rows after the step, each with its old values in ``BEFORE`` (null for a new
    row). ``changed`` numbers the changed columns, and ``cells`` holds their new values and null
    for all others. Rows that ``carried`` lacks are gone; ids alone are shuffled to find them.
    """
    names, kinds = _names(carried), families(carried)
    number = lambda i, c: F.when(F.col(BEFORE).isNull() | ~_same(kinds[c], _old(c), col(c)), F.lit(i))
    marked = carried.withColumn("_changed", F.array_compact(F.array(*[number(i, c) for i, c in enumerate(names)]).cast("array<int>")))
    edited = marked.where((F.size("_changed") > 0) | F.col(BEFORE).isNull()).select(ROW_ID, F.lit(False).alias("gone"), F.col("_changed").alias("changed"), F.struct(*[
        F.when(F.array_contains("_changed", i), col(c)).alias(c) for i, c in enumerate(names)]).alias("cells"))
    gone = before.select(ROW_ID).join(carried.select(ROW_ID), ROW_ID, "left_anti").select(
        ROW_ID, F.lit(True).alias("gone"), F.array().cast("array<int>").alias("changed"), F.lit(None).cast(edited.schema["cells"].dataType).alias("cells"))
    return edited.unionByName(gone)


def merged(base: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``base`` with the changes of ``steps``, oldest first, laid over it.

    The newest value of a cell counts; a row that is gone and comes back later is a new row.
    """
    if not steps:
        return base
    names = data_columns(base)
    listed = steps[0].withColumn("_step", F.lit(0))
    for n, step in enumerate(steps[1:], 1):
        listed = listed.unionByName(step.withColumn("_step", F.lit(n)))
    newest = lambda i, c: F.max_by(F.struct(F.col("cells").getField(c).alias("v"), F.col("_step").alias("_step")), F.when(F.array_contains("changed", i), F.col("_step"))).alias(f"_cell{i}")
    last = listed.groupBy(ROW_ID).agg(
        F.max(F.when(F.col("gone"), F.col("_step"))).alias("_gone"), F.max(F.when(~F.col("gone"), F.col("_step"))).alias("_kept"), *[newest(i, c) for i, c in enumerate(names)])
    joined = base.withColumn("_base", F.lit(True)).join(last.withColumnRenamed(ROW_ID, "_id"), F.col(ROW_ID) == F.col("_id"), "full_outer")
    alive = F.col("_gone").isNull() | F.coalesce(F.col("_kept") > F.col("_gone"), F.lit(False))
    # Cells older than a deletion belong to the row that is gone.
    fresh = lambda i: F.col(f"_cell{i}").isNotNull() & (F.col("_gone").isNull() | (F.col(f"_cell{i}._step") > F.col("_gone")))
    value = lambda i, c: F.when(fresh(i), F.col(f"_cell{i}.v")).when(F.col("_gone").isNull(), col(c))
    made = {ROW_ID: F.coalesce(F.col(ROW_ID), F.col("_id")).alias(ROW_ID)} | {c: value(i, c).alias(c) for i, c in enumerate(names)}
    return joined.where(alive).select(*[made[c] for c in base.columns])


@dataclass(frozen=True)
class VersionStore:
    """Versions of a working table with the quarantine after each step.

    Version 0 is the original and is written once. Undo and reset move to an older version by
    recording it as current again; no data is rewritten. Rows need a ``_row_id``.
    """

    spark: SparkSession
    root: str
    compact_after: int = COMPACT_AFTER

    def start(self, df: DataFrame) -> None:
        df.write.mode("errorifexists").parquet(self._full(0))
        self._record(0, 0, "original", 0)

    def original(self) -> DataFrame:
        return self.spark.read.parquet(self._full(0))

    def apply(self, transform: Callable[[DataFrame], tuple[DataFrame, DataFrame]], description: str) -> int:
        """Store the outcome of ``transform(working) -> (clean, quarantine)``; returns the step's number.

        Old values travel along as one more column, which ``transform`` must pass on as it does
        with columns that it does not know; so changes are found without a join.
        """
        before = self.working()
        clean, quarantine = transform(before.withColumn(BEFORE, F.struct(*cols(data_columns(before)))))
        if BEFORE not in clean.columns:
            return self.commit(clean, quarantine.drop(BEFORE), description)
        return self._store(before, clean, quarantine.drop(BEFORE), description)

    def commit(self, clean: DataFrame, quarantine: DataFrame, description: str) -> int:
        """Store the outcome of one cleansing step; returns its number. ``clean`` meets its old values by row id."""
        before = self.working()
        old = before.select(F.col(ROW_ID).alias("_old_id"), F.struct(*cols(data_columns(before))).alias(BEFORE))
        carried = clean.join(old, clean[ROW_ID] == old["_old_id"], "left").drop("_old_id")
        return self._store(before, carried, quarantine, description)

    def _store(self, before: DataFrame, carried: DataFrame, quarantine: DataFrame, description: str) -> int:
        # Paths carry the event number, so a step made after an undo never meets old files.
        last = self.history().orderBy(F.col("event").desc()).first()
        step, parent = last["event"] + 1, last["step"]
        if _shape(carried) != _shape(before):
            carried.drop(BEFORE).write.mode("errorifexists").parquet(self._full(step))
        else:
            changes(before, carried).write.mode("errorifexists").parquet(f"{self.root}/changes/step={step}")
        quarantine.withColumn("step", F.lit(step)).write.mode("errorifexists").parquet(f"{self.root}/quarantine/step={step}")
        self._record(step, step, description, parent)
        if len(self._laid_over(step)[1]) >= self.compact_after:
            self.compact()
        return step

    def compact(self) -> None:
        """Write the current version as a full copy; what is read stays the same."""
        step = self.current_step()
        if not self._is_full(step):
            self.working().write.mode("overwrite").parquet(self._full(step))

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/history")

    def current_step(self) -> int:
        return self.history().orderBy(F.col("event").desc()).first()["step"]

    def _chain(self, step: int | None = None) -> list[int]:
        """Steps from the given or the current one back to the original."""
        rows = {r["step"]: r["parent"] for r in self.history().where("event = step").collect()}
        chain, step = [], self.current_step() if step is None else step
        while step:
            chain.append(step)
            step = rows[step]
        return chain

    def _full(self, step: int) -> str:
        return f"{self.root}/working/step={step}"

    def _is_full(self, step: int) -> bool:
        from assayer.sources.stores import exists

        return exists(self.spark, f"{self._full(step)}/_SUCCESS")

    def _laid_over(self, step: int) -> tuple[int, list[int]]:
        """The newest full copy up to ``step`` and the steps after it, oldest first."""
        later = []
        for k in [*self._chain(step), 0]:
            if self._is_full(k):
                return k, later[::-1]
            later.append(k)
        raise FileNotFoundError(f"{self.root} has no original")

    def working(self) -> DataFrame:
        base, later = self._laid_over(self.current_step())
        return merged(self.spark.read.parquet(self._full(base)), [self.spark.read.parquet(f"{self.root}/changes/step={k}") for k in later])

    def rejected(self) -> DataFrame | None:
        paths = [f"{self.root}/quarantine/step={s}" for s in self._chain()]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def undo(self) -> bool:
        chain = self._chain()
        if not chain:
            return False
        self._move(chain[1] if len(chain) > 1 else 0, "undo")
        return True

    def reset(self) -> None:
        self._move(0, "reset")

    def _move(self, step: int, description: str) -> None:
        event = self.history().agg(F.max("event").alias("e")).first()["e"] + 1
        self._record(event, step, description, None)

    def _record(self, event: int, step: int, description: str, parent: int | None) -> None:
        row = self.spark.createDataFrame([(event, step, description, parent)], "event int, step int, description string, parent int")
        row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/history")
