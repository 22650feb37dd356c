"""Score bands and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _ladder(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    (first, label), *others = steps
    out = F.when(value >= first, label)
    for bound, name in others:
        out = out.when(value >= bound, name)
    return out.otherwise(rest)


def rating(score: Column) -> Column:
    return _ladder(score, [(0.95, "Strong"), (0.85, "Moderate"), (0.70, "Needs Attention")], "Critical")


def risk(score: Column) -> Column:
    return _ladder(score, [(0.95, "Low"), (0.80, "Medium")], "High")


def threshold(score: Column) -> Column:
    return F.when(score.isNull(), "Unscored").otherwise(_ladder(score, [(0.95, "High"), (0.70, "Medium")], "Low"))


def fill_status(rate: Column, is_key: Column) -> Column:
    """A recommended column with fill below 95% is watched rather than accepted."""
    return (
        F.when(rate >= 0.999, "Complete").when(rate <= 0, "Empty").when(rate < 0.5, "Critical")
        .when(rate < 0.9, "Low").when((rate < 0.95) & is_key, "Watch").otherwise("Acceptable")
    )


def fill_bucket(rate: Column) -> Column:
    return (
        F.when(rate >= 1.0, "Complete (100%)").when(rate >= 0.95, "Acceptable (95-99%)")
        .when(rate >= 0.5, "Low (50-94%)").when(rate > 0, "Critical (<50%)").otherwise("Empty (0%)")
    )
