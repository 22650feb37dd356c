"""Column names with dots, blanks and backticks."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import cleanse, compare, correlation, crossfield, dedup, drift, fuzzy, golden, profile, rules
from assayer.operators.cleanse import Step
from assayer.operators.rules import Rule

NUMBER, TEXT, OTHER = "S.No", "full name", "odd`one"


@pytest.fixture
def frame(spark):
    rows = [(0, 1, "Ann Lee", 2.0), (1, 1, "Ann Lee", 2.0), (2, 2, "Bob", None), (3, 3, None, 4.0), (4, 3, "bob ", 8.0)]
    return spark.createDataFrame(rows, ["_row_id", NUMBER, TEXT, OTHER])


def test_profile(frame):
    found = {r["column"]: r for r in profile.profile(frame).collect()}
    assert set(found) == {NUMBER, TEXT, OTHER}
    assert found[NUMBER]["distinct_count"] == 3 and found[TEXT]["null_count"] == 1 and found[OTHER]["max_number"] == 8


def test_rules(frame):
    made = [Rule("not_blank", TEXT, rule_id=1), Rule("unique", NUMBER, rule_id=2), Rule("range", OTHER, params={"low": 0, "high": 5}, rule_id=3), crossfield.composite_unique(NUMBER, TEXT, OTHER, rule_id=4)]
    assert {r["rule_id"]: r["issues"] for r in rules.evaluate(frame, made).collect()} == {1: 1, 2: 4, 3: 1, 4: 2}
    assert [r["_row_id"] for r in rules.failing_rows(frame, made[3]).orderBy("_row_id").collect()] == [0, 1]
    kept, gone = crossfield.fix(frame, made[3], "deduplicate", "2024-01-01")
    assert kept.count() == 4 and gone.count() == 1


def test_cleansing(frame):
    clean, rejected = cleanse.apply(frame, [Step(TEXT, "Case", case="UPPERCASE"), Step(TEXT, "Validate", pattern="^[A-Z ]+$")], "2024-01-01")
    assert clean.where(F.col(f"`{TEXT}`") == "ANN LEE").count() == 2 and clean.count() + rejected.count() == 5


def test_duplicates_and_golden_records(frame):
    groups = dedup.exact_groups(frame, [NUMBER, TEXT])
    members = dedup.members(frame, groups, [NUMBER, TEXT])
    assert sorted(r["_row_id"] for r in members.collect()) == [0, 1]
    assert fuzzy.fuzzy_groups(frame, TEXT, 85.0, within=[]).count() == 4
    assert golden.golden_records(frame, members, "field_level_merge", priority=["most_complete"]).count() == 1
    assert dedup.remove_exact(frame, [NUMBER]).count() == 3


def test_compare_drift_and_correlation(frame):
    after = frame.withColumn(TEXT, F.upper(F.col(f"`{TEXT}`")))
    changed = {r["column"]: r["changed"] for r in compare.column_changes(frame, after).collect()}
    assert changed[TEXT] == 4 and not changed.get(NUMBER)
    assert drift.baseline(frame).count() == 3
    assert [(r["column_a"], r["column_b"]) for r in correlation.pearson(frame).collect()] == [(NUMBER, OTHER)]


def test_every_public_reader_of_columns_takes_such_names(spark, frame, tmp_path):
    """Functions that take a table and columns, over names with a dot, a blank and a backtick."""
    from assayer.functions.formats import Glossary
    from assayer.operators import digests, select
    from assayer.operators import values
    from assayer.plans import dashboard, reports, scorecard
    from assayer.sources import writers
    from assayer.sources.search import SearchStore
    from assayer.sources.stores import TableStore
    from assayer.sources.versions import VersionStore

    names, glossary = [NUMBER, TEXT, OTHER], Glossary({TEXT: {"semantic_type": "free_text_name", "recommended": True}, NUMBER: {"semantic_type": "numeric_id", "recommended": True}})
    profiled = profile.profile(frame)
    made = {
        "characters": profile.character_frequency(frame), "symbols": profile.special_characters(frame), "samples": profile.sample_values(frame), "outliers": profile.outliers(frame),
        "evidence": profile.evidence(frame), "report": profile.quality_report(frame, profiled), "table": dashboard.profile_table(frame, profiled), "cards": dashboard.column_cards(frame, profiled, 5),
        "fields": dashboard.field_scores(frame, glossary), "case": reports.case_patterns(frame, glossary), "off": reports.off_pattern_samples(frame, reports.case_patterns(frame, glossary)),
        "spellings": reports.spelling_variants(frame, TEXT), "whitespace": reports.whitespace(frame, glossary), "shared": reports.shared_identifiers(frame, [NUMBER, TEXT]),
        "composite": reports.composite_duplicates(frame, [NUMBER, TEXT]), "top": reports.top_duplicates(frame, [NUMBER]), "uniqueness": reports.uniqueness_summary(frame, glossary),
        "score": scorecard.uniqueness(frame, glossary), "rates": scorecard.identifier_rates(frame, [NUMBER]), "counts": scorecard.field_counts(frame, glossary),
        "repetition": digests.repetition(frame, [(names, "none")]), "values": values.value_counts(frame, names), "smallest": values.smallest_values(frame, names, 3), "repeated": values.repeated_value_groups(frame, names, 5),
        "scoped": select.scoped(frame, [TEXT]), "search": select.search(frame, "bob"), "spearman": correlation.spearman(frame), "stats": compare.stats(frame, frame), "cells": compare.cell_diff(frame, frame, names, 0, 3),
        "similar": fuzzy.repeated_or_similar(frame, TEXT), "low": fuzzy.fuzzy_groups(frame, TEXT, 60.0), "drift": drift.detect(drift.baseline(frame), drift.baseline(frame)),
    }
    rows = {k: df.count() for k, df in made.items()}
    assert rows["scoped"] == 5 and rows["search"] == 2 and rows["cells"] == 9 and rows["smallest"] == 9 and rows["samples"] == 9
    writers.write_batches(frame, f"{tmp_path}/b", 2, [TEXT, OTHER])
    TableStore(spark, f"{tmp_path}/t").save("x", frame)
    store = SearchStore(spark, f"{tmp_path}/s", block=2)
    store.save("x", frame)
    assert store.search("x", "lee").count() == 2
    versions = VersionStore(spark, f"{tmp_path}/v")
    versions.start(frame)
    versions.apply(lambda df: cleanse.apply(df, [Step(TEXT, "Case", case="UPPERCASE")], "2024-01-01"), "upper")
    assert versions.working().where(F.col(f"`{TEXT}`") == "BOB").count() == 1
