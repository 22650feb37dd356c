"""Cleansing on small frames with known outcomes."""

import pytest
from pyspark.sql import functions as F

from assayer.functions.formats import FORMATS
from assayer.operators import cleanse, compare, crossfield as x
from assayer.operators.cleanse import Step
from assayer.operators.dedup import remove_exact
from assayer.operators.rules import Rule, checked_expression, evaluate, failing_rows
from assayer.plans import lifecycle

AT = "2024-01-01 00:00:00"


def ids(df):
    return sorted(r["_row_id"] for r in df.select("_row_id").collect())


def values(df, column):
    return [r[column] for r in df.orderBy("_row_id").collect()]


VENDOR = {
    "vendor_id": (["VND-00001"] * 9 + ["INVALID"], r"^VND-\d{5}$", 1),
    "vendor_name": (["Acme"] * 7 + ["", None, "  "], r"^.*\S.*$", 3),
    "gstin": (["27ABCDE1234F1Z5"] * 8 + ["BAD_GSTIN", ""], FORMATS["gstin"], 2),
    "ifsc_code": (["HDFC0001234"] * 8 + ["NOTANIFSC", "PNB0004567"], FORMATS["ifsc"], 2),
    "swift_code": (["HDFCINBB"] * 9 + ["INVALIDSWIFT"], FORMATS["swift"], 1),
    "bank_account": (["12345678901"] * 8 + ["1234", "ABC123456789"], r"^\d{8,18}$", 2),
    "email": (["a@b.co"] * 8 + ["BADEMAIL", "no@email"], r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", 2),
    "country": (["IN"] * 9 + ["INDIA"], FORMATS["iso_country"], 1),
    "created_date": (["2024-04-01"] * 9 + ["01/04/2024"], r"^\d{4}-\d{2}-\d{2}$", 1),
}


@pytest.mark.parametrize("column", VENDOR)
def test_vendor_rules(table, column):
    cells, pattern, expected = VENDOR[column]
    df = table([(c,) for c in cells], f"{column} string")
    clean, quarantine = cleanse.apply(df, [Step(column, "Validate", pattern=pattern, name=column)], AT)
    assert quarantine.count() == expected
    assert clean.count() == len(cells) - expected
    assert sorted(ids(clean) + ids(quarantine)) == list(range(len(cells)))


def test_case_then_allowed_values(table):
    df = table([("approved",), ("PENDING",), ("Archived",)], "status string")
    steps = [Step("status", "Case", case="UPPERCASE"), Step("status", "Validate", pattern="^(APPROVED|PENDING)$", name="known")]
    clean, quarantine = cleanse.apply(df, steps, AT)
    assert values(clean, "status") == ["APPROVED", "PENDING"]
    # The rejected row carries the value as changed by the first step.
    assert values(quarantine, "status") == ["ARCHIVED"]
    assert values(quarantine, "Rejection_Reason") == ["known - Does not match"]


def test_whole_doubles_match_integer_patterns(table):
    df = table([(2017.0,), (2018.0,), (2019.0,), (1850.0,), (None,)], "year double")
    step = Step("year", "Validate", pattern=r"^(19\d{2}|20\d{2})$")
    shown = cleanse.preview(df, step).orderBy("_row_id").collect()
    assert [r["before"] for r in shown] == ["2017", "2018", "2019", "1850"]
    assert [r["status"] for r in shown] == ["Valid"] * 3 + ["Rejected"]
    assert ids(cleanse.apply(df, [step], AT)[1]) == [3, 4]


@pytest.mark.parametrize("step, before, after", [
    (Step("v", "Clean", pattern="[^A-Za-z]"), ["A@B!", "C#D$", "PLAIN"], ["AB", "CD", "PLAIN"]),
    (Step("v", "Replace", pattern="_", replace=" "), ["foo_bar", "baz_qux"], ["foo bar", "baz qux"]),
    (Step("v", "Replace", pattern=r"(\w)-(\w)", replace=r"\2$\1"), ["a-b"], ["b$a"]),
    (Step("v", "Case", case="UPPERCASE"), ["india", "Usa", "uk"], ["INDIA", "USA", "UK"]),
    (Step("v", "Case", case="Title Case"), ["o'neil mc-DONALD 2nd"], ["O'Neil Mc-Donald 2Nd"]),
    (Step("v", "Extract", pattern=r"\d"), ["a1b22", "c3"], ["122", "3"]),
])
def test_transforms(table, step, before, after):
    df = table([(v,) for v in before], "v string")
    assert values(cleanse.apply(df, [step], AT)[0], "v") == after


def test_missing_values_by_mode(table):
    df = table([(None,), ("ab",), ("abcdef",)], "v string")
    kept = lambda **kw: ids(cleanse.apply(df, [Step("v", **kw)], AT)[0])
    assert kept(mode="Length", length_mode="Exact", exact_length=2) == [1]
    assert kept(mode="Length", length_mode="Minimum", min_length=3) == [0, 2]
    assert kept(mode="Length", length_mode="Maximum", max_length=3) == [0, 1]
    assert kept(mode="Validate", pattern="a") == [1, 2]
    assert kept(mode="Extract", pattern="z") == []
    numbers = table([(None,), (12.0,)], "n double")
    # A missing number reads as empty text, so a minimum length rejects it.
    assert ids(cleanse.apply(numbers, [Step("n", "Length", length_mode="Minimum", min_length=1)], AT)[0]) == [1]


def test_manual_and_disabled_steps_do_nothing(table):
    df = table([("a",)], "v string")
    steps = [Step("v", "ManualReview"), Step("v", "Validate", pattern="z", enabled=False)]
    clean, quarantine = cleanse.apply(df, steps, AT)
    assert clean.count() == 1 and quarantine.count() == 0


def test_preview_failing_has_context(table):
    df = table([("ABCDE1234F", "a", "IN"), ("BAD", "b", "IN"), ("ABCDE1234F", "c", "US"), ("NO", None, "US"), ("ABCDE1234F", "e", "IN")], "pan string, name string, country string")
    rows = cleanse.preview_failing(df, Step("pan", "Validate", pattern=FORMATS["pan"])).orderBy("_row_id").collect()
    assert [(r["pan"], r["name"], r["_status"]) for r in rows] == [("BAD", "b", "Rejected"), ("NO", "", "Rejected")]
    assert cleanse.count_failing(table([("ABC",), ("TOOLONG",), ("OK",), ("EVENLONGER",)], "v string"), Step("v", "Length", length_mode="Maximum", max_length=5)).first()["total_failing"] == 2


def test_dropped_rows_are_removals_not_edits(table):
    rows = [(f"n{i}", None if i in (3, 5, 8, 11) else f"98{i}", "x") for i in range(12)]
    before = table(rows, "name string, phone string, city string")
    after, _ = cleanse.apply(before, [Step("phone", "Validate", pattern=r".*\S")], AT)
    stats = compare.stats(before, after).first()
    assert (stats["row_change"], stats["modified_cells"]) == (-4, 0)
    cells = compare.cell_diff(before, after, ["phone"], 0, 50).collect()
    assert sorted(r["_row_id"] for r in cells if r["row_status"] == "removed") == [3, 5, 8, 11]


def test_mixed_edit_and_removal(table):
    before = table([("C1", "india"), ("C2", "US"), ("C3", "x"), ("C4", "germany"), ("C5", "UK")], "code string, country string")
    after = before.where("code != 'C3'").withColumn("country", F.upper("country"))
    changes = compare.column_changes(before, after).collect()
    assert [(r["column"], r["changed"], r["change_type"]) for r in changes] == [("country", 2, "Standardised")]


def test_compare_with_itself_is_empty(table):
    df = table([("a", 1), (None, None)], "v string, n int")
    assert compare.column_changes(df, df).count() == 0


def test_keep_first(table):
    df = table([(1, "x"), (1, "x"), (2, "y"), (2, "y"), (3, "z")], "a int, b string")
    assert ids(remove_exact(df)) == [0, 2, 4]


def test_cross_field_drop(table):
    rows = [("IN" if i % 2 else "US", None if i in (1, 3, 8 + 1) else "g", f"n{i}") for i in range(11)]
    df = table(rows, "billing_country string, gstin string, name string")
    rule = x.conditional_presence("gstin", "billing_country", ["in"])
    kept, quarantine = x.fix(df, rule, "drop", AT)
    assert ids(quarantine) == [1, 3, 9]
    first = quarantine.first()
    assert first["Rejected_Column"] == "gstin + billing_country" and first["Rejection_Reason"].startswith("Cross-field")
    assert kept.count() == 8


def test_expression_rules_are_checked(table):
    df = table([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        checked_expression(df, "a + b")
    with pytest.raises(ValueError):
        checked_expression(df, "a > (select 1)")


def test_lifecycle(table):
    df = table([("x", None, "v" if i == 0 else None, "ok" if i > 1 else "no") for i in range(10)], "filled string, empty_col string, sparse string, word string")
    rules = [
        Rule("pattern", "empty_col", params={"pattern": "a"}, rule_id=0), Rule("pattern", "sparse", params={"pattern": "v"}, rule_id=1), Rule("pattern", "nowhere", params={"pattern": "a"}, rule_id=2),
        Rule("multi_unique", columns=("filled", "word"), dimension="Uniqueness", rule_id=3), Rule("manual", "filled", "Accuracy", rule_id=4), Rule("pattern", "filled", params={"pattern": "x"}, rule_id=5), Rule("pattern", "word", params={"pattern": "ok"}, rule_id=6)]
    found = {r["rule_id"]: (r["status"], r["issues"]) for r in lifecycle.statuses(df, rules).collect()}
    assert found == {0: ("blocked_empty", 0), 1: ("blocked_incomplete", 0), 2: ("invalid", 0), 3: ("multi_cde", 0), 4: ("unmapped", 0), 5: ("passed", 0), 6: ("actionable", 2)}


def test_failing_rows_agree_with_counts(table):
    df = table([("a", 1.0), ("A", 2.55), (None, -3.0), ("", None), ("a", 1e20)], "v string, n double")
    rules = [Rule("not_blank", "v"), Rule("unique", "v"), Rule("unique_incl_null", "n"), Rule("max_decimals", "n", params={"digits": 1}), Rule("not_negative", "n"), Rule("uppercase", "v")]
    rules = [Rule(q.kind, q.column, params=q.params, rule_id=i) for i, q in enumerate(rules)]
    counts = {r["rule_id"]: r["issues"] for r in evaluate(df, rules).collect()}
    for rule in rules:
        assert failing_rows(df, rule).count() == counts[rule.rule_id]
    assert counts == {0: 2, 1: 2, 2: 0, 3: 1, 4: 1, 5: 2}
