"""Table operators: profile, rules, cleansing, duplicates, compare, drift."""
