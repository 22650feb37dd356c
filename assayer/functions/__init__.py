"""Column expressions: text shape, score bands, format registry, similarity."""
