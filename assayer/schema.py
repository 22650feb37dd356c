"""Column families. Every operator branches on these and on nothing finer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer import ROW_ID



def quoted(name: str) -> str:
    """A column name as SQL reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The top-level column of that very name."""
    return F.col(quoted(name))


def cols(names) -> list[Column]:
    return [col(n) for n in names]


TEXT, NUMERIC, TEMPORAL, BOOLEAN, OTHER = "text", "numeric", "temporal", "boolean", "other"


def family(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def families(df: DataFrame) -> dict[str, str]:
    """Family of each data column, in table order; the row id is not a data column."""
    return {f.name: family(f.dataType) for f in df.schema.fields if f.name != ROW_ID}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, fam in families(df).items() if fam in wanted]


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name != ROW_ID]


def comparable(df: DataFrame, names: list[str] | None = None) -> list[str]:
    """Columns with value operators (group, count, compare); nested types have none."""
    fams = families(df)
    return [c for c in (names or list(fams)) if fams[c] != OTHER]


def as_text(df: DataFrame, name: str) -> "F.Column":
    """Readable string form of any column."""
    data_type = df.schema[name].dataType
    if family(data_type) == TEXT:
        return col(name)
    return col(name).cast("string")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the source data model; Spark keeps it apart from null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns
    ])
