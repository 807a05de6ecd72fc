"""One exact text key per result row, comparable across statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _number(value: str) -> str:
    """Whole numbers as exact integer text, others as double text."""
    number = f"CAST({value} AS DOUBLE)"
    return (
        f"CASE WHEN rint({number}) = {number} AND abs({number}) < 9.2e18D "
        f"THEN concat('n', CAST({number} AS BIGINT)) ELSE concat('n', {number}) END"
    )


def _tagged(value: str, data_type: T.DataType) -> str:
    """SQL for the value as text with a type tag; NULL stays NULL."""
    if isinstance(data_type, T.NullType):
        return "CAST(NULL AS STRING)"
    if isinstance(data_type, T.BooleanType):
        return f"concat('n', CAST({value} AS INT))"
    if isinstance(data_type, T.IntegralType):
        return f"concat('n', {value})"
    if isinstance(data_type, T.DecimalType):
        # Compared in the value's own type: a common type may drop decimal places.
        whole = f"CAST({value} AS DECIMAL(38, 0))"
        again = f"try_cast({whole} AS {data_type.simpleString()})"
        return f"CASE WHEN {again} = {value} THEN concat('n', {whole}) ELSE {_number(value)} END"
    if isinstance(data_type, T.FractionalType):
        return _number(value)
    if isinstance(data_type, T.StringType):
        return f"concat('s', {value})"
    if isinstance(data_type, T.BinaryType):
        return f"concat('b', hex({value}))"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"concat('d', {value})"
    return f"CASE WHEN {value} IS NOT NULL THEN concat('j', to_json(struct({value} AS v))) END"


def row_keys(result: DataFrame) -> DataFrame:
    """``(row_key)``: the row as a JSON array of tagged texts, column order kept.

    Columns are renamed by position first, so duplicate names are no obstacle.
    """
    fields = result.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    parts = [_tagged(name, field.dataType) for name, field in zip(names, fields)]
    return result.toDF(*names).selectExpr(f"to_json(array({', '.join(parts)})) AS row_key")
