"""Undefined-value rules: undefined is NULL, never NaN and never a guess."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Significant digits kept when doubles are compared for ordering. Sums of doubles
#: depend on the order of addition in their last bits; ranking on the rounded value
#: makes the order the same under every partitioning, however small the values are.
ORDER_DIGITS = 12

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` worked out once, however often ``build`` names it.

    A column named in several branches is otherwise worked out anew in each.
    """
    return F.get(F.transform(F.array(value), build), 0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; NULL unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def ratio_nonzero(numerator: Column, denominator: Column) -> Column:
    """As :func:`ratio`, but any non-zero denominator counts."""
    return F.when(denominator != 0, numerator / denominator)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def total(value: Column) -> Column:
    """Sum that skips NULL and is 0.0 for an empty or all-NULL group."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def finite(value: Column) -> Column:
    """NaN and the infinities become NULL."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~F.isnan(value) & ~infinite, value)


def coerce_double(value: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    text = value.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def stable(value: Column) -> Column:
    """The value doubles are ordered by: ``ORDER_DIGITS`` significant digits of it."""
    x = value.cast("double")
    size = F.abs(x)
    scale = F.pow(F.lit(10.0), F.least(ORDER_DIGITS - 1 - F.floor(F.log10(size)), F.lit(300)))
    ordinary = (size > 0) & (size < F.lit(float("inf"))) & ~F.isnan(x)
    return F.when(ordinary, F.rint(x * scale) / scale).otherwise(x)


def null_out_nonfinite(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every float column, also inside arrays and structs."""
    return df.select(
        [_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def _clean(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value)
    if isinstance(kind, T.ArrayType) and _has_float(kind):
        return F.transform(value, lambda item: _clean(item, kind.elementType))
    if isinstance(kind, T.MapType) and _has_float(kind):
        return F.transform_values(value, lambda _, item: _clean(item, kind.valueType))
    if isinstance(kind, T.StructType) and _has_float(kind):
        fields = [_clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_float(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))
