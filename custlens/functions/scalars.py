"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour days from ``earlier`` to ``later``, rounded down (not calendar days)."""
    gap = later - earlier
    days = F.extract(F.lit("DAY"), gap)
    return (days - (gap < F.make_dt_interval(days)).cast("int")).cast("long")


def parsed_timestamp(text: Column, strict: bool = False) -> Column:
    """String to timestamp; unreadable text becomes null, or fails the query when ``strict``."""
    return text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")


def finite(value: Column) -> Column:
    """The value, with NaN and both infinities turned into null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def finite_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value.cast("double")), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` in double precision; null when ``whole`` is zero or null."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def columns_of(df, numeric: bool) -> list[str]:
    """Names of the numeric or of the string columns, in schema order."""
    from pyspark.sql.types import NumericType, StringType

    wanted = NumericType if numeric else StringType
    return [field.name for field in df.schema if isinstance(field.dataType, wanted)]
