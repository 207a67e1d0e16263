"""Scalar column expressions. Each takes and returns a Column (or renames on a DataFrame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canasta import fixed


def week_start(date: Column) -> Column:
    """Monday of the date's week."""
    return F.to_date(F.date_trunc("week", date))


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def weekday_index(date: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(date)


def weekday_name(date: Column) -> Column:
    """English day name."""
    return F.date_format(date, "EEEE")


def weekday_label(index: Column, short: bool = False) -> Column:
    """Spanish day label of a weekday index."""
    labels = fixed.WEEKDAYS_ES_SHORT if short else fixed.WEEKDAYS_ES
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index + 1)


def category_display_name(name: Column, category_id: Column) -> Column:
    """The category name, or a generic one built from the id when it is unknown."""
    return F.coalesce(
        name, F.concat(F.lit(fixed.UNKNOWN_CATEGORY_PREFIX), category_id.cast("string"))
    )


def percent_of(part: Column, total: Column, decimals: int = 2) -> Column:
    share = F.try_divide(part.cast("double"), total.cast("double"))
    return F.round(share * F.lit(100.0), decimals)


def num_rows(counted: str | None = None) -> Column:
    """Aggregate: the rows, or the sum of ``counted`` where a row stands for several."""
    return F.sum(counted) if counted else F.count(F.lit(1))


def segment_label(frequency: Column, units: Column, diversity: Column) -> Column:
    """Descriptive label of a client or of a segment centroid; the first match wins."""
    return (
        F.when((frequency <= 4) & (units <= 25), fixed.SPORADIC)
        .when((frequency <= 10) & (units <= 80), fixed.OCCASIONAL)
        .when((diversity >= 40) & (units >= 200), fixed.DIVERSIFIED)
        .when(units >= 300, fixed.VIP)
        .otherwise(fixed.REGULAR)
    )


def lift_band(lift: Column) -> Column:
    """Name of the highest band whose lower bound the lift reaches."""
    band = F.lit(f"<{fixed.LIFT_BANDS[-1]:g}")
    for bound in sorted(fixed.LIFT_BANDS):
        band = F.when(lift >= bound, f">={bound:g}").otherwise(band)
    return band


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; false for null, NaN and the infinities."""
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def _sanitized(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(is_finite(value), value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _sanitized(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_sanitized(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def sanitize_floats(df: DataFrame) -> DataFrame:
    """Null in place of NaN and infinities, also inside arrays and structs."""
    return df.select(
        *[_sanitized(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def iso_dates(df: DataFrame) -> DataFrame:
    """Date columns as ISO text, the form used in the JSON marts."""
    dates = {
        f.name: F.date_format(F.col(f.name), fixed.DATE_PATTERN)
        for f in df.schema.fields
        if isinstance(f.dataType, T.DateType)
    }
    return df.withColumns(dates) if dates else df
