"""Bands, years and null rules as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turmalina.functions import fixed_values as fv


def enrolment_band(c: Column) -> Column:
    """Demand band; the edges belong to the lower band."""
    return (F.when(c <= fv.BAND_LOW_MAX, fv.BAND_LOW)
            .when(c <= fv.BAND_MID_MAX, fv.BAND_MID)
            .when(c.isNotNull(), fv.BAND_HIGH))


def age_band(c: Column) -> Column:
    """Age band; a missing age counts as the youngest."""
    chain = F.when(c.isNull(), fv.AGE_BANDS[0][1])
    for top, label in fv.AGE_BANDS:
        chain = chain.when(c <= top, label)
    return chain.when(c >= fv.AGE_BAND_OPEN[0], fv.AGE_BAND_OPEN[1]).otherwise(fv.AGE_BAND_NONE)


def lagged_year(c: Column, years) -> Column:
    """The year after, for the listed years; null for others."""
    return F.when(c.isin(list(years)), c + 1)


def recode_year(c: Column, mapping: dict) -> Column:
    chain = F
    for old, new in mapping.items():
        chain = chain.when(c == old, F.lit(new))
    return chain.otherwise(c)


def day_first_year(c: Column) -> Column:
    """Year of a day-first (or ISO) date text, time part ignored; null where it is no date."""
    day = F.substring_index(F.substring_index(F.btrim(c), " ", 1), "T", 1)
    return F.year(F.coalesce(F.try_to_timestamp(day, F.lit("d/M/yyyy")),
                             F.try_to_timestamp(day, F.lit("yyyy-M-d"))))


def dependency(c: Column) -> Column:
    """Administrative dependency of a school: private or public."""
    return F.when(c == fv.CENSUS_PRIVATE_CODE, fv.CENSUS_PRIVATE).otherwise(fv.CENSUS_PUBLIC)


def sum0(c) -> Column:
    """Sum where a group of only nulls gives 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def on_groups(count: Column, condition: Column) -> Column:
    """A condition to be checked once per group of an aggregation.

    A condition on grouping columns alone would be moved below the aggregation and run on
    every raw row, text functions included; one that reads the group's count stays above.
    """
    return F.when(count > 0, condition)


def fill_numeric(df):
    """0 for every missing numeric value (NaN included)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numeric) if numeric else df


def finite(vector: Column) -> Column:
    """NaN in a probability vector counts as 0."""
    return F.transform(vector, lambda p: F.nanvl(p, F.lit(0.0)))
