"""Municipalities, territories and training units."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions.text import normalise_key, recode


def municipality_dimension(raw):
    """Municipality, its nearest training unit, and the accent-free join key."""
    return raw.select(
        F.upper("MUNICIPIO_ORIGEM").alias("MUNICIPIO"),
        F.upper("`MUNICIPIO_UO_PRÓXIMA`").alias("UNIDADE"),
    ).withColumn("MUNICIPIO_COD", normalise_key(F.col("MUNICIPIO")))


def name_territory(df, territory, code, territory_code="CO_MUN_IBGE_6"):
    """Add the territory name by code; ``code`` is dropped."""
    names = territory.select(F.col(territory_code).alias(code), "NO_MUNICIPIO")
    return df.join(names, code, "left").drop(code)


def restore_accents(df, accents=None):
    """Write municipality names with their accents."""
    return df.withColumn(
        "NO_MUNICIPIO", recode(F.col("NO_MUNICIPIO"), accents or fv.MUNICIPALITY_ACCENTS))


def attach_unit(df, municipality):
    """Add ``UNIDADE`` by the accent-free municipality name, which is dropped."""
    units = municipality.select("MUNICIPIO_COD", "UNIDADE")
    return (df.withColumn("MUNICIPIO_COD", normalise_key(F.col("NO_MUNICIPIO")))
            .join(units, "MUNICIPIO_COD", "left")
            .drop("MUNICIPIO_COD", "NO_MUNICIPIO"))


def unit_by_name(territory, municipality, accents=None):
    """``UNIDADE`` by the territory's name as written: ``attach_unit`` with the text functions run
    once per name.  A null name, which a code without territory gets, has a row too."""
    null = territory.sparkSession.range(1).select(F.lit(None).cast("string").alias("_nome"))
    names = territory.select(F.col("NO_MUNICIPIO").alias("_nome")).union(null).distinct()
    return attach_unit(restore_accents(names.withColumn("NO_MUNICIPIO", F.col("_nome")), accents), municipality)


def within_years(date_column, years):
    """Rows of the listed years; the range part can be pushed to the scan."""
    c = F.col(date_column)
    start, end = F.make_date(F.lit(min(years)), F.lit(1), F.lit(1)), \
        F.make_date(F.lit(max(years) + 1), F.lit(1), F.lit(1))
    return (c >= start) & (c < end) & F.year(c).isin(list(years))
