"""Last-row and first-row operators.

A group is settled by its last year first, a fixed-width number that Spark aggregates in hash
tables on the map side; a hash join on the keys then finds the rows of that year, so the rows are
not sorted, and a group that holds a large part of them is split like any other skewed join.
Only where the order goes on with names are the rows of the last year compared by them.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def _order(columns):
    return F.struct(*[F.col(c) for c in columns])


def _rows_at(df, keys, column):
    """The rows whose ``column`` is the greatest of their group."""
    top = df.groupBy(*keys).agg(F.max(column).alias(column)).hint("shuffle_hash")
    same = F.lit(True)
    for k in [*keys, column]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("l").join(top.alias("r"), same, "left_semi")


def latest_per(df, keys, order):
    """Last row of each group under a total order: no two rows of a group are equal in it."""
    rest = [c for c in order if c not in keys]
    while rest and isinstance(df.schema[rest[0]].dataType, T.NumericType):
        df = _rows_at(df, keys, rest.pop(0))
    if not rest:
        return df
    kept = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*kept), _order(rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}") for c in kept]) \
        .select(*df.columns)


def latest_numbers_per(df, keys, columns, year="ANO"):
    """The last year of each group and the numbers of that year's row, in one hash aggregation; a
    group has one row a year."""
    return df.groupBy(*keys).agg(F.max(year).alias(year), *[F.max_by(c, year).alias(c) for c in columns])


def latest_values_per(df, keys, order):
    """Last non-null value of every column of each group."""
    kept = [c for c in df.columns if c not in keys]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), _order(order))).alias(c) for c in kept]
    return df.groupBy(*keys).agg(*last).select(*df.columns)


def rows_at_latest_year(df, keys, year="ANO"):
    """Every row of a group's latest year."""
    # The right side holds one row per group, so a hot group is split on the left only.
    top = df.groupBy(*keys).agg(F.max(year).alias(year))
    return df.join(top, [*keys, year], "left_semi")


def appearance(df, column, order):
    """First position of each value in the dataset order, as a comparable struct."""
    return df.groupBy(column).agg(F.min(_order(order)).alias("APARECIMENTO"))


def first_value_per(df, keys, value, rank):
    """First non-null value of each group by rank."""
    ranked = F.when(F.col(value).isNotNull(), F.col(rank))
    return df.groupBy(*keys).agg(F.min_by(value, ranked).alias(value))


def choices(df, column):
    """Sorted distinct values."""
    return df.select(column).distinct().orderBy(column)
