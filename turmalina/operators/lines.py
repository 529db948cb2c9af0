"""Unpacking of multi-line text cells."""

from pyspark.sql import functions as F


def explode_lines(df, columns):
    """One row per line of the packed cells.

    Columns packed together stay aligned; the shorter ones are padded with empty text, and
    a null cell counts as one empty line.
    """
    packed = {f"_lines_{i}": F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), "\n")
              for i, c in enumerate(columns)}
    lines = df.withColumns(packed).withColumn("_line", F.explode(F.arrays_zip(*packed)))
    padded = {c: F.coalesce(F.col(f"_line._lines_{i}"), F.lit("")) for i, c in enumerate(columns)}
    return lines.withColumns(padded).drop("_line", *packed)
