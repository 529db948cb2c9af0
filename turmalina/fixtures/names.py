"""Names that meet the real rules: texts of the rules around what the sales tables hold."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv

RULE_TEXTS = [pattern for pattern, _ in fv.SCRAPED_INSTITUTIONS]
ARM_TEXTS = [value.strip("%") for _, value, _ in fv.CENSUS_INSTITUTIONS]
CITIES = [*fv.CITY_RECODE, "SALVADOR", "NOVO HORIZONTE DO SUL"]
SITES = ["SENAI CIMATEC", "SENAI  DENDEZEIROS", "CIMATEC-PARK", "SENAI XCIMATEC", "SENAI CIMATECA", "SENAI"]


def listed(texts, number):
    """The text whose turn the number is."""
    return F.element_at(F.array(*map(F.lit, texts)), (number % len(texts) + 1).cast("int"))


def listed_sql(texts, number):
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"([{quoted}])[({number}) % {len(texts)} + 1]"


def around(text, number, other):
    """The text as it is, within another, cut short, or next to another of the list."""
    return (F.when(number % 5 == 0, text).when(number % 5 == 1, F.concat(F.lit("X "), text, F.lit(" 2")))
            .when(number % 5 == 2, F.expr("substring(_t, 1, length(_t) - 3)"))
            .when(number % 5 == 3, F.concat_ws(" ", text, other)).otherwise(F.concat(text, F.lit("S"))))


AROUND_SQL = ("CASE {n} % 5 WHEN 0 THEN t WHEN 1 THEN 'X ' || t || ' 2' WHEN 2 THEN substr(t, 1, length(t) - 3) "
              "WHEN 3 THEN t || ' ' || {other} ELSE t || 'S' END")


def with_names(df, key, texts):
    """``df`` with ``NOME``, a variant of the texts by the key."""
    rows = df.withColumn("_t", listed(texts, F.col(key)))
    return rows.withColumn("NOME", around(F.col("_t"), (F.col(key) / len(texts)).cast("long"),
                                          listed(texts, F.col(key) + 7))).drop("_t")


def with_names_sql(table, key, texts):
    """The rows of a table with ``NOME``."""
    turned = AROUND_SQL.format(n=f"({key} // {len(texts)})", other=listed_sql(texts, f"{key} + 7"))
    return f"SELECT *, {turned} AS NOME FROM (SELECT *, {listed_sql(texts, key)} AS t FROM {table})"
