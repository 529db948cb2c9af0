"""Scoring of rows and local sensitivity.

A *scorer* is any object with ``classes`` (class names in the order of its probabilities)
and ``score(df)``, which adds ``PROBS array<double>``.  It works row by row; several scorings of one
row are stacked as projections of it.
"""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.functions.measures import finite
from turmalina.schemas import NUMERIC

OUTCOME = ["PROBS", "FAIXA_IDX", "FAIXA_DOMINANTE", "PROB_MAX"]


def with_features(df, numeric=None):
    """Model inputs as doubles; a missing column or value counts as 0."""
    numeric = numeric or NUMERIC
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        for c in numeric})


def class_names(scorer):
    return F.array(*[F.lit(c) for c in scorer.classes])


def score(df, scorer):
    """Add the probabilities and the dominant band; the first of equal maxima wins."""
    rows = scorer.score(df).withColumn("PROBS", finite(F.col("PROBS")))
    rows = rows.withColumn("PROB_MAX", F.array_max("PROBS"))
    rows = rows.withColumn("FAIXA_IDX", (F.array_position("PROBS", F.col("PROB_MAX")) - 1).cast("int"))
    return rows.withColumn("FAIXA_DOMINANTE",
                           F.element_at(class_names(scorer), F.col("FAIXA_IDX") + 1))


def band_columns(df, scorer):
    """One probability column per band."""
    return df.select(*[c for c in df.columns if c not in OUTCOME],
                     *[F.col("PROBS")[i].alias(name) for i, name in enumerate(scorer.classes)])


def shocked(c, delta=0.10, epsilon=1.0):
    """A value raised by a share, or set to ``epsilon`` where it is not positive."""
    return F.when(c > 0, c * (1 + delta)).otherwise(F.lit(epsilon))


def with_impacts(df, scorer, variables=None, delta=0.10, epsilon=1.0, band_index=None):
    """Scored rows with ``IMPACTOS``, one (``VARIAVEL``, ``IMPACTO``) per variable the rows have:
    how far the shocked variable moves the probability of a band.

    The band is the row's dominant one unless ``band_index`` names a column or constant.  Every
    variable is one more projection of the same row: nothing is copied, moved or regrouped.  A
    scorer's ``prepare`` adds once what all its scorings need.
    """
    variables = [v for v in (variables or NUMERIC) if v in df.columns]
    index = F.col("FAIXA_IDX") if band_index is None else (
        F.col(band_index) if isinstance(band_index, str) else F.lit(band_index))
    rows = df.withColumns({"_i": index + 1, "_antes": F.element_at("PROBS", index + 1)})
    rows = rows.withColumnsRenamed({c: f"_fora_{c}" for c in OUTCOME}).withColumns(
        {f"_fora_{v}": F.col(v) for v in variables})
    rows = getattr(scorer, "prepare", lambda x: x)(rows.withColumns({v: F.col(v).cast("double") for v in variables}))
    for v in variables:
        rows = scorer.score(rows.withColumn(v, shocked(F.col(v), delta, epsilon)))
        after = F.element_at(finite(F.col("PROBS")), F.col("_i"))
        rows = rows.withColumns({f"_impacto_{v}": after - F.col("_antes"), v: F.col(f"_fora_{v}").cast("double")}).drop("PROBS")
    impacts = F.array(*[F.struct(F.lit(v).alias("VARIAVEL"), F.col(f"_impacto_{v}").alias("IMPACTO")) for v in variables])
    own = [F.col(f"_fora_{c}" if c in (*OUTCOME, *variables) else c).alias(c) for c in df.columns]
    return rows.select(*own, impacts.alias("IMPACTOS"))


def shocked_rows(df, scorer, **options):
    """Long form: each scored row once per variable, with ``VARIAVEL`` and ``IMPACTO``.

    A plain ``explode`` would make Spark check for empty lists as early as it can, below the joins
    that choose the rows, and so score every row of the panel for it; the list is never empty.
    """
    return with_impacts(df, scorer, **options).withColumn("_x", F.explode_outer("IMPACTOS")).select(
        *df.columns, "_x.VARIAVEL", "_x.IMPACTO")


def by_size(impacts):
    """Impacts from the largest to the smallest absolute value, ties by name."""
    keyed = F.transform(impacts, lambda x: F.struct(
        (-F.abs(x["IMPACTO"])).alias("k"), x["VARIAVEL"].alias("VARIAVEL"),
        x["IMPACTO"].alias("IMPACTO")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["VARIAVEL"], x["IMPACTO"]))


def sensitivity(df, scorer, keys, **options):
    """Long form of the impacts: one row per case and variable the input has."""
    options.setdefault("variables", [v for v in NUMERIC if v in df.columns])
    rows = score(with_features(df), scorer)
    return shocked_rows(rows, scorer, **options) \
        .select(*keys, "FAIXA_DOMINANTE", "VARIAVEL", "IMPACTO")


def cell_label(band, probability):
    """Recommendation cell: mark, band and probability in percent."""
    percent = F.round(probability * 100, 1).cast("string")
    mark = (F.when((band == fv.BAND_HIGH) & (probability >= fv.STRONG_PROBABILITY), fv.MARK_STRONG)
            .when(band == fv.BAND_HIGH, fv.MARK_GOOD)
            .when(band == fv.BAND_MID, fv.MARK_CAUTION)
            .when(band == fv.BAND_LOW, fv.MARK_LOW).otherwise(fv.MARK_UNCLEAR))
    return F.concat(mark, F.lit(" "), band, F.lit(" ("), percent, F.lit("%)"))
