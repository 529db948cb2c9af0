"""What-if scoring."""

from pyspark.sql import functions as F

from turmalina.functions import fixed_values as fv
from turmalina.operators.latest import latest_per
from turmalina.operators.pairs import pair_grid
from turmalina.plans.scenario import GLOBAL, LAST, choose, course_stats
from turmalina.plans.scoring import cell_label, score, with_features
from turmalina.schemas import EDITABLE

INTEGER_MEASURES = ["QTD_EMPRESAS", "QTD_CONC", "SALDO_EMPREGO"]


def real_rows(panel, unit=None, course=None, per_course=True):
    """The last record of each selection: per unit and course, or per unit over all courses
    (then ``CURSO_SEL`` is the wildcard)."""
    chosen = choose(panel, UNIDADE=unit, CURSO=course)
    keys = ["UNIDADE", "CURSO"] if per_course else ["UNIDADE"]
    rows = latest_per(chosen, keys, LAST)
    return rows.withColumn("CURSO_SEL", F.col("CURSO") if per_course else F.lit(GLOBAL))


def apply_edits(rows, edits=None, edit_table=None, keys=("UNIDADE", "CURSO_SEL")):
    """Override measures.

    ``edits`` maps a measure to a number or Column, for all rows.  ``edit_table`` holds
    (keys, ``CASO``, ``VARIAVEL``, ``VALOR``): every case of a key gives one more edited
    row; unlisted measures keep their value.
    """
    if edit_table is not None:
        wide = edit_table.groupBy(*keys, "CASO").agg(*[
            F.max(F.when(F.col("VARIAVEL") == m, F.col("VALOR"))).alias(f"_{m}") for m in EDITABLE])
        rows = rows.join(wide, list(keys)).withColumns(
            {m: F.coalesce(F.col(f"_{m}"), F.col(m).cast("double")) for m in EDITABLE}
        ).drop(*[f"_{m}" for m in EDITABLE])
    if edits:
        unknown = set(edits) - set(EDITABLE)
        if unknown:
            raise ValueError(f"measures that cannot be edited: {sorted(unknown)}")
        rows = rows.withColumns({m: (v if isinstance(v, F.Column) else F.lit(v)).cast("double")
                                 for m, v in edits.items()})
    return rows


def whatif(panel, scorer, edits=None, edit_table=None, unit=None, course=None, per_course=True):
    """Real rows with the edits applied, scored."""
    rows = apply_edits(real_rows(panel, unit, course, per_course), edits, edit_table)
    return score(with_features(rows), scorer)


def whatif_courses(panel, edited, scorer, year=fv.FUTURE_YEAR, mode="live", extra_keys=()):
    """Recommendation of every course under each what-if row.

    ``edited`` holds what-if rows (``UNIDADE``, ``CURSO_SEL``, measures).  The selected
    course takes the what-if row in full.  Others take the local measures of the what-if
    and their own mean wage and job balance; in ``mode="function"`` the job balance is the
    what-if's as well.
    """
    if mode not in ("live", "function"):
        raise ValueError("mode is 'live' or 'function'")
    cases = edited.select(
        *extra_keys, "UNIDADE", "CURSO_SEL", *[F.col(m).cast("double").alias(m) for m in EDITABLE])
    grid = pair_grid(cases, course_stats(panel), "CURSO")
    own = F.col("CURSO") == F.col("CURSO_SEL")
    balance = F.col("SALDO_EMPREGO") if mode == "function" else F.when(
        own, F.col("SALDO_EMPREGO")).otherwise(F.col("SALDO_EMPREGO_MEDIO"))
    rows = grid.withColumns({
        "ANO": F.lit(year), "SALDO_EMPREGO": balance,
        "SALARIO_MEDIO": F.when(own, F.col("SALARIO_MEDIO")).otherwise(F.col("SALARIO_MEDIO_MEDIO")),
    })
    scored = score(with_features(rows), scorer)
    return scored.select(
        *extra_keys, "UNIDADE", "CURSO_SEL", "CURSO",
        cell_label(F.col("FAIXA_DOMINANTE"), F.col("PROB_MAX")).alias("RECOM_SIMULADO"))
