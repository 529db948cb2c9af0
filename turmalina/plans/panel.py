"""The panel: one row per year, course and training unit."""

from functools import reduce

from pyspark.sql import functions as F

from turmalina.functions.measures import enrolment_band, fill_numeric, on_groups
from turmalina.functions.text import occupation_family
from turmalina.schemas import PANEL_COLUMNS, PANEL_KEYS
from turmalina.sources.tables import written

PLACE = ["UNIDADE", "ANO"]
OCCUPATION = ["CBO_UNIDADE", "ANO"]


def _grouped(df, keys, rows, **sums):
    """A feed at its join grain: sums, and under ``rows`` how many rows they stand for."""
    return df.dropna(subset=keys).groupBy(*keys).agg(
        F.count("*").alias(rows), *[F.sum(c).alias(name) for name, c in sums.items()])


def spread_nulls(key, by):
    """A join key whose nulls have values of their own that nothing else has, so that the rows of
    an outer join that find no partner don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*by).cast("string")))


def build_panel(enrolments, establishments, course_occupation, job_flow, job_links,
                competitors, benefit, dedupe: bool = False):
    """Join the feeds, aggregate, and band the enrolments.

    The panel's numbers are defined over the joined rows: an enrolment count is repeated
    for every occupation of the course and every competitor row, and the band is cut on
    the repeated sum.  The repetition is not carried out.  Each feed is summed at its own
    join grain together with its row count, and a sum is multiplied by the row counts of
    the other feeds, which gives the same totals without the joined rows ever existing.

    ``dedupe=True`` sums each feed once, with no repetition.

    The feeds by unit and occupation and by unit and year are far smaller than the panel: they are
    written first, so Spark knows their sizes and needn't move the panel's rows to look them up.
    """
    def times(name):
        return F.lit(1) if dedupe else F.coalesce(F.col(name), F.lit(1))

    keyed = F.col("ANO").isNotNull() & F.col("CURSO").isNotNull() & F.col("UNIDADE").isNotNull()
    base = (enrolments.groupBy(*PANEL_KEYS)
            .agg(F.sum("MATRICULAS").alias("_mat"), F.count("*").alias("_n"))
            .filter(on_groups(F.col("_n"), keyed)).drop("_n"))

    flow = _grouped(job_flow, OCCUPATION, "_n_flow", _adm="SUM_ADMITIDOS", _des="SUM_DESLIGADOS",
                    _saldo="SALDO_EMPREGO", _wage="SALARIO_MEDIO",
                    _wages=F.col("SALARIO_MEDIO").isNotNull().cast("long"))
    links = _grouped(job_links, OCCUPATION, "_n_link", _vinc="QTD_VINCULOS")
    occupations = course_occupation.select("CURSO", "CBO")
    # Codes come without dashes already; the family is kept for the key's sake.
    flow, links = written(flow, "flow"), written(links, "links")
    by_occupation = (base.join(occupations, "CURSO", "left")
                     .withColumn("CBO", F.replace(occupation_family("CBO"), F.lit("-"), F.lit("")))
                     .withColumn("CBO_UNIDADE", spread_nulls(F.concat("CBO", "UNIDADE"), PANEL_KEYS))
                     .join(flow, OCCUPATION, "left").join(links, OCCUPATION, "left"))
    n_flow, n_link = times("_n_flow"), times("_n_link")
    by_key = by_occupation.groupBy(*PANEL_KEYS).agg(
        F.max("_mat").alias("_mat"), F.sum(n_flow * n_link).alias("_n_occ"),
        *[F.sum(F.col(c) * n_link).alias(c) for c in ("_adm", "_des", "_saldo", "_wage", "_wages")],
        F.sum(F.col("_vinc") * n_flow).alias("_vinc"))

    conc = _grouped(competitors, PANEL_KEYS, "_n_conc", _conc="QTD_CONC", _mat_conc="QTD_MAT_CONC")
    firms = _grouped(establishments, PLACE, "_n_firm", _firms="QTD_EMPRESAS")
    aid = _grouped(benefit, PLACE, "_n_aid", _fam="QTD_FAMILIAS", _rep="TOTAL_REPASSE",
                   _vlr="VLR_MEDIO_BENEFICIO",
                   _vlrs=F.col("VLR_MEDIO_BENEFICIO").isNotNull().cast("long"))
    firms, aid = written(firms, "firms"), written(aid, "aid")
    joined = (by_key.join(conc, PANEL_KEYS, "left").join(firms, PLACE, "left")
              .join(aid, PLACE, "left"))

    counts = {c: times(c) for c in ("_n_occ", "_n_conc", "_n_firm", "_n_aid")}

    def repeated(value, own=None):
        factors = [f for name, f in counts.items() if name != own]
        total = reduce(lambda a, b: a * b, factors, F.col(value))
        return F.coalesce(total, F.lit(0))

    panel = joined.select(
        *PANEL_KEYS,
        repeated("_mat").alias("MAT_PAG"),
        repeated("_conc", "_n_conc").alias("QTD_CONC"),
        repeated("_mat_conc", "_n_conc").alias("QTD_MAT_CONC"),
        repeated("_firms", "_n_firm").alias("QTD_EMPRESAS"),
        repeated("_vinc", "_n_occ").alias("QTD_VINCULOS"),
        repeated("_adm", "_n_occ").alias("SUM_ADMITIDOS"),
        repeated("_des", "_n_occ").alias("SUM_DESLIGADOS"),
        repeated("_saldo", "_n_occ").alias("SALDO_EMPREGO"),
        F.try_divide("_wage", "_wages").alias("SALARIO_MEDIO"),
        repeated("_fam", "_n_aid").alias("QTD_FAMILIAS"),
        repeated("_rep", "_n_aid").alias("TOTAL_REPASSE"),
        F.try_divide("_vlr", "_vlrs").alias("VLR_MEDIO_BENEFICIO"))
    return finish_panel(panel)


def finish_panel(panel):
    """Keep rows with job measures, band the enrolments, fill missing numbers."""
    kept = panel.filter(F.col("SALDO_EMPREGO").isNotNull() & F.col("QTD_VINCULOS").isNotNull())
    banded = kept.withColumn("FAIXA_MAT", enrolment_band(F.col("MAT_PAG")))
    return fill_numeric(banded).select(*PANEL_COLUMNS)
