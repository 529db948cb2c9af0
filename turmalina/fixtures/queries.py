"""Named queries over the driver tables: one per operator or job."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turmalina import app
from turmalina.fixtures import names
from turmalina.fixtures.jobs import Jobs
from turmalina.fixtures.scorer import fixed_scorer
from turmalina.fixtures.shared import written
from turmalina.fixtures.tables import TABLES, WAGES, YEARS, table
from turmalina.functions import fixed_values as fv
from turmalina.functions import measures, text
from turmalina.operators import latest
from turmalina.operators.lines import explode_lines
from turmalina.operators.rules import canonical_names
from turmalina.operators.split import class_weights
from turmalina.plans import catalogue, competitors, decision, enrolment, labour, scenario, whatif
from turmalina.plans.scoring import cell_label, score, sensitivity, with_features, with_impacts
from turmalina.plans.training import (
    BandModel, TrainingOptions, evaluate, evaluate_rounds, fit_features, one_hot_slot, split_panel, train)
from turmalina.schemas import CATEGORICAL, NUMERIC, PANEL_COLUMNS
from turmalina.sources import tables as io

PART_RULES = [
    ("SMALL", "MINI"), ("MINI", "NADA"), ("RED (WIDGET|RING)", "GRUPO"), ("RING", "ANEL"),
    ("ANEL", "NADA"), ("(BLUE|COLD) ", "FRIO "), ("FRIO BOLT", "NADA"), ("BLUE BOLT", "AZUL"),
]
PART_ARMS = [
    ("=", "red ring", "R1"), ("LIKE", "%ring%", "ANEL"), ("LIKE", "new%", "NOVO"),
    ("LIKE", "%bolt", "PARAFUSO"), ("=", "new bolt", "NUNCA"),
]
NATION_ACCENTS = {"NATION_3": "NAÇÃO_3", "NATION_7": "NAÇÃO_7", "NATION_24": "NAÇÃO_24"}
TEXT_CLASSES = [("que |les ", "FR"), ("der |und ", "DE")]
TEXT_REPAIRS = [("éonç", "REPARADO"), ("stion", "AJUSTADO")]
EDITS = {"QTD_EMPRESAS": 1.2, "SALDO_EMPREGO": 0.5}
# The model queries take 8 rounds at rate 0.3 where ``TrainingOptions`` has 1000 at 0.006; the
# README has the figures of the latter.
CHECKED = TrainingOptions(rounds=8, rate=0.3)


def written_panel(spark, sf_dir, sparse=False):
    """The panel as the analysis steps find it: built and written once, then read."""
    path = written(spark, sf_dir, "panel-sparse" if sparse else "panel",
                   lambda to: io.write_panel(Jobs(spark, sf_dir).panel(sparse), to))
    return io.read_panel(spark, path)


def _round(df, places, *columns):
    """Rounded for comparison.

    Means of few amounts in cents often end in exactly half a cent, where the order of a
    sum decides the rounding; an addend far below a cent settles them.
    """
    addend = 0.000001 if places == 2 else 0.0
    return df.withColumns({c: F.round(F.col(c) + addend, places) for c in columns})


# ---- text -------------------------------------------------------------------

def key_normalise(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.normalise_key(F.col("text")).alias("CHAVE"))


def rules_ordered(spark, sf):
    cleaned = table(spark, sf, "part").select(
        "p_partkey", text.clean_institution(F.col("p_name")).alias("n"))
    return cleaned.select("p_partkey", text.ordered_rules(F.col("n"), PART_RULES).alias("NOME"))


def rules_first_match(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", text.first_match(F.col("p_name"), PART_ARMS).alias("NOME"))


def recode_values(spark, sf):
    return table(spark, sf, "nation").select(
        "n_nationkey", text.recode(F.col("n_name"), NATION_ACCENTS).alias("NOME"))


def explode_multiline(spark, sf):
    lines = explode_lines(table(spark, sf, "documents").select("doc_id", "text", "source"),
                          ["text", "source"])
    return lines.filter(text.not_blank(F.col("text"))).select(
        "doc_id", F.col("text").alias("LINHA"), F.col("source").alias("ORIGEM"))


def occupation_code(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", "url", text.occupation_code(F.col("html")).alias("CODIGO"))
    return pages.select("page_id", "CODIGO", text.code_family(F.col("CODIGO")).alias("FAMILIA"),
                        text.occupation_family(F.col("url")).alias("PREFIXO"))


def keyword_class(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").filter(~text.contains_any(c, "nenhum|thereou ")).select(
        "doc_id", text.keyword_class(c, TEXT_CLASSES, "OUTRO").alias("CLASSE"),
        F.md5(text.keyword_repair(c, TEXT_REPAIRS)).alias("REPARO"))


def drop_subtotals(spark, sf):
    docs = table(spark, sf, "documents")
    return text.drop_subtotals(docs, ["text", "source", "absent"], "que").select("doc_id", "source")


def exclude_own(spark, sf):
    return text.exclude_matching(table(spark, sf, "documents"), "text", "ÉON").select("doc_id", "lang")


def age_band(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", measures.age_band(F.col("p_size")).alias("FAIXA_ETARIA"))


def institutions_scraped(spark, sf):
    """The rule table of the scraped names, on the dictionary of names."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = names.with_names(lines, "l_partkey", names.RULE_TEXTS)
    done = canonical_names(named, "NOME", fv.SCRAPED_INSTITUTIONS, "INSTITUICAO")
    return done.groupBy("NOME", "INSTITUICAO").agg(F.count("*").alias("N"))


def institutions_scraped_column(spark, sf):
    """The same table as one expression.  The keys are few bytes a row beside the work of the rules,
    so they are dealt out anew, in a fixed number of parts that isn't cut down for their few bytes: a
    file of millions of them is one task's otherwise."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = table(spark, sf, "part").select("p_partkey").repartition(parts, "p_partkey")
    named = names.with_names(keys, "p_partkey", names.RULE_TEXTS)
    return named.select("p_partkey", text.ordered_rules(F.col("NOME")).alias("INSTITUICAO"))


def institutions_census(spark, sf):
    named = names.with_names(table(spark, sf, "part").select("p_partkey"), "p_partkey", names.ARM_TEXTS)
    return named.select("p_partkey", text.first_match(F.col("NOME")).alias("INSTITUICAO"))


def unit_sites(spark, sf):
    """Word-bounded recode: only whole words are sites of the capital."""
    rows = table(spark, sf, "customer").withColumn("SITIO", F.concat(
        names.listed(names.SITES, F.col("c_custkey")), F.lit(" "), F.col("c_mktsegment")))
    unit = text.recode(text.strip_unit_name(F.col("SITIO")), fv.UNIT_RECODE)
    return rows.select("c_custkey", unit.alias("UNIDADE"))


def city_recode(spark, sf):
    cities = table(spark, sf, "customer").withColumn("CIDADE", names.listed(names.CITIES, F.col("c_custkey")))
    return cities.groupBy(text.recode(F.col("CIDADE"), fv.CITY_RECODE).alias("CIDADE")).agg(
        F.count("*").alias("N"), F.sum("c_acctbal").cast("decimal(18,2)").cast("double").alias("SALDO"))


def vector_nan(spark, sf):
    """A vector with NaN entries, as a scorer may give, counts them as 0."""
    nan = F.lit(float("nan"))
    rows = io.read_table(spark, f"{sf}/embeddings.parquet").withColumn("v", F.transform(
        "embedding", lambda x: F.when(x < 0, nan).otherwise(x.cast("double"))))
    done = rows.withColumn("v", measures.finite(F.col("v")))
    return done.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("SOMA"),
                       F.size(F.filter("v", lambda x: x == 0)).alias("ZEROS"))


# ---- sources ----------------------------------------------------------------

def trimmed_columns(spark, sf):
    """Column names with blanks around them, as a cube exports them."""
    nation = table(spark, sf, "nation").toDF(" n_nationkey", "n_name ", "\tn_regionkey\n")
    return io.trim_column_names(nation).groupBy("n_regionkey").agg(
        F.count("n_nationkey").alias("N"), F.min("n_name").alias("PRIMEIRA"))


def ready_feed(spark, sf):
    """A conformed feed written by one job and taken as it is by the panel of another."""
    folder = io.work_path(spark, "ready")
    jobs = Jobs(spark, sf)
    jobs.establishments().write.parquet(f"{folder}/establishments")
    ready = app.read_ready(spark, folder)
    raw = {n: getattr(jobs.feeds, n)() for n in ("municipality_unit", "territory", "school_census_raw", "enrolment_cube",
                                                 "competitors_scraped", "course_catalogue", "job_flow_raw", "job_links_raw",
                                                 "benefit_raw")}
    rows = app.panel_from_feeds(raw, ready, dedupe=True)
    return rows.filter("QTD_EMPRESAS > 0").select("ANO", "UNIDADE", "QTD_EMPRESAS").distinct().orderBy("ANO", "UNIDADE")


def folder_union(spark, sf):
    schema = T.StructType(
        [f for name in ("customer", "supplier")
         for f in T.StructType.fromDDL(TABLES[name]).fields])
    return io.read_folder(spark, sf, "{customer,supplier}.parquet", schema)


def folder_drift(spark, sf):
    """Files of one folder whose columns differ in type and presence."""
    wanted = T.StructType.fromDDL("k string, nome string, saldo double, nacao long")
    folder = io.work_path(spark, "drift")
    for i, name in enumerate(("customer", "supplier")):
        rows, p = table(spark, sf, name), name[0]
        key = F.col(f"{p}_{'cust' if i == 0 else 'supp'}key")
        columns = [key.cast("string" if i else "long").alias("k"), F.col(f"{p}_acctbal").cast("string" if i else "double").alias("saldo"),
                   F.col(f"{p}_nationkey").alias("nacao")] + ([F.col(f"{p}_name").alias("nome")] if i else [])
        rows.select(*columns).write.parquet(f"{folder}/{name}")
    return io.read_drifting(spark, folder, "*/*.parquet", wanted)


def panel_refresh(spark, sf):
    """One year's folder written anew; the years beside it stay as they were."""
    path = io.work_path(spark, "refresh")
    df = written_panel(spark, sf)
    io.write_panel(df, path)
    io.write_panel(df.withColumn("MAT_PAG", -F.col("MAT_PAG")), path, years=[1998])
    return io.read_panel(spark, path).select("ANO", "CURSO", "UNIDADE", "MAT_PAG")


def sql_query(spark, sf):
    return io.run_query(spark, """
        SELECT year(o_orderdate) AS ANO, o_orderstatus AS SITUACAO, count(*) AS N,
               round(sum(o_totalprice), 2) AS TOTAL
        FROM turmalina_orders GROUP BY ALL""", {"turmalina_orders": table(spark, sf, "orders")})


def conform_feed(spark, sf):
    wanted = T.StructType.fromDDL(
        "c_custkey string, c_acctbal double, c_phone string, c_nationkey long")
    return io.conform(table(spark, sf, "customer"), wanted)


# ---- feeds ------------------------------------------------------------------

def municipality(spark, sf):
    return Jobs(spark, sf).municipality


def job_links(spark, sf):
    return _round(Jobs(spark, sf).job_links(), 2, "SALARIO_MEDIO")


def establishments(spark, sf):
    return Jobs(spark, sf).establishments()


def job_flow(spark, sf):
    return _round(Jobs(spark, sf).job_flow(), 2, "SALARIO_MEDIO", "SALARIO_ADMITIDOS",
                  "SALARIO_DESLIGADOS")


def job_flow_by_municipality(spark, sf):
    flow = labour.job_flow_by_municipality(Jobs(spark, sf).feeds.job_flow_raw(), YEARS, WAGES)
    return _round(flow, 2, "SALARIO_MEDIO", "SALARIO_ADMITIDOS", "SALARIO_DESLIGADOS")


def census_rows(spark, sf):
    return (competitors.census_rows(Jobs(spark, sf).feeds.school_census_raw())
            .groupBy("ANO", "DEPEND_ADM", "CURSO").agg(F.sum("QTD_MAT").alias("QTD_MAT")))


def census_competitors(spark, sf):
    return Jobs(spark, sf).census()


def scraped_offers(spark, sf):
    rows = competitors.scraped_offers(Jobs(spark, sf).feeds.competitors_scraped(), {2002: 2001})
    return rows.distinct()


def scraped_competitors(spark, sf):
    return Jobs(spark, sf).scraped()


def competitors_union(spark, sf):
    jobs = Jobs(spark, sf)
    return io.union_by_name(jobs.census(), jobs.scraped())


def benefit_by_unit(spark, sf):
    return _round(Jobs(spark, sf).benefit(), 2, "TOTAL_REPASSE", "VLR_MEDIO_BENEFICIO")


def enrolment_rows(spark, sf):
    return enrolment.enrolment_rows(Jobs(spark, sf).feeds.enrolment_cube()).select(
        "ANO", "UNIDADE", "CURSO", "CIDADE", "CPF_E_RA", "FAIXA_ETARIA", "MATRICULAS")


def enrolments(spark, sf):
    return Jobs(spark, sf).enrolments()


def itinerary_list(spark, sf):
    return catalogue.itinerary_list(Jobs(spark, sf).feeds.itinerary())


def course_occupation(spark, sf):
    return Jobs(spark, sf).course_occupation()


def course_occupation_all(spark, sf):
    return Jobs(spark, sf).course_occupation(None)


# ---- panel ------------------------------------------------------------------

PANEL_MONEY = ("SALARIO_MEDIO", "TOTAL_REPASSE", "VLR_MEDIO_BENEFICIO")


def panel(spark, sf):
    return _round(Jobs(spark, sf).panel(), 2, *PANEL_MONEY)


def panel_dedupe(spark, sf):
    return _round(Jobs(spark, sf).panel(dedupe=True), 2, *PANEL_MONEY)


def panel_sparse(spark, sf):
    return _round(Jobs(spark, sf).panel(sparse=True), 2, *PANEL_MONEY)


def panel_roundtrip(spark, sf):
    """Written by year and read back."""
    return _round(written_panel(spark, sf), 2, *PANEL_MONEY)


def band_profile(spark, sf):
    return _round(decision.band_profile(written_panel(spark, sf)), 6, "PARTE")


def class_weights_query(spark, sf):
    return _round(class_weights(written_panel(spark, sf), "FAIXA_MAT"), 6, "PESO")


def stratified_split_query(spark, sf):
    return split_panel(written_panel(spark, sf)).select("ANO", "CURSO", "UNIDADE", "E_TESTE")


LATEST = ["ANO", "CURSO", "UNIDADE", "MAT_PAG", "QTD_CONC", "FAIXA_MAT"]


def latest_per_unit(spark, sf):
    return latest.latest_per(written_panel(spark, sf), ["UNIDADE"], scenario.LAST).select(*LATEST)


def latest_per_pair(spark, sf):
    return latest.latest_per(written_panel(spark, sf), ["UNIDADE", "CURSO"], scenario.LAST) \
        .select(*LATEST)


def latest_per_course(spark, sf):
    return latest.latest_values_per(written_panel(spark, sf), ["CURSO"], scenario.LAST).select(*LATEST)


def rows_latest_year(spark, sf):
    return latest.rows_at_latest_year(written_panel(spark, sf), ["UNIDADE"]).select(*LATEST)


def first_per_course(spark, sf):
    df = written_panel(spark, sf)
    ranked = df.join(latest.appearance(df, "UNIDADE", scenario.LAST), "UNIDADE")
    ranked = ranked.withColumn("POS", F.struct("APARECIMENTO", "ANO"))
    return latest.first_value_per(ranked, ["CURSO"], "MAT_PAG", "POS")


def unit_appearance(spark, sf):
    first = latest.appearance(written_panel(spark, sf), "UNIDADE", scenario.LAST)
    return first.select("UNIDADE", F.col("APARECIMENTO.ANO").alias("ANO"),
                        F.col("APARECIMENTO.CURSO").alias("CURSO"))


def choices(spark, sf):
    return latest.choices(written_panel(spark, sf), "CURSO")


def course_stats(spark, sf):
    return _round(scenario.course_stats(written_panel(spark, sf)), 4,
                  "SALDO_EMPREGO_MEDIO", "SALARIO_MEDIO_MEDIO")


def course_median(spark, sf):
    return scenario.course_medians(written_panel(spark, sf))


def context_by_year(spark, sf):
    return _round(scenario.context_by_year(written_panel(spark, sf)), 2, "SALARIO_MEDIO")


def context_table(spark, sf):
    return decision.context_table(written_panel(spark, sf), unit="ASIA", course="GLOBAL", year="TODOS")


def empty_selection(spark, sf):
    """Selections with and without rows: no rows in, no rows out, of every table."""
    df = written_panel(spark, sf)
    counts = []
    for unit, course in (("ASIA", None), ("NOWHERE", None), ("ASIA", "NOTHING")):
        chosen = scenario.choose(df, UNIDADE=unit, CURSO=course)
        counts += [
            chosen.agg(F.count("*").alias("N")).select(F.lit(f"{unit} {course} panel").alias("SELECAO"), "N"),
            scenario.probability_history(df, fixed_scorer(), unit, course).agg(F.count("*").alias("N"))
            .select(F.lit(f"{unit} {course} history").alias("SELECAO"), "N"),
            scenario.future_base(chosen).agg(F.count("*").alias("N"))
            .select(F.lit(f"{unit} {course} future").alias("SELECAO"), "N")]
    return io.union_by_name(*counts)


# ---- scoring ----------------------------------------------------------------

def _probabilities(df):
    return _round(df, 6, *fixed_scorer().classes)


def probability_history(spark, sf):
    return _probabilities(scenario.probability_history(written_panel(spark, sf), fixed_scorer()))


def probability_history_global(spark, sf):
    return _probabilities(scenario.probability_history(
        written_panel(spark, sf), fixed_scorer(), per_course=False))


def score_rows(spark, sf):
    """Dominant band of every panel row."""
    rows = score(with_features(written_panel(spark, sf)), fixed_scorer())
    return _round(rows.select(F.col("ANO").cast("int").alias("ANO"), "CURSO", "UNIDADE",
                              "FAIXA_DOMINANTE", "PROB_MAX"), 6, "PROB_MAX")


def scenario_rows(spark, sf):
    rows = scenario.scenario_rows(
        scenario.future_base(written_panel(spark, sf)), 2026, ("base", "conservador", "otimista", "x"))
    return _round(rows.select("CENARIO", "ANO", "UNIDADE", "CURSO", "SALDO_EMPREGO", "QTD_CONC",
                              "SALARIO_MEDIO", "VLR_MEDIO_BENEFICIO"),
                  2, "SALDO_EMPREGO", "QTD_CONC", "SALARIO_MEDIO", "VLR_MEDIO_BENEFICIO")


def future_matrix(spark, sf):
    return _round(scenario.future_matrix(written_panel(spark, sf), fixed_scorer()), 6, "PROB_MAX")


def future_matrix_sparse(spark, sf):
    return _round(scenario.future_matrix(written_panel(spark, sf, True), fixed_scorer()), 6, "PROB_MAX")


def _edits():
    return {m: F.col(m) * f for m, f in EDITS.items()}


def whatif_query(spark, sf):
    rows = whatif.whatif(written_panel(spark, sf), fixed_scorer(), _edits())
    return _round(rows.select("UNIDADE", "CURSO", "FAIXA_DOMINANTE", "PROB_MAX"), 6, "PROB_MAX")


def _edit(case, variable, value):
    return F.struct(F.lit(case).alias("CASO"), F.lit(variable).alias("VARIAVEL"),
                    value.alias("VALOR"))


def whatif_edit_table(spark, sf):
    df = written_panel(spark, sf)
    edits = df.groupBy("UNIDADE", F.col("CURSO").alias("CURSO_SEL")).agg(
        F.max("QTD_CONC").cast("double").alias("c"), F.min("SALARIO_MEDIO").alias("s")
    ).select("UNIDADE", "CURSO_SEL", F.explode(F.array(
        _edit("a", "QTD_CONC", F.col("c")), _edit("b", "QTD_CONC", F.col("c") + 5),
        _edit("b", "SALARIO_MEDIO", F.col("s")))).alias("e")).select("UNIDADE", "CURSO_SEL", "e.*")
    rows = whatif.whatif(df, fixed_scorer(), edit_table=edits)
    return _round(rows.select("UNIDADE", "CURSO", "CASO", "FAIXA_DOMINANTE", "PROB_MAX"), 6, "PROB_MAX")


def _edited(df):
    """One what-if per unit, made on the unit's last record."""
    rows = whatif.real_rows(df, per_course=False).withColumn("CURSO_SEL", F.col("CURSO"))
    return whatif.apply_edits(rows, _edits())


def whatif_courses(spark, sf):
    df = written_panel(spark, sf)
    return whatif.whatif_courses(df, _edited(df), fixed_scorer())


def whatif_courses_fn(spark, sf):
    df = written_panel(spark, sf)
    return whatif.whatif_courses(df, _edited(df), fixed_scorer(), mode="function")


def _latest_with_impacts(spark, sf):
    required = CATEGORICAL + NUMERIC
    rows = whatif.whatif(written_panel(spark, sf), fixed_scorer(), _edits())
    rows = rows.drop("CURSO_SEL", *[c for c in PANEL_COLUMNS if c not in required])
    return with_impacts(rows, fixed_scorer())


def sensitivity_query(spark, sf):
    rows = whatif.real_rows(written_panel(spark, sf))
    return _round(sensitivity(rows, fixed_scorer(), ["UNIDADE", "CURSO"]), 6, "IMPACTO")


def top_drivers(spark, sf):
    return decision.top_drivers(_latest_with_impacts(spark, sf), ["UNIDADE", "CURSO"])


def executive_real(spark, sf):
    return decision.executive_real(_latest_with_impacts(spark, sf), floor=0.5, points=0.5).select(
        "UNIDADE", "CURSO", "TEXTO", "NIVEL")


def executive_default(spark, sf):
    """With the thresholds that a job uses."""
    return decision.executive_real(_latest_with_impacts(spark, sf)).select(
        "UNIDADE", "CURSO", "TEXTO", "NIVEL")


def executive_whatif(spark, sf):
    return decision.executive_whatif(_latest_with_impacts(spark, sf)).select(
        "UNIDADE", "CURSO", "TEXTO", "NIVEL")


def _scored(spark, sf):
    return score(with_features(written_panel(spark, sf)), fixed_scorer()).select(
        F.col("ANO").cast("int").alias("ANO"), "CURSO", "UNIDADE", "FAIXA_DOMINANTE", "PROB_MAX")


def recommendation_cell(spark, sf):
    return _scored(spark, sf).select("ANO", "CURSO", "UNIDADE", cell_label(
        F.col("FAIXA_DOMINANTE"), F.col("PROB_MAX")).alias("CELULA"))


def recommendation_text(spark, sf):
    return _scored(spark, sf).select("ANO", "CURSO", "UNIDADE", decision.advice(
        F.col("FAIXA_DOMINANTE"), F.col("PROB_MAX")).alias("CONSELHO"))


def recommendation_table(spark, sf):
    df = written_panel(spark, sf)
    edited = whatif.apply_edits(whatif.real_rows(df, unit="ASIA", per_course=False), _edits())
    simulated = whatif.whatif_courses(df, edited, fixed_scorer())
    return decision.recommendation_table(df, fixed_scorer(), ["ASIA", "EUROPE"], simulated)


# ---- model ------------------------------------------------------------------

def features(spark, sf):
    """Where each row's one-hot slots are, counted from 1 (0 = first or unseen category)."""
    df = with_features(written_panel(spark, sf))
    stages = fit_features(df, TrainingOptions())
    rows = PipelineModel(stages).transform(df)
    size = stages[-1].size
    slots = [one_hot_slot(stages, c).alias(f"POS_{c}") for c in CATEGORICAL]
    return rows.select(
        F.col("ANO").cast("int").alias("ANO"), "CURSO", "UNIDADE", F.lit(size).alias("TAMANHO"), *slots,
        F.round(F.col("SALARIO_MEDIO") + 0.000001, 2).alias("SALARIO_MEDIO"))


def train_and_score(spark, sf):
    """Whether each row's probabilities add up to 1 and the largest is the dominant band's."""
    df = written_panel(spark, sf)
    model = train(df, CHECKED)
    names = F.array(*[F.lit(c) for c in model.classes])
    total = F.aggregate("PROBS", F.lit(0.0), lambda acc, x: acc + x)
    dominant = F.element_at("PROBS", F.array_position(names, F.col("FAIXA_DOMINANTE")).cast("int"))
    return score(df, model).select(
        F.col("ANO").cast("int").alias("ANO"), "CURSO", "UNIDADE", "FAIXA_MAT",
        (F.abs(total - 1) < 1e-9).alias("SOMA_UM"),
        ((dominant == F.array_max("PROBS")) & (dominant == F.col("PROB_MAX"))).alias("DOMINANTE_MAIOR"))


def evaluate_query(spark, sf):
    """Test rows, log-loss of the class shares, and whether the model's is lower."""
    df = written_panel(spark, sf)
    found = evaluate(df, train(df, CHECKED), CHECKED)
    return found.select("N_TESTE", F.round("LOGLOSS_PARTES", 6).alias("LOGLOSS_PARTES"),
                        (F.col("LOGLOSS") < F.col("LOGLOSS_PARTES")).alias("MELHOR"))


def model_roundtrip(spark, sf):
    """Rows whose score changes when the model is saved and loaded (none should)."""
    df = written_panel(spark, sf)
    model = train(df, CHECKED)
    path = io.work_path(spark, "model")
    model.save(path)
    before = score(df, model).withColumnRenamed("PROB_MAX", "ANTES").drop("PROBS", "FAIXA_IDX", "FAIXA_DOMINANTE")
    both = score(before, BandModel.load(path))
    return both.agg(F.count("*").alias("N"),
                    F.sum((F.abs(F.col("ANTES") - F.col("PROB_MAX")) > 1e-12).cast("long")).alias("DIFERENTES"))


def fitted_bands(spark, sf):
    """The fitted model's band and probability of every row."""
    df = written_panel(spark, sf)
    return score(df, train(df, CHECKED)).select(
        F.col("ANO").cast("int").alias("ANO"), "CURSO", "UNIDADE", "FAIXA_MAT", "FAIXA_DOMINANTE", "PROB_MAX")


def _rounds(spark, sf):
    df = written_panel(spark, sf)
    return evaluate_rounds(df, train(df, CHECKED), CHECKED)


def evaluate_rounds_query(spark, sf):
    """Test rows and loss of the class shares beside each round, and whether the round's loss is
    lower than theirs."""
    return _rounds(spark, sf).select("RODADA", "N_TESTE", F.round("LOGLOSS_PARTES", 6).alias("LOGLOSS_PARTES"),
                                     (F.col("LOGLOSS") < F.col("LOGLOSS_PARTES")).alias("MELHOR"))


def loss_by_round(spark, sf):
    return _rounds(spark, sf).select("RODADA", "N_TESTE", "LOGLOSS", "LOGLOSS_PARTES")


QUERIES = {
    "key_normalise": key_normalise,
    "rules_ordered": rules_ordered,
    "rules_first_match": rules_first_match,
    "recode_values": recode_values,
    "explode_multiline": explode_multiline,
    "occupation_code": occupation_code,
    "keyword_class": keyword_class,
    "drop_subtotals": drop_subtotals,
    "exclude_own": exclude_own,
    "age_band": age_band,
    "folder_union": folder_union,
    "sql_query": sql_query,
    "conform_feed": conform_feed,
    "municipality": municipality,
    "job_links": job_links,
    "establishments": establishments,
    "job_flow": job_flow,
    "job_flow_by_municipality": job_flow_by_municipality,
    "census_rows": census_rows,
    "census_competitors": census_competitors,
    "scraped_offers": scraped_offers,
    "scraped_competitors": scraped_competitors,
    "competitors_union": competitors_union,
    "benefit_by_unit": benefit_by_unit,
    "enrolment_rows": enrolment_rows,
    "enrolments": enrolments,
    "itinerary_list": itinerary_list,
    "course_occupation": course_occupation,
    "course_occupation_all": course_occupation_all,
    "panel": panel,
    "panel_dedupe": panel_dedupe,
    "panel_sparse": panel_sparse,
    "panel_roundtrip": panel_roundtrip,
    "band_profile": band_profile,
    "class_weights": class_weights_query,
    "stratified_split": stratified_split_query,
    "latest_per_unit": latest_per_unit,
    "latest_per_pair": latest_per_pair,
    "latest_per_course": latest_per_course,
    "rows_latest_year": rows_latest_year,
    "first_per_course": first_per_course,
    "unit_appearance": unit_appearance,
    "choices": choices,
    "course_stats": course_stats,
    "course_median": course_median,
    "context_by_year": context_by_year,
    "context_table": context_table,
    "probability_history": probability_history,
    "probability_history_global": probability_history_global,
    "score_rows": score_rows,
    "scenario_rows": scenario_rows,
    "future_matrix": future_matrix,
    "future_matrix_sparse": future_matrix_sparse,
    "whatif": whatif_query,
    "whatif_edit_table": whatif_edit_table,
    "whatif_courses": whatif_courses,
    "whatif_courses_fn": whatif_courses_fn,
    "sensitivity": sensitivity_query,
    "top_drivers": top_drivers,
    "recommendation_cell": recommendation_cell,
    "recommendation_text": recommendation_text,
    "executive_real": executive_real,
    "executive_default": executive_default,
    "executive_whatif": executive_whatif,
    "recommendation_table": recommendation_table,
    "features": features,
    "train_and_score": train_and_score,
    "evaluate": evaluate_query,
    "model_roundtrip": model_roundtrip,
    "institutions_scraped": institutions_scraped,
    "institutions_scraped_column": institutions_scraped_column,
    "institutions_census": institutions_census,
    "unit_sites": unit_sites,
    "city_recode": city_recode,
    "vector_nan": vector_nan,
    "trimmed_columns": trimmed_columns,
    "ready_feed": ready_feed,
    "empty_selection": empty_selection,
    "folder_drift": folder_drift,
    "panel_refresh": panel_refresh,
    "fitted_bands": fitted_bands,
    "evaluate_rounds": evaluate_rounds_query,
    "loss_by_round": loss_by_round,
}
# What a fitted model says can't be told in SQL; tests/test_training.py checks it on a fixture.
WITHOUT_SQL = {"fitted_bands", "loss_by_round"}
