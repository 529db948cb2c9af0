"""Feeds derived from the driver's sales tables.

Roles: nation = municipality, region = training unit, parts of a name = course, part type =
occupation, brand or supplier = competing institution, line = enrolment.

The courses grow with the parts: parts of one name whose keys lie in the same 200 are a course,
so that a course has about as many lines at every scale.  A line of 50 pieces belongs to the
one-off edition of its part, which few units offer and which the catalogue doesn't know.
"""

from functools import lru_cache

from pyspark.sql import functions as F

from turmalina.fixtures.shared import written
from turmalina.plans.catalogue import ITINERARIES, OCCUPATIONS, TITLE

YEARS = list(range(1995, 2002))
LAGGED = YEARS[:-1]
WAGES = (25000.0, 475000.0)
# Rules for supplier names; the second never fires, since no original name holds "REDE".
NETWORK_RULES = [
    ("SUPPLIER#0+1", "REDE A "),
    ("REDE A", "REDE X"),
    ("SUPPLIER#0+2", "REDE B "),
    ("(4|5)$", "Z"),
    ("SUPPLIER", "ESCOLA"),
]
BRAND_ARMS = [
    ("=", "Brand#1", "REDE UM"),
    ("LIKE", "Brand#1%", "REDE DEZ"),
    ("LIKE", "%#2%", "REDE VINTE"),
    ("=", "Brand#21", "NUNCA"),
]


# Schemas of the tables used, so that opening one starts no job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, "
              "props string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark, sf_dir, name):
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def course():
    """Course name of a part."""
    return F.concat("p_name", F.lit(" "), F.expr("p_partkey div 200").cast("string"))


def edition():
    """Name of the one-off edition of a part."""
    return F.concat("p_name", F.lit(" avulso "), F.col("p_partkey").cast("string"))


def line_course():
    """Course name of a line."""
    return F.when(F.col("l_quantity") == 50, edition()).otherwise(course())


def occupation(c):
    """Six-digit code of a part type: first letter, length, 05."""
    return F.concat((F.ascii(c) * 100 + F.length(c)).cast("string"), F.lit("05"))


class Feeds:
    """Raw feeds over one folder of driver tables."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.t = lru_cache(maxsize=None)(lambda name: table(spark, sf_dir, name))
        self._written = None

    def _order_places(self):
        """Orders with the customer's nation."""
        return self.t("orders").join(
            self.t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"),
            "o_custkey")

    def _lines(self):
        return self.t("lineitem").join(
            self._order_places().withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")

    def _sales(self):
        """Lines with their order, customer's nation and part: the base of four feeds."""
        return self._with_part(self._lines()) if self._written is None else self._written

    def write_sales(self):
        """Join the base once and let the feeds read the written copy.

        Four feeds would each shuffle the lines twice; now they only scan.
        """
        if self._written is None:
            base = self._with_part(self._lines()).select(
                "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
                "l_linestatus", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority", "c_nationkey", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
            path = written(self.spark, self.sf_dir, "sales",
                           lambda to: base.write.parquet(to))
            self._written = self.spark.read.schema(base.schema).parquet(path)

    def _with_part(self, df):
        return df.withColumnRenamed("l_partkey", "p_partkey").join(self.t("part"), "p_partkey")

    def municipality_unit(self):
        return self.t("nation").join(
            self.t("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
        ).select(F.col("n_name").alias("MUNICIPIO_ORIGEM"),
                 F.col("r_name").alias("MUNICIPIO_UO_PRÓXIMA"))

    def territory(self):
        key = F.col("n_nationkey").cast("string")
        return self.t("nation").select(
            key.alias("CO_MUN_IBGE_6"), F.concat(key, F.lit("7")).alias("CO_MUN_IBGE_7"),
            F.col("n_name").alias("NO_MUNICIPIO"))

    def enrolment_cube(self, sparse=False):
        """One row per line; ``sparse`` makes every part a course of its own."""
        lines = self._sales().withColumn("course", edition() if sparse else line_course())
        places = self.t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
        units = self.t("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return lines.join(places, "c_nationkey").join(units, "n_regionkey").select(
            F.col("l_linestatus").alias("TIPO_ALUNO"),
            F.col("l_returnflag").alias("TIPO_MATRICULA"),
            F.col("o_orderstatus").alias("SITUACAO_CURSO"),
            F.concat(F.lit("SENAI "), "r_name").alias("UNIDADE"),
            F.concat(F.lit("Técnico em "), "course").alias("CURSO"),
            F.col("p_type").alias("MODALIDADE"),
            F.col("o_orderpriority").alias("TURNO"),
            F.concat(F.year("o_orderdate"), F.lit("/1")).alias("PERIODO_LETIVO"),
            F.col("l_linenumber").cast("string").alias("PERIODO_ALUNO"),
            F.col("o_custkey").cast("string").alias("CPF"),
            F.col("l_orderkey").cast("string").alias("RA"),
            F.col("p_size").alias("IDADE"),
            F.concat(F.lit("\t"), F.lower("n_name")).alias("CIDADE"))

    def establishments_raw(self):
        served = self.t("lineitem").join(
            self.t("orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                    F.year("o_orderdate").alias("Ano")), "l_orderkey"
        ).select(F.col("l_suppkey").alias("s_suppkey"), "Ano").distinct()
        return served.join(self.t("supplier"), "s_suppkey").select(
            F.col("s_nationkey").cast("string").alias("COD_MUN"),
            (F.col("s_suppkey") % 10).cast("string").alias("COD_SUBCLASSE_CNAE"), "Ano")

    def job_flow_raw(self):
        return self._sales().select(
            F.col("o_orderdate").cast("date").alias("Data"),
            F.col("c_nationkey").cast("string").alias("municipio"),
            occupation(F.col("p_type")).alias("cbo2002_ocupacao"),
            F.col("o_totalprice").alias("salario"),
            (F.col("o_orderstatus") == "F").cast("int").alias("admitidos"),
            (F.col("o_orderstatus") == "O").cast("int").alias("desligados"),
            F.when(F.col("o_orderpriority") == "5-LOW", 111).otherwise(101).alias("categoria"))

    def job_links_raw(self):
        return self._sales().select(
            F.col("c_nationkey").cast("string").alias("CO_MUN_IBGE_6"),
            occupation(F.col("p_type")).alias("CO_CBO"), F.year("o_orderdate").alias("Ano"),
            F.col("l_extendedprice").alias("VL_REMUNERACAO_MEDIA_NOMINAL"))

    def school_census_raw(self):
        return self._sales().select(
            F.year("o_orderdate").alias("NU_ANO_CENSO"),
            F.concat(F.col("c_nationkey").cast("string"), F.lit("7")).alias("CO_MUNICIPIO"),
            F.col("l_linenumber").alias("TP_DEPENDENCIA"),
            F.col("p_brand").alias("NO_ENTIDADE"),
            line_course().alias("NO_CURSO_EDUC_PROFISSIONAL"),
            F.col("l_quantity").cast("int").alias("QT_MAT_CURSO_TEC_CT"),
            F.col("l_linenumber").alias("QT_MAT_CURSO_TEC_CONC"),
            F.when(F.col("l_linenumber") < 7, 0).alias("QT_MAT_TEC_SUBS"),
            F.when(F.col("l_linestatus") == "O", "0").otherwise("1")
            .alias("TP_LOCALIZACAO_DIFERENCIADA"))

    def competitors_scraped(self):
        # One table after the other: Spark takes a join of two small tables for a large one.
        sellers = self.t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
        places = self.t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        return self._with_part(self.t("lineitem")).join(
            sellers, "l_suppkey").join(places, "s_nationkey").select(
            F.col("s_name").alias("UNIDADE_DE_ENSINO"),
            F.when(F.col("l_linestatus") == "O", "Educação Presencial")
            .otherwise("Educação a Distância").alias("MODALIDADE"),
            F.upper(line_course()).alias("CURSO"), F.col("n_name").alias("MUNICIPIO"),
            F.date_format("l_shipdate", "dd/MM/yyyy").alias("Dt_SCRAPING"),
            F.lit(None).cast("string").alias("AZURE_GEOLOCATOR"))

    def benefit_raw(self):
        stats = self.t("customer").groupBy("c_nationkey").agg(
            F.count("*").alias("n"), F.sum("c_acctbal").alias("s"), F.avg("c_acctbal").alias("a"))
        years = F.explode(F.array(*[F.lit(y) for y in YEARS]))
        return stats.withColumn("y", years).select(
            F.make_date("y", F.lit(6), F.lit(1)).alias("referencia"),
            F.col("c_nationkey").cast("string").alias("CO_MUN_IBGE_6"), F.lit("BA").alias("uf"),
            F.col("n").alias("familias_pbf_pos_2023"),
            F.col("s").alias("valor_repasse_familias_pbf_a_partir_2023"),
            F.col("a").alias("valor_beneficio_medio_apos_mar_2023"))

    def course_catalogue(self):
        kind = F.col("p_type")
        code = F.concat((F.ascii(kind) * 100 + F.length(kind)).cast("string"), F.lit(" -05 - "), kind)
        return self.t("part").select(
            F.concat(F.lit("Técnico em "), course()).alias(TITLE),
            F.concat(code, F.lit("\nOCUPAÇÃO AINDA NÃO CLASSIFICADA\n \nsem código")).alias(OCCUPATIONS),
            F.concat(F.lit("Especialização Técnica em "), "p_brand",
                     F.lit("\nSugestões de cursos\nBacharelado em "), "p_type",
                     F.lit("\n\nbacharealdo em negócios da moda - outro\nOficina de "), "p_brand")
            .alias(ITINERARIES),
            F.lit("x").alias("Eixo Tecnológico"))

    def itinerary(self):
        prefix = (F.when(F.col("p_size") % 3 == 0, "Especialização em ")
                  .when(F.col("p_size") % 3 == 1, "Técnico em ").otherwise("tecnólogo em "))
        return self.t("part").select(F.concat(prefix, "p_name").alias("Nome do Item"))
