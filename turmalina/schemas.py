"""Column lists and feed schemas."""

from pyspark.sql import types as T

PANEL_KEYS = ["ANO", "CURSO", "UNIDADE"]
PANEL_COUNTS = [
    "MAT_PAG", "QTD_CONC", "QTD_MAT_CONC", "QTD_EMPRESAS", "QTD_VINCULOS",
    "SUM_ADMITIDOS", "SUM_DESLIGADOS", "SALDO_EMPREGO", "QTD_FAMILIAS",
]
PANEL_COLUMNS = [
    "ANO", "CURSO", "UNIDADE", "MAT_PAG", "QTD_CONC", "QTD_MAT_CONC", "QTD_EMPRESAS",
    "QTD_VINCULOS", "SUM_ADMITIDOS", "SUM_DESLIGADOS", "SALDO_EMPREGO", "SALARIO_MEDIO",
    "QTD_FAMILIAS", "TOTAL_REPASSE", "VLR_MEDIO_BENEFICIO", "FAIXA_MAT",
]

CATEGORICAL = ["UNIDADE", "CURSO"]
NUMERIC = [
    "ANO", "QTD_EMPRESAS", "QTD_CONC", "SALARIO_MEDIO", "SALDO_EMPREGO", "VLR_MEDIO_BENEFICIO",
]
# Measures a what-if may override.
EDITABLE = ["QTD_EMPRESAS", "VLR_MEDIO_BENEFICIO", "QTD_CONC", "SALARIO_MEDIO", "SALDO_EMPREGO"]


def _schema(text):
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(),
             "d": T.DoubleType(), "t": T.DateType()}
    fields = [item.rsplit(":", 1) for item in text.split(",")]
    return T.StructType([T.StructField(n.strip(), kinds[k.strip()], True) for n, k in fields])


FEED_SCHEMAS = {
    "municipality_unit": _schema("MUNICIPIO_ORIGEM:s,MUNICIPIO_UO_PRÓXIMA:s"),
    "territory": _schema("CO_MUN_IBGE_6:s,CO_MUN_IBGE_7:s,NO_MUNICIPIO:s"),
    "job_links_raw": _schema("CO_MUN_IBGE_6:s,CO_CBO:s,Ano:i,VL_REMUNERACAO_MEDIA_NOMINAL:d"),
    "establishments_raw": _schema("COD_MUN:s,COD_SUBCLASSE_CNAE:s,Ano:i"),
    "job_flow_raw": _schema(
        "Data:t,municipio:s,cbo2002_ocupacao:s,salario:d,admitidos:i,desligados:i,categoria:i"),
    "school_census_raw": _schema(
        "NU_ANO_CENSO:i,CO_MUNICIPIO:s,TP_DEPENDENCIA:i,NO_ENTIDADE:s,"
        "NO_CURSO_EDUC_PROFISSIONAL:s,QT_MAT_CURSO_TEC_CT:i,QT_MAT_CURSO_TEC_CONC:i,"
        "QT_MAT_TEC_SUBS:i,TP_LOCALIZACAO_DIFERENCIADA:s"),
    "competitors_scraped": _schema(
        "UNIDADE_DE_ENSINO:s,MODALIDADE:s,CURSO:s,MUNICIPIO:s,Dt_SCRAPING:s,AZURE_GEOLOCATOR:s"),
    "benefit_raw": _schema(
        "referencia:t,CO_MUN_IBGE_6:s,uf:s,familias_pbf_pos_2023:l,"
        "valor_repasse_familias_pbf_a_partir_2023:d,valor_beneficio_medio_apos_mar_2023:d"),
    "enrolment_cube": _schema(
        "TIPO_ALUNO:s,TIPO_MATRICULA:s,SITUACAO_CURSO:s,SITUAÇÃO_MAT_PERIODO_LETIVO:s,"
        "TIPO_GRATUIDADE:s,UNIDADE:s,CURSO:s,MODALIDADE:s,TURNO:s,PERIODO_LETIVO:s,"
        "PERIODO_ALUNO:s,CPF:s,RA:s,SEXO:s,CIDADE:s,IDADE:i"),
    "itinerary": _schema("Nome do Item:s"),
    "course_catalogue": _schema(
        "Denominação do Curso:s,Ocupações CBO Associadas:s,Itinerários Formativos:s"),
}
