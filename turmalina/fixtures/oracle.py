"""SQL counterparts of the named queries, over the driver tables.

The SQL joins row by row, with every repetition carried out, and scores with the fixed
weights spelled out; it shares no shortcut with the library.
"""

from turmalina.fixtures import names
from turmalina.fixtures.queries import (
    EDITS, NATION_ACCENTS, PART_ARMS, PART_RULES, TEXT_CLASSES, TEXT_REPAIRS)
from turmalina.fixtures.scorer import CLASSES, SCALES, WEIGHTS
from turmalina.fixtures.tables import BRAND_ARMS, NETWORK_RULES
from turmalina.functions import fixed_values as fv
from turmalina.functions.text import WHITESPACE

BLANKS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
WORD_END = r"[^\p{L}\p{M}\p{N}\p{Pc}]"


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def rules_sql(source, column, rules):
    """Ordered rules as nested selects; ``column`` is the original, the result is ``a<n>``."""
    query = f"SELECT *, {column} AS a0 FROM ({source})"
    for i, (pattern, replacement) in enumerate(rules):
        query = (f"SELECT *, CASE WHEN regexp_matches({column}, {lit(pattern)}) THEN "
                 f"regexp_replace(a{i}, {lit(pattern)}, {lit(replacement)}, 'g') ELSE a{i} END "
                 f"AS a{i + 1} FROM ({query})")
    return query, f"a{len(rules)}"


def arms_sql(column, arms):
    whens = " ".join(f"WHEN {column} {kind} {lit(value)} THEN {lit(label)}"
                     for kind, value, label in arms)
    return f"CASE {whens} ELSE {column} END"


COURSE = "p_name || ' ' || (p_partkey // 200)::VARCHAR"
EDITION = "p_name || ' avulso ' || p_partkey::VARCHAR"
LINE_COURSE = f"CASE WHEN l_quantity = 50 THEN {EDITION} ELSE {COURSE} END"
SCRAPED, SCRAPED_NAME = rules_sql(
    "SELECT *, trim(regexp_replace(regexp_replace(upper(s_name), '^\\d+', ''), '[-–/]', ' ', 'g')) AS nome "
    "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN muni ON s_nationkey = nk", "nome", NETWORK_RULES)

FEEDS = f"""
muni AS (SELECT n_name, upper(r_name) AS r_name, n_nationkey AS nk
         FROM nation JOIN region ON n_regionkey = r_regionkey),
wide AS (SELECT *, year(o_orderdate)::INTEGER AS y, {LINE_COURSE} AS line_course, upper(line_course) AS course,
                ((ascii(p_type) * 100 + length(p_type))::VARCHAR || '05') AS cbo
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN part ON l_partkey = p_partkey JOIN muni ON c_nationkey = nk),
links AS (SELECT ANO, UNIDADE, CBO_UNIDADE, sum(q)::BIGINT AS QTD_VINCULOS, avg(m) AS SALARIO_MEDIO FROM (
            SELECT (y + 1)::INTEGER AS ANO, r_name AS UNIDADE, cbo || r_name AS CBO_UNIDADE, count(*) AS q,
                   sum(l_extendedprice) / nullif(count(*), 0) AS m
            FROM wide WHERE y IN (1995, 1996, 1997, 1998, 1999, 2000)
            GROUP BY y, nk, r_name, cbo) GROUP BY ALL),
firms AS (SELECT (y + 1)::INTEGER AS ANO, r_name AS UNIDADE, count(*)::BIGINT AS QTD_EMPRESAS FROM (
            SELECT DISTINCT l_suppkey, year(o_orderdate)::INTEGER AS y
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
          JOIN supplier ON l_suppkey = s_suppkey JOIN muni ON s_nationkey = nk
          WHERE y BETWEEN 1995 AND 2000 GROUP BY ALL),
flow0 AS (SELECT y AS ANO, nk, r_name, cbo AS CO_CBO,
            sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS SALARIO_DESLIGADOS,
            sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS SALARIO_ADMITIDOS,
            avg(o_totalprice) AS SALARIO_MEDIO,
            count(*) FILTER (o_orderstatus = 'F')::BIGINT AS SUM_ADMITIDOS,
            count(*) FILTER (o_orderstatus = 'O')::BIGINT AS SUM_DESLIGADOS
          FROM wide WHERE o_totalprice BETWEEN 25000 AND 475000 AND o_orderpriority <> '5-LOW'
          AND y BETWEEN 1995 AND 2001 GROUP BY ALL),
flow AS (SELECT ANO, r_name AS UNIDADE, CO_CBO, CO_CBO || r_name AS CBO_UNIDADE,
            avg(SALARIO_ADMITIDOS) AS SALARIO_ADMITIDOS, avg(SALARIO_DESLIGADOS) AS SALARIO_DESLIGADOS,
            avg(SALARIO_MEDIO) AS SALARIO_MEDIO, sum(SUM_ADMITIDOS)::BIGINT AS SUM_ADMITIDOS,
            sum(SUM_DESLIGADOS)::BIGINT AS SUM_DESLIGADOS,
            (sum(SUM_ADMITIDOS) - sum(SUM_DESLIGADOS))::BIGINT AS SALDO_EMPREGO
         FROM flow0 GROUP BY ALL),
census0 AS (SELECT y AS ANO, course AS CURSO, nk, r_name AS UNIDADE, p_brand,
              sum(l_quantity::INTEGER + l_linenumber + CASE WHEN l_linenumber < 7 THEN 0 END) AS m
            FROM wide WHERE l_linestatus = 'O' AND p_brand NOT LIKE '%SENAI%'
              AND course NOT LIKE '%MAGISTÉRIO%' GROUP BY ALL HAVING m > 0),
census AS (SELECT ANO, CURSO, UNIDADE, 1::INTEGER AS QTD_CONC, trunc(avg(m))::INTEGER AS QTD_MAT_CONC
           FROM (SELECT *, {arms_sql("p_brand", BRAND_ARMS)} AS inst FROM census0)
           GROUP BY ANO, CURSO, UNIDADE, inst),
scraped AS (SELECT CASE WHEN year(l_shipdate) = 2002 THEN 2001 ELSE year(l_shipdate) END::INTEGER AS ANO,
              upper({LINE_COURSE}) AS CURSO, r_name AS UNIDADE, count(DISTINCT {SCRAPED_NAME})::INTEGER AS QTD_CONC,
              0::INTEGER AS QTD_MAT_CONC
            FROM ({SCRAPED}) GROUP BY ALL),
conc AS (SELECT * FROM census UNION ALL SELECT * FROM scraped),
aid AS (SELECT ANO::INTEGER AS ANO, UNIDADE, sum(n)::BIGINT AS QTD_FAMILIAS, sum(s) AS TOTAL_REPASSE,
          avg(a) AS VLR_MEDIO_BENEFICIO
        FROM (SELECT r_name AS UNIDADE, count(*) AS n, sum(c_acctbal) AS s, avg(c_acctbal) AS a
              FROM customer JOIN muni ON c_nationkey = nk GROUP BY nk, r_name), range(1995, 2002) t(ANO)
        GROUP BY ALL),
cat AS (SELECT DISTINCT ((ascii(p_type) * 100 + length(p_type))::VARCHAR || '05') AS CBO,
          upper({COURSE}) AS CURSO FROM part)"""

ENROL = """
enr AS (SELECT y AS ANO, r_name AS UNIDADE, {course} AS CURSO, count(*)::BIGINT AS MATRICULAS
        FROM wide WHERE y <= 2025 GROUP BY ALL)"""
SPARSE = f"upper({EDITION})"
BAND = ("CASE WHEN MAT_PAG <= 20 THEN 'Abaixo de 21' WHEN MAT_PAG <= 40 THEN 'Entre 21 e 40' "
        "ELSE 'Acima de 40' END AS FAIXA_MAT")
PANEL = f"""
panel AS (SELECT *, {BAND} FROM (
  SELECT e.ANO, e.CURSO, e.UNIDADE, sum(MATRICULAS)::BIGINT AS MAT_PAG,
    coalesce(sum(QTD_CONC), 0)::BIGINT AS QTD_CONC, coalesce(sum(QTD_MAT_CONC), 0)::BIGINT AS QTD_MAT_CONC,
    coalesce(sum(QTD_EMPRESAS), 0)::BIGINT AS QTD_EMPRESAS, coalesce(sum(QTD_VINCULOS), 0)::BIGINT AS QTD_VINCULOS,
    coalesce(sum(SUM_ADMITIDOS), 0)::BIGINT AS SUM_ADMITIDOS,
    coalesce(sum(SUM_DESLIGADOS), 0)::BIGINT AS SUM_DESLIGADOS,
    coalesce(sum(SALDO_EMPREGO), 0)::BIGINT AS SALDO_EMPREGO, coalesce(avg(flow.SALARIO_MEDIO), 0) AS SALARIO_MEDIO,
    coalesce(sum(QTD_FAMILIAS), 0)::BIGINT AS QTD_FAMILIAS, coalesce(sum(TOTAL_REPASSE), 0) AS TOTAL_REPASSE,
    coalesce(avg(VLR_MEDIO_BENEFICIO), 0) AS VLR_MEDIO_BENEFICIO
  FROM enr e LEFT JOIN firms ON firms.UNIDADE = e.UNIDADE AND firms.ANO = e.ANO
  LEFT JOIN cat ON cat.CURSO = e.CURSO
  LEFT JOIN flow ON flow.CBO_UNIDADE = cat.CBO || e.UNIDADE AND flow.ANO = e.ANO
  LEFT JOIN links ON links.CBO_UNIDADE = cat.CBO || e.UNIDADE AND links.ANO = e.ANO
  LEFT JOIN conc ON conc.UNIDADE = e.UNIDADE AND conc.ANO = e.ANO AND conc.CURSO = e.CURSO
  LEFT JOIN aid ON aid.UNIDADE = e.UNIDADE AND aid.ANO = e.ANO
  GROUP BY ALL))"""
DEDUPE = f"""
panel AS (SELECT *, {BAND} FROM (
  SELECT e.ANO, e.CURSO, e.UNIDADE, MATRICULAS AS MAT_PAG, coalesce(c.QTD_CONC, 0)::BIGINT AS QTD_CONC,
    coalesce(c.QTD_MAT_CONC, 0)::BIGINT AS QTD_MAT_CONC, coalesce(QTD_EMPRESAS, 0)::BIGINT AS QTD_EMPRESAS,
    coalesce(l.v, 0)::BIGINT AS QTD_VINCULOS, coalesce(f.a, 0)::BIGINT AS SUM_ADMITIDOS,
    coalesce(f.d, 0)::BIGINT AS SUM_DESLIGADOS, coalesce(f.s, 0)::BIGINT AS SALDO_EMPREGO,
    coalesce(f.m, 0) AS SALARIO_MEDIO, coalesce(QTD_FAMILIAS, 0)::BIGINT AS QTD_FAMILIAS,
    coalesce(TOTAL_REPASSE, 0) AS TOTAL_REPASSE, coalesce(VLR_MEDIO_BENEFICIO, 0) AS VLR_MEDIO_BENEFICIO
  FROM enr e LEFT JOIN firms USING (UNIDADE, ANO) LEFT JOIN aid USING (UNIDADE, ANO)
  LEFT JOIN (SELECT ANO, CURSO, UNIDADE, sum(QTD_CONC) AS QTD_CONC, sum(QTD_MAT_CONC) AS QTD_MAT_CONC
             FROM conc GROUP BY ALL) c USING (UNIDADE, ANO, CURSO)
  LEFT JOIN (SELECT CURSO, UNIDADE, ANO, sum(SUM_ADMITIDOS) AS a, sum(SUM_DESLIGADOS) AS d,
               sum(SALDO_EMPREGO) AS s, avg(SALARIO_MEDIO) AS m
             FROM cat JOIN flow ON CBO = CO_CBO GROUP BY ALL) f USING (UNIDADE, ANO, CURSO)
  LEFT JOIN (SELECT CURSO, UNIDADE, ANO, sum(QTD_VINCULOS) AS v
             FROM cat JOIN links ON CBO || UNIDADE = CBO_UNIDADE GROUP BY ALL) l USING (UNIDADE, ANO, CURSO)))"""


def feeds(select):
    return f"WITH {FEEDS}, {ENROL.format(course='course')} {select}"


def on_panel(select, sparse=False, more="", panel=PANEL):
    return f"WITH {FEEDS}, {ENROL.format(course=SPARSE if sparse else 'course')}, {panel}{more} {select}"


PANEL_OUT = ("SELECT * REPLACE (round(SALARIO_MEDIO + 0.000001, 2) AS SALARIO_MEDIO, round(TOTAL_REPASSE + 0.000001, 2) AS "
             "TOTAL_REPASSE, round(VLR_MEDIO_BENEFICIO + 0.000001, 2) AS VLR_MEDIO_BENEFICIO) FROM panel")


# ---- scoring in SQL ---------------------------------------------------------

def exp_terms(values=None):
    """One exponential per class; ``values`` replaces variables by expressions."""
    values = values or {}
    terms = []
    for bias, linear, by_unit, by_course in WEIGHTS:
        parts = [str(float(bias)), f"(length(UNIDADE) % 5) * {by_unit}", f"(length(CURSO) % 7) * {by_course}"]
        for v, scale in SCALES.items():
            if v in linear:
                x = values.get(v, v)
                parts.append(f"coalesce(({x})::DOUBLE / (abs(({x})::DOUBLE) + {scale}), 0) * ({linear[v]})")
        terms.append("exp(" + " + ".join(parts) + ")")
    return terms


def with_probs(source, name="p", values=None):
    """The rows with the probability list ``name``."""
    e = ", ".join(f"{t} AS {name}e{i}" for i, t in enumerate(exp_terms(values)))
    total = " + ".join(f"{name}e{i}" for i in range(len(WEIGHTS)))
    probs = ", ".join(f"{name}e{i} / ({total})" for i in range(len(WEIGHTS)))
    drop = ", ".join(f"{name}e{i}" for i in range(len(WEIGHTS)))
    return f"SELECT * EXCLUDE ({drop}), [{probs}] AS {name} FROM (SELECT *, {e} FROM ({source}))"


def scored(source):
    """Rows with ``p``, ``pm`` and ``band``."""
    names = "[" + ", ".join(lit(c) for c in CLASSES) + "]"
    return (f"SELECT *, list_max(p) AS pm, list_position(p, list_max(p)) AS bi, "
            f"{names}[list_position(p, list_max(p))] AS band FROM ({with_probs(source)})")


SHOCKED = list(SCALES)


def impacts(source):
    """Scored rows with one impact column ``d<n>`` per variable."""
    query = scored(source)
    for n, v in enumerate(SHOCKED):
        shock = f"CASE WHEN ({v})::DOUBLE > 0 THEN ({v})::DOUBLE * 1.1 ELSE 1.0 END"
        query = with_probs(query, f"q{n}", {v: shock})
    diffs = ", ".join(f"q{n}[bi] - p[bi] AS d{n}" for n in range(len(SHOCKED)))
    return f"SELECT *, {diffs} FROM ({query})"


def long_impacts(source, keys):
    parts = [f"SELECT {keys}, band, pm, {lit(v)} AS VARIAVEL, d{n} AS IMPACTO FROM imp"
             for n, v in enumerate(SHOCKED)]
    return f", imp AS ({impacts(source)}), li AS ({' UNION ALL '.join(parts)})"


CELL = ("CASE WHEN {b} = 'Acima de 40' AND {p} >= 0.7 THEN '✅' WHEN {b} = 'Acima de 40' THEN '🟢' "
        "WHEN {b} = 'Entre 21 e 40' THEN '🟡' WHEN {b} = 'Abaixo de 21' THEN '🔴' ELSE '⚠️' END "
        "|| ' ' || {b} || ' (' || round({p} * 100, 1)::VARCHAR || '%)'")


def cell(b="band", p="pm"):
    return CELL.format(b=b, p=p)


def last(keys, order="ANO DESC, CURSO DESC, UNIDADE DESC", source="panel"):
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


LATEST = "ANO, CURSO, UNIDADE, MAT_PAG, QTD_CONC, FAIXA_MAT"
HISTORY_SRC = (
    "SELECT l.* EXCLUDE (ANO), y.ANO FROM ({last}) l, (SELECT DISTINCT ANO FROM panel) y")
CONTEXT = ("SELECT ANO, UNIDADE, CURSO, max(QTD_CONC)::BIGINT AS QTD_CONC, max(QTD_EMPRESAS)::BIGINT AS "
           "QTD_EMPRESAS, avg(SALARIO_MEDIO) AS SALARIO_MEDIO, sum(SALDO_EMPREGO)::BIGINT AS SALDO_EMPREGO, "
           "sum(MAT_PAG)::BIGINT AS MAT_PAG FROM panel GROUP BY ALL")
HISTORY_OUT = "UNIDADE, CURSO, ANO, " + ", ".join(
    f'round(p[{i + 1}], 6) AS "{c}"' for i, c in enumerate(CLASSES))


def history(keys):
    source = HISTORY_SRC.format(last=last(keys, "ANO DESC, CURSO DESC", f"({CONTEXT})"))
    source = f"SELECT *, 0.0 AS VLR_MEDIO_BENEFICIO FROM ({source})"
    return on_panel(f"SELECT {HISTORY_OUT} FROM ({with_probs(source)})")


BASE = f"""
, pair AS ({last('UNIDADE, CURSO')}), unit AS ({last('UNIDADE')}),
med AS (SELECT CURSO, median(QTD_CONC) AS m FROM panel GROUP BY CURSO),
base AS (SELECT u.UNIDADE, c.CURSO,
   coalesce(p.QTD_EMPRESAS, u.QTD_EMPRESAS)::DOUBLE AS QTD_EMPRESAS,
   CASE WHEN p.ANO IS NULL THEN c.m ELSE p.QTD_CONC END::DOUBLE AS QTD_CONC,
   coalesce(p.SALARIO_MEDIO, u.SALARIO_MEDIO)::DOUBLE AS SALARIO_MEDIO,
   coalesce(p.SALDO_EMPREGO, u.SALDO_EMPREGO)::DOUBLE AS SALDO_EMPREGO,
   coalesce(p.VLR_MEDIO_BENEFICIO, u.VLR_MEDIO_BENEFICIO)::DOUBLE AS VLR_MEDIO_BENEFICIO,
   p.ANO IS NOT NULL AS HISTORICO_NA_UNIDADE
  FROM unit u CROSS JOIN med c LEFT JOIN pair p ON p.UNIDADE = u.UNIDADE AND p.CURSO = c.CURSO),
factor(CENARIO, a, b, c, d) AS (VALUES {{factors}}),
future AS (SELECT 2026::INTEGER AS ANO, CENARIO, UNIDADE, CURSO, QTD_EMPRESAS, SALDO_EMPREGO * a AS SALDO_EMPREGO,
   QTD_CONC * b AS QTD_CONC, SALARIO_MEDIO * c AS SALARIO_MEDIO,
   VLR_MEDIO_BENEFICIO * d AS VLR_MEDIO_BENEFICIO, HISTORICO_NA_UNIDADE FROM base, factor)"""
FACTORS = "('base', 1.0, 1.0, 1.0, 1.0), ('conservador', 1.0, 1.02, 1.05, 1.02), ('otimista', 1.2, 1.0, 1.1, 1.03)"
FUTURE = BASE.format(factors=FACTORS)
FUTURE_X = BASE.format(factors=FACTORS + ", ('x', 1.0, 1.0, 1.0, 1.0)")
FUTURE_OUT = (f"SELECT ANO AS ANO_SIM, CENARIO, UNIDADE, CURSO, band AS FAIXA_DOMINANTE, round(pm, 6) AS PROB_MAX, "
              f"{cell()} AS col_recom, HISTORICO_NA_UNIDADE FROM ({scored('SELECT * FROM future')})")

EDIT = ", ".join(f"{m} * {f} AS {m}" for m, f in EDITS.items())
EDITED_PAIR = f"SELECT * REPLACE ({EDIT}) FROM ({last('UNIDADE, CURSO')})"
EDITED_UNIT = f"SELECT * REPLACE ({EDIT}) FROM ({last('UNIDADE')})"


def courses(cases, mode, selected="w.CURSO"):
    """What-if across courses."""
    balance = "w.SALDO_EMPREGO" if mode == "function" else \
        f"CASE WHEN c.CURSO = {selected} THEN w.SALDO_EMPREGO ELSE c.b END"
    source = (f"SELECT 2026 AS ANO, w.UNIDADE, {selected} AS CURSO_SEL, c.CURSO, w.QTD_EMPRESAS, "
              f"w.VLR_MEDIO_BENEFICIO, w.QTD_CONC, {balance} AS SALDO_EMPREGO, "
              f"CASE WHEN c.CURSO = {selected} THEN w.SALARIO_MEDIO ELSE c.s END AS SALARIO_MEDIO "
              f"FROM ({cases}) w, (SELECT CURSO, avg(SALDO_EMPREGO) AS b, avg(SALARIO_MEDIO) AS s "
              f"FROM panel GROUP BY CURSO) c")
    return f"SELECT UNIDADE, CURSO_SEL, CURSO, {cell()} AS RECOM_SIMULADO FROM ({scored(source)})"


LABELS = "CASE VARIAVEL " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.DISPLAY_NAMES.items()) + " ELSE VARIAVEL END"
RANKED = "row_number() OVER (PARTITION BY UNIDADE, CURSO ORDER BY abs(IMPACTO) DESC, VARIAVEL)"


def filled(text, *values):
    """A message with its slots filled, as a concatenation."""
    parts, rest = [], text
    for value in values:
        slot = "%.1f%%" if "%.1f%%" in rest and (
            "%s" not in rest or rest.index("%.1f%%") < rest.index("%s")) else "%s"
        before, rest = rest.split(slot, 1)
        parts += [lit(before), f"printf('%.1f', {value}) || '%'" if slot != "%s" else value]
    return " || ".join([*parts, lit(rest)])


def named(condition):
    return (f"(SELECT string_agg({LABELS}, ', ' ORDER BY abs(IMPACTO) DESC, VARIAVEL) FROM "
            f"(SELECT * FROM li WHERE li.UNIDADE = i.UNIDADE AND li.CURSO = i.CURSO AND {condition} "
            f"ORDER BY abs(IMPACTO) DESC, VARIAVEL LIMIT 2))")


MOVED = named("abs(IMPACTO) > 0.01")
PERCENT = "pm * 100"


def executive(floor, points):
    """Status of the real record; ``points`` are percentage points."""
    risks = named(f"IMPACTO < -{points / 100}")
    return f"""SELECT UNIDADE, CURSO,
  CASE WHEN band = 'Entre 21 e 40' THEN {filled(fv.TEXT_MID, PERCENT)}
       WHEN band = 'Acima de 40' AND pm >= {floor} AND r IS NOT NULL THEN {filled(fv.TEXT_HIGH_RISK, PERCENT, 'r')}
       WHEN band = 'Acima de 40' AND pm >= {floor} THEN {filled(fv.TEXT_HIGH, PERCENT)}
       ELSE {lit(fv.TEXT_BALANCED)} END AS TEXTO,
  CASE WHEN band = 'Entre 21 e 40' THEN 'info' WHEN band = 'Acima de 40' AND pm >= {floor} THEN 'success'
       ELSE 'info' END AS NIVEL
FROM (SELECT *, {risks} AS r FROM imp i)"""


EXEC_WHATIF = f"""SELECT UNIDADE, CURSO,
  CASE WHEN r IS NULL THEN {lit(fv.TEXT_WHATIF_STABLE)} ELSE {filled(fv.TEXT_WHATIF_SHIFT, 'band', 'r')} END AS TEXTO,
  'info' AS NIVEL FROM (SELECT *, {MOVED} AS r FROM imp i)"""

ADVICE = "CASE " + " ".join(
    f"WHEN band = {lit(b)} AND pm >= {p} THEN {lit(t)}" for b, p, t in fv.ADVICE
) + f" ELSE {lit(fv.ADVICE_OTHER)} END"

PARTS, PARTS_NAME = rules_sql("SELECT p_partkey, upper(p_name) AS n FROM part", "n", PART_RULES)
CODE = r"regexp_extract(html, '(\d{4}\s*-\s*\d{2}|\d{6}|\d{4})', 1)"

SPLIT = ("SELECT *, row_number() OVER (PARTITION BY FAIXA_MAT ORDER BY md5('123|' || ANO || '|' || CURSO || '|' || "
         "UNIDADE)) <= round(0.2 * count(*) OVER (PARTITION BY FAIXA_MAT)) AS E_TESTE FROM panel")

REAL, REAL_NAME = rules_sql(
    "SELECT NOME, count(*) AS n FROM (" + names.with_names_sql("lineitem", "l_partkey", names.RULE_TEXTS)
    + ") GROUP BY NOME", "NOME", fv.SCRAPED_INSTITUTIONS)
REAL_PART, REAL_PART_NAME = rules_sql(
    names.with_names_sql("part", "p_partkey", names.RULE_TEXTS), "NOME", fv.SCRAPED_INSTITUTIONS)

ORACLE = {
    "key_normalise": "SELECT doc_id, upper(regexp_replace(strip_accents(coalesce(text, '')), "
                     "'[^0-9A-Za-z]+', '', 'g')) AS CHAVE FROM documents",
    "rules_ordered": f"SELECT p_partkey, {PARTS_NAME} AS NOME FROM ({PARTS})",
    "rules_first_match": f"SELECT p_partkey, {arms_sql('p_name', PART_ARMS)} AS NOME FROM part",
    "recode_values": "SELECT n_nationkey, CASE n_name " + " ".join(
        f"WHEN {lit(k)} THEN {lit(v)}" for k, v in NATION_ACCENTS.items()) + " ELSE n_name END AS NOME FROM nation",
    "explode_multiline": f"""SELECT doc_id, LINHA, ORIGEM FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS LINHA,
               unnest(list_resize([source], len(string_split(text, chr(10))), '')) AS ORIGEM
        FROM documents) WHERE trim(LINHA, {BLANKS}) <> ''""",
    "occupation_code": f"SELECT page_id, nullif(regexp_replace({CODE}, '\\D', '', 'g'), '') AS CODIGO, "
                       f"substr(nullif(regexp_replace({CODE}, '\\D', '', 'g'), ''), 1, 4) AS FAMILIA, "
                       "string_split(url, '-')[1] AS PREFIXO FROM pages",
    "keyword_class": "SELECT doc_id, CASE " + " ".join(
        f"WHEN regexp_matches(text, '(?i){p}') THEN '{c}'" for p, c in TEXT_CLASSES)
        + " ELSE 'OUTRO' END AS CLASSE, md5(CASE " + " ".join(
        f"WHEN regexp_matches(text, '(?i){p}') THEN '{c}'" for p, c in TEXT_REPAIRS)
        + " ELSE text END) AS REPARO FROM documents WHERE NOT regexp_matches(text, '(?i)nenhum|thereou ')",
    "drop_subtotals": f"SELECT doc_id, source FROM documents WHERE NOT regexp_matches(lower(text), "
                      f"'(^|{WORD_END})que($|{WORD_END})') AND source <> 'que'",
    "exclude_own": "SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '(?i)ÉON')",
    "age_band": "SELECT p_partkey, CASE WHEN p_size IS NULL OR p_size <= 14 THEN 'Menor de 14 anos' "
                "WHEN p_size <= 17 THEN '14 a 17' WHEN p_size <= 24 THEN '18 a 24' WHEN p_size <= 30 THEN "
                "'25 a 30' WHEN p_size <= 39 THEN '31 a 39' WHEN p_size <= 50 THEN '40 a 50' WHEN p_size <= 59 "
                "THEN '51 a 59' ELSE '+ 60' END AS FAIXA_ETARIA FROM part",
    "folder_union": "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier",
    "sql_query": "SELECT year(o_orderdate)::INTEGER AS ANO, o_orderstatus AS SITUACAO, count(*)::BIGINT AS N, "
                 "round(sum(o_totalprice), 2) AS TOTAL FROM orders GROUP BY ALL",
    "conform_feed": "SELECT c_custkey::VARCHAR AS c_custkey, c_acctbal, NULL::VARCHAR AS c_phone, "
                    "c_nationkey::BIGINT AS c_nationkey FROM customer",
    "municipality": "SELECT upper(n_name) AS MUNICIPIO, upper(r_name) AS UNIDADE, replace(n_name, '_', '') AS "
                    "MUNICIPIO_COD FROM nation JOIN region ON n_regionkey = r_regionkey",
    "job_links": feeds("SELECT * REPLACE (round(SALARIO_MEDIO + 0.000001, 2) AS SALARIO_MEDIO) FROM links"),
    "establishments": feeds("SELECT * FROM firms"),
    "job_flow": feeds("SELECT * REPLACE (round(SALARIO_MEDIO + 0.000001, 2) AS SALARIO_MEDIO, round(SALARIO_ADMITIDOS + 0.000001, 2) AS "
                      "SALARIO_ADMITIDOS, round(SALARIO_DESLIGADOS + 0.000001, 2) AS SALARIO_DESLIGADOS) FROM flow"),
    "job_flow_by_municipality": feeds(
        "SELECT ANO, nk::VARCHAR AS municipio, CO_CBO, round(SALARIO_DESLIGADOS + 0.000001, 2) AS SALARIO_DESLIGADOS, "
        "round(SALARIO_ADMITIDOS + 0.000001, 2) AS SALARIO_ADMITIDOS, round(SALARIO_MEDIO + 0.000001, 2) AS SALARIO_MEDIO, "
        "SUM_ADMITIDOS, SUM_DESLIGADOS, substr(CO_CBO, 1, 4) AS CO_CBO_FAMILIA FROM flow0"),
    "census_rows": feeds(
        "SELECT y AS ANO, CASE WHEN l_linenumber = 4 THEN 'PRIVADA' ELSE 'PÚBLICA' END AS DEPEND_ADM, "
        "course AS CURSO, sum(l_quantity::INTEGER + l_linenumber + CASE WHEN l_linenumber < 7 THEN 0 END)::BIGINT "
        "AS QTD_MAT FROM wide WHERE l_linestatus = 'O' GROUP BY ALL"),
    "census_competitors": feeds("SELECT * FROM census"),
    "scraped_offers": feeds(
        "SELECT DISTINCT s_name AS UNIDADE_DE_ENSINO, CASE WHEN l_linestatus = 'O' THEN 'PRES' ELSE 'EAD' END AS "
        f"MODALIDADE, upper({LINE_COURSE}) AS CURSO, n_name AS MUNICIPIO, CASE WHEN year(l_shipdate) = 2002 THEN 2001 ELSE "
        "year(l_shipdate) END::INTEGER AS ANO FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON "
        "l_suppkey = s_suppkey JOIN muni ON s_nationkey = nk"),
    "scraped_competitors": feeds("SELECT * FROM scraped"),
    "competitors_union": feeds("SELECT * FROM conc"),
    "benefit_by_unit": feeds("SELECT ANO, UNIDADE, QTD_FAMILIAS, round(TOTAL_REPASSE + 0.000001, 2) AS TOTAL_REPASSE, "
                             "round(VLR_MEDIO_BENEFICIO + 0.000001, 2) AS VLR_MEDIO_BENEFICIO FROM aid"),
    "enrolment_rows": feeds(
        "SELECT y AS ANO, r_name AS UNIDADE, 'Técnico em ' || line_course AS CURSO, n_name AS CIDADE, "
        "sha256(o_custkey::VARCHAR || '|' || o_orderkey::VARCHAR) AS CPF_E_RA, CASE WHEN p_size <= 14 THEN "
        "'Menor de 14 anos' WHEN p_size <= 17 THEN '14 a 17' WHEN p_size <= 24 THEN '18 a 24' WHEN p_size <= 30 "
        "THEN '25 a 30' WHEN p_size <= 39 THEN '31 a 39' ELSE '40 a 50' END AS FAIXA_ETARIA, "
        "1::INTEGER AS MATRICULAS FROM wide"),
    "enrolments": feeds("SELECT * FROM enr"),
    "itinerary_list": "SELECT DISTINCT upper(p_name) AS \"Nome do Item\", 'CHP' AS MODALIDADE FROM part "
                      "WHERE p_size % 3 <> 0",
    "course_occupation": feeds("SELECT CBO, CURSO, 'CHP' AS MODALIDADE FROM cat"),
    "course_occupation_all": feeds(
        "SELECT CBO, CURSO, 'CHP' AS MODALIDADE FROM cat UNION SELECT CBO, u.i, u.c FROM cat JOIN ("
        f"SELECT upper({COURSE}) AS CURSO, unnest([{{'i': 'Especialização Técnica em ' || p_brand, 'c': 'POSTEC'}}, "
        "{'i': 'Bacharelado em ' || p_type, 'c': 'GRAD'}, {'i': 'Bacharelado em Negócios da Moda', 'c': 'GRAD'}, "
        "{'i': 'Oficina de ' || p_brand, 'c': 'FIC'}]) AS u FROM part) "
        "USING (CURSO)"),
    "panel": on_panel(PANEL_OUT),
    "panel_dedupe": on_panel(PANEL_OUT, panel=DEDUPE),
    "panel_sparse": on_panel(PANEL_OUT, sparse=True),
    "panel_roundtrip": on_panel(PANEL_OUT),
    "band_profile": on_panel("SELECT FAIXA_MAT, count(*)::BIGINT AS N, round(count(*) / sum(count(*)) OVER (), 6) "
                             "AS PARTE FROM panel GROUP BY FAIXA_MAT"),
    "class_weights": on_panel("SELECT FAIXA_MAT, count(*)::BIGINT AS N, round((SELECT count(*) / count(DISTINCT "
                              "FAIXA_MAT) FROM panel) / count(*), 6) AS PESO FROM panel GROUP BY FAIXA_MAT"),
    "stratified_split": on_panel(f"SELECT ANO, CURSO, UNIDADE, E_TESTE FROM ({SPLIT})"),
    "latest_per_unit": on_panel(f"SELECT {LATEST} FROM ({last('UNIDADE')})"),
    "latest_per_pair": on_panel(f"SELECT {LATEST} FROM ({last('UNIDADE, CURSO')})"),
    "latest_per_course": on_panel(f"SELECT {LATEST} FROM ({last('CURSO')})"),
    "rows_latest_year": on_panel(f"SELECT {LATEST} FROM panel QUALIFY ANO = max(ANO) OVER (PARTITION BY UNIDADE)"),
    "first_per_course": on_panel(
        "SELECT CURSO, MAT_PAG FROM (SELECT *, (SELECT min(struct_pack(a := q.ANO, b := q.CURSO)) FROM panel q "
        "WHERE q.UNIDADE = panel.UNIDADE) AS ap FROM panel) QUALIFY row_number() OVER (PARTITION BY CURSO "
        "ORDER BY ap, UNIDADE, ANO) = 1"),
    "unit_appearance": on_panel(
        f"SELECT UNIDADE, ANO, CURSO FROM ({last('UNIDADE', 'ANO, CURSO, UNIDADE')})"),
    "choices": on_panel("SELECT DISTINCT CURSO FROM panel ORDER BY CURSO"),
    "course_stats": on_panel("SELECT CURSO, round(avg(SALDO_EMPREGO), 4) AS SALDO_EMPREGO_MEDIO, "
                             "round(avg(SALARIO_MEDIO), 4) AS SALARIO_MEDIO_MEDIO FROM panel GROUP BY CURSO"),
    "course_median": on_panel("SELECT CURSO, median(QTD_CONC)::DOUBLE AS QTD_CONC_MEDIANA FROM panel GROUP BY CURSO"),
    "context_by_year": on_panel(f"SELECT * REPLACE (round(SALARIO_MEDIO + 0.000001, 2) AS SALARIO_MEDIO) FROM ({CONTEXT})"),
    "context_table": on_panel(
        'SELECT ANO, UNIDADE, CURSO, FAIXA_MAT AS "FAIXA DE MATR. (SENAI)", MAT_PAG AS "MATR.(SENAI)", '
        'QTD_CONC AS "CONCORRÊNCIA)", QTD_EMPRESAS AS "EMPRESAS (RAIS)", SALDO_EMPREGO AS "SALDO EMPREGO (CAGED)", '
        'round(SALARIO_MEDIO, 2) AS "SALÁRIO MÉDIO (CAGED)" FROM panel WHERE UNIDADE = \'ASIA\' ORDER BY ANO'),
    "probability_history": history("UNIDADE, CURSO"),
    "probability_history_global": history("UNIDADE"),
    "score_rows": on_panel("SELECT ANO, CURSO, UNIDADE, band AS FAIXA_DOMINANTE, round(pm, 6) AS PROB_MAX FROM "
                           f"({scored('SELECT * FROM panel')})"),
    "scenario_rows": on_panel(
        "SELECT CENARIO, ANO, UNIDADE, CURSO, round(SALDO_EMPREGO + 0.000001, 2) AS SALDO_EMPREGO, round(QTD_CONC + 0.000001, 2) AS "
        "QTD_CONC, round(SALARIO_MEDIO + 0.000001, 2) AS SALARIO_MEDIO, round(VLR_MEDIO_BENEFICIO + 0.000001, 2) AS VLR_MEDIO_BENEFICIO "
        "FROM future", more=FUTURE_X),
    "future_matrix": on_panel(FUTURE_OUT, more=FUTURE),
    "future_matrix_sparse": on_panel(FUTURE_OUT, sparse=True, more=FUTURE),
    "whatif": on_panel("SELECT UNIDADE, CURSO, band AS FAIXA_DOMINANTE, round(pm, 6) AS PROB_MAX FROM "
                       f"({scored(EDITED_PAIR)})"),
    "whatif_edit_table": on_panel(
        "SELECT UNIDADE, CURSO, CASO, band AS FAIXA_DOMINANTE, round(pm, 6) AS PROB_MAX FROM (" + scored(
            f"SELECT l.* REPLACE (CASE CASO WHEN 'a' THEN c ELSE c + 5 END AS QTD_CONC, CASE CASO WHEN 'b' THEN s "
            f"ELSE SALARIO_MEDIO END AS SALARIO_MEDIO), CASO FROM ({last('UNIDADE, CURSO')}) l JOIN (SELECT UNIDADE, "
            "CURSO, max(QTD_CONC) AS c, min(SALARIO_MEDIO) AS s FROM panel GROUP BY ALL) USING (UNIDADE, CURSO), "
            "(VALUES ('a'), ('b')) v(CASO)") + ")"),
    "whatif_courses": on_panel(courses(EDITED_UNIT, "live")),
    "whatif_courses_fn": on_panel(courses(EDITED_UNIT, "function")),
    "sensitivity": on_panel(
        "SELECT UNIDADE, CURSO, band AS FAIXA_DOMINANTE, VARIAVEL, round(IMPACTO, 6) + 0.0 AS IMPACTO FROM li",
        more=long_impacts(last("UNIDADE, CURSO"), "UNIDADE, CURSO")),
    "top_drivers": on_panel(
        f"SELECT UNIDADE, CURSO, n::INTEGER AS POSICAO, VARIAVEL, {LABELS} AS ROTULO, "
        f"printf('%+.1f', IMPACTO * 100) AS PONTOS FROM (SELECT *, {RANKED} AS n FROM li) WHERE n <= 5",
        more=long_impacts(EDITED_PAIR, "UNIDADE, CURSO")),
    "recommendation_cell": on_panel(f"SELECT ANO, CURSO, UNIDADE, {cell()} AS CELULA FROM "
                                    f"({scored('SELECT * FROM panel')})"),
    "recommendation_text": on_panel(f"SELECT ANO, CURSO, UNIDADE, {ADVICE} AS CONSELHO FROM "
                                    f"({scored('SELECT * FROM panel')})"),
    "executive_real": on_panel(executive(0.5, 0.5), more=long_impacts(EDITED_PAIR, "UNIDADE, CURSO")),
    "executive_default": on_panel(executive(0.69, 1.0), more=long_impacts(EDITED_PAIR, "UNIDADE, CURSO")),
    "executive_whatif": on_panel(EXEC_WHATIF, more=long_impacts(EDITED_PAIR, "UNIDADE, CURSO")),
    "recommendation_table": on_panel(
        f"""SELECT f.CURSO AS "Curso Técnico", max(cellv) FILTER (CENARIO = 'base') AS Base,
          max(cellv) FILTER (CENARIO = 'conservador') AS Conservador,
          max(cellv) FILTER (CENARIO = 'otimista') AS Otimista, any_value(s.RECOM_SIMULADO) AS Simulado
        FROM (SELECT *, {cell()} AS cellv FROM ({scored('SELECT * FROM future')}) WHERE UNIDADE = (
                SELECT UNIDADE FROM panel WHERE UNIDADE IN ('ASIA', 'EUROPE') ORDER BY ANO, CURSO, UNIDADE LIMIT 1)) f
        LEFT JOIN ({courses(EDITED_UNIT + " WHERE UNIDADE = 'ASIA'", "live", "'GLOBAL'")}) s ON s.CURSO = f.CURSO
        GROUP BY f.CURSO ORDER BY f.CURSO""", more=FUTURE),
    "features": on_panel(
        "SELECT ANO, CURSO, UNIDADE, (6 + (SELECT count(DISTINCT UNIDADE) + count(DISTINCT CURSO) - 2 FROM panel))"
        "::INTEGER AS TAMANHO, (dense_rank() OVER (ORDER BY UNIDADE) - 1)::INTEGER AS POS_UNIDADE, "
        "(dense_rank() OVER (ORDER BY CURSO) - 1)::INTEGER AS POS_CURSO, round(SALARIO_MEDIO + 0.000001, 2) AS SALARIO_MEDIO "
        "FROM panel"),
    "train_and_score": on_panel("SELECT ANO, CURSO, UNIDADE, FAIXA_MAT, true AS SOMA_UM, true AS DOMINANTE_MAIOR "
                                "FROM panel"),
    "evaluate": on_panel(
        f"SELECT count(*)::BIGINT AS N_TESTE, round(avg(-ln(s)), 6) AS LOGLOSS_PARTES, true AS MELHOR FROM ({SPLIT}) t "
        f"JOIN (SELECT FAIXA_MAT, count(*) / sum(count(*)) OVER () AS s FROM ({SPLIT}) WHERE NOT E_TESTE "
        "GROUP BY FAIXA_MAT) USING (FAIXA_MAT) WHERE E_TESTE"),
    "institutions_scraped": f"SELECT NOME, {REAL_NAME} AS INSTITUICAO, sum(n)::BIGINT AS N FROM ({REAL}) GROUP BY ALL",
    "institutions_scraped_column": f"SELECT p_partkey, {REAL_PART_NAME} AS INSTITUICAO FROM ({REAL_PART})",
    "institutions_census": f"SELECT p_partkey, {arms_sql('NOME', fv.CENSUS_INSTITUTIONS)} AS INSTITUICAO FROM "
                           f"({names.with_names_sql('part', 'p_partkey', names.ARM_TEXTS)})",
    "unit_sites": (
        "SELECT c_custkey, CASE u " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in fv.UNIT_RECODE.items())
        + " ELSE u END AS UNIDADE FROM (SELECT c_custkey, trim(regexp_replace(regexp_replace(s, '^SENAI\\s+', ''), "
        r"'\bDENDEZEIROS\b|\bCIMATEC\b', 'SALVADOR', 'g')) AS u FROM (SELECT c_custkey, "
        + names.listed_sql(names.SITES, "c_custkey") + " || ' ' || c_mktsegment AS s FROM customer))"),
    "city_recode": (
        "SELECT CASE c " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in fv.CITY_RECODE.items())
        + " ELSE c END AS CIDADE, count(*) AS N, round(sum(c_acctbal::DECIMAL(18, 2)), 2)::DOUBLE AS SALDO FROM (SELECT *, "
        + names.listed_sql(names.CITIES, "c_custkey") + " AS c FROM customer) GROUP BY ALL"),
    "vector_nan": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x < 0 THEN 0 ELSE x::DOUBLE END)), 4) "
                  "AS SOMA, len(list_filter(embedding, lambda x: x <= 0))::INTEGER AS ZEROS FROM embeddings",
    "trimmed_columns": "SELECT n_regionkey, count(*) AS N, min(n_name) AS PRIMEIRA FROM nation GROUP BY ALL",
    "ready_feed": on_panel("SELECT DISTINCT p.ANO, p.UNIDADE, f.QTD_EMPRESAS FROM panel p JOIN firms f USING (ANO, UNIDADE) "
                           "WHERE f.QTD_EMPRESAS > 0"),
    "empty_selection": on_panel(
        "SELECT s || ' panel' AS SELECAO, (SELECT count(*) FROM panel WHERE UNIDADE = u AND CURSO = coalesce(c, CURSO)) AS N "
        "FROM sel UNION ALL SELECT s || ' history', (SELECT count(DISTINCT CURSO) * (SELECT count(DISTINCT ANO) FROM panel) "
        "FROM panel WHERE UNIDADE = u AND CURSO = coalesce(c, CURSO)) FROM sel UNION ALL SELECT s || ' future', "
        "(SELECT count(DISTINCT CURSO) FROM panel WHERE UNIDADE = u AND CURSO = coalesce(c, CURSO)) FROM sel").replace(
            "WITH ", "WITH sel(s, u, c) AS (VALUES ('ASIA None', 'ASIA', NULL), ('NOWHERE None', 'NOWHERE', NULL), "
            "('ASIA NOTHING', 'ASIA', 'NOTHING')), ", 1),
    "folder_drift": "SELECT c_custkey::VARCHAR AS k, NULL::VARCHAR AS nome, c_acctbal AS saldo, c_nationkey::BIGINT AS nacao "
                    "FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, s_acctbal, s_nationkey FROM supplier",
    "panel_refresh": on_panel("SELECT ANO, CURSO, UNIDADE, CASE WHEN ANO = 1998 THEN -MAT_PAG ELSE MAT_PAG END AS MAT_PAG "
                              "FROM panel"),
    "evaluate_rounds": on_panel(
        "SELECT RODADA::INTEGER AS RODADA, N_TESTE, LOGLOSS_PARTES, MELHOR FROM range(1, 9) r(RODADA), ("
        f"SELECT count(*)::BIGINT AS N_TESTE, round(avg(-ln(s)), 6) AS LOGLOSS_PARTES, true AS MELHOR FROM ({SPLIT}) t "
        f"JOIN (SELECT FAIXA_MAT, count(*) / sum(count(*)) OVER () AS s FROM ({SPLIT}) WHERE NOT E_TESTE "
        "GROUP BY FAIXA_MAT) USING (FAIXA_MAT) WHERE E_TESTE)"),
    "model_roundtrip": on_panel("SELECT count(*)::BIGINT AS N, 0::BIGINT AS DIFERENTES FROM panel"),
}
