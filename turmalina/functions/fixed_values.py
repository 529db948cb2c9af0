"""Fixed values of the domain: names, patterns, cut points and labels.

Everything in this module is data that decides results (which spelling maps to
which, where a band starts, what a message says).  Nothing here is logic.
"""

# --- Fixed values: classes of the enrolment band, and their cut points -------
BAND_LOW = "Abaixo de 21"
BAND_MID = "Entre 21 e 40"
BAND_HIGH = "Acima de 40"
BAND_LOW_MAX = 20
BAND_MID_MAX = 40

# --- Fixed values: age bands, (upper age, label); the last one is open -------
AGE_BANDS = [
    (14, "Menor de 14 anos"),
    (17, "14 a 17"),
    (24, "18 a 24"),
    (30, "25 a 30"),
    (39, "31 a 39"),
    (50, "40 a 50"),
    (59, "51 a 59"),
]
AGE_BAND_OPEN = (60, "+ 60")
AGE_BAND_NONE = "Sem faixa"

# --- Fixed values: years -----------------------------------------------------
ENROLMENT_YEAR_CAP = 2025
FLOW_YEARS = [2023, 2024, 2025]
BENEFIT_YEARS = [2023, 2024, 2025]
LAGGED_YEARS = [2022, 2023, 2024]
SCRAPE_YEAR_RECODE = {2026: 2025}
FUTURE_YEAR = 2026

# --- Fixed values: job-flow filters (wage range in minimum wages of 2025) ----
MINIMUM_WAGE = 1518
WAGE_RANGE = (0.3 * MINIMUM_WAGE, 150 * MINIMUM_WAGE)
INTERMITTENT_CATEGORY = 111
STATE = "BA"

# --- Fixed values: texts of the enrolment cube -------------------------------
OWN_INSTITUTION = "SENAI"
SUBTOTAL_WORD = "total"
SUBTOTAL_COLUMNS = [
    "TIPO_ALUNO", "TIPO_MATRICULA", "SITUACAO_CURSO", "SITUAÇÃO_MAT_PERIODO_LETIVO",
    "TIPO_GRATUIDADE", "UNIDADE", "CURSO", "MODALIDADE", "TURNO", "PERIODO_LETIVO",
    "PERIODO_ALUNO", "IDADE", "CPF", "RA", "SEXO", "CIDADE",
]
UNIT_PREFIX_PATTERN = r"^SENAI\s+"
UNIT_CAPITAL_PATTERN = r"\bDENDEZEIROS\b|\bCIMATEC\b"
UNIT_CAPITAL = "SALVADOR"
COURSE_PREFIX_PATTERN = r"^TÉCNICO\s+EM\s+"
UNIT_RECODE = {
    "LEM": "LUÍS EDUARDO MAGALHÃES",
    "FEIRA": "FEIRA DE SANTANA",
    "CONQUISTA": "VITÓRIA DA CONQUISTA",
}
CITY_RECODE = {
    "ARAÇAS": "ARAÇÁS",
    "SANTO ESTEVÃO": "SANTO ESTÊVÃO",
    "SAO SEBASTIAO DO PASSE": "SÃO SEBASTIÃO DO PASSÉ",
    "NOVO HORIZONTE": "CAMAÇARI",
    "PETROLINA": "JUAZEIRO",
    "PORTO ALEGRE DO TOCANTINS": "LUÍS EDUARDO MAGALHÃES",
    "TAMBAÚ": "CAMAÇARI",
}

# --- Fixed values: texts of the course catalogue and itineraries -------------
TITLE_PREFIXES = ["TÉCNICO EM ", "TECNÓLOGO EM "]
CATALOGUE_DROPPED = [
    "Eixo Tecnológico", "Área Tecnológica", "Perfil Profissional de Conclusão",
    "Carga Horária Mínima", "Pré-Requisitos para Ingresso",
    "Descrição Carga Horária Mínima", "Campo de Atuação",
]
UNCLASSIFIED_OCCUPATION = "Ocupação ainda não classificada"
OCCUPATION_CODE_PATTERN = r"(\d{4}\s*-\s*\d{2}|\d{6}|\d{4})"
ITINERARY_REPAIRS = [
    ("Curso Superior de Tecnologia em Agroecologia", "Curso Superior de Tecnologia em Agroecologia"),
    ("Bacharealdo em Negócios da Moda", "Bacharelado em Negócios da Moda"),
]
ITINERARY_CLASSES = [
    ("Especialização Técnica em ", "POSTEC"),
    ("Bacharelado |Bacharel |Licenciatura |Curso Superior de Tecnologia |Graduação |Bacharelado/Licenciatura ", "GRAD"),
]
ITINERARY_CLASS_OTHER = "FIC"
ITINERARY_EXCLUDED = "Sugestões de |Não identificadas|Não há|O curso não prevê|:"
ITEM_CLASSES = [("Aperfeiçoamento|Especialista|Especialização", "CAEP")]
TECHNICAL = "CHP"

# --- Fixed values: census filters and labels ---------------------------------
CENSUS_LOCATION = "0"
CENSUS_COURSE_EXCLUDED = "%MAGISTÉRIO%"
CENSUS_PRIVATE_CODE = 4
CENSUS_PRIVATE = "PRIVADA"
CENSUS_PUBLIC = "PÚBLICA"
MODE_RECODE = {"Educação Presencial": "PRES", "Educação a Distância": "EAD"}

# --- Fixed values: municipality names written without accents ----------------
MUNICIPALITY_ACCENTS = {
    "CAMACARI": "CAMAÇARI",
    "EUNAPOLIS": "EUNÁPOLIS",
    "ILHEUS": "ILHÉUS",
    "VITORIA DA CONQUISTA": "VITÓRIA DA CONQUISTA",
    "JEQUIE": "JEQUIÉ",
    "LUIS EDUARDO MAGALHAES": "LUÍS EDUARDO MAGALHÃES",
    "SENHOR DO BONFIN": "SENHOR DO BONFIM",
    "SANTO ANTONIO DE JESUS": "SANTO ANTÔNIO DE JESUS",
    "SAO GONCALO DOS CAMPOS": "SÃO GONÇALO DOS CAMPOS",
    "SAO SEBASTIAO DO PASSE": "SÃO SEBASTIÃO DO PASSE",
    "SAO FELIPE": "SÃO FELIPE",
    "SAO FRANCISCO DO CONDE": "SÃO FRANCISCO DO CONDE",
    "SIMOES FILHO": "SIMÕES FILHO",
}
# The job-flow extract has one spelling more.
MUNICIPALITY_ACCENTS_FLOW = {**MUNICIPALITY_ACCENTS, "SANTA TEREZINHA": "SANTA TERESINHA"}

# --- Fixed values: scenario factors (unknown names behave like "base") -------
SCENARIO_MEASURES = ["SALDO_EMPREGO", "QTD_CONC", "SALARIO_MEDIO", "VLR_MEDIO_BENEFICIO"]
SCENARIOS = {
    "base": (1.0, 1.0, 1.0, 1.0),
    "conservador": (1.00, 1.02, 1.05, 1.02),
    "otimista": (1.20, 1.0, 1.10, 1.03),
}

# --- Fixed values: display names ---------------------------------------------
DISPLAY_NAMES = {
    "QTD_CONC": "CONCORRÊNCIA)",
    "QTD_EMPRESAS": "EMPRESAS (RAIS)",
    "SALARIO_MEDIO": "SALÁRIO MÉDIO (CAGED)",
    "SALDO_EMPREGO": "SALDO EMPREGO (CAGED)",
    "VLR_MEDIO_BENEFICIO": "VALOR MÉDIO BOLSA FAMÍLIA",
    "MAT_PAG": "MATR.(SENAI)",
    "FAIXA_MAT": "FAIXA DE MATR. (SENAI)",
}
COURSE_HEADER = "Curso Técnico"
SCENARIO_HEADERS = {"base": "Base", "conservador": "Conservador", "otimista": "Otimista"}
WHATIF_HEADER = "Simulado"

# --- Fixed values: recommendation marks and texts ----------------------------
MARK_STRONG = "✅"
MARK_GOOD = "🟢"
MARK_CAUTION = "🟡"
MARK_LOW = "🔴"
MARK_UNCLEAR = "⚠️"
STRONG_PROBABILITY = 0.70
ADVICE = [
    # (band, lowest probability, text)
    (BAND_HIGH, 0.70, "✅ Recomendar fortemente a oferta"),
    (BAND_HIGH, 0.50, "🟢 Recomendar a oferta"),
    (BAND_MID, 0.50, "🟡 Oferta com cautela"),
    (BAND_LOW, 0.60, "🔴 Não priorizar oferta"),
]
ADVICE_OTHER = "⚠️ Analisar manualmente"

# --- Fixed values: status messages (%s / %.1f are filled per row) ------------
EXECUTIVE_FLOOR = 0.69
RELEVANT_POINTS = 1.0
EXECUTIVE_LOW_LABEL = "Abaixo de 21 matrículas"
LEVEL_WARNING = "warning"
LEVEL_INFO = "info"
LEVEL_SUCCESS = "success"
TEXT_LOW = (
    "O cenário atual apresenta **baixa demanda**, com **%.1f%%** de probabilidade concentrada na "
    "faixa **abaixo de 21 matrículas**. Esse patamar indica um **contexto desfavorável**, que tende "
    "a se manter na ausência de mudanças estruturais. A recomendação é utilizar o **simulador** para "
    "avaliar quais variáveis podem contribuir para a reversão desse cenário."
)
TEXT_MID = (
    "O cenário atual indica **demanda intermediária**, com **%.1f%%** de probabilidade na faixa "
    "**entre 21 e 40 matrículas**. Esse resultado sugere **equilíbrio**, ainda com espaço para "
    "evolução. A recomendação é monitorar os fatores de mercado e, se necessário, avaliar ajustes "
    "por meio do **simulador**."
)
TEXT_HIGH_RISK = (
    "O cenário atual é **altamente favorável**, com **%.1f%%** de probabilidade na faixa **acima de "
    "40 matrículas**. O modelo indica, contudo, que variáveis como **%s** representam **fatores de "
    "atenção**, pois podem provocar deslocamentos marginais do perfil de demanda. A recomendação é "
    "**manter a estratégia atual** e **monitorar a evolução desses indicadores**."
)
TEXT_HIGH = (
    "O cenário atual é **altamente favorável**, com **%.1f%%** de probabilidade na faixa **acima de "
    "40 matrículas**. Não há sinais relevantes de risco no curto prazo. A recomendação é **manter a "
    "estratégia vigente**."
)
TEXT_BALANCED = (
    "O cenário atual apresenta comportamento equilibrado. Recomenda-se acompanhamento contínuo."
)
TEXT_WHATIF_STABLE = (
    "As alterações realizadas não provocaram mudanças relevantes no cenário projetado. O perfil de "
    "demanda permanece estável."
)
TEXT_WHATIF_SHIFT = (
    "No cenário simulado, a faixa dominante passa a ser **%s**. O modelo indica que as mudanças "
    "realizadas afetam principalmente **%s**, resultando em **deslocamento do perfil de demanda** em "
    "relação ao cenário atual."
)

# --- Fixed values: institution names of the census, first matching arm wins --
CENSUS_INSTITUTIONS = [
    ("=", "CENTRO ESTADUAL DE EDUCACAO PROFISSIONAL", "CEEP"),
    ("=", "CENTRO EST DE ED PROFISSIONAL", "CEEP"),
    ("=", "CENTRO EST DE EDUC PROFISSIONAL", "CEEP"),
    ("=", "CENTRO TERRITORIAL DE EDUCAÇÃO PROFISSIONAL", "CTEP"),
    ("=", "CENTRO DE EDUCAÇÃO PROFISSIONAL COMÉRCIO", "SENAC"),
    ("=", "CENTRO DE EDUCAÇÃO PROFISSIONAL SENAC CASA DO COMÉRCIO", "SENAC"),
    ("=", "CENTRO DE EDUCAÇÃO PROFISSIONAL SENAC LAURO DE FREITAS", "SENAC"),
    ("=", "CENTRO DE EDUCAÇÃO PROFISSIONAL DE ALAGOINHAS CEP ALH", "SENAC"),
    ("LIKE", "%SENAC%", "SENAC"),
    ("=", "CENTRO DE EDUCACAO PROFISSIONAL", "CEP"),
    ("=", "CENTRO EDUCACIONAL MUNICIPAL", "CEM"),
    ("=", "CENTRO DE EDUCACAO", "CE"),
    ("=", "CENTRO EDUCACIONAL", "CE"),
    ("=", "CASA FAMILIAR AGROFLORESTAL", "CFA"),
    ("=", "CASA FAMILIAR RURAL", "CFR"),
    ("=", "CENTRO DE ENSINO GRAU T UNIDADE CAJAZEIRAS", "GRAU TÉCNICO"),
    ("LIKE", "%GRAU TÉCNICO%", "GRAU TÉCNICO"),
    ("LIKE", "%GRAUTECNICO%", "GRAU TÉCNICO"),
    ("LIKE", "%GRAU TECNICO%", "GRAU TÉCNICO"),
    ("=", "CENTRO DE EXCELÊNCIA EM FRUTICULTURA", "SENAR"),
    ("LIKE", "%SENART%", "SENART"),
    ("LIKE", "%CRUZEIRO DO SUL%", "UNICSUL"),
    ("LIKE", "%UNICSUL%", "UNICSUL"),
    ("LIKE", "%SE7E CENTRO%", "SE7E CENTRO TECNOLÓGICO"),
    ("=", "PROCURSOS SERVIÇOS DE EDUCAÇÃO", "PROCURSOS"),
    ("=", "CENTRO DE ESTUDOS TÉCNICOS, TREINAMENTOS PROFISSIONAIS E SERVIÇOS - CETTPS", "CETTP'S - CETTPS"),
    ("LIKE", "%COLEGIO ESTADUAL CARLITO DE CARVALHO%", "COLEGIO ESTADUAL CARLITO DE CARVALHO"),
    ("LIKE", "%CENTRO ESTADUAL DE EDUCACAO PROFISSIONAL AGUAS%", "CENTRO ESTADUAL DE EDUCACAO PROFISSIONAL AGUAS"),
    ("LIKE", "%CENTRO ESTADUAL DE EDUCACAO PROFISSIONAL DO SEMI ARIDO%", "CENTRO ESTADUAL DE EDUCACAO PROFISSIONAL DO SEMI ARIDO"),
    ("LIKE", "%CENTRO TERRITORIAL DE EDUCACAO PROFISSIONAL DA BACIA DO JACUIPE IIIEDNA DALTRO EM TEMPO INTEGRAL%", "CENTRO TERRITORIAL DE EDUCACAO PROFISSIONAL DA BACIA DO JACUIPE IIIEDNA DALTRO"),
    ("LIKE", "%CENTRO TERRITORIAL DE EDUCACAO PROFISSIONAL DA CHAPADA DIAMANTINA TEMPO INTEGRAL%", "CENTRO TERRITORIAL DE EDUCACAO PROFISSIONAL DA CHAPADA DIAMANTINA"),
    ("LIKE", "%CENTRO TERRITORIAL DE EDUCACAO PROFISSIONAL DE MEDEIROS NETO TEMPO INTEGRAL%", "CENTRO TERRITORIAL DE EDUCACAO PROFISSIONAL DE MEDEIROS NETO"),
    ("LIKE", "%COLEGIO DEMOCRATICO ESTADUAL ANISIO TEIXEIRA TEMPO INTEGRAL%", "COLEGIO DEMOCRATICO ESTADUAL ANISIO TEIXEIRA"),
    ("LIKE", "%COLEGIO ESTADUAL ANTONIO CARLOS MAGALHAES TEMPO INTEGRAL%", "COLEGIO ESTADUAL ANTONIO CARLOS MAGALHAES"),
    ("LIKE", "%COLEGIO ESTADUAL ANTONIO RODRIGUES VIANA TEMPO INTEGRAL%", "COLEGIO ESTADUAL ANTONIO RODRIGUES VIANA"),
    ("LIKE", "%COLEGIO ESTADUAL ARISTIDES CEDRAZ DE OLIVEIRA TEMPO INTEGRAL%", "COLEGIO ESTADUAL ARISTIDES CEDRAZ DE OLIVEIRA"),
    ("LIKE", "%COLEGIO ESTADUAL CONCEICAO DO JACUIPE TEMPO INTEGRAL%", "COLEGIO ESTADUAL CONCEICAO DO JACUIPE"),
    ("LIKE", "%COLEGIO ESTADUAL DE BOQUIRA TEMPO INTEGRAL%", "COLEGIO ESTADUAL DE BOQUIRA"),
    ("LIKE", "%COLEGIO ESTADUAL DE COCOS TEMPO INTEGRAL", "COLEGIO ESTADUAL DE COCOS"),
    ("LIKE", "%COLEGIO ESTADUAL DE CONCEICAO DA FEIRA CECF TEMPO INTEGRAL%", "COLEGIO ESTADUAL DE CONCEICAO DA FEIRA CECF"),
    ("LIKE", "%COLEGIO ESTADUAL DE CORRENTINA %", "COLEGIO ESTADUAL DE CORRENTINA"),
    ("LIKE", "%COLEGIO ESTADUAL DE IBIQUERA TEMPO INTEGRAL%", "COLEGIO ESTADUAL DE IBIQUERA"),
    ("LIKE", "%COLEGIO ESTADUAL DE JEQUIE TEMPO INTEGRAL%", "COLEGIO ESTADUAL DE JEQUIE"),
    ("LIKE", "%COLEGIO ESTADUAL DE MALHADA DE PEDRAS TEMPO INTEGRAL%", "COLEGIO ESTADUAL DE MALHADA DE PEDRAS"),
    ("LIKE", "%COLEGIO ESTADUAL DE TEMPO INTEGRAL RUI BARBOSA TEMPO INTEGRAL%", "COLEGIO ESTADUAL DE RUI BARBOSA"),
    ("LIKE", "%COLEGIO ESTADUAL DEMOCRATICO QUITERIA MARIA DE JESUS TEMPO INTEGRAL%", "COLEGIO ESTADUAL DEMOCRATICO QUITERIA MARIA DE JESUS"),
    ("LIKE", "%COLEGIO ESTADUAL DINAH GONCALVES TEMPO INTEGRAL%", "COLEGIO ESTADUAL DINAH GONCALVES"),
    ("LIKE", "%COLEGIO ESTADUAL DO CAMPO ANNA JUNQUEIRA AYRES TOURINHO TEMPO INTEGRAL DISTRITO DE MATARIPE%", "COLEGIO ESTADUAL DO CAMPO ANNA JUNQUEIRA AYRES TOURINHO DISTRITO DE MATARIPE"),
    ("LIKE", "%COLEGIO ESTADUAL DO CAMPO DE CARNAIBA TEMPO INTEGRAL DISTRITO DE CARNAIBA%", "COLEGIO ESTADUAL DO CAMPO DE CARNAIBA DISTRITO DE CARNAIBA"),
    ("LIKE", "%COLEGIO ESTADUAL DO CAMPO MIGUEL MOREIRA DE CARVALHO DIST RODA VELHA%", "COLEGIO ESTADUAL DO CAMPO MIGUEL MOREIRA DE CARVALHO DIST RODA VELHA"),
    ("LIKE", "%COLEGIO ESTADUAL DO CAMPO JORGE CALMON DISTRITO DE OLIVENCA TEMPO INTEGRAL%", "COLEGIO ESTADUAL DO CAMPO JORGE CALMON DISTRITO DE OLIVENCA"),
    ("LIKE", "%COLEGIO ESTADUAL DO CAMPO MIGUEL MOREIRA DE CARVALHO DIST RODA VELHA%", "COLEGIO ESTADUAL DO CAMPO MIGUEL MOREIRA DE CARVALHO DISTRITO DE RODA VELHA"),
    ("LIKE", "%COLEGIO ESTADUAL DO STIEP CARLOS MARIGHELLA TEMPO INTEGRAL%", "COLEGIO ESTADUAL DO STIEP CARLOS MARIGHELLA"),
    ("LIKE", "%COLEGIO ESTADUAL DOM PEDRO I TEMPO INTEGRAL%", "COLEGIO ESTADUAL DOM PEDRO I"),
    ("LIKE", "%COLEGIO ESTADUAL DR ANTONIO CARLOS MAGALHAES TEMPO INTEGRAL%", "COLEGIO ESTADUAL DR ANTONIO CARLOS MAGALHAES"),
    ("LIKE", "%COLEGIO ESTADUAL DOUTOR IVES ORLANDO LOPES DA SILVA TEMPO INTEGRAL%", "COLEGIO ESTADUAL DOUTOR IVES ORLANDO LOPES DA SILVA"),
    ("LIKE", "%COLEGIO ESTADUAL DOUTOR JOSE ANTONIO DE ARAUJO PIMENTA TEMPO INTEGRAL%", "COLEGIO ESTADUAL DOUTOR JOSE ANTONIO DE ARAUJO PIMENTA"),
    ("LIKE", "%COLEGIO ESTADUAL EDVALDO FLORES TEMPO INTEGRAL%", "COLEGIO ESTADUAL EDVALDO FLORES"),
    ("LIKE", "%COLEGIO ESTADUAL ERALDO TINOCO TEMPO INTEGRAL%", "COLEGIO ESTADUAL ERALDO TINOCO"),
    ("LIKE", "%COLEGIO ESTADUAL ERNESTO CARNEIRO RIBEIRO TEMPO INTEGRAL%", "COLEGIO ESTADUAL ERNESTO CARNEIRO RIBEIRO"),
    ("LIKE", "%COLEGIO ESTADUAL EVANDRO BRANDAO TEMPO INTEGRAL%", "COLEGIO ESTADUAL EVANDRO BRANDAO"),
    ("LIKE", "%COLEGIO ESTADUAL GENTIL PARAISO MARTINS TEMPO INTEGRAL%", "COLEGIO ESTADUAL GENTIL PARAISO MARTINS"),
    ("LIKE", "%COLEGIO ESTADUAL GOVERNADOR LUIZ VIANA FILHO TEMPO INTEGRAL%", "COLEGIO ESTADUAL GOVERNADOR LUIZ VIANA FILHO"),
    ("LIKE", "%COLEGIO ESTADUAL GRANDES MESTRES BRASILEIROS EM TEMPO INTEGRAL%", "COLEGIO ESTADUAL GRANDES MESTRES BRASILEIROS"),
    ("LIKE", "%COLEGIO ESTADUAL GRANDES MESTRES BRASILEIROS TEMPO INTEGRAL%", "COLEGIO ESTADUAL GRANDES MESTRES BRASILEIROS"),
    ("LIKE", "%COLEGIO ESTADUAL JOAO BENEVIDES NOGUEIRA EM TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOAO BENEVIDES NOGUEIRA"),
    ("LIKE", "%COLEGIO ESTADUAL JOAO BENEVIDES NOGUEIRA TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOAO BENEVIDES NOGUEIRA"),
    ("LIKE", "%COLEGIO ESTADUAL JORGE CALMON DISTRITO DE OLIVENCA TEMPO INTEGRAL%", "COLEGIO ESTADUAL JORGE CALMON DISTRITO DE OLIVENCA"),
    ("LIKE", "%COLEGIO ESTADUAL JOSE DANTAS DE SOUZA TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOSE DANTAS DE SOUZA"),
    ("LIKE", "%COLEGIO ESTADUAL JOSE DE FREITAS MASCARENHAS TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOSE DE FREITAS MASCARENHAS"),
    ("LIKE", "%COLEGIO ESTADUAL JOSE RIBEIRO DE ARAUJO TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOSE RIBEIRO DE ARAUJO"),
    ("LIKE", "%COLEGIO ESTADUAL JOSE RIBEIRO PAMPONET TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOSE RIBEIRO PAMPONET"),
    ("LIKE", "%COLEGIO ESTADUAL JOSE VICENTE LEAL EM TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOSE VICENTE LEAL"),
    ("LIKE", "%COLEGIO ESTADUAL JOSE VICENTE LEAL TEMPO INTEGRAL%", "COLEGIO ESTADUAL JOSE VICENTE LEAL"),
    ("LIKE", "%COLEGIO ESTADUAL LUIS EDUARDO MAGALHAES TEMPO INTEGRAL%", "COLEGIO ESTADUAL LUIS EDUARDO MAGALHAES"),
    ("LIKE", "%COLEGIO ESTADUAL LUIS NAVARRO DE BRITO TEMPO INTEGRAL%", "COLEGIO ESTADUAL LUIS NAVARRO DE BRITO"),
    ("LIKE", "%COLEGIO ESTADUAL LUIZ ROGERIO DE SOUZA TEMPO INTEGRAL%", "COLEGIO ESTADUAL LUIZ ROGERIO DE SOUZA"),
    ("LIKE", "%COLEGIO ESTADUAL LUIZ VIANA FILHO TEMPO INTEGRAL%", "COLEGIO ESTADUAL LUIZ VIANA FILHO"),
    ("LIKE", "%COLEGIO ESTADUAL LUIZ VIANA TEMPO INTEGRAL%", "COLEGIO ESTADUAL LUIZ VIANA"),
    ("LIKE", "%COLEGIO ESTADUAL MANDINHO DE SOUZA ALMEIDA TEMPO INTEGRAL%", "COLEGIO ESTADUAL MANDINHO DE SOUZA ALMEIDA"),
    ("LIKE", "%COLEGIO ESTADUAL MANOEL FRANCISCO DE CAIRES EM TEMPO INTEGRAL%", "COLEGIO ESTADUAL MANOEL FRANCISCO DE CAIRES"),
    ("LIKE", "%COLEGIO ESTADUAL MARIA OTILIA LUTZ - BAIRRO JARDIM DAS ACACIAS - TEMPO INTEGRAL%", "COLEGIO ESTADUAL MARIA OTILIA LUTZ - BAIRRO JARDIM DAS ACACIAS"),
    ("LIKE", "%COLEGIO ESTADUAL MARIA OTILIA LUTZ BAIRRO JARDIM DAS ACACIAS TEMPO INTEGRAL%", "COLEGIO ESTADUAL MARIA OTILIA LUTZ BAIRRO JARDIM DAS ACACIAS"),
    ("LIKE", "%COLEGIO ESTADUAL MINISTRO OLIVEIRA BRITO - TEMPO INTEGRAL%", "COLEGIO ESTADUAL MINISTRO OLIVEIRA BRITO"),
    ("LIKE", "%COLEGIO ESTADUAL MINISTRO OLIVEIRA BRITO TEMPO INTEGRAL%", "COLEGIO ESTADUAL MINISTRO OLIVEIRA BRITO"),
    ("LIKE", "%COLEGIO ESTADUAL MONSENHOR TURIBIO VILANOVA TEMPO INTEGRAL%", "COLEGIO ESTADUAL MONSENHOR TURIBIO VILANOVA"),
    ("LIKE", "%COLEGIO ESTADUAL NEMISIA RIBEIRO DOS SANTOS TEMPO INTEGRAL%", "COLEGIO ESTADUAL NEMISIA RIBEIRO DOS SANTOS"),
    ("LIKE", "%COLEGIO ESTADUAL NERCY ANTONIO DUARTE TEMPO INTEGRAL%", "COLEGIO ESTADUAL NERCY ANTONIO DUARTE"),
    ("LIKE", "%COLEGIO ESTADUAL NOSSA SENHORA DA CONCEICAO TEMPO INTEGRAL%", "COLEGIO ESTADUAL NOSSA SENHORA DA CONCEICAO"),
    ("LIKE", "%COLEGIO ESTADUAL NOSSA SENHORA DO ROSARIO TEMPO INTEGRAL%", "COLEGIO ESTADUAL NOSSA SENHORA DO ROSARIO"),
    ("LIKE", "%COLEGIO ESTADUAL OCTACILIO MANOEL GOMES TEMPO INTEGRAL%", "COLEGIO ESTADUAL OCTACILIO MANOEL GOMES"),
    ("LIKE", "%COLEGIO ESTADUAL OLAVO ALVES PINTO%", "COLEGIO ESTADUAL OLAVO ALVES PINTO"),
]

# --- Fixed values: institution names of the scraped list, ordered patterns ---
SCRAPED_INSTITUTIONS = [
    ("CENTRO ESTADUAL DE EDUCACAO PROFISSIONAL", "CEEP"),
    ("CENTRO EST DE ED PROFISSIONAL", "CEEP"),
    ("CENTRO EST DE EDUC PROFISSIONAL", "CEEP"),
    ("CENTRO TERRITORIAL DE EDUCAÇÃO PROFISSIONAL", "CTEP"),
    ("CENTRO DE EDUCAÇÃO PROFISSIONAL COMÉRCIO", "SENAC"),
    ("CENTRO DE EDUCAÇÃO PROFISSIONAL SENAC CASA DO COMÉRCIO", "SENAC"),
    ("CENTRO DE EDUCAÇÃO PROFISSIONAL SENAC LAURO DE FREITAS", "SENAC"),
    ("CENTRO DE EDUCAÇÃO PROFISSIONAL DE ALAGOINHAS CEP ALH", "SENAC"),
    ("SENAC CA", "SENAC"),
    ("SENAC CAMAÇARI", "SENAC"),
    ("SENAC CEP FS", "SENAC"),
    ("SENAC CEP PITUBA", "SENAC"),
    ("SENAC CEP PS", "SENAC"),
    ("SENAC CEP SANTO ANTONIO DE JESUS", "SENAC"),
    ("SENAC CEP VC", "SENAC"),
    ("SENAC FEIRA DE SANTANA", "SENAC"),
    ("SENAC SÉ", "SENAC"),
    ("CENTRO DE EDUCACAO PROFISSIONAL", "CEP"),
    ("CENTRO EDUCACIONAL MUNICIPAL", "CEM"),
    ("CENTRO DE EDUCACAO", "CE"),
    ("CENTRO EDUCACIONAL", "CE"),
    ("CASA FAMILIAR AGROFLORESTAL", "CFA"),
    ("CASA FAMILIAR RURAL", "CFR"),
    ("CENTRO DE ENSINO GRAU T UNIDADE CAJAZEIRAS", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO FEIRA DE SANTANA BA", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO UNID VITÓRIA DA CONQUISTA", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO UNIDADE CAMAÇARI", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO UNIDADE PAULO AFONSO BA", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO UNIDADE PLATAFORMA", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO UNIDADE SÃO CRISTÓVÃO", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO JUAZEIRO", "GRAU TÉCNICO"),
    ("CENTRO DE ENSINO GRAU TÉCNICO UNIDADE FONTE NOVA", "GRAU TÉCNICO"),
    ("GRAU TÉCNICO JUAZEIRO", "GRAU TÉCNICO"),
    ("GRAU TÉCNICO UNIDADE FONTE NOVA", "GRAU TÉCNICO"),
    ("CENTRO DE EXCELÊNCIA EM FRUTICULTURA", "SENAR"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL BROTAS_MATATU", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL CAMAÇARI (ALTO DA CRUZ)", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL CONCEIÇÃO DO JACUÍPE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL IPIAÚ _CENTRO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL ITACARÉ", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL JEREMOABO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL MORRO DO CHAPÉU", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL PIRITIBA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POJUCA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO ALAGOINHAS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO ARACI", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO BARRA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO BARRA DA ESTIVA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO BARREIRAS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CACHOEIRA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CAMACAN", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CAMAMU", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CAMAÇARI", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CAMAÇARI_AREMBEPE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CANAVIEIRAS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CANDIDO SALES", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CATU", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CONCEICAO DO COITE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO CONCEIÇAO DA FEIRA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO ENTRE RIOS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO EUCLIDES DA CUNHA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO EUNAPOLIS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO FEIRA DE SANTANA_CID. NOVA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO GANDU", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO GUARATINGA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO IBOTIRAMA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO ILHEUS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO INHAMBUPE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO IRECE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO ITAPETINGA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO ITUBERA_NOBERTO ODEBRECHT", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO JACOBINA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO JOAO DOURADO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO JUAZEIRO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO LUIS EDUARDO MAGALHAES", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO MARACAS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO MUCURI_ITABATA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO NOVA VICOSA_POSTO DA MATA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO OLINDINA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO OLIVEIRA DOS BREJINHOS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO PILAO ARCADO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO PLANALTO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO PORTO SEGURO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO PRADO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO PRESIDENTE TANCREDO NEVES", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO RIBEIRA DO POMBAL", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO RIO REAL", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SALVADOR_CENTENARIO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SALVADOR_LIBERDADE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SALVADOR_LOBATO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SALVADOR_NAZARE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SALVADOR_PARIPE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SALVADOR_ROMA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SALVADOR_SAO CRISTOVAO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SANTA MARIA DA VITÓRIA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SANTALUZ", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SANTO ANTONIO DE JESUS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SANTO ESTEVAO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SATIRO DIAS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SERRINHA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO SIMOES FILHO", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO TANHACU", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO TEIXEIRA DE FREITAS", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO TEOFILANDIA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO VALENCA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO VALENTE", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL POLO VITORIA DA CONQUISTA", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL PORTO SEGURO (PARQUE ECOLÓGICO)", "UNICSUL"),
    ("UNIVERSIDADE CRUZEIRO DO SUL UNICSUL VERA CRUZ", "UNICSUL"),
    ("UNICSUL_AREMBEPE", "UNICSUL"),
    ("SE7E CENTRO TECNOLÓGICO REMANSO", "SE7E CENTRO TECNOLÓGICO"),
    ("SE7E CENTRO TECNOLÓGICO SALVADOR", "SE7E CENTRO TECNOLÓGICO"),
    ("PROCURSOS SERVIÇOS DE EDUCAÇÃO", "PROCURSOS"),
    ("CENTRO DE ESTUDOS TÉCNICOS, TREINAMENTOS PROFISSIONAIS E SERVIÇOS - CETTPS", "CETTP'S - CETTPS"),
]
