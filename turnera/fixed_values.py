"""Fixed values.

Every value below is part of the data contract: results are only right when they
hold exactly these names, words, patterns and numbers.  They are kept together, as
plain text and in their order of precedence; the code that interprets them lives in
``turnera.functions`` and ``turnera.operators``.

Patterns use the usual Unicode meaning of ``\\b \\w \\d \\s``; they are matched
against folded, lower-case text (see ``functions.text.matching_form``).
"""

from decimal import Decimal

# --- column contract ---------------------------------------------------------

REQUIRED_COLUMNS = ("paciente_id", "mensaje_texto")

COLUMN_ALIASES = {
    "id_paciente": "paciente_id",
    "mensaje": "mensaje_texto",
    "especialidad_medica": "especialidad",
}

EXTRACTED_COLUMNS = ("accion", "especialidad", "fecha_solicitada", "preferencia_horario")

RESULT_COLUMNS = {
    "paciente_id": "string",
    "paciente": "string",
    "mensaje_texto": "string",
    "mensaje_limpio": "string",
    "mensaje_ingles": "string",
    "accion": "string",
    "especialidad": "string",
    "fecha_solicitada": "string",
    "preferencia_horario": "string",
    "tokens_original": "int",
    "tokens_limpio": "int",
    "tokens_ingles": "int",
    "costo_estimado_original": "double",
    "costo_estimado_limpio": "double",
    "costo_estimado_ingles": "double",
}

VARIANTS = {
    "original": "mensaje_texto",
    "limpio": "mensaje_limpio",
    "ingles": "mensaje_ingles",
}

WITHOUT_ACTION = "(sin accion)"
WITHOUT_SPECIALTY = "(sin especialidad)"

# --- text cleaning -----------------------------------------------------------

COURTESIES = (
    "por favor",
    "porfavor",
    "muchas gracias",
    "gracias",
    "buenos dias",
    "buenas tardes",
    "buenas noches",
    "hola",
    "buen dia",
    "muy amable",
    "saludos",
    "cordialmente",
    "atentamente",
    "urgente",
    "con gusto",
    "para su atencion",
    "le agradezco",
    "agradezco",
    "solicito de manera respetuosa",
    "adjunto",
)

CLOSINGS = (
    "saludos a",
    "quedo a su disposicion",
    "muchas gracias de antemano",
)

KEPT_MARKS = ".,:;¿?¡!/()-"
EDGE_MARKS = " .,;:¿?¡!"

FOLD_FROM = "áéíóúüñÁÉÍÓÚÜÑ"
FOLD_TO = "aeiouunAEIOUUN"

# --- extraction rules --------------------------------------------------------

ACTION_VETOES = (r"\bno quiero confirmar\b", r"\bdesconfirmar\b")

ACTION_RULES = {
    "cancelar": (
        r"\bcancel(ar|acion|a|ado|arlo|o)?\b",
        r"\banul(ar|acion|a|ado)?\b",
        r"\bno (podre|voy a poder|puedo) asistir\b",
        r"\bno asistire\b",
        r"\bno (me|voy a) presentar(e)?\b",
        r"\bdar de baja\b",
        r"\bborrar la cita\b",
    ),
    "reprogramar": (
        r"\breprogram(ar|acion|a|ado|arlo)?\b",
        r"\breagend(ar|amiento|a)?\b",
        r"\bcambiar (la fecha|la cita|de fecha|el dia|el horario)\b",
        r"\bmodificar (la fecha|el horario|mi cita|la cita|mi turno)\b",
        r"\bmover (la cita|la fecha|mi cita)\b",
        r"\bposponer\b",
        r"\bposterg(ar|arla|arlo|acion|amiento)\b",
        r"\baplazar\b",
        r"\badelantar (mi turno|mi cita|el turno|la cita|mi consulta|la consulta|mi control)\b",
        r"\bagendar (para|otra vez|de nuevo|nuevamente)\b",
        r"\bfecha alternativa\b",
    ),
    "confirmar": (
        r"\bconfirm(ar|acion|o|a|amos|andola|andolo)?\b",
        r"\breafirm(ar|acion|o)?\b",
        r"\bsi, quiero (mantener|confirmar)\b",
        r"\bconfirmada\b",
    ),
}

SPECIALTY_RULES = {
    "cardiologia": (r"\bcardio\w*",),
    "dermatologia": (r"\bdermatolo\w*", r"\bpiel\b"),
    "ginecologia": (r"\bgineco\w*",),
    "pediatria": (r"\bpediatra\w*", r"\bpedia\w*"),
    "medicina general": (r"\bmedicina general\b", r"\bmedico general\b", r"\bgeneralista\b"),
    "oftalmologia": (r"\boftalmo\w*", r"\bojo\b", r"\bojos\b"),
    "otorrinolaringologia": (r"\boto(rrino|rinola)?\w*",),
    "traumatologia": (r"\btraumat\w*",),
    "neurologia": (r"\bneuro\w*",),
    "psicologia": (r"\bpsicolo\w*", r"\bpsiquiatra\w*", r"\bpsiquiatria\b"),
    "odontologia": (r"\bodonto\w*", r"\bdentista\b", r"\bdental\b"),
    "urologia": (r"\burolog\w*",),
    "endocrinologia": (r"\bendocrin\w*",),
    "gastroenterologia": (r"\bgastro(enterol)?\w*", r"\bgastro\b"),
    "nutricion": (r"\bnutricio\w*", r"\bnutriolog\w*"),
    "fisioterapia": (r"\bfisio\w*",),
    "oncologia": (r"\boncolog\w*",),
    "nefrologia": (r"\bnefrolog\w*",),
    "reumatologia": (r"\breumat\w*",),
    "geriatria": (r"\bgeriatr\w*", r"\bgeronto\w*"),
    "maternidad": (r"\bmatemidad\b", r"\bembarazo\b", r"\bobstetricia\b", r"\bobstetra\b"),
    "laboratorio": (r"\blaboratorio\b", r"\bexamenes?\b", r"\banalisis\b", r"\bprueba de sangre\b"),
    "radiologia": (
        r"\bradiolog\w*",
        r"\brayos x\b",
        r"\bresonancia\b",
        r"\becografia\b",
        r"\beco \b",
    ),
    "vacunacion": (r"\bvacun(a|acion|as)\b", r"\bvacuna\b"),
}

DATE_RULES = (
    r"\b(el|la|para el|para|en el)\s+\d{1,2}\s+de\s+(enero|febrero|marzo|abril|mayo|junio"
    r"|julio|agosto|septiembre|octubre|noviembre|diciembre)\b",
    r"\bdia\s+\d{1,2}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}(/\d{2,4})?\b",
    r"\bpasado manana\b",
    r"\bproxima semana\b",
    r"\bproximo mes\b",
    r"\bsemana (que viene|siguiente|entrante)\b",
    r"\bla (proxima|siguiente) semana\b",
    r"\beste\s+(lunes|martes|miercoles|jueves|viernes|sabado|domingo)\b",
    r"\b(lunes|martes|miercoles|jueves|viernes|sabado|domingo)\b",
    r"\bmanana\b",
)

TIME_RULES = (
    r"\b(por|en|para|durante)\s+(la\s+)?manana\b",
    r"\b(por|en|para|durante)\s+(la\s+)?tarde\b",
    r"\b(por|en|para|durante)\s+(la\s+)?noche\b",
    r"\b(horario|turno|agenda) de la (manana|tarde|noche)\b",
    r"\bprimeras horas del dia\b",
    r"\bprimera hora\b",
    r"\bmediodia\b",
    r"\bmedio dia\b",
    r"\b(a las|alas|a eso de|sobre)\s+\d{1,2}(:\d{2})?\s*(am|pm)?\b",
    r"\b\d{1,2}(:\d{2})?\s*(am|pm)\b",
    r"\ben la manana\b",
    r"\ben la tarde\b",
    r"\bmanana temprano\b",
    r"\bde la (manana|tarde|noche)\b",
    r"\bpor la mananita\b",
)

# --- tokens, memo, costs -----------------------------------------------------

#: Split pattern of the public ``o200k_base`` encoding, for a caller's rank file.
O200K_SPLIT = "|".join(
    (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    )
)

MEMO_KEY_PREFIX = "tr_es_en:"
MEMO_KEY_HEX_DIGITS = 16
#: Tokens of a batch for a translation engine.
TOKENS_PER_BATCH = 1024
MEMO_TTL_DAYS = 30

RATE_USD_PER_MILLION = Decimal("2.50")
MESSAGES_PER_DAY = 15_000
PERIOD_DAYS = {"diario": 1, "mensual": 30, "trimestral": 90, "anual": 365}

#: Cell texts that a spreadsheet reader treats as "no value" (the pandas default set).
MISSING_CELL_TEXTS = frozenset(
    (
        "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
        "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
    )
)

# --- generated requests ------------------------------------------------------

EMPTY_MESSAGE_PERCENT = 10
FIRST_DAY_AHEAD, LAST_DAY_AHEAD = 2, 30
