"""Request tables made by Spark: a view over given tables, and a generator.

``solicitudes`` words appointment requests from the keys of an orders and a customer
table, so that every cleaning and extraction rule has something to find.  ``generate``
and ``generate_from`` make synthetic requests for any number of keys; a row depends on
nothing but its key and the seed, so any partitioning gives the same table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera.fixed_values import EMPTY_MESSAGE_PERCENT, FIRST_DAY_AHEAD, LAST_DAY_AHEAD, SPECIALTY_RULES
from turnera.functions.text import sql_text
from turnera.session import at_least

# --- words of the derived view: one phrase per rule, in rule order ------------

GREETINGS = ("Hola, ", "Buenos días, ", "Buenas tardes, por favor ", "¡Hola! ", "")

ACTIONS = (
    "quiero cancelar mi cita", "necesito anular la hora", "no podré asistir", "no asistiré",
    "no me presentaré", "pido dar de baja mi reserva", "les ruego borrar la cita",
    "deseo reprogramar el control", "quisiera reagendar", "necesito cambiar la fecha",
    "solicito modificar mi turno", "pido mover la cita", "prefiero posponer la visita",
    "me gustaría postergar la visita", "hace falta aplazar la revisión",
    "¿se puede adelantar mi consulta?", "vuelvo a agendar de nuevo", "busco una fecha alternativa",
    "confirmo mi cita", "reafirmo la reserva", "sí, quiero mantener la hora",
    "queda confirmada la visita", "no quiero confirmar todavía", "",
)

SPECIALTIES = (
    "con cardiología", "con el dermatólogo", "por una mancha en la piel", "con la ginecóloga",
    "con la pediatra", "en pediatría", "en medicina general", "con el médico general",
    "con un generalista", "en oftalmología", "por el ojo derecho", "por los ojos",
    "con el otorrino", "en traumatología", "con neurología", "con la psicóloga",
    "con el psiquiatra", "en psiquiatría", "en odontología", "con el dentista",
    "para control dental", "en urología", "con el endocrino", "con la gastroenteróloga",
    "del gastro", "con la nutricionista", "con el nutriólogo", "de fisioterapia",
    "en oncología", "con nefrología", "en reumatología", "en geriatría", "de gerontología",
    "en la sala de matemidad", "por mi embarazo", "en obstetricia", "con la obstetra",
    "en el laboratorio", "por unos exámenes", "por los análisis", "para la prueba de sangre",
    "en radiología", "para rayos x", "por la resonancia", "de la ecografía",
    "para un eco abdominal", "de vacunación", "por la vacuna", "antes del otoño", "",
)

DATES = (
    "el 15 de mayo", "el día 8", "2025-03-04", "07/04/25", "pasado mañana", "la próxima semana",
    "el próximo mes", "la semana que viene", "la siguiente semana", "este lunes", "el jueves",
    "mañana", "",
)

TIMES = (
    "por la mañana", "para la tarde", "durante la noche", "en el turno de la tarde",
    "en las primeras horas del día", "a primera hora", "al mediodía", "al medio día",
    "a las 9:30 am", "10 pm", "en la mañana", "en la tarde", "mañana temprano", "de la noche",
    "por la mañanita", "",
)

TAILS = (
    "Gracias por su ayuda.", "Si no se puede, prefiero cancelar.",
    "Escribir a recepcion@sede #turnos 100%", "Espero respuesta\nhoy\r\nmismo", "saludos a todos",
    "Muchas gracias de antemano por la gestión", "",
)

REPEATED = (
    "Quiero confirmar mi cita de cardiología",
    "quiero  CONFIRMAR mi cita de cardiologia",
    "Buenas tardes, cancelar mi turno de las 10 am saludos a la doctora",
    "Necesito reprogramar: dentista #2 (urgente) @ sede norte, por favor",
    "Hola, mi hijo tiene fiebre\ny no podré asistir mañana",
    "¿Pueden adelantar mi consulta? Muchas gracias",
)


def _pick(words: tuple[str, ...], index: str) -> Column:
    return F.expr(f"element_at(array({', '.join(map(sql_text, words))}), cast({index} + 1 as int))")


def solicitudes(orders: DataFrame, customers: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Requests worded from order keys; ``paciente`` is only there if customers are given.

    ``partitions`` deals the rows out before they are worded, after names have met them.
    """
    k = F.col("o_orderkey")
    composed = F.concat(
        _pick(GREETINGS, "(o_orderkey div 5) % 5"),
        _pick(ACTIONS, "o_orderkey % 24"), F.lit(" "),
        _pick(SPECIALTIES, "(o_orderkey div 24) % 50"), F.lit(" "),
        _pick(DATES, "(o_orderkey div 7) % 13"), F.lit(" "),
        _pick(TIMES, "(o_orderkey div 11) % 16"), F.lit(". "),
        _pick(TAILS, "o_orderkey % 7"),
    )
    message = (
        F.when(k % 20 == 0, "")
        .when(k % 20 == 10, None)
        .when(k % 37 == 0, "ok")
        .when(k % 41 == 0, "hola, gracias!!")
        .when(k % 5 == 1, _pick(REPEATED, "o_orderkey % 6"))
        .otherwise(composed)
    )
    view = {
        "archivo_origen": F.concat(F.lit("lote_"), (k % 4).cast("string")),
        "fila": k,
        "paciente_id": F.when(k % 211 != 0, F.concat(F.lit("P"), (F.col("o_custkey") % 97).cast("string"))),
        "especialidad": F.when(k % 9 == 0, "Urologia").when(k % 9 == 1, "  "),
        "fecha_solicitada": F.when(k % 6 == 0, F.concat(F.lit("2025-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))).otherwise(""),
        "mensaje_texto": message,
    }
    if customers is not None:
        names = customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("paciente"))
        orders = orders.join(names, "o_custkey", "left")
        view["paciente"] = F.col("paciente")
    return at_least(orders, partitions).select(*(c.alias(name) for name, c in view.items()))


# --- generator ----------------------------------------------------------------

SPECIALTY_LABELS = tuple(SPECIALTY_RULES)[:12]
FIRST_NAMES = ("Ana", "Luis", "Marta", "Jorge", "Elena", "Pablo", "Rosa", "Diego", "Carmen", "Iván", "Lucía", "Tomás")
LAST_NAMES = ("García", "López", "Núñez", "Pérez", "Romero", "Sanz", "Vega", "Molina", "Ortiz", "Ríos", "Cano", "Gil")
CITIES = ("Madrid", "Sevilla", "Bilbao", "Málaga", "Murcia", "León", "Cádiz", "Toledo", "Burgos", "Vigo")
FILLER = ("casa", "tiempo", "grupo", "parte", "mundo", "forma", "punto", "lugar", "noche", "agua",
          "campo", "mesa", "calle", "libro", "papel", "puerta")


def _share(digest: str, start: int, digits: int, size: int) -> str:
    """A number below ``size`` from some hex digits of a digest column."""
    return f"cast(conv(substring({digest}, {start}, {digits}), 16, 10) as bigint) % {size}"


def _chosen(words: tuple[str, ...], digest: str, start: int, digits: int = 8) -> Column:
    return _pick(words, _share(digest, start, digits, len(words)))


def generate_from(
    keys: DataFrame, key: str, seed: int = 42, first_day: str = "2025-01-01", row: str | None = None
) -> DataFrame:
    """One synthetic request per row of ``keys``, all columns strings; ``row`` keeps the key.

    A message is an action, a specialty, a date and a time of the view's lists, and a line of
    filler words.
    """
    kept = [F.col(key).alias(row)] if row else []
    digests = keys.select(
        *kept,
        *(F.md5(F.concat_ws(":", F.lit(f"{seed}{part}"), F.col(key).cast("string"))).alias(part) for part in "abcd")
    )
    filler = F.concat_ws(" ", *(_chosen(FILLER, "c", 1 + 4 * i, 4) for i in range(8)))
    ahead = f"{FIRST_DAY_AHEAD} + {_share('b', 9, 8, LAST_DAY_AHEAD - FIRST_DAY_AHEAD + 1)}"
    day = F.expr(f"date_add(date'{first_day}', cast({ahead} as int))")
    message = F.when(F.expr(_share("b", 17, 8, 100)) < EMPTY_MESSAGE_PERCENT, "").otherwise(
        F.concat_ws(
            " ", *(_chosen(words, "d", 1 + 8 * i) for i, words in enumerate((ACTIONS, SPECIALTIES, DATES, TIMES))),
            F.concat(F.initcap(F.substring_index(filler, " ", 1)), F.lit(" "), F.substring_index(filler, " ", -7), F.lit(".")),
        )
    )
    return digests.select(
        *([row] if row else []),
        F.upper(F.substring("a", 1, 8)).alias("id_paciente"),
        F.concat_ws(" ", _chosen(FIRST_NAMES, "a", 9), _chosen(LAST_NAMES, "a", 17)).alias("paciente"),
        _chosen(CITIES, "a", 25).alias("ciudad"),
        _chosen(SPECIALTY_LABELS, "b", 1).alias("especialidad_medica"),
        F.date_format(day, "yyyy-MM-dd").alias("fecha_solicitada"),
        message.alias("mensaje_texto"),
    )


def generate(spark: SparkSession, rows: int = 50_000, seed: int = 42, first_day: str = "2025-01-01") -> DataFrame:
    """``rows`` synthetic requests."""
    return generate_from(spark.range(rows), "id", seed, first_day)
