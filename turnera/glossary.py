"""A small Spanish-English word list for the offline engine."""

WORDS = {
    "quiero": "want", "necesito": "need", "deseo": "wish", "solicito": "request", "pido": "ask",
    "confirmo": "confirm", "confirmar": "confirm", "cancelar": "cancel", "anular": "cancel",
    "reprogramar": "reschedule", "reagendar": "book again", "cambiar": "change", "modificar": "change",
    "mover": "move", "posponer": "postpone", "postergar": "postpone", "aplazar": "postpone",
    "adelantar": "advance", "agendar": "schedule", "mantener": "keep", "borrar": "delete",
    "cita": "appointment", "turno": "appointment", "consulta": "visit", "visita": "visit",
    "control": "checkup", "reserva": "time slot", "hora": "hour", "fecha": "date", "día": "day",
    "semana": "week", "mes": "month", "lunes": "monday", "jueves": "thursday", "mañana": "morning",
    "tarde": "afternoon", "noche": "night", "mediodía": "noon", "próxima": "next", "próximo": "next",
    "siguiente": "next", "mi": "my", "la": "the", "el": "the", "los": "the", "las": "the",
    "de": "of", "en": "in", "con": "with", "por": "by", "para": "for", "un": "a", "una": "a",
    "no": "not", "sí": "yes", "y": "and", "médico": "doctor", "dentista": "dentist", "ojo": "eye",
    "ojos": "eyes", "piel": "skin", "sangre": "blood", "vacuna": "vaccine", "laboratorio": "laboratory",
    "embarazo": "pregnancy", "cardiología": "cardiology", "pediatría": "pediatrics",
}
