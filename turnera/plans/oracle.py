"""The catalogue in SQL, as an independent statement of every result.

Word boundaries are expressed by marking the words of a text, and costs in whole
micro-dollars, so neither shares a formula with the Spark side.
"""

from turnera import fixed_values as fixed
from turnera.glossary import WORDS
from turnera.plans.queries import EARLIER_FILES
from turnera.sources import requests as words

OPEN, CLOSE = "\x01", "\x02"
# Own statements of white space and of tokens, so that a wrong pattern of the engine shows.
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PRETOKEN_SQL = r"\p{L}+|\p{N}{1,3}|[^\t-\r\x1c-\x20\x{85}\p{Z}\p{L}\p{N}]+"
SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _pick(values, index: str) -> str:
    return f"list_extract({_list(values)}, CAST({index} + 1 AS INTEGER))"


SOL = f"""
sol AS (
  SELECT 'lote_' || CAST(o_orderkey % 4 AS VARCHAR) AS archivo_origen,
         o_orderkey AS fila,
         CASE WHEN o_orderkey % 211 <> 0 THEN 'P' || CAST(o_custkey % 97 AS VARCHAR) END AS paciente_id,
         c_name AS paciente,
         CASE WHEN o_orderkey % 9 = 0 THEN 'Urologia' WHEN o_orderkey % 9 = 1 THEN '  ' END AS especialidad,
         CASE WHEN o_orderkey % 6 = 0 THEN '2025-01-' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') ELSE '' END AS fecha_solicitada,
         CASE WHEN o_orderkey % 20 = 0 THEN ''
              WHEN o_orderkey % 20 = 10 THEN NULL
              WHEN o_orderkey % 37 = 0 THEN 'ok'
              WHEN o_orderkey % 41 = 0 THEN 'hola, gracias!!'
              WHEN o_orderkey % 5 = 1 THEN {_pick(words.REPEATED, "o_orderkey % 6")}
              ELSE {_pick(words.GREETINGS, "(o_orderkey // 5) % 5")}
                || {_pick(words.ACTIONS, "o_orderkey % 24")} || ' '
                || {_pick(words.SPECIALTIES, "(o_orderkey // 24) % 50")} || ' '
                || {_pick(words.DATES, "(o_orderkey // 7) % 13")} || ' '
                || {_pick(words.TIMES, "(o_orderkey // 11) % 16")} || '. '
                || {_pick(words.TAILS, "o_orderkey % 7")}
         END AS mensaje_texto
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

DOC = """
doc AS (SELECT lang AS archivo_origen, doc_id AS fila, source AS paciente_id, text AS mensaje_texto FROM documents)"""


def _marked(phrase: str) -> str:
    return " ".join(f"{OPEN}{word}{CLOSE}" for word in phrase.split(" "))


def _cleaned(source: str) -> str:
    """CTEs ending in ``limpia``: the rows of ``source`` with ``mensaje_limpio``."""
    closings = "|".join(map(_marked, fixed.CLOSINGS))
    courtesies = "|".join(map(_marked, fixed.COURTESIES))
    return f"""
c1 AS (SELECT *, trim(split_part(trim(regexp_replace(coalesce(mensaje_texto, ''), '{SPACES}+', ' ', 'g'), ' '), '.', 1), ' ') AS t1 FROM {source}),
c2 AS (SELECT *, regexp_replace(t1, '([\\p{{L}}\\p{{N}}_]+)', '{OPEN}\\1{CLOSE}', 'g') AS t2 FROM c1),
c3 AS (SELECT *, regexp_replace(regexp_replace(t2, '(?is) (?:{closings}).*$', ''), '(?i)(?:{courtesies})', '', 'g') AS t3 FROM c2),
c4 AS (SELECT *, regexp_replace(regexp_replace(t3, '[{OPEN}{CLOSE}]', '', 'g'), '[^\\p{{L}}\\p{{N}}_ .,:;¿?¡!/()-]', ' ', 'g') AS t4 FROM c3),
limpia AS (SELECT * EXCLUDE (t1, t2, t3, t4), trim(trim(regexp_replace(t4, ' +', ' ', 'g'), ' '), '{fixed.EDGE_MARKS}') AS mensaje_limpio FROM c4)"""


def _folded(column: str) -> str:
    return f"lower(translate({column}, '{fixed.FOLD_FROM}', '{fixed.FOLD_TO}'))"


MARKED = f"""
marcada AS (
  SELECT *, (length(trim(coalesce(mensaje_texto, ''), {_text(SPACE_CHARS)})) >= 3 AND mensaje_limpio <> ''
             AND (length(mensaje_limpio) >= 3 OR regexp_matches(mensaje_limpio, '\\p{{L}}'))) AS util,
         {_folded("mensaje_limpio")} AS clave
  FROM limpia
),
puesta AS (
  SELECT *, CASE WHEN util THEN row_number() OVER (PARTITION BY util, paciente_id, clave ORDER BY archivo_origen, fila) END AS lugar,
         count(*) OVER (PARTITION BY util, paciente_id, clave) AS copias
  FROM marcada
)"""

MESSAGE = "coalesce(mensaje_texto, '')"
# Rules see plain letters only: other marks become spaces, other letters an unused one.
PLAIN = f"regexp_replace(regexp_replace({_folded(MESSAGE)}, '[^\\p{{L}}\\p{{N}}_\\x00-\\x7f]', ' ', 'g'), '[^\\x00-\\x7f]', 'k', 'g')"


def _hits(patterns) -> str:
    return " OR ".join(f"regexp_matches(t, {_text(p)})" for p in patterns)


def _label(table, vetoes=()) -> str:
    veto = f"WHEN {_hits(vetoes)} THEN '' " if vetoes else ""
    return f"CASE {veto}{' '.join(f'WHEN {_hits(p)} THEN {_text(label)}' for label, p in table.items())} ELSE '' END"


def _match(rules) -> str:
    cases = (f"WHEN regexp_matches(t, {_text(r)}) THEN trim(regexp_extract(t, {_text(r)}, 0))" for r in rules)
    return f"CASE {' '.join(cases)} ELSE '' END"


EXTRACT = {
    "accion": _label(fixed.ACTION_RULES, fixed.ACTION_VETOES),
    "especialidad": _label(fixed.SPECIALTY_RULES),
    "fecha_solicitada": _match(fixed.DATE_RULES),
    "preferencia_horario": _match(fixed.TIME_RULES),
}


def _extraction(source: str, filtered: str = "true") -> str:
    """CTE ``campos``: the rows of ``source`` with the four fields, given values kept."""
    given = {"especialidad": "especialidad", "fecha_solicitada": "fecha_solicitada"}
    columns = ", ".join(
        f"CASE WHEN trim(coalesce({field}, '')) <> '' THEN {field} ELSE {sql} END AS {field}" if field in given else f"{sql} AS {field}"
        for field, sql in EXTRACT.items()
    )
    return f"""
plegada AS (SELECT *, {PLAIN} AS t FROM {source} WHERE {filtered}),
campos AS (SELECT * EXCLUDE (t, especialidad, fecha_solicitada), {columns} FROM plegada)"""


GLOSSARY_SQL = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in WORDS.items()) + "}"


def _tokens(column: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, {_text(PRETOKEN_SQL)})) AS INTEGER)"


def _english(column: str) -> str:
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda w: coalesce(element_at({GLOSSARY_SQL}, lower(w))[1], w)), ' ')"


def _usd(tokens: str) -> str:
    return f"(CAST((CAST({tokens} AS HUGEINT) * 5 + 1) // 2 AS DOUBLE) / 1e6)"


VALID = f"{SOL},{_cleaned('sol')},{MARKED}"
FIELDS = f"{VALID},{_extraction('puesta', 'lugar = 1')}"
PROCESSED = f"""{FIELDS},
traducida AS (SELECT *, {_english("mensaje_limpio")} AS mensaje_ingles FROM campos),
contada AS (SELECT *, {_tokens("mensaje_texto")} AS tokens_original, {_tokens("mensaje_limpio")} AS tokens_limpio, {_tokens("mensaje_ingles")} AS tokens_ingles FROM traducida),
sumas AS (
  SELECT count(*) AS n, CAST(sum(tokens_original) AS BIGINT) AS tokens_original,
         CAST(sum(tokens_limpio) AS BIGINT) AS tokens_limpio, CAST(sum(tokens_ingles) AS BIGINT) AS tokens_ingles
  FROM contada
),
variantes AS (
  SELECT 'original' AS variante, tokens_original AS tokens, * EXCLUDE (tokens_limpio, tokens_ingles) FROM sumas
  UNION ALL SELECT 'limpio', tokens_limpio, * EXCLUDE (tokens_limpio, tokens_ingles) FROM sumas
  UNION ALL SELECT 'ingles', tokens_ingles, * EXCLUDE (tokens_limpio, tokens_ingles) FROM sumas
)"""

CONTRACT = f"""
SELECT paciente_id, paciente, mensaje_texto, mensaje_limpio, {{english}} AS mensaje_ingles, accion, especialidad,
       fecha_solicitada, preferencia_horario, tokens_original, tokens_limpio, {{tokens}} AS tokens_ingles,
       {_usd("tokens_original")} AS costo_estimado_original, {_usd("tokens_limpio")} AS costo_estimado_limpio,
       {{cost}} AS costo_estimado_ingles
FROM contada"""

PERIODS = ", ".join(f"('{p}', CAST({days * fixed.MESSAGES_PER_DAY} AS BIGINT))" for p, days in fixed.PERIOD_DAYS.items())


def _projection(variants: str) -> str:
    return f"""
SELECT variante, periodo, mensajes,
       CAST(q + CASE WHEN 2 * r > n OR (2 * r = n AND q % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS tokens,
       CAST((p * 5 + n) // (2 * n) AS DOUBLE) / 1e6 AS costo
FROM (SELECT *, p // n AS q, p % n AS r
      FROM (SELECT variante, periodo, mensajes, CAST(tokens AS HUGEINT) * mensajes AS p, CAST(n AS HUGEINT) AS n
            FROM {variants}, (VALUES {PERIODS}) AS v(periodo, mensajes)))"""


def _distribution(column: str, absent: str, top: str = "") -> str:
    return f"WITH {PROCESSED} SELECT coalesce({column}, '{absent}') AS {column}, count(*) AS n FROM contada GROUP BY 1 ORDER BY n DESC, 1 {top}"


TEXTS = f"""{VALID},
textos AS (
  SELECT 'tr_es_en:' || substr(sha256(mensaje_limpio), 1, 16) AS cache_key, mensaje_limpio AS texto_origen, count(*) AS veces,
         bool_or(archivo_origen IN ({", ".join(map(_text, EARLIER_FILES))})) AS antes
  FROM puesta WHERE lugar = 1 GROUP BY mensaje_limpio
)"""


def _single(field: str) -> str:
    return f"WITH {SOL}, plegada AS (SELECT archivo_origen, fila, {PLAIN} AS t FROM sol) SELECT archivo_origen, fila, {EXTRACT[field]} AS {field} FROM plegada"


def _share(digest: str, start: int, digits: int, size: int) -> str:
    return f"CAST(CAST('0x' || substr({digest}, {start}, {digits}) AS BIGINT) % {size} AS INTEGER)"


def _chosen(values, digest: str, start: int, digits: int = 8) -> str:
    return f"list_extract({_list(values)}, {_share(digest, start, digits, len(values))} + 1)"


def _generated() -> str:
    fill = [_chosen(words.FILLER, "c", 1 + 4 * i, 4) for i in range(8)]
    first = f"(upper(substr({fill[0]}, 1, 1)) || substr({fill[0]}, 2))"
    digests = ", ".join(f"md5('42{p}:' || CAST(o_orderkey AS VARCHAR)) AS {p}" for p in "abcd")
    lists = (words.ACTIONS, words.SPECIALTIES, words.DATES, words.TIMES)
    composed = " || ' ' || ".join(_chosen(values, "d", 1 + 8 * i) for i, values in enumerate(lists))
    return f"""
SELECT upper(substr(a, 1, 8)) AS id_paciente,
       {_chosen(words.FIRST_NAMES, "a", 9)} || ' ' || {_chosen(words.LAST_NAMES, "a", 17)} AS paciente,
       {_chosen(words.CITIES, "a", 25)} AS ciudad,
       {_chosen(words.SPECIALTY_LABELS, "b", 1)} AS especialidad_medica,
       strftime(DATE '2025-01-01' + 2 + {_share("b", 9, 8, 29)}, '%Y-%m-%d') AS fecha_solicitada,
       CASE WHEN {_share("b", 17, 8, 100)} < 10 THEN '' ELSE {composed} || ' ' || {first} || ' ' || {" || ' ' || ".join(fill[1:])} || '.' END AS mensaje_texto
FROM (SELECT {digests} FROM orders)"""


#: Entries whose key's first digit is even are still alive in the second run.
_EVEN = "substr(cache_key, 10, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')"
_READ = """SELECT CAST(fila AS BIGINT) AS fila, paciente_id, coalesce(mensaje_texto, '') AS mensaje_texto,
    nullif(fecha_solicitada, '') AS fecha_solicitada FROM sol"""


def _by_dictionary() -> str:
    """Texts read from left to right, a phrase of the dictionary or a word at a time."""
    def phrase(n: int) -> str:
        return f"lower(array_to_string(w[a : a + {n - 1}], ' '))"

    def known(n: int) -> str:
        return f"a + {n - 1} <= len(w) AND substr(md5({phrase(n)}), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')"

    size = " ".join(f"WHEN {known(n)} THEN {n}" for n in (3, 2))
    said = " ".join(f"WHEN {known(n)} THEN '<' || {phrase(n)} || '>'" for n in (3, 2, 1))
    recursive = TEXTS.lstrip().replace("sol AS (", "RECURSIVE sol AS (", 1)
    return f"""WITH {recursive},
        leida AS (
          SELECT cache_key, texto_origen, veces, string_split(texto_origen, ' ') AS w, 1 AS a, '' AS dicho FROM textos
          UNION ALL
          SELECT cache_key, texto_origen, veces, w, a + CASE {size} ELSE 1 END,
                 dicho || CASE WHEN a > 1 THEN ' ' ELSE '' END || CASE {said} ELSE w[a] END FROM leida WHERE a <= len(w)
        )
        SELECT cache_key, texto_origen, dicho AS texto_destino, veces FROM leida WHERE a > len(w)"""


def _document_rows(saved: dict[str, str], share: dict[str, str]) -> str:
    def row(section: str, key: str, value: str, source: str) -> str:
        return f"SELECT '{section}' AS seccion, '{key}' AS clave, CAST({value} AS DOUBLE) AS valor FROM {source}"

    parts = [row("totales", f"tokens_{v}", f"tokens_{v}", "sumas") for v in fixed.VARIANTS]
    parts += [row("totales", f"costo_{v}", _usd(f"tokens_{v}"), "sumas") for v in fixed.VARIANTS]
    parts += [row("ahorro", f"{v}_absoluto", saved[v], "sumas") for v in saved] + [row("ahorro", f"{v}_pct", share[v], "sumas") for v in saved]
    parts.append(row("procesadas", "n_procesadas", "n", "sumas"))
    parts += [row("promedio_tokens_por_mensaje", v, f"CAST(tokens_{v} AS DOUBLE) / n", "sumas") for v in fixed.VARIANTS]
    parts += [row("preprocesamiento", c, c, "contados") for c in ("filas_leidas", "filas_descartadas_vacio", "duplicados_eliminados", "filas_validas")]
    for column, absent in (("accion", fixed.WITHOUT_ACTION), ("especialidad", fixed.WITHOUT_SPECIALTY)):
        name = {"accion": "distribucion_acciones", "especialidad": "distribucion_especialidades"}[column]
        parts.append(f"SELECT '{name}', coalesce({column}, '{absent}'), CAST(count(*) AS DOUBLE) FROM contada GROUP BY 2")
    parts += [f"SELECT 'proyeccion', variante || '.' || periodo || '.{c}', CAST({c} AS DOUBLE) FROM proyectada" for c in ("mensajes", "tokens", "costo")]
    return " UNION ALL ".join(parts)


def catalogue() -> dict[str, str]:
    off = CONTRACT.format(english="''", tokens="CAST(NULL AS INTEGER)", cost="CAST(NULL AS DOUBLE)")
    on = CONTRACT.format(english="mensaje_ingles", tokens="tokens_ingles", cost=_usd("tokens_ingles"))
    micros = {v: f"((CAST(tokens_{v} AS HUGEINT) * 5 + 1) // 2)" for v in fixed.VARIANTS}
    saved = {v: f"(CAST({micros['original']} - {micros[v]} AS DOUBLE) / 1e6)" for v in ("limpio", "ingles")}
    share = {v: f"{saved[v]} / {_usd('tokens_original')} * 100" for v in saved}
    return {
        "normalize_columns": f"WITH {SOL} SELECT fila, archivo_origen, paciente_id, coalesce(mensaje_texto, '') AS mensaje_texto, especialidad FROM sol",
        "consolidate_sources": f"""WITH {SOL},{DOC}
            SELECT archivo_origen, fila, paciente_id, especialidad, fecha_solicitada, mensaje_texto FROM sol
            UNION ALL SELECT archivo_origen, fila, paciente_id, NULL, NULL, mensaje_texto FROM doc""",
        "clean_messages": f"WITH {DOC},{_cleaned('doc')} SELECT archivo_origen, fila, mensaje_limpio FROM limpia",
        "fold_messages": f"WITH {DOC} SELECT archivo_origen, fila, {_folded('mensaje_texto')} AS texto_plegado FROM doc",
        "usable_messages": f"WITH {VALID} SELECT archivo_origen, fila, mensaje_texto, mensaje_limpio FROM puesta WHERE util",
        "rejected_messages": f"""WITH {VALID} SELECT archivo_origen, fila, paciente_id, coalesce(mensaje_texto, '') AS mensaje_texto,
            CASE WHEN util THEN 'duplicado' ELSE 'vacio' END AS motivo_rechazo FROM puesta WHERE lugar IS NULL OR lugar > 1""",
        "dedup_messages": f"WITH {VALID} SELECT archivo_origen, fila, paciente_id, mensaje_limpio FROM puesta WHERE lugar = 1",
        "collapsed_messages": f"WITH {VALID} SELECT archivo_origen, fila, mensaje_limpio, copias FROM puesta WHERE lugar = 1",
        "preprocess_stats": f"""WITH {VALID} SELECT count(*) AS filas_leidas, count(*) FILTER (NOT util) AS filas_descartadas_vacio,
            count(*) FILTER (lugar > 1) AS duplicados_eliminados, count(*) FILTER (lugar = 1) AS filas_validas FROM puesta""",
        "extract_accion": _single("accion"),
        "extract_especialidad": _single("especialidad"),
        "extract_fecha": _single("fecha_solicitada"),
        "extract_horario": _single("preferencia_horario"),
        "merge_input_fields": f"WITH {SOL},{_extraction('sol')} SELECT archivo_origen, fila, accion, especialidad, fecha_solicitada, preferencia_horario FROM campos",
        "clean_and_extract": f"WITH {SOL},{_cleaned('sol')},{_extraction('limpia')} SELECT archivo_origen, fila, mensaje_limpio, accion, especialidad, fecha_solicitada, preferencia_horario FROM campos",
        "pretoken_counts": f"WITH {DOC} SELECT archivo_origen, fila, {_tokens('mensaje_texto')} AS tokens_original FROM doc",
        "distinct_texts": f"WITH {TEXTS} SELECT texto_origen, veces FROM textos",
        "memo_keys": f"WITH {TEXTS} SELECT cache_key, texto_origen FROM textos",
        "memo_lookup": f"WITH {TEXTS} SELECT cache_key, texto_origen, CASE WHEN antes THEN {_english('texto_origen')} END AS texto_destino, CASE WHEN antes THEN 'glosario' END AS motor FROM textos",
        "memo_misses": f"WITH {TEXTS} SELECT cache_key, texto_origen FROM textos WHERE NOT antes",
        "memo_translations": f"WITH {TEXTS} SELECT cache_key, texto_origen, veces, {_english('texto_origen')} AS texto_destino, 'glosario' AS motor, NOT antes AS nuevo FROM textos",
        "translate_glossary": f"WITH {VALID} SELECT archivo_origen, fila, mensaje_limpio, {_english('mensaje_limpio')} AS mensaje_ingles FROM puesta WHERE lugar = 1",
        "row_costs": f"WITH {PROCESSED} SELECT archivo_origen, fila, {', '.join(_usd('tokens_' + v) + ' AS costo_estimado_' + v for v in fixed.VARIANTS)} FROM contada",
        "totals_and_savings": f"""WITH {PROCESSED} SELECT n AS n_procesadas, tokens_original, tokens_limpio, tokens_ingles,
            {', '.join(_usd('tokens_' + v) + ' AS costo_' + v for v in fixed.VARIANTS)},
            {', '.join(f'{saved[v]} AS {v}_absoluto, {share[v]} AS {v}_pct' for v in saved)} FROM sumas""",
        "avg_tokens": f"WITH {PROCESSED} SELECT {', '.join(f'CAST(tokens_{v} AS DOUBLE) / n AS {v}' for v in fixed.VARIANTS)} FROM sumas",
        "cost_projection": f"WITH {PROCESSED} {_projection('variantes')}",
        "projection_not_optimized": f"WITH {PROCESSED} {_projection('''(SELECT * FROM variantes WHERE variante <> 'ingles')''')}",
        "dist_acciones": _distribution("accion", fixed.WITHOUT_ACTION),
        "dist_especialidades": _distribution("especialidad", fixed.WITHOUT_SPECIALTY),
        "top_especialidades": _distribution("especialidad", fixed.WITHOUT_SPECIALTY, "LIMIT 8"),
        "variant_comparison": f"""WITH {PROCESSED} SELECT variante, tokens, {_usd('tokens')} AS costo, CAST(tokens AS DOUBLE) / n AS promedio,
            CAST({micros['original']} - (CAST(tokens AS HUGEINT) * 5 + 1) // 2 AS DOUBLE) / 1e6 AS ahorro,
            CAST({micros['original']} - (CAST(tokens AS HUGEINT) * 5 + 1) // 2 AS DOUBLE) / 1e6 / {_usd('tokens_original')} * 100 AS ahorro_pct FROM variantes""",
        "kpi_row": f"""WITH {VALID} SELECT count(*) AS leidas, count(*) FILTER (lugar = 1) AS validas,
            count(*) FILTER (NOT util) AS descartadas, count(*) FILTER (lugar > 1) AS duplicados FROM puesta""",
        "results_contract": f"WITH {PROCESSED} {on}",
        "results_not_optimized": f"WITH {PROCESSED} {off}",
        "aggregates_document": f"""WITH {PROCESSED}, proyectada AS ({_projection('variantes')}),
            contados AS (SELECT count(*) AS filas_leidas, count(*) FILTER (NOT util) AS filas_descartadas_vacio,
                count(*) FILTER (lugar > 1) AS duplicados_eliminados, count(*) FILTER (lugar = 1) AS filas_validas FROM puesta)
            {_document_rows(saved, share)}""",
        "job_results": f"WITH {PROCESSED} {on}",
        "job_results_not_optimized": f"WITH {PROCESSED} {off}",
        "latest_aggregates": f"WITH {PROCESSED} SELECT n AS n_procesadas, tokens_original, tokens_limpio, tokens_ingles FROM sumas",
        "read_parquet_folder": f"WITH {SOL} {_READ}",
        "read_csv_folder": f"WITH {SOL} {_READ}",
        "read_json_folder": f"WITH {SOL} {_READ}",
        "memo_second_run": f"WITH {TEXTS} SELECT cache_key, texto_origen, NOT (antes AND hash_par) AS nuevo FROM (SELECT *, {_EVEN} AS hash_par FROM textos)",
        "memo_compaction": f"""WITH {TEXTS} SELECT cache_key, texto_origen, {_english('texto_origen')} AS texto_destino, 'otra' AS motor
            FROM (SELECT *, {_EVEN} AS hash_par FROM textos) WHERE antes AND hash_par""",
        "latest_results": f"WITH {PROCESSED} {on}",
        "run_metrics": f"""WITH {PROCESSED}, contados AS (SELECT count(*) AS filas_leidas, count(*) FILTER (NOT util) AS filas_descartadas_vacio,
                count(*) FILTER (lugar > 1) AS duplicados_eliminados, count(*) FILTER (lugar = 1) AS filas_validas FROM puesta)
            SELECT contados.*, n AS filas_escritas, tokens_original, tokens_limpio, tokens_ingles FROM contados, sumas""",
        "empty_guards": f"""WITH {VALID} SELECT 'todas' AS entrada, count(*) AS filas_leidas, count(*) FILTER (lugar = 1) AS filas_validas, NULL AS guarda FROM puesta
            UNION ALL SELECT 'rechazadas', count(*), 0, 'every row was discarded in preprocessing' FROM puesta WHERE fila % 20 = 0
            UNION ALL SELECT 'ninguna', 0, 0, 'the input has no rows'""",
        "budgeted_translation": f"WITH {TEXTS} SELECT cache_key, texto_origen, upper(texto_origen) AS texto_destino, veces FROM textos",
        "translate_dictionary": _by_dictionary(),
        "incremental_mixed_headers": f"WITH {PROCESSED} {on.replace('paciente,', 'CAST(NULL AS VARCHAR) AS paciente,', 1)}",
        "batch_engine_translation": f"WITH {VALID} SELECT archivo_origen, fila, mensaje_limpio, upper(mensaje_limpio) AS mensaje_ingles FROM puesta WHERE lugar = 1",
        "incremental_batches": f"WITH {PROCESSED} {on.replace('paciente,', 'CAST(NULL AS VARCHAR) AS paciente,', 1)}",
        "incremental_run": f"WITH {PROCESSED} {on.replace('paciente,', 'CAST(NULL AS VARCHAR) AS paciente,', 1)}",
        "generated_requests": _generated(),
    }
