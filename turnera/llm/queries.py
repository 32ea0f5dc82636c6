"""One query for each operator, over its whole table, and its statement in SQL where there is one."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera.llm import decontamination, license_scan, lm_scoring, phrases, quality, sentencepiece_codec, sharding, simhash, source_audit, token_counts, token_files, topk, url_filter
from turnera.llm.common import table, tables_of

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, _vocabulary("byte_bpe_50k.json")).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_hits(docs, table(spark, sf_dir, "benchmark"), size=10)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda total, x: total + x)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(table(spark, sf_dir, "documents"), shards=24)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary("piece_bpe_32k.model")
    coded = sentencepiece_codec.with_text(sentencepiece_codec.with_ids(docs, model), model)
    back = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), back.alias("round_trip"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("id % 100 = 0"), vectors, k=10)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "source", "lang", *quality.OUTPUTS)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.with_notices(table(spark, sf_dir, "documents").select("doc_id", "text"))
    surest = F.sort_array(F.transform("notices", lambda n: F.struct(-n["probability"], n["family"].alias("family"))))[0]
    return found.select(
        "doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))), ",").alias("families"),
        F.when(F.size("notices") > 0, surest["family"]).alias("license"),
        F.array_max(F.transform("notices", lambda n: n["probability"])).alias("probability"),
        F.array_max(F.transform("notices", lambda n: n["similarity"])).alias("similarity"),
    )


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), size=3, differing=3)


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=4, least=30, within=80, best=2000)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a data set into this application's folder of stored tables and reads it back."""
    path = f"{tables_of(spark)}/{uuid.uuid4().hex}/token-files"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write(token_files.encoded(docs, _vocabulary("word_bpe_49k.json"), end=2), path)
    return token_files.read_digests(spark, path)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(table(spark, sf_dir, "documents"), least=10, best=10)


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_lm_scores": op8_lm_scores,
    "op9_simhash": op9_simhash,
    "op10_url_filter": op10_url_filter,
    "op11_phrases": op11_phrases,
    "op12_token_files": op12_token_files,
    "op13_source_audit": op13_source_audit,
}

#: Rounds of the statement in SQL: what later ones could add to a rank is below 0.85 ** 200 of all.
SQL_ROUNDS = 200


def _url_filter_sql() -> str:
    """The filter in SQL.  A source without a name, which no page has, holds rank 1 for ever and sends the seeds theirs."""
    lower = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
    rest = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END".format
    host = f"translate(regexp_extract({{}}, '^([^/?#]*)', 1), {lower})".format
    rules = ", ".join(f"('{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{v}')" for t, v in RULES)
    href = url_filter.HREF.replace("'", "''")
    follow = url_filter.FOLLOW
    return f"""
        WITH RECURSIVE rules(rule, rule_host, rule_path, says) AS (VALUES {rules}),
        split AS (SELECT row_number() OVER () AS r, page_id, html, {rest("coalesce(url, '')")} AS rest FROM pages),
        page AS (SELECT r, page_id, html, {host('rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
        fitted AS (
            SELECT r, arg_max(rule, (len(rule), rule)) AS rule, arg_max(says, (len(rule), rule)) AS says
            FROM page JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r
        ),
        targets AS (SELECT host AS src, regexp_replace(unnest(regexp_extract_all(html, '{href}', 1)), '(?i)^https?:', '') AS t FROM page),
        absolute AS (SELECT DISTINCT src, {host(rest("('x:' || t)"))} AS dst FROM targets),
        hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM (SELECT host FROM page UNION ALL SELECT dst FROM absolute) WHERE host <> ''),
        up AS (
            SELECT DISTINCT array_to_string(labels[i:], '.') AS src, array_to_string(labels[i + 1 :], '.') AS dst
            FROM (SELECT labels, unnest(range(1, len(labels) - 1)) AS i FROM hosts WHERE len(labels) > 2)
        ),
        links AS (
            SELECT DISTINCT src, dst FROM (SELECT src, dst FROM absolute UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up)
            WHERE src <> dst AND src <> '' AND dst <> ''
        ),
        arcs AS MATERIALIZED (SELECT 'trust' AS kind, src, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links),
        degrees AS (SELECT kind, src, count(*) AS degree FROM arcs GROUP BY kind, src),
        seeds AS (SELECT CASE says WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS weight FROM page JOIN fitted USING (r) GROUP BY 1, 2),
        r0 AS MATERIALIZED (SELECT kind, host, weight::DOUBLE / sum(weight) OVER (PARTITION BY kind) AS rank FROM seeds),
        moves AS MATERIALIZED (
            SELECT a.kind, a.src, a.dst, {follow} / d.degree AS share FROM arcs a JOIN degrees d USING (kind, src)
            UNION ALL SELECT kind, NULL, host, rank * (1 - {follow}) FROM r0 UNION ALL SELECT DISTINCT kind, NULL, NULL, 1.0 FROM r0
        ),
        ranks AS (
            SELECT 0 AS round, kind, host, rank FROM r0 UNION ALL SELECT DISTINCT 0, kind, NULL, 1.0::DOUBLE FROM r0
            UNION ALL SELECT any_value(round) + 1, r.kind, m.dst, sum(r.rank * m.share)
            FROM ranks r JOIN moves m ON r.kind = m.kind AND r.host IS NOT DISTINCT FROM m.src WHERE round < {SQL_ROUNDS} GROUP BY r.kind, m.dst
        ),
        evidence AS (
            SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust
            FROM ranks WHERE round = {SQL_ROUNDS} AND host IS NOT NULL GROUP BY host
        )
        SELECT page_id, page.host, path, rule,
               coalesce(says, CASE WHEN distrust > trust * (1 + {url_filter.EQUAL}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM page LEFT JOIN fitted USING (r) LEFT JOIN evidence ON page.host = evidence.host
    """


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), item AS (
            SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
        ), places AS (
            SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
        ), found AS (SELECT r, i, p.n, item_id FROM places p JOIN windows USING (n, win)),
        hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
        listed AS (
            SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
    """,
    "op5_topk": """
        WITH ints AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
            FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op10_url_filter": _url_filter_sql(),
    "op11_phrases": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ASCII_LOWER}, '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
        ), worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
        placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
        phrases AS MATERIALIZED (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM placed GROUP BY ALL
        ),
        totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE k = 1 GROUP BY lang),
        candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 30),
        cuts AS (SELECT *, unnest(range(1, k)) AS j FROM candidates),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score
            FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[: c.j], ' ')
            JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1 :], ' ')
        ),
        weakest AS (SELECT lang, phrase, any_value(a) AS a, arg_min(struct_pack(l := l, r := r, score := score), (score, j)) AS cut FROM scored GROUP BY lang, phrase),
        inner_sizes AS (SELECT lang, a AS f, w, k, unnest(range(2, k)) AS s FROM candidates WHERE k > 2),
        longer AS (
            SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(f) AS f
            FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM inner_sizes) GROUP BY ALL
        ),
        ranked AS (
            SELECT lang, weakest.phrase, a, cut.l AS l, cut.r AS r, cut.score AS score,
                   row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, encode(weakest.phrase)) AS rank
            FROM weakest LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 80 * a
        )
        SELECT lang, rank::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_source_audit": rf"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), found AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
        counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM found GROUP BY ALL),
        terms AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
        wholes AS (SELECT lang, count(*)::HUGEINT AS kept, sum(n) AS whole FROM terms GROUP BY lang),
        kept AS MATERIALIZED (SELECT lang, source, term, c.n::HUGEINT AS n FROM counts c JOIN terms USING (lang, term)),
        totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
        groups AS MATERIALIZED (
            SELECT lang, source, coalesce(total, 0) AS total, coalesce(wholes.kept, 0) AS kept
            FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN totals USING (lang, source) LEFT JOIN wholes USING (lang)
        ),
        shares AS MATERIALIZED (
            SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, 1 + 1000000000 * (coalesce(k.n, 0) + 2) // (total + 2 * kept) AS p
            FROM groups g JOIN terms t USING (lang) LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term
        ),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ),
        whole AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (whole + 2 * kept) AS q FROM terms JOIN wholes USING (lang)),
        apart AS (
            SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
            FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM apart)
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
