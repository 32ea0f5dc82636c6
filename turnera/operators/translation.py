"""Translation of the distinct clean texts through a memo table.

The memo is a plain table (``MEMO_SCHEMA``).  An engine is either a Column function,
which stays in the JVM, or a function over batches of texts, which runs in Arrow batches
and may load a model once per worker.
"""

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.functions.text import present, sql_text, strip

MEMO_SCHEMA = (
    "cache_key string, texto_origen string, texto_destino string, motor string, "
    "written_at timestamp, expires_at timestamp"
)

Batches = Callable[[Iterator[list[str]]], Iterator[list[str]]]


@dataclass(frozen=True)
class Engine:
    """How to translate: one of ``column``, ``batches`` and ``joined``, which answers for a whole frame.

    ``available`` tells, where it is called, whether the engine's library and model are there.
    """

    name: str
    column: Callable[[Column], Column] | None = None
    batches: Batches | None = None
    available: Callable[[], bool] | None = None
    joined: Callable[[DataFrame, Column, str], DataFrame] | None = None

    def apply(self, frame: DataFrame, source: Column, name: str) -> DataFrame:
        """Add the translation of ``source``, or the source where the engine returns nothing."""
        useful = strip(present(F.col(name))) != ""
        if self.joined:
            answered = self.joined(frame, source, name)
        else:
            answered = frame.withColumn(name, (self.column or _in_batches(self.batches))(source))
        return answered.withColumn(name, F.when(useful, F.col(name)).otherwise(source))


def _in_batches(translate: Batches) -> Callable[[Column], Column]:
    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pending: deque[pa.Array] = deque()

        def wanted() -> Iterator[list[str]]:
            for column in columns:
                pending.append(column)
                yield column.drop_null().to_pylist()

        for answers in translate(wanted()):
            column, texts = pending.popleft(), iter(answers)
            yield pa.array([None if gap else next(texts) for gap in column.is_null().to_pylist()], pa.string())

    return run


def budgeted(translate: Batches, budget: int = fixed.TOKENS_PER_BATCH, cost: Callable[[str], int] = lambda text: len(text.split()) + 1) -> Batches:
    """An engine that sees batches of like texts within a budget of tokens.

    The texts of each list it is handed are ordered by length and packed so that a batch, every
    text in it padded to its longest, stays within ``budget``; a text beyond it goes alone.
    Answers come back in the order of the texts.
    """

    def packs(texts: list[str]) -> list[list[int]]:
        costs = list(map(cost, texts))
        found: list[list[int]] = []
        for i in sorted(range(len(texts)), key=costs.__getitem__):
            if not found or (len(found[-1]) + 1) * costs[i] > budget:
                found.append([])
            found[-1].append(i)
        return found

    def run(lists: Iterator[list[str]]) -> Iterator[list[str]]:
        waiting: deque[tuple[list, deque[list[int]]]] = deque()

        def wanted() -> Iterator[list[str]]:
            for texts in lists:
                own = packs(texts)
                waiting.append(([None] * len(texts), deque(own)))
                for pack in own:
                    yield [texts[i] for i in pack]

        def whole() -> Iterator[list[str]]:
            while waiting and not waiting[0][1]:
                yield waiting.popleft()[0]

        for answers in translate(wanted()):
            yield from whole()  # lists without texts
            answered, left = waiting[0]
            for i, answer in zip(left.popleft(), answers):
                answered[i] = answer
            yield from whole()
        yield from whole()

    return run


def probed(spark: SparkSession, engines: dict[str, Engine], tasks: int | None = None) -> dict[str, Engine]:
    """The engines whose probe succeeds wherever it is asked; one job asks for all, where engines would run."""
    probes = {name: e.available for name, e in engines.items() if e.available}
    if not probes:
        return dict(engines)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_pydict({"engine": list(probes), "there": [bool(probe()) for probe in probes.values()]})

    places = tasks or spark.sparkContext.defaultParallelism
    told = spark.range(0, places, 1, places).mapInArrow(asked, "engine string, there boolean")
    there = {r.engine: r.there for r in told.groupBy("engine").agg(F.bool_and("there").alias("there")).collect()}
    return {name: e for name, e in engines.items() if there.get(name, True)}


def glossary_engine(words: dict[str, str], name: str = "glosario") -> Engine:
    """Word-for-word translation by a small dictionary; unknown words stay."""
    entries = ", ".join(f"{sql_text(word)}, {sql_text(meaning)}" for word, meaning in words.items())

    def column(source: Column) -> Column:
        table = F.expr(f"map({entries})")
        translated = F.transform(F.split(source, " "), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w))
        return F.array_join(translated, " ")

    return Engine(name, column=column)


def dictionary_engine(entries: DataFrame, longest: int, name: str = "diccionario") -> Engine:
    """Translation by a dictionary table (origen, destino) of any size, with phrases of up to ``longest`` words.

    From left to right the longest phrase that the dictionary has is replaced, in any case;
    other words stay.  Every place and length is a row that meets the dictionary by its phrase, so
    nothing of the dictionary is in the plan; a phrase that most texts hold is left to adaptive skew
    joins.  Of several meanings the first by order counts; entries that are null or longer never do.
    """
    plain = entries.select(F.lower("origen").alias("_frase"), "destino").dropna()
    meanings = plain.groupBy("_frase").agg(F.min("destino").alias("_destino"))

    def joined(frame: DataFrame, source: Column, answer: str) -> DataFrame:
        texts = frame.select(source.alias("_fuente")).dropna().distinct().withColumn("_palabras", F.split("_fuente", " "))
        place = texts.select("_fuente", "_palabras", F.explode(F.sequence(F.lit(1), F.size("_palabras"))).alias("_lugar"))
        lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_palabras") - F.col("_lugar") + 1))).alias("_largo")
        phrase = F.lower(F.array_join(F.slice("_palabras", F.col("_lugar"), F.col("_largo")), " ")).alias("_frase")
        found = place.select("_fuente", "_palabras", "_lugar", lengths).select("_fuente", "_lugar", "_largo", phrase).join(meanings, "_frase")
        best = found.groupBy("_fuente", "_lugar").agg(F.max(F.struct("_largo", "_destino")).alias("m"))
        held = best.groupBy("_fuente").agg(F.map_from_entries(F.collect_list(F.struct("_lugar", "m"))).alias("_hallado"))
        words = F.split("_fuente", " ")

        def step(state: Column, at: Column) -> Column:
            match = F.try_element_at("_hallado", at)
            said = F.coalesce(match["_destino"], F.element_at(words, at))
            taken = F.struct((at + F.coalesce(match["_largo"], F.lit(1))).alias("libre"), F.concat(state["dicho"], F.array(said)).alias("dicho"))
            return F.when(at < state["libre"], state).otherwise(taken)

        start = F.struct(F.lit(1).alias("libre"), F.array().cast("array<string>").alias("dicho"))
        said = F.aggregate(F.sequence(F.lit(1), F.size(words)), start, step, lambda state: F.array_join(state["dicho"], " "))
        return frame.withColumn("_fuente", source).join(held.select("_fuente", said.alias(answer)), "_fuente", "left").drop("_fuente")

    return Engine(name, joined=joined)


def choose_engine(wanted: str, engines: dict[str, Engine], preference: tuple[str, ...] = ()) -> Engine:
    """The wanted engine, or for "auto" (or an absent one) the first available by preference."""
    if wanted in engines:
        return engines[wanted]
    for name in (*preference, *engines):
        if name in engines:
            return engines[name]
    raise ValueError(f"no translation engine available for {wanted!r}")


def distinct_texts(frame: DataFrame) -> DataFrame:
    """Distinct clean texts with their memo key and ``veces``, the rows that hold each."""
    texts = frame.groupBy(F.col("mensaje_limpio").alias("texto_origen")).agg(F.count("*").alias("veces"))
    return texts.select(memo_key(F.col("texto_origen")).alias("cache_key"), "texto_origen", "veces")


def memo_key(source: Column) -> Column:
    digest = F.sha2(strip(source), 256)
    return F.concat(F.lit(fixed.MEMO_KEY_PREFIX), F.substring(digest, 1, fixed.MEMO_KEY_HEX_DIGITS))


def fresh(memo: DataFrame, now: datetime | None = None) -> DataFrame:
    """The latest unexpired entry of each key and text."""
    moment = F.lit(now) if now else F.current_timestamp()
    alive = memo.filter(F.col("expires_at").isNull() | (F.col("expires_at") > moment))
    latest = F.max_by(F.struct("texto_destino", "motor", "written_at", "expires_at"), "written_at").alias("m")
    return alive.groupBy("cache_key", "texto_origen").agg(latest).select("cache_key", "texto_origen", "m.*")


def lookup(texts: DataFrame, memo: DataFrame, now: datetime | None = None) -> DataFrame:
    """Texts with their memoised ``texto_destino`` and ``motor``, null where unknown.

    The short key alone could collide, so the join takes the source text as well; both
    sides hold each text once.
    """
    known = fresh(_asked(memo, texts), now).select("cache_key", "texto_origen", "texto_destino", "motor")
    return texts.join(known, ["cache_key", "texto_origen"], "left")


def _asked(memo: DataFrame, texts: DataFrame) -> DataFrame:
    """The entries of these texts: a run's keys thin the memo before it is ordered, however long its history."""
    return memo.join(texts.select("cache_key", "texto_origen"), ["cache_key", "texto_origen"], "left_semi")


def misses(texts: DataFrame, memo: DataFrame, now: datetime | None = None) -> DataFrame:
    """Texts the memo does not know."""
    known = fresh(_asked(memo, texts), now).select("cache_key", "texto_origen")
    return texts.join(known, ["cache_key", "texto_origen"], "left_anti")


def translations(
    texts: DataFrame,
    engine: Engine,
    memo: DataFrame | None = None,
    now: datetime | None = None,
    partitions: int | None = None,
    tokens_per_task: int | None = None,
) -> DataFrame:
    """Distinct texts with ``texto_destino``, ``motor`` and ``nuevo`` (not from the memo).

    Only unknown texts reach the engine.  ``partitions`` spreads a costly engine over
    that many tasks, since the bytes of the texts say little about its work;
    ``tokens_per_task`` derives their number from the words of the unknown texts, which it
    counts in a job of its own.
    """
    none = F.lit(None).cast("string")
    looked = texts.withColumns({"texto_destino": none, "motor": none}) if memo is None else lookup(texts, memo, now)
    if tokens_per_task:
        words = F.sum(F.when(F.col("texto_destino").isNull(), F.size(F.split("texto_origen", " "))))
        partitions = max(1, -(-(looked.agg(words).first()[0] or 0) // tokens_per_task))
    if partitions:
        looked = looked.repartition(partitions, "texto_origen")
    unknown = F.when(F.col("texto_destino").isNull(), F.col("texto_origen"))
    return engine.apply(looked, unknown, "_respuesta").select(
        "cache_key",
        "texto_origen",
        "veces",
        F.coalesce("texto_destino", "_respuesta").alias("texto_destino"),
        F.coalesce("motor", F.lit(engine.name)).alias("motor"),
        F.col("texto_destino").isNull().alias("nuevo"),
    )


def memo_entries(translated: DataFrame, ttl_days: int = fixed.MEMO_TTL_DAYS, now: datetime | None = None) -> DataFrame:
    """New memo rows of a run; empty texts are never kept."""
    moment = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    expiry = moment + F.make_dt_interval(F.lit(ttl_days)) if ttl_days > 0 else F.lit(None).cast("timestamp")
    new = translated.filter((F.col("texto_origen") != "") & (F.col("texto_destino") != ""))
    if "nuevo" in translated.columns:
        new = new.filter("nuevo")
    return new.select(
        "cache_key", "texto_origen", "texto_destino", "motor",
        moment.alias("written_at"), expiry.alias("expires_at"),
    )


#: A text in more than 1 / PIECES of the rows is met in pieces; at most PIECES texts are.
PIECES = 200


def map_back(frame: DataFrame, translated: DataFrame) -> DataFrame:
    """Give every row the translation of its text, or the text itself.

    ``translated`` is a stored table: it is read for the texts that hold more than 1 / PIECES
    of the rows (``veces``), at most PIECES, and for the join.  Those texts are known to the plan by a
    64-bit hash with the number of pieces they need; their rows are dealt over the pieces and
    their translations repeated in each.  One join for every size.
    """
    right = translated.withColumnRenamed("texto_origen", "mensaje_limpio")
    total = translated.agg(F.sum("veces")).first()[0] or 0
    often = translated.filter(F.col("veces") * PIECES > total).select(F.xxhash64("texto_origen").alias("h"), "veces").collect()  # PIECES at most
    needed: dict[int, int] = {}
    for r in often:
        needed[r.h] = max(needed.get(r.h, 1), -(-r.veces * PIECES // total))
    if not needed:
        return _filled(frame.join(right, "mensaje_limpio", "left"))
    table = F.expr(f"map({', '.join(f'{h}L, {n}' for h, n in needed.items())})")

    def pieces(side: DataFrame) -> Column:
        return F.coalesce(F.try_element_at(table, F.xxhash64(side["mensaje_limpio"])), F.lit(1))

    spread = frame.withColumn("_pieza", F.pmod(F.xxhash64(*frame.columns, F.spark_partition_id()), pieces(frame).cast("bigint")))
    repeated = right.withColumn("_pieza", F.explode(F.sequence(F.lit(0).cast("bigint"), (pieces(right) - 1).cast("bigint"))))
    return _filled(spread.join(repeated, ["mensaje_limpio", "_pieza"], "left").drop("_pieza"))


def _filled(joined: DataFrame) -> DataFrame:
    english = F.coalesce("texto_destino", "mensaje_limpio")
    return joined.withColumn("mensaje_ingles", english).drop("texto_destino", "veces", "cache_key", "motor", "nuevo")


def translate(frame: DataFrame, engine: Engine, memo: DataFrame | None = None, now: datetime | None = None) -> DataFrame:
    """Add ``mensaje_ingles``.  A Column engine without a memo needs no join at all."""
    if engine.column and memo is None:
        return engine.apply(frame, F.col("mensaje_limpio"), "mensaje_ingles")
    return map_back(frame, translations(distinct_texts(frame), engine, memo, now))


def untranslated(frame: DataFrame) -> DataFrame:
    """Columns of a run without translation."""
    return frame.withColumns({"mensaje_ingles": F.lit(""), "tokens_ingles": F.lit(None).cast("int")})
