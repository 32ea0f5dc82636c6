"""Quality by hierarchical empirical Bayes: a document's own evidence and that of its site.

A logistic regression reads each document (frequencies of bytes and of neighbouring byte
classes, word statistics).  Its probabilities, summed by host and by path within the host,
give site rates that are shrunk towards the level above: paths to their host, hosts to the
labelled rate of the whole corpus.  How strongly a level shrinks is estimated from how much
more its rates differ than chance would make them.  A document's final log odds are its own
plus what its path (without the document itself) says beyond the corpus.

The classifier alone is fitted on a bounded sample, ``sample`` labelled documents chosen by a
hash of their id; the labelled rate, the site sums and the scores cover all rows.  Texts are
read twice and never shuffled: sums are pre-aggregated, and the site table is broadcast only
if its stored size is below the session's limit, and joined on a salted key otherwise.

Defined cases: null texts are empty texts; null hosts and paths are sites of their own.
Labels other than 0 and 1, and null ones, are ignored; a document with as many ones as zeros
is unlabelled.  If all labels agree, or none exist, documents carry no evidence and the site
rates equal the corpus rate (one half without labels, which keeps everything).  Repeated rows
count each.  Other columns pass through; those named like an output are replaced.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import ready, require, stored, text_of, without

#: Labelled documents on which the classifier is fitted, at most.
SAMPLE = 8192
#: Bounds of the log odds one document can hold, and of the shrinkage in documents.
MOST_EVIDENCE, LEAST_STRENGTH, MOST_STRENGTH = 12.0, 1.0, 1000.0
SALTS = 16

OUTPUTS = ("p_document", "host_rate", "path_rate", "p_quality", "keep")

_CLASSES = np.array([
    0 if c in (10, 13) else 1 if c in (9, 32) else 2 if c < 32 else 3 if 48 <= c <= 57 else 4 if 65 <= c <= 90
    else 5 if 97 <= c <= 122 else 6 if c >= 128 else 7 if chr(c) in ".,;:" else 8 if chr(c) in "!?" else 9 if chr(c) in "'\"()-" else 10
    for c in range(256)
], np.uint8)
_KINDS = int(_CLASSES.max()) + 1
WIDTH = 256 + _KINDS * _KINDS + 6


def features(text: str) -> np.ndarray:
    """Evidence of one text; lengths of parts are bounded, its whole length is read."""
    data = text.encode()
    row = np.zeros(WIDTH, np.float32)
    if not data:
        return row
    codes = np.frombuffer(data, np.uint8)
    row[:256] = np.sqrt(np.bincount(codes, minlength=256) / len(codes))
    kinds = _CLASSES[codes]
    pairs = np.bincount(kinds[:-1] * np.uint8(_KINDS) + kinds[1:], minlength=_KINDS * _KINDS)
    row[256 : 256 + _KINDS * _KINDS] = np.sqrt(pairs / len(codes))
    words = data.split()
    lines = [n for n in data.split(b"\n") if n.strip()]
    count = max(1, len(words))
    row[-6:] = (
        np.log1p(len(words)) / 10, len(data) / count / 10, len(set(words)) / count,
        len(set(lines)) / max(1, len(lines)), len(lines) / count, min(1.0, max(map(len, words), default=0) / 100),
    )
    return row


class Classifier(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale @ self.weights + self.bias, -MOST_EVIDENCE, MOST_EVIDENCE)


def fit(rows: np.ndarray, good: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> Classifier:
    """Penalised logistic regression by Newton's method."""
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x = np.hstack([(rows - centre) / scale, np.ones((len(rows), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - good) + ridge * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(centre, scale, beta[:-1], float(beta[-1]))


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row (key, good) for each document with more labels of one kind than the other."""
    value = F.col(f"`{label}`").cast("double")
    known = labels.select(F.col(f"`{key}`").alias("_key"), value.alias("_label")).filter("_key IS NOT NULL AND _label IN (0.0, 1.0)")
    return known.groupBy("_key").agg(F.avg("_label").alias("_rate")).filter("_rate <> 0.5").select("_key", (F.col("_rate") > 0.5).cast("double").alias("_good"))


def train(docs: DataFrame, known: DataFrame, key: str, text: str, sample: int) -> Classifier | None:
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)  # the bound of the broadcast and of the collected rows

    @F.arrow_udf("array<float>")
    def described(texts: pa.Array) -> pa.Array:
        rows = np.array([features(t.as_py()) for t in texts], np.float32).reshape(len(texts), WIDTH)
        return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), WIDTH).cast(pa.list_(pa.float32()))

    texts = docs.select(F.col(f"`{key}`").alias("_key"), text_of(text).alias("_text"))
    held = texts.join(F.broadcast(chosen), "_key").select("_key", "_good", described("_text").alias("_row"))
    table = held.groupBy("_key").agg(F.min("_good").alias("_good"), F.min("_row").alias("_row")).orderBy("_key").toArrow()
    good = table["_good"].to_numpy()
    if not len(good) or good.min() == good.max():
        return None
    rows = table["_row"].combine_chunks().flatten().to_numpy().reshape(len(good), WIDTH)
    return fit(rows.astype(float), good)


def evidence(text: Column, classifier: Classifier | None, spark) -> Column:
    """The classifier's log odds of a text; zero where there is none."""
    if classifier is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(classifier)  # WIDTH weights

    @F.arrow_udf("double")
    def log_odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch], np.float32).reshape(len(batch), WIDTH)
            yield pa.array(shared.value.log_odds(rows))

    return log_odds(text)


def _odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def _strength(mean: Column, spread: Column, chance: Column) -> Column:
    """Documents that a prior is worth: from the variance of rates beyond that of chance."""
    between = F.greatest(spread - chance, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def site_rates(scored: DataFrame, rate: float) -> DataFrame:
    """(_host, _path, n, good, host_rate, host and path strength) from scored rows (_host, _path, _odds)."""
    p = 1 / (1 + F.exp(-F.col("_odds")))
    # Whole millionths, so that a sum does not depend on its order.
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), (F.sum(F.round(p * 1e6).cast("long")) / 1e6).alias("good"))
    paths = stored(paths, "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))

    def level(sites: DataFrame, n: str, good: str) -> DataFrame:
        own = F.col(good) / F.col(n)
        mean = F.sum(good) / F.sum(n)
        return sites.agg(_strength(mean, F.var_pop(own), F.avg(1 / F.col(n)) * mean * (1 - mean)).alias("strength"))

    host_strength = level(hosts, "host_n", "host_good").first()["strength"]
    path_strength = level(paths, "n", "good").first()["strength"]
    a, b = (LEAST_STRENGTH if s is None else float(s) for s in (host_strength, path_strength))
    hosts = hosts.select("_host", ((F.col("host_good") + a * rate) / (F.col("host_n") + a)).alias("host_rate"))
    return paths.join(hosts, "_host").withColumn("strength", F.lit(b))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
           host: str = "source", path: str = "lang", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """Add ``p_document``, ``host_rate``, ``path_rate``, ``p_quality`` and ``keep`` (at least ``least``) to every row."""
    require(docs, key, text, host, path)
    require(labels, key, label)
    spark = docs.sparkSession
    ready(spark)
    known = labelled(labels, key, label)
    total = known.agg(F.count("*").alias("n"), F.sum("_good").alias("good")).first()
    rate = ((total["good"] or 0.0) + 1) / (total["n"] + 2)
    classifier = train(docs, known, key, text, sample)

    def site(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit(""))

    narrow = docs.select(site(host).alias("_host"), site(path).alias("_path"), evidence(text_of(text), classifier, spark).alias("_odds"))
    sites = stored(site_rates(narrow, rate), "sites") if classifier else None
    columns = without(docs, *OUTPUTS).columns
    held = docs.select(F.struct(*(docs[f"`{c}`"] for c in columns)).alias("_row"), site(host).alias("_host"), site(path).alias("_path"),
                       F.pmod(F.xxhash64(docs[f"`{key}`"], docs[f"`{text}`"]), F.lit(SALTS)).alias("_salt"), evidence(text_of(text), classifier, spark).alias("_odds"))
    own = 1 / (1 + F.exp(-F.col("_odds")))
    if sites is None:
        p = F.lit(rate)
        return held.select("_row.*", own.alias("p_document"), p.alias("host_rate"), p.alias("path_rate"), p.alias("p_quality"), (p >= least).alias("keep"))
    dealt = sites.select("*", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("_salt"))
    others = (F.greatest(F.col("good") - own, F.lit(0.0)) + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    joined = held.join(dealt, ["_host", "_path", "_salt"]).withColumn("path_rate", F.greatest(F.least(others, F.lit(1 - 1e-6)), F.lit(1e-6)))
    final = F.col("_odds") + _odds(F.col("path_rate")) - _odds(F.lit(rate))
    p = 1 / (1 + F.exp(-final))
    return joined.select("_row.*", own.alias("p_document"), "host_rate", "path_rate", p.alias("p_quality"), (p >= least).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are not rejected, columns as they were."""
    columns = docs.columns
    wrapped = docs.select(F.struct(*(docs[f"`{c}`"] for c in columns)).alias("_all"), *(docs[f"`{c}`"] for c in _read_by(docs, options)))
    return scored(wrapped, labels, **options).filter("keep").select("_all.*")


def _read_by(docs: DataFrame, options: dict) -> list[str]:
    defaults = {"key": "doc_id", "text": "text", "host": "source", "path": "lang"}
    return [c for c in docs.columns if c.lower() in {options.get(k, v).lower() for k, v in defaults.items()}]
