"""Token counters.

A counter takes any number of text columns and returns one array column with their
counts, so that a Python-backed counter needs a single Arrow pass for all variants.
``pretoken_counts`` stays in the JVM; ``bpe_counts`` calls a byte-pair encoder.
"""

import base64
import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnera.functions.text import SPACE, present
from turnera.session import ship_package

PRETOKEN = rf"\p{{L}}+|\p{{N}}{{1,3}}|[^{SPACE}\p{{L}}\p{{N}}]+"

TokenCounter = Callable[..., Column]


def pretoken_counts(*texts: Column) -> Column:
    """Runs of letters, of up to three digits and of marks: a cheap stand-in for BPE."""
    return F.array(*(F.regexp_count(present(t), F.lit(PRETOKEN)) for t in texts))


@functools.cache
def _encoder(rank_file: str | None, split: str | None):
    import tiktoken

    if rank_file is None:
        import public_tokenizers

        path, split = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), split or public_tokenizers.PATTERN
    else:
        path = rank_file if os.path.exists(rank_file) else SparkFiles.get(os.path.basename(rank_file))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def bpe_counts(rank_file: str | None = None, split: str | None = None) -> TokenCounter:
    """A counter over byte-pair ranks; special-token strings count as ordinary text.

    ``rank_file`` is a path every executor can read, or a file shipped with
    ``SparkContext.addFile``; ``split`` is the pre-split pattern that belongs to it.
    Each worker loads the ranks once, and each batch encodes a repeated text once.
    """
    if rank_file is not None and split is None:
        from turnera.fixed_values import O200K_SPLIT as split

    @F.arrow_udf("array<int>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(rank_file, split)
        for batch in batches:
            texts = batch.flatten().dictionary_encode()
            sizes = [len(encoder.encode_ordinary(t)) for t in texts.dictionary.to_pylist()]
            flat = pa.array(sizes, pa.int32()).take(texts.indices)
            yield pa.ListArray.from_arrays(_offsets(batch), flat)

    def counter(*texts: Column) -> Column:
        ship_package(SparkSession.active())
        return counts(F.array(*map(present, texts)))

    return counter


def _offsets(lists: pa.ListArray) -> pa.Array:
    first = lists.offsets[0].as_py()
    return lists.offsets if first == 0 else pa.compute.subtract(lists.offsets, first)


def with_token_counts(frame: DataFrame, columns: dict[str, str], counter: TokenCounter) -> DataFrame:
    """Add one int column per entry of ``columns`` (new name -> text column)."""
    counted = frame.withColumn("_counts", counter(*(F.col(text) for text in columns.values())))
    return counted.select(
        *(c for c in frame.columns if c not in columns),
        *(F.col("_counts")[i].cast("int").alias(name) for i, name in enumerate(columns)),
    )
