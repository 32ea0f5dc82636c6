"""Token counts of a byte-level BPE by the whole-token shortcut.

Most pre-tokens of a text are themselves one token.  Which vocabulary strings have this
property is proved once, before any text is read: each is encoded alone, and those that
come out as exactly their own id count one wherever the split yields them.  Only the other
pre-tokens go through the merges, each distinct one once per worker.

The split runs on this side, so its character classes have to be the library's.  That is
proved in the same step, character by character; a text holding a character on which the two
disagree is counted by the library alone.

Defined cases: null is the empty text, which has no tokens.  A special token's string inside
a text is one token.  Repeated rows are counted each; other columns pass through, and an
input column named like an output is replaced.
"""

import functools
import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import adding, ready, require, text_of

# White space of the split, and the split of byte-level vocabularies with it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The letter by which a byte-level vocabulary writes a byte: itself if visible, else one from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: No letters, digits or spaces are assigned outside these ranges.
ASSIGNED = (range(0xD800), range(0xE000, 0x33480), range(0xE0000, 0xE0200))
#: Costs of distinct pre-tokens that a worker keeps beside the proved ones.
KEPT = 400_000


class Proof(NamedTuple):
    """A vocabulary with what was proved about it; its size is bounded by the vocabulary's."""

    library: str
    whole: list[str]
    foreign: str


def prove(path: str) -> Proof:
    """Find the whole tokens and the characters on which the split and the library differ."""
    with open(path, encoding="utf-8") as file:
        return _prove(file.read())


@functools.cache
def _prove(library: str) -> Proof:
    from tokenizers import Tokenizer

    _supported(json.loads(library))
    tokenizer = Tokenizer.from_str(library)
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    pairs = [(i, s) for i, s in zip(ids, strings) if s and "\ufffd" not in s]
    alone = tokenizer.encode_batch_fast([s for _, s in pairs], add_special_tokens=False)
    whole = [s for (i, s), encoding in zip(pairs, alone) if encoding.ids == [i]]
    return Proof(library, whole, _foreign(tokenizer))


def _supported(spec: dict) -> None:
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    bare = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    if not (plain and bare and spec.get("normalizer") is None and spec["model"].get("dropout") is None):
        raise ValueError("the shortcut is proved for byte-level vocabularies without normaliser or prefix space")


def _foreign(tokenizer) -> str:
    import regex

    split = regex.compile(SPLIT)

    def same(text: str) -> bool:
        return [m.span() for m in split.finditer(text)] == [s for _, s in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def probe(points) -> str:
        return "".join(f"a{chr(p)}1a{chr(p)}!\n" for p in points)

    found = []
    for points in ASSIGNED:
        for start in range(0, len(points), 512):
            block = points[start : start + 512]
            if not same(probe(block)):
                found += [chr(p) for p in block if not same(probe([p]))]
    return "".join(found)


class Counts:
    """Counts the tokens of texts; one per worker process."""

    def __init__(self, proof: Proof):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(proof.library)
        self.merge = self.library.model.tokenize
        self.whole = dict.fromkeys(proof.whole, 1)
        self.costs = dict(self.whole)
        self.split = regex.compile(SPLIT).findall
        self.foreign = frozenset(proof.foreign)
        special = [t["content"] for t in json.loads(proof.library)["added_tokens"]]
        special.sort(key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))).split if special else lambda text: [text]

    def of(self, text: str) -> int:
        if not (text.isascii() or self.foreign.isdisjoint(text)):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts = self.special(text)
        return len(parts) - 1 + sum(map(self.part, parts))

    def part(self, text: str) -> int:
        times, costs = Counter(self.split(text)), self.costs
        rest = [p for p in times if p not in costs]
        if rest:
            if len(costs) > len(self.whole) + KEPT:
                costs = self.costs = dict(self.whole)
                rest = [p for p in times if p not in costs]
            merge, letters = self.merge, LETTERS
            costs.update((p, len(merge(p.encode().decode("latin-1").translate(letters)))) for p in rest)
        return sum(n * costs[p] for p, n in times.items())


_workers: dict[str, Counts] = {}


def _counts(key: str, proof) -> Counts:
    if key not in _workers:
        _workers.clear()
        _workers[key] = Counts(proof.value)
    return _workers[key]


def with_token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    ``vocabulary`` is a tokenizer file the driver can read; executors need no file.
    """
    require(docs, text)
    spark = docs.sparkSession
    ready(spark)
    proof = prove(vocabulary)
    shared, key = spark.sparkContext.broadcast(proof), hashlib.sha256(proof.library.encode()).hexdigest()

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = _counts(key, shared)
        for batch in batches:
            yield pa.array((counts.of(t.as_py()) for t in batch), pa.int64(), size=len(batch))

    counted = adding(docs, {"n_bytes": F.octet_length(text_of(text)).cast("long"), "n_tokens": tokens(text_of(text))})
    return adding(counted, {"over_limit": F.col("n_tokens") > limit})
