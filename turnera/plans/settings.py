"""Options of a run."""

from dataclasses import dataclass, field
from decimal import Decimal

from turnera import fixed_values as fixed
from turnera.functions.tokens import TokenCounter, pretoken_counts
from turnera.glossary import WORDS
from turnera.operators.translation import Engine, glossary_engine


@dataclass(frozen=True)
class RunOptions:
    """What a run computes and where it writes.

    ``output_path`` receives a folder for each run with ``resultados``, ``metricas`` and the report tables.  ``memo_path`` is the
    translation memo, None to run without one.  ``export_format`` writes the results a
    second time as xlsx, csv or json.  ``rejects`` also writes the rows left out.
    ``min_partitions`` deals out an input of fewer splits than there are cores.
    ``keep_stages`` leaves the intermediate tables in the shared folder.
    """

    output_path: str
    memo_path: str | None = None
    optimize_tokens: bool = True
    engine: Engine = field(default_factory=lambda: glossary_engine(WORDS))
    counter: TokenCounter = pretoken_counts
    memo_ttl_days: int = fixed.MEMO_TTL_DAYS
    translate_partitions: int | None = None
    tokens_per_task: int | None = None
    rate: Decimal = fixed.RATE_USD_PER_MILLION
    messages_per_day: int = fixed.MESSAGES_PER_DAY
    rejects: bool = False
    export_format: str | None = None
    min_partitions: int | None = None
    keep_stages: bool = False
