"""Text cleaning as plain Column expressions; nothing here leaves the JVM."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnera import fixed_values as fixed

# Spark's regex dialect changed its idea of \w, \b and \s between Java versions, so the
# Unicode classes are spelled out: letters, numbers and underscore; all white space.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
SPACE_CHARS = "".join(
    chr(c)
    for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

_STARTS = "".join(sorted({phrase[0] for phrase in fixed.COURTESIES}))
_COURTESY = rf"(?iu)(?<![{WORD}])(?=[{_STARTS}])(?:{'|'.join(fixed.COURTESIES)})(?![{WORD}])"
_CLOSING = rf"(?iu) (?:{'|'.join(fixed.CLOSINGS)})(?![{WORD}])"
_NOISE = rf"[^{WORD} {re.escape(fixed.KEPT_MARKS)}]"


def sql_text(value: str) -> str:
    """A string literal for a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Turn every run of white space into one space and trim the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+", " "))


def present(text: Column) -> Column:
    """The text itself, or '' where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def fold(text: Column) -> Column:
    """Plain letters for the accented Spanish ones; every other character stays."""
    return F.translate(text, fixed.FOLD_FROM, fixed.FOLD_TO)


def matching_form(text: Column) -> Column:
    """Folded and lower-case, the form all rules and duplicate keys use."""
    return F.lower(fold(text))


def clean(text: Column) -> Column:
    """First sentence of a message, without courtesies, closing formulas and noise."""
    sentence = squeeze(F.substring_index(present(text), ".", 1))
    body = F.split(sentence, _CLOSING, 2)[0]
    plain = F.regexp_replace(F.regexp_replace(body, _COURTESY, ""), _NOISE, " ")
    return F.btrim(F.regexp_replace(plain, "  +", " "), F.lit(fixed.EDGE_MARKS))


def is_usable(message: Column, cleaned: Column) -> Column:
    """True where a message of at least three characters still says something when cleaned:
    three characters, or a letter among fewer."""
    return (F.char_length(strip(present(message))) >= 3) & cleaned.rlike(r"(?s).{3}|\p{L}")
