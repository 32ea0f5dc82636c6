"""Rule tables compiled to Column expressions.

A rule table stays data (see ``fixed_values``); this module only decides how Spark
evaluates it.  Both kinds of table are lazy ``CASE WHEN`` chains, so a row pays for the
rules up to its first hit, and only for those of which it holds a needle.  ``text`` is
the name of a column in matching form; SQL text keeps building hundreds of conditions
to one call into the JVM.
"""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnera import fixed_values as fixed
from turnera.functions.text import SPACE, WORD, sql_text, strip

_EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"


def java_pattern(pattern: str) -> str:
    """A rule in Spark's regex dialect; every rule begins at a word start."""
    body = pattern.removeprefix(r"\b").replace("(", "(?:")
    for ours, java in ((r"\b", _EDGE), (r"\w", f"[{WORD}]"), (r"\d", r"\p{Nd}"), (r"\s", f"[{SPACE}]")):
        body = body.replace(ours, java)
    return rf"(?<![{WORD}]){body}"


def needles(pattern: str) -> tuple[str, ...]:
    """Plain strings one of which every match of ``pattern`` contains; () if none is known."""
    choices = [
        tuple(group.split("|"))
        for group, optional in re.findall(r"\(([^()]*)\)(\??)", pattern)
        if not optional and re.fullmatch(r"[a-z |]+", group)
    ]
    plain = re.sub(r"\([^()]*\)\??|\\[a-z]|\{[^}]*\}|[a-z]\?|[*+]", "\0", pattern)
    pieces = sorted(filter(None, plain.split("\0")), key=len)
    if pieces and (len(pieces[-1]) > 2 or not choices):
        return (pieces[-1],)
    return max(choices, key=lambda words: min(map(len, words)), default=())


def occurs(text: str, pattern: str) -> str:
    """SQL condition: the rule matches.  A byte search for a needle spares most regex scans."""
    found = f"{text} RLIKE {sql_text(java_pattern(pattern))}"
    words = " OR ".join(f"contains({text}, {sql_text(word)})" for word in needles(pattern))
    return f"(({words}) AND {found})" if words else found


def first_label(text: str, rules: Mapping[str, Sequence[str]], vetoes: Sequence[str] = ()) -> Column:
    """The first label, in table order, one of whose patterns occurs anywhere in ``text``."""
    labelled = ({"": vetoes} if vetoes else {}) | dict(rules)
    cases = (
        f"WHEN {' OR '.join(occurs(text, p) for p in patterns)} THEN {sql_text(label)}"
        for label, patterns in labelled.items()
    )
    return F.expr(f"CASE {' '.join(cases)} ELSE '' END")


def first_match(text: str, rules: Sequence[str]) -> Column:
    """The text matched by the first rule that occurs anywhere: rule order beats position."""
    cases = (
        f"WHEN {occurs(text, rule)} THEN regexp_extract({text}, {sql_text(java_pattern(rule))}, 0)"
        for rule in rules
    )
    return strip(F.expr(f"CASE {' '.join(cases)} ELSE '' END"))


def action(text: str) -> Column:
    return first_label(text, fixed.ACTION_RULES, fixed.ACTION_VETOES)


def specialty(text: str) -> Column:
    return first_label(text, fixed.SPECIALTY_RULES)


def requested_date(text: str) -> Column:
    return first_match(text, fixed.DATE_RULES)


def preferred_time(text: str) -> Column:
    return first_match(text, fixed.TIME_RULES)


EXTRACTORS = {
    "accion": action,
    "especialidad": specialty,
    "fecha_solicitada": requested_date,
    "preferencia_horario": preferred_time,
}
