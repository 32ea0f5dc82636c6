"""URL verdicts by rules, and beyond them by trust and distrust spread over host links.

Rules (host and path prefix) decide first, the longest that fits.  Pages that no rule fits
are judged by their host: personalised PageRank starts from the hosts of allowed pages and
follows links; distrust starts from the hosts of blocked pages and follows links backwards,
to those that link to them, until ranks settle.  A host with more distrust than trust is blocked.

Links between hosts are the absolute ``href`` targets of a page, and those between a host
and its parent domains down to two labels, in both directions, since a site and its
subdomains vouch for each other.  Links within a host move nothing and are left out.

Everything is joins and sums of DataFrames.  Ranks are one row a host; arcs of one host are
dealt into salted pieces, as a hub may hold most of them.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule, and
is allowed, as is a host without evidence (no trust, no distrust).  Null html has no links.
A url or html of any length is read whole.  Repeated rows are judged and counted each.  Other columns pass through; those named like an
output are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import adding, checkpointed, require

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
#: Share of rank that follows links; the rest returns to the seeds.
FOLLOW = 0.85
#: Ranks have settled when ``TOGETHER`` rounds change none by more than this share of it; what later rounds
#: would add is then below FOLLOW / (1 - FOLLOW) of that.  Distrust is more than trust when it is
#: more by a share beyond that rest, so that neither it nor the order of sums decides.
SETTLED, EQUAL = 1e-4, 1e-3
#: Rounds between two checkpoints.
TOGETHER = 4
SALTS = 8
#: Links and ranks that a task holds, whatever number of partitions a shuffle has.
ROWS = 1 << 18


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (rule text, verdict) that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(set(rules), key=lambda r: (len(r[0]), r)):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` by rules alone."""
    source = F.col(f"`{url}`").cast("string")
    split = adding(pages, {"host": host_of(source), "path": path_of(source)})
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    return adding(split, {"rule": rule, "verdict": verdict})


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct links (src, dst) between hosts."""
    host = host_of(F.col(f"`{url}`").cast("string")).alias("src")
    targets = F.transform(F.regexp_extract_all(F.col(f"`{html}`").cast("string"), F.lit(HREF), 1), lambda t: host_of(F.concat(F.lit("x:"), F.regexp_replace(t, "^(?i)https?:", ""))))
    absolute = pages.select(host, F.explode(F.array_distinct(targets)).alias("dst")).distinct()
    hosts = pages.select(host.alias("host")).union(absolute.select("dst")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    sized = hosts.withColumn("labels", labels).filter(F.size("labels") > 2)
    steps = sized.select(F.explode(F.transform(F.expr("sequence(1, size(labels) - 2)"), lambda i: F.struct(
        F.array_join(F.slice("labels", i, F.size("labels")), ".").alias("src"), F.array_join(F.slice("labels", i + 1, F.size("labels")), ".").alias("dst")))).alias("step"))
    up = steps.select("step.src", "step.dst").distinct()
    return absolute.union(up).union(up.select("dst", "src")).filter("src <> dst AND src <> '' AND dst <> ''").distinct()


def spread(seeds: DataFrame, links: DataFrame, follow: float = FOLLOW, rounds: int | None = None, settled: float = SETTLED) -> DataFrame:
    """Personalised PageRank (kind, host, rank) over links (kind, src, dst) from seeds (kind, host, weight).

    Weights of a kind are brought to a sum of one.  Without a number of ``rounds`` it goes on until ``TOGETHER``
    rounds change no host's rank by more than the share ``settled`` of it, so that every host that links reach has
    one, however far it is and however small.
    """
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("rank"))  # a row a kind
    start = checkpointed(start)
    every = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt")
    shares = links.groupBy("kind", "src").agg((F.lit(follow) / F.count("*")).alias("share")).select("*", every)
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)))
    arcs = checkpointed(dealt.join(shares, ["kind", "src", "salt"]))  # what a link passes on never changes: met once
    tasks = -(-(arcs.count() + start.count()) // ROWS) or 1  # no more hosts than that have a rank
    arcs, start = arcs.coalesce(tasks), start.coalesce(tasks)
    none = F.lit(0.0).alias("before")
    back = start.select("kind", "host", (F.col("rank") * (1 - follow)).alias("rank"), none)
    ranks = last = start
    number = 0
    while number != rounds:
        number += 1
        sent = ranks.select("kind", F.col("host").alias("src"), "rank", every)
        heard = arcs.join(sent, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"), none)
        ends = number % TOGETHER == 0 or number == rounds
        terms = heard.union(back)
        if ends:
            terms = terms.union(last.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("before")))
        ranks = terms.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")).coalesce(tasks)
        if ends:
            ranks = last = checkpointed(ranks)
            if rounds is None and ranks.filter(F.abs(F.col("rank") - F.col("before")) > settled * F.col("rank")).isEmpty():
                break
    return ranks.select("kind", "host", "rank")


def judged(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", key: str = "page_id", rounds: int | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and a ``verdict`` that is never null to every page.

    Ranks are spread until they settle, unless a number of ``rounds`` is given.
    """
    require(pages, url, html, key)
    named = parsed(pages.select(F.col(f"`{url}`").alias("_url")), rules, "_url").filter("verdict IS NOT NULL")
    seeds = named.groupBy(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    links = checkpointed(host_links(pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").union(links.select(F.lit("distrust"), "dst", "src"))
    evidence = spread(seeds, both, rounds=rounds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"),
    )
    worse = F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * (1 + EQUAL)
    blocked = evidence.filter(worse).select("host", F.explode(F.expr(f"sequence(0L, {SALTS * 2 - 1}L)")).alias("_salt"), F.lit(True).alias("_blocked"))
    dealt = parsed(pages, rules, url).withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{key}`"), "path"), F.lit(SALTS * 2)))
    held = dealt.join(blocked, ["host", "_salt"], "left")
    by_host = F.when(F.col("_blocked"), "block").otherwise("allow")
    return adding(held, {"verdict": F.coalesce("verdict", by_host)}).drop("_salt", "_blocked")
