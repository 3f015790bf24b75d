"""URL verdicts by rules and by a tree of path templates per host.

A rule names a host (with all its subdomains) and a path prefix; the longest
fitting rule decides. Where none fits, the template of the url does: per host and
level, segments of fewer than ``MIN_PAGES`` pages become the wildcard ``*``;
branches whose labelled share is statistically like their siblings' are merged
into the wildcard too; a branch that differs stays literal. ``DEPTH`` levels have
templates, anything below them is ``**``. A template is blocked when its smoothed
share of bad labels reaches ``PURITY``: its own labels are weighed against its
host's, and the host's against all labels.

Counts are summed per (host, template, segment) before any shuffle needs them, so
a host with most of the pages stays cheap; the rare segments of a host are never
gathered in one place.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and the verdict of the empty host's template; pages without a label count
for branches but not for purity; with no label at all everything without a rule
is allowed; repeated rows count and are judged each.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.sources.scratch import durable

ALLOW, BLOCK = "allow", "block"
DEPTH = 4
#: A literal branch has at least so many pages, however many its node has: no share of
#: them is asked for.
MIN_PAGES, MIN_SHARE = 5, 0.0
#: Standard deviations from the siblings' share beyond which a branch is not merged.
APART = 1.96
#: Labels' worth of weight that a prior share has.
STRENGTH = 4.0
PURITY = 0.5
WILDCARD, BELOW = "*", "**"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(at > 0, lower).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    after = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.when(at > 0, F.regexp_extract(after, r"^[^?#]*", 0)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits; null where none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def _shown(segment: Column) -> Column:
    """A literal segment, with a star of its own kept apart from the wildcard."""
    return F.regexp_replace(segment, r"([*\\])", r"\\$1")


def _branches(level: DataFrame) -> DataFrame:
    """Literal branches ``(h, p, s)`` of one level of ``(host, template, segment, bad)``."""
    node, labelled = ["host", "template"], F.col("labelled")
    counts = level.groupBy(*node, "segment").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum("bad").alias("bad")
    )
    counts = counts.withColumn("bad", F.coalesce("bad", F.lit(0)))
    large = counts.where(F.col("n") >= MIN_PAGES)
    pooled = large.groupBy(*node).agg(
        (F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0))).alias("share")
    )
    spread = F.sqrt(labelled * F.col("share") * (1 - F.col("share")))
    away = F.abs(F.col("bad") - labelled * F.col("share"))
    return (
        large.join(pooled, node)
        .where(away > APART * spread)
        .select(F.col("host").alias("h"), F.col("template").alias("p"), F.col("segment").alias("s"))
    )


def with_templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``pages(host, path, bad, ...)`` with the ``template`` of each path."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    df = pages.withColumns(
        {"segments": F.when(F.col("path") == "", F.array()).otherwise(segments), "template": F.lit("")}
    )
    for i in range(depth):
        segment = F.get("segments", F.lit(i))
        df = df.withColumn("segment", segment)
        literal = durable(_branches(df.where(segment.isNotNull())))
        on = (F.col("host") == F.col("h")) & (F.col("template") == F.col("p")) & (F.col("segment") == F.col("s"))
        shown = F.when(F.col("s").isNotNull(), _shown(F.col("s"))).otherwise(WILDCARD)
        grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(
            F.concat("template", F.lit("/"), shown)
        )
        df = df.join(literal, on, "left").withColumn("template", grown).drop("h", "p", "s")
    deeper = F.size("segments") > depth
    template = F.when(deeper, F.concat("template", F.lit("/" + BELOW))).otherwise(F.col("template"))
    return df.withColumn("template", template).drop("segments", "segment")


def purities(templates: DataFrame) -> DataFrame:
    """``(host, template, purity)``: smoothed share of bad labels of each template."""
    per_template = durable(
        templates.groupBy("host", "template").agg(
            F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
        )
    )
    per_host = per_template.groupBy("host").agg(
        F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad")
    )
    n, bad = per_template.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = bad / n if n else 0.0
    host = (F.col("host_bad") + STRENGTH * overall) / (F.col("host_labelled") + STRENGTH)
    own = (F.col("bad") + STRENGTH * host) / (F.col("labelled") + STRENGTH)
    return per_template.join(per_host, "host").select("host", "template", own.alias("purity"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = (), purity: float = PURITY
) -> DataFrame:
    """``(page_id, host, path, rule, template, purity, verdict)`` per row of
    ``pages(page_id, url, bad)``; ``bad`` is 1, 0 or null for no label.

    ``rules`` pairs a rule like ``example.net/en/`` with a verdict.
    """
    base = durable(
        pages.select(
            "page_id",
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            F.col("bad").cast("long").alias("bad"),
        )
    )
    templates = durable(with_templates(base))
    shares = purities(templates).withColumnsRenamed({"host": "h", "template": "t"})
    found = templates.join(shares, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = F.when(F.col("purity") >= purity, BLOCK).otherwise(ALLOW)
    for name, verdict in rules:
        verdicts = F.when(F.col("rule") == name, verdict).otherwise(verdicts)
    return found.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", verdicts.alias("verdict"), "template", "purity"
    )
