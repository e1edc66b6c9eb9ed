"""URL filters by rules and by link-graph propagation between hosts. Built-in DataFrame functions only.

Rules come first: a rule `host/path` fits its host and all subdomains when the url's path starts with the rule's path;
the longest fitting rule gives the verdict. Every other page takes the verdict of its host, from two propagations over
the host graph (absolute links of the pages' HTML, without links of a host to itself, weighted by their number):

* trust: personalised PageRank along the links, restarting at hosts with allowed pages;
* distrust: the same along the reversed links, restarting at hosts with blocked pages.

Restart weight is a host's share of the allowed (blocked) pages, each side sums to one, mass at a host without links
leaves the walk. Both run in one frame (kind, host, score): power steps of one join and one aggregation each,
cut by a checkpoint every few steps. A host is blocked if its distrust makes up more than `threshold` of its distrust
plus trust; a host that neither walk reaches is allowed. The walk stops when a step moves less than `tolerance` of the
mass; since step k moves at most damping ** k of it, that is after log(tolerance) / log(damping) steps at the latest.
A link is an `<a` tag up to its first < or > with an href of any length.

Skew: links are counted by (from, to) with partial sums before they are shuffled, so copies and a host with a third of
all pages add one row for each distinct target and task; the last join is on the host, where AQE splits a hot host.

Defined cases: null url or url without `://` has empty host and path, no rule, and is allowed; null html has no links;
repeated pages count as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (rule, verdict)
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
DAMPING = 0.85
TOLERANCE = 1e-6
THRESHOLD = 0.5
_LINK = r"""(?i)<a\s(?:[^<>]*?[\s"'])??href\s*+=\s*+["']?\s*+(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s<>]++)"""


def _lower(c: Column) -> Column:
    return F.translate(c, common.UPPER, common.UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty for null or no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule = verdict = None
    for text, word in sorted(rules, key=lambda r: -len(r[0])):
        at_host, _, at_path = text.partition("/")
        fits = ((host == at_host) | host.endswith("." + at_host)) & path.startswith("/" + at_path)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(text))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(word))
    none = F.lit(None).cast("string")
    return (rule.otherwise(none), verdict.otherwise(none)) if rule is not None else (none, none)


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): absolute links between different hosts."""
    host, _ = host_and_path(F.col(url))
    found = pages.where(F.col(html).contains("//")).select(host.alias("src"), F.col(html).alias("html"))
    found = found.select("src", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    found = found.select("src", _lower(F.col("dst")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(kind, host, score) of the settled walks. edges: (kind, src, dst, n); seeds: (kind, host, n)."""
    total = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    walk = edges.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("p"))
    walk = common.cut(walk)
    mass = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    start = common.cut(seeds.join(mass, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("score")))
    restart = start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    if walk.isEmpty():  # without links every walk ends where it started
        return restart
    now = before = start
    steps = math.ceil(math.log(tolerance) / math.log(damping))
    for k in range(steps):
        moved = now.join(walk, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        now = restart.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            now = common.cut(now)
            change = now.unionByName(before.select("kind", "host", (-F.col("score")).alias("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d"))
            if (change.agg(F.sum("d")).first()[0] or 0.0) < tolerance:
                break
            before = now
    return now


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    threshold: float = THRESHOLD,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    kind = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust")
    seeds = ruled.where("by_rule IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    links = common.cut(host_links(pages, url, html))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    scores = propagate(edges, seeds, damping, tolerance)
    part = {k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)) for k in ("trust", "distrust")}
    hosts = common.cut(scores.groupBy(F.col("host").alias("scored")).agg(*(v.alias(k) for k, v in part.items())))
    both = ruled.join(hosts, F.col("host") == F.col("scored"), "left")
    bad = F.round(F.col("distrust") / (F.col("distrust") + F.col("trust")), 12) > threshold
    verdict = F.coalesce("by_rule", F.when(bad, "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
