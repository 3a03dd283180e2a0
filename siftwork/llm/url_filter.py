"""URL filters: rules by host and path, and for the rest trust that spreads over the links of hosts.

Hosts with allowed pages are trusted seeds, hosts with blocked pages distrusted ones. Trust follows
links, distrust runs against them, both as personalised PageRank over host edges until the masses
settle; a host is blocked where distrust outweighs trust, or where distrust alone arrives. All of it is Spark SQL over tables of hosts and edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.sources.checkpoints import discard, materialize, materialize_counting

LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # host and path, like example.org/en/


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    rule_host, slash, rest = rule.pattern.partition("/")
    return ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))


def _longest(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # the last one wraps the others
        out = F.when(_fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from links in `pages(host, html)` that name a host.

    A link that begins with `//` has the scheme of its page, whichever that is.
    """
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("url"))
    url = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("page:"), "url")).otherwise(F.col("url"))
    ends = linked.select("src", host_of(url).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-9, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust, trusted, distrusted) from `seeds(host, trust, distrust)`.

    Masses only grow from round to round. The rounds end when none reaches a host anew and no host's
    mass grows by more than `tolerance` of itself, however small it is, so the last host of a long
    chain is as exact as a seed. `trusted` and `distrusted` say which kind arrives at all, also where
    its mass is too small for a double. Distrust uses the edges reversed. One table per round; a host of any number of links is joined
    to one row and summed with partial sums. Mass that meets no edge leaves the walk.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), "links")
    both = both.union(edges.select(F.lit("distrust"), "dst", "src", "links"))
    out = both.groupBy("kind", "host").agg(F.sum("links").alias("out"))
    moves = materialize(both.join(out, ["kind", "host"]).select("kind", "host", "next", (F.col("links") / F.col("out")).alias("share")), "moves")
    start = seeds.select("host", F.expr("stack(2, 'trust', double(trust), 'distrust', double(distrust)) as (kind, mass)")).filter("mass > 0")
    start = materialize(start.select("kind", "host", (F.lit(1 - damping) * F.col("mass")).alias("mass")), "seeds")
    mass, none = start, F.lit(None).cast("double")
    growing = 0 if moves.isEmpty() else 1
    while growing:
        moved = moves.join(mass, ["kind", "host"]).select("kind", F.col("next").alias("host"), (F.lit(damping) * F.col("share") * F.col("mass")).alias("mass"))
        parts = start.union(moved).withColumn("old", none).union(mass.select("kind", "host", none, "mass"))
        summed = parts.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.max("old").alias("old"))
        old, (mass, growing) = mass, materialize_counting(summed, "mass", f"old is null or mass - old > {tolerance!r} * mass")
        mass = mass.select("kind", "host", "mass")
        if old is not start:
            discard(old)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    there = lambda kind: F.max(F.col("kind") == kind).alias(kind + "ed")
    return mass.groupBy("host").agg(part("trust"), part("distrust"), there("trust"), there("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = 2.0) -> DataFrame:
    """The rows of `pages(page_id, url, html)` as page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    wins. Other pages are blocked if their host's distrust exceeds `ratio` times its trust, or if distrust
    alone reaches it, however little; else they are allowed; so are pages without a host, and hosts that no seed reaches. Null html has no links.
    """
    host, path = F.col("host"), F.col("path")
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = placed.withColumn("rule", _longest(rules, host, path, lambda r: r.pattern)).withColumn("by_rule", _longest(rules, host, path, lambda r: r.verdict))
    edges = materialize(host_edges(placed), "edges")
    seeds = ruled.filter("rule is not null").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("trust"), F.count_if(F.col("by_rule") == "block").alias("distrust"))
    scores = propagate(edges, seeds)
    bad = scores.filter((F.col("distrust") > ratio * F.col("trust")) | (F.col("distrusted") & ~F.col("trusted"))).select("host", F.lit("block").alias("by_host"))
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
