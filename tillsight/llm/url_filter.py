"""URL filter: rules first, link-graph propagation for what no rule fits.

Pages judged by a rule make their hosts seeds.  Trust starts at the hosts of
allowed pages and follows links; distrust starts at the hosts of blocked pages
and follows links backwards, to those that link to them.  Both are personalised
PageRanks over weighted host edges.  All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .storage import Scratch

DAMPING = 0.85
# Ranks are iterated until a round changes them by no more than this in total, of
# either kind, which sum to 1; damping bounds the rounds that takes.
TOLERANCE = 1e-6
# Iterations that one plan holds before the ranks are written and compared.
STRIDE = 5
THRESHOLD = 0.5
# An attribute's value stands in quotes of either kind, or ends at white space.
HREF = r"""(?i)href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF_AROUND = r"""(?i)^href\s*=\s*["']?|["']$"""


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The parts of a url after its first ``://``; both empty if there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def fits(rule: Rule, host: Column, path: Column) -> Column:
    at = (host == rule.host) | host.endswith("." + rule.host)
    return at & path.startswith(rule.path)


def by_rules(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; of equally long ones, that with the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(str(r)), -len(r.host), str(r), r.verdict))
    nothing = F.lit(None).cast("string")
    rule = reduce(lambda other, r: F.when(fits(r, host, path), str(r)).otherwise(other), reversed(ordered), nothing)
    verdict = reduce(lambda other, r: F.when(fits(r, host, path), r.verdict).otherwise(other), reversed(ordered), nothing)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between hosts with their number: src, dst, links.

    ``pages`` has host and html.  A link without a host of its own leads to
    the page's host; anchors, scripts and mail addresses are no links.
    """
    found = pages.where("host != ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(0))).alias("found")
    )
    link = found.select("src", F.regexp_replace("found", HREF_AROUND, "").alias("link"))
    link = link.where(~F.lower("link").rlike(r"^\s*(#|javascript:|mailto:|data:|tel:)"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    is_full = full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    target = F.when(is_full, host_and_path(full)[0]).otherwise(F.col("src"))
    return link.select("src", target.alias("dst")).where("dst != ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(
    hosts: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """Trust and distrust of every host: host, trust, distrust.

    ``hosts`` has host, allowed and blocked (numbers of pages so judged).  A
    host without outgoing (for distrust: incoming) links keeps its rank, as if
    it linked to itself.  Without seeds of a kind all ranks of that kind are 0.

    A round changes the ranks by at most ``damping`` times what the one before
    changed, so they settle, however long the paths are.
    """
    way = F.explode(
        F.array(
            F.struct(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to")),
            F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to")),
        )
    )
    ways = edges.select("links", way.alias("way")).select("way.*", "links")
    out = ways.groupBy("kind", "from").agg(F.sum("links").alias("out"))
    weighted = ways.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("links") / F.col("out")).alias("part"))

    named = hosts.select("host").union(edges.select("dst")).union(edges.select("src")).distinct()
    counted = named.join(hosts, "host", "left").select(
        "host", F.coalesce("allowed", F.lit(0)).alias("allowed"), F.coalesce("blocked", F.lit(0)).alias("blocked")
    )
    totals = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()

    def share(kind: str, count: str) -> Column:
        total = totals[count] or 0
        seed = F.col(count) / total if total else F.lit(0.0)
        return F.struct(F.lit(kind).alias("kind"), seed.cast("double").alias("seed"))

    seeds = counted.select("host", F.explode(F.array(share("trust", "allowed"), share("distrust", "blocked"))).alias("s"))
    seeds = scratch.table(seeds.select("host", "s.kind", "s.seed"), "seeds")
    stuck = seeds.join(
        weighted.select("kind", F.col("from").alias("host")).distinct(), ["kind", "host"], "left_anti"
    ).select("kind", F.col("host").alias("from"), F.col("host").alias("to"), F.lit(1.0).alias("part"))
    graph = scratch.table(weighted.union(stuck), "edges")

    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    done, change = 0, 1.0
    while change > tolerance:
        for _ in range(STRIDE):
            done += 1
            before = ranks.select("kind", "host", F.col("rank").alias("before"))
            inflow = (
                ranks.where("rank > 0")
                .join(graph.withColumnRenamed("from", "host"), ["kind", "host"])
                .groupBy("kind", F.col("to").alias("host"))
                .agg(F.sum(F.col("rank") * F.col("part")).alias("inflow"))
            )
            rank = (1 - damping) * F.col("seed") + damping * F.coalesce("inflow", F.lit(0.0))
            ranks = seeds.join(inflow, ["kind", "host"], "left").select("kind", "host", rank.alias("rank"))
        # Only the last round of a stride is compared with the one before.
        ranks = ranks.join(before, ["kind", "host"])
        ranks = scratch.table(ranks, f"ranks-{done}")
        if done > STRIDE:
            scratch.drop(f"ranks-{done - STRIDE}")
        changes = ranks.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("change"))
        change = changes.agg(F.max("change")).first()[0] or 0.0
    return ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"),
    )


def judge(
    pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """Every page's verdict: page_id, host, path, rule, verdict, by_host.

    ``pages`` has page_id, url and html.  The longest rule that fits decides.
    Where none fits, a host is blocked if its distrust exceeds its trust by
    more than ``threshold`` times its share of all pages with a host; every
    other host is allowed.  A null url, or one without ``://``, has an empty
    host, which no rule fits and which is allowed; null html has no links.
    Repeated pages count as often as they are there.  Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = host_and_path(F.col("url"))
    located = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(rules, F.col("host"), F.col("path"))
    judged = located.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    hosts = (
        judged.where("host != ''")
        .groupBy("host")
        .agg(
            F.count_if(F.col("by_rule") == "allow").alias("allowed"),
            F.count_if(F.col("by_rule") == "block").alias("blocked"),
            F.count("*").alias("pages"),
        )
    )
    hosts = scratch.table(hosts, "hosts")
    edges = scratch.table(host_edges(pages.select(host.alias("host"), "html")), "links")
    total = hosts.agg(F.sum("pages")).first()[0] or 1
    ranks = propagate(hosts.select("host", "allowed", "blocked"), edges, scratch, tolerance=tolerance)
    excess = F.col("distrust") - F.col("trust")
    verdicts = ranks.join(hosts.select("host", "pages"), "host").select(
        "host", F.when(excess > threshold * F.col("pages") / total, "block").otherwise("allow").alias("of_host")
    )
    verdicts = scratch.table(verdicts, "verdicts")
    return judged.join(verdicts, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", "of_host", F.lit("allow")).alias("verdict"),
        F.col("by_rule").isNull().alias("by_host"),
    )
