"""URL filters: rules on hosts and paths, and link-graph propagation where no rule fits.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are blocked seeds, each weighted
by its number of such pages. Trust is a personalised PageRank from the trusted seeds along the links between hosts;
distrust is the same from the blocked seeds against the links, so that it reaches who links to blocked hosts. A host
whose distrust exceeds `limit` times its trust is blocked, any other allowed, an unreached one too.

Host links are counted over all pages: absolute or protocol-relative href and src values, and bare www. names in the
text; a link to the page's own host is none. A host and the next host above it in its name (blog.a.org and a.org), where
both have pages, also link with each other, as they are run by the same people; that counts as one page's link. Dangling hosts pass nothing on. Ranks are computed for both at once, by one
join and one aggregation a round, and written out every few rounds. Only DataFrame functions are used.

A null url, or one without "://", has an empty host and path, fits no rule, takes part in no link and is allowed.
In the graph a host goes without user, port and closing dot, in urls as in links; the column host keeps them.
Null html has no links. Repeated rows count again as seeds and links, and are judged each.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.staging import staged

DAMPING = 0.85
ROUNDS = 12
ROUNDS_BETWEEN_WRITES = 4

_URL = r"://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""
_BARE = r"(?i)(?<![\w./@\-])(www\.[a-z0-9\-]+(?:\.[a-z0-9\-]+)+)"


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str

    @classmethod
    def parse(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _first_fit(rules: list[Rule], value) -> Column:
    """`value(rule)` of the longest rule that fits the columns host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        host = F.lit(True) if not rule.host else (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
        out = F.when((F.col("host") != "") & host & F.col("path").startswith(rule.path), F.lit(value(rule))).otherwise(out)
    return out


def node_of(host: Column) -> Column:
    """The host in the link graph: without user, port and closing dots."""
    return F.regexp_replace(host, r"^.*@|(?::\d*|\.)+$", "")


def judged_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, action) of every page; rule and action are null where no rule fits."""
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return at.select("*", _first_fit(rules, lambda r: r.text).alias("rule"), _first_fit(rules, lambda r: r.action).alias("action"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many pages of host src name host dst."""
    named = F.array_union(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), F.regexp_extract_all("html", F.lit(_BARE), F.lit(1)))
    links = pages.where("html is not null").select(node_of(host_of(F.col("url"))).alias("src"), F.explode(named).alias("to"))
    links = links.select("src", node_of(_lower(F.col("to"))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def family_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): links in both directions between hosts and the hosts above them, from distinct `hosts` (host)."""
    above = F.expr("substring_index(host, '.', -(size(split(host, '[.]')) - 1))")
    pairs = hosts.where("host like '%.%.%'").select("host", above.alias("above")).join(hosts.select(F.col("host").alias("above")), "above")
    both = F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("host").alias("dst"))))
    return pairs.select(both.alias("x")).select("x.src", "x.dst", F.lit(1).cast("long").alias("n"))


def ranks(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from `links` (src, dst, n) and `seeds` (host, allowed, blocked)."""
    links = staged(links, "links")
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    none = F.lit(0.0)
    forward = links.join(out, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("t"), none.alias("d"))
    back = links.join(into, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), none.alias("t"), (F.col("n") / F.col("total")).alias("d"))
    flows = staged(forward.union(back).groupBy("from", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "flows")
    total = seeds.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    share = [F.coalesce(F.col(c) / F.lit(float(total[c] or 1)), none).alias(c) for c in ("allowed", "blocked")]
    hosts = seeds.select("host").union(flows.select("to")).distinct()
    start = staged(hosts.join(seeds.select("host", *share), "host", "left").fillna(0.0), "seeds")
    now = start.select("host", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"))
    for k in range(1, rounds + 1):
        sent = flows.join(now.withColumnRenamed("host", "from"), "from").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        new = [((1 - damping) * F.col(s) + damping * F.coalesce(F.col(m), none)).alias(c) for s, m, c in (("allowed", "t", "trust"), ("blocked", "d", "distrust"))]
        now = start.join(sent, "host", "left").select("host", *new)
        if k % ROUNDS_BETWEEN_WRITES == 0 or k == rounds:
            now = staged(now, "ranks")
    return now


def judge(pages: DataFrame, rules: list[Rule], limit: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    at = judged_by_rules(pages, rules).withColumn("node", node_of(F.col("host")))
    count = [F.count(F.when(F.col("action") == a, 1)).alias(c) for a, c in (("allow", "allowed"), ("block", "blocked"))]
    seeds = staged(at.where("node <> ''").groupBy(F.col("node").alias("host")).agg(*count), "hosts")
    links = host_links(pages.select("url", "html")).unionByName(family_links(seeds.select("host")))
    known = ranks(links.groupBy("src", "dst").agg(F.sum("n").alias("n")), seeds)
    both = at.join(known.withColumnRenamed("host", "node"), "node", "left")
    own = F.when(F.col("distrust") > limit * F.col("trust"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
