"""URL filter: hand-written rules first, and trust spread over the host graph for all other urls.

Hosts are nodes. Absolute links in the pages, and a listed host's nearest listed ancestor domain, are edges; their weight is
the number of pages that have them. Personalised PageRank starts from the hosts with allowed pages and follows the edges;
distrust starts from those with blocked pages and goes against them, until no host's rank changes by more than a share of
itself. A host whose distrust exceeds its trust by the threshold is blocked. Hosts, edges and ranks stay in tables; each
round is a join and a sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import cut, stored

DAMPING = 0.85
#: Spreading ends when a round adds no more than this share to any host's rank.
TOLERANCE = 1e-6
#: Ranks within this share are equal, so that neither the end of spreading nor the order of a sum can decide.
MARGIN = 1e-5
#: Distrust may exceed trust by this factor.
THRESHOLD = 1.0
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of op5.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty without ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(has, path).otherwise("")


def matched(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        mine = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fits = F.when(mine, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fits)
    return fits


def host_edges(urls: DataFrame) -> DataFrame:
    """(src, dst, w) between hosts; ``urls`` has host and html."""
    links = urls.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    hosts = urls.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"))
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("host", "\\.")), F.lit(2))), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(F.split("host", "\\."), i, 1000), ".").alias("up")))).alias("a"))
    listed = above.join(hosts.select(F.col("host").alias("up")), F.col("a.up") == F.col("up")).groupBy("host").agg(F.min_by("up", "a.i").alias("up"))
    both = listed.where("up != ''").select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*", F.lit(1).cast("bigint").alias("w"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind, rank) of all hosts that seeds reach; seeds: (host, kind, seed) with kind trust or distrust, summing to 1 in each.

    A rank is a sum over the lengths of walks. A host's first term is far above the tolerance, so spreading goes on until no
    host is reached for the first time.
    """
    one = edges.select("src", "dst", "w", F.lit("trust").alias("kind")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit("distrust").alias("kind")))
    out = one.groupBy("src", "kind").agg(F.sum("w").alias("all"))
    steps = cut(one.join(out, ["src", "kind"]).select("src", "dst", "kind", (F.col("w") / F.col("all")).alias("share")))
    if steps.isEmpty():  # nothing to follow
        return seeds.select("host", "kind", F.col("seed").alias("rank"))
    state = seeds.select("host", "kind", F.col("seed").alias("term"), ((1 - damping) * F.col("seed")).alias("rank"))
    while True:
        moved = state.where("term > 0").withColumnRenamed("host", "src").join(steps, ["src", "kind"]).select(F.col("dst").alias("host"), "kind", (damping * F.col("term") * F.col("share")).alias("term"))
        both = state.select("host", "kind", F.lit(0.0).alias("term"), "rank").unionByName(moved.withColumn("rank", (1 - damping) * F.col("term")))
        state = cut(both.groupBy("host", "kind").agg(F.sum("term").alias("term"), F.sum("rank").alias("rank")))
        if (state.agg(F.max(F.when(F.col("rank") > 0, F.col("term") / F.col("rank"))).alias("most")).first()["most"] or 0.0) <= tolerance:
            return state.select("host", "kind", "rank")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Null html has no links.
    Repeated rows count each, also as seeds. Without seeds all is allowed; an empty table gives no rows; other columns are
    ignored.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    light = stored(urls.drop("html").withColumn("m", matched(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "m.rule", "m.verdict"), "urls")
    edges = stored(host_edges(urls), "edges")
    counted = light.where("rule is not null").groupBy("host", F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind")).agg(F.count("*").alias("n"))
    total = counted.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    seeds = cut(counted.join(F.broadcast(total), "kind").select("host", "kind", (F.col("n") / F.col("total")).alias("seed")))
    ranks = propagate(seeds, edges)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    scored = cut(ranks.groupBy("host").agg(of("trust"), of("distrust")))
    joined = light.join(scored, "host", "left").select("page_id", "host", "path", "rule", "verdict", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    spread = F.when(F.col("distrust") > (1 + MARGIN) * threshold * F.col("trust"), "block").otherwise("allow")
    return joined.withColumn("verdict", F.coalesce("verdict", spread))
