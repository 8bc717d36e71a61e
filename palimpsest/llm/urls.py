"""URL filters: rules on hosts and paths, and trust and distrust that spread over the links between hosts.

A rule fits its host and all subdomains where the url's path begins with the rule's; the longest rule decides.  Rules meet the distinct
hosts by an equality join on host suffixes, as long as the longest rule host at most, and only then the pages.

Hosts that rules do not settle are judged by the link graph.  A host is trusted where at least `seed_share` of its pages are allowed by
rules, and blocked where as many are blocked.  Trust is a personalised PageRank from the trusted hosts along the links; distrust is one
from the blocked hosts against them, since whoever links to a blocked host has a part in it.  Both are summed as a series: each round moves
the mass of the hosts reached last over one link and damps it, until what is left on the way is under `tolerance`, so a round's rows are
the hosts that it reaches.  A host is blocked where its distrust exceeds its trust and is at least `least_lift` times the mean over hosts.

Links are `<a href>` with a host of their own.  A link inside a host, relative ones included, is no edge; a page counts once for each host
that it links to, and edges are summed before anything is joined.

Defined results: a url that is null or has no `://` has an empty host and path, which no rule fits and no link reaches: it is allowed, as
is every host of which nothing is known; null html has no links; repeated pages count again; without seeds nothing spreads; an empty table
gives no rows; only page_id, url and html are read, so extra columns with clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: The rules of the registered query, as (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or scheme-relative target of a link, without what stands before the host.
LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^"'\s>/?#]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty where it has none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.char_length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, verdict, rule) of (verdict, host and path)."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], verdict, r) for verdict, r in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, verdict string, rule string")


def fit_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits) to (host, path, ...).  The rules of one host are held together."""
    labels = F.split("rule_host", r"\.")
    longest = rules.agg(F.max(F.size(labels))).first()[0] or 0
    if not longest:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    parts = F.slice(F.reverse(F.split("host", r"\.")), 1, longest)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.reverse(F.slice(parts, F.lit(1), k))))
    hosts = pages.select("host").where("host <> ''").distinct().withColumn("rule_host", F.explode(suffixes))
    order = F.struct((-F.char_length("rule")).alias("less"), "rule_path", "verdict", "rule")
    of = materialise(hosts.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("rules")))
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    joined = pages.join(of, "host", "left").withColumn("fit", F.get(fitting, F.lit(0)))
    return joined.select(*pages.columns, F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("rule_verdict"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many pages of a host link to another host."""
    own, _ = host_and_path(F.col("url"))
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda t: F.translate(t, UPPER, LOWER)))
    found = pages.select(own.alias("src"), F.explode(targets).alias("dst")).where("src <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _ways(links: DataFrame) -> DataFrame:
    """(way, at, to, share): trust along the links, by the share of the source's links; distrust against them, by the share of the target's."""
    out = links.groupBy("src").agg(F.sum("weight").alias("n"))
    into = links.groupBy("dst").agg(F.sum("weight").alias("n"))
    along = links.join(out, "src").select(F.lit("trust").alias("way"), F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("weight") / F.col("n")).alias("share"))
    against = links.join(into, "dst").select(F.lit("distrust").alias("way"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("weight") / F.col("n")).alias("share"))
    return along.unionByName(against)


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """(way, host, mass) from seeds (way, host, mass): for each way the masses sum to 1.  Mass that finds no link goes back to the seeds."""
    ways = materialise(_ways(links))
    total = F.sum("mass").alias("total")
    started = materialise(seeds.join(seeds.groupBy("way").agg(total), "way").select("way", "host", (F.col("mass") / F.col("total")).alias("mass")))
    reached, every = started, started
    while True:
        moved = reached.withColumnRenamed("host", "at").join(ways, ["way", "at"]).select("way", F.col("to").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        reached = materialise(moved.groupBy("way", "host").agg(F.sum("mass").alias("mass")))
        left = reached.groupBy("way").agg(total).agg(F.max("total")).first()[0] or 0.0
        if left == 0.0:
            break
        every = every.unionByName(reached)
        if left < tolerance:
            break
    summed = materialise(every.groupBy("way", "host").agg(F.sum("mass").alias("mass")))
    return summed.join(summed.groupBy("way").agg(total), "way").select("way", "host", (F.col("mass") / F.col("total")).alias("mass"))


def judge(pages: DataFrame, rules: DataFrame, seed_share: float = 0.5, least_lift: float = 0.1, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, and the trust and distrust of its host."""
    host, path = host_and_path(F.col("url"))
    judged = materialise(fit_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules))
    links = materialise(host_links(pages))
    share = lambda verdict: F.avg((F.coalesce(F.col("rule_verdict"), F.lit("")) == verdict).cast("double"))
    own = materialise(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    seeds = own.unpivot(["host"], ["trust", "distrust"], "way", "mass").where(F.col("mass") >= seed_share)
    found = propagate(seeds, links, damping, tolerance)
    scores = found.groupBy("host").agg(*[F.round(F.sum(F.when(F.col("way") == w, F.col("mass")).otherwise(0.0)), 12).alias(w) for w in ("trust", "distrust")])
    n_hosts = own.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct().count()
    known = judged.join(scores, "host", "left").withColumns({w: F.coalesce(w, F.lit(0.0)) for w in ("trust", "distrust")})
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * n_hosts >= least_lift)
    return known.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
