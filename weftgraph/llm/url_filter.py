"""URL filters: rules on hosts and paths, and for all other pages trust that spreads over the host graph.

Edges lead from a page's host to the hosts that it links to, and between a host and the domain it belongs to. Trust is
personalised PageRank from pages that a rule allows; distrust runs along reversed edges from pages that a rule
blocks. A host whose distrust is above `ratio` times its trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: Rounds between two looks at what is left.
CHECK = 5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: Sums come in any order; a difference below this share is a tie, and ties are allowed.
TIE = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or no `://`."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host/path as one string; of equally long ones the first) and its action; null if none does."""
    name = action = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, ratio: float = 1.0, residue: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, good, bad), page counts.

    Trust runs along edges, distrust against them, each from its seeds in proportion; hosts that nothing reaches
    are missing. A row holds what a host has gathered (r) and what reached it in the last round (moving), so r only
    grows, and by no more than damping times all that is moving. Rounds go on until every host that can be reached has
    been, and until for each host the growth still to come cannot change whether its distrust is above ratio
    times its trust, or is below `residue` (ties). One join and one aggregation a round, written to the shared folder
    every CHECK rounds; the driver sees sums and counts.
    """
    ways = edges.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    ways = ways.unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    out = ways.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    ways = ways.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("share"))
    start = seeds.select(F.lit(0).alias("kind"), "host", F.col("good").alias("n")).unionByName(seeds.select(F.lit(1).alias("kind"), "host", F.col("bad").alias("n"))).where("n > 0")
    # a way of no share from each host to itself takes along what the host has, so that a round reads the one before once
    own = ways.select("kind", "a").unionByName(ways.select("kind", F.col("b").alias("a"))).unionByName(start.select("kind", F.col("host").alias("a"))).distinct()
    ways = materialize(ways.unionByName(own.select("kind", "a", F.col("a").alias("b"), F.lit(None).cast("double").alias("share"))), "ways")
    total = start.groupBy("kind").agg(F.sum("n").alias("all"))
    start = start.join(total, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("moving"))
    rank = materialize(start.select("kind", "host", (F.col("moving") * (1 - damping)).alias("r"), "moving"), "rank")
    side = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("r")).otherwise(0.0))
    reached = rank.count()
    while reached:
        step = rank
        for _ in range(CHECK):
            sent = step.withColumnRenamed("host", "a").join(ways, ["kind", "a"])
            held, moved = F.when(F.col("share").isNull(), F.col("r")).otherwise(0.0), F.coalesce(F.col("moving") * F.col("share") * damping, F.lit(0.0))
            step = sent.select("kind", F.col("b").alias("host"), held.alias("r"), moved.alias("moving")).groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("moving").alias("moving"))
            step = step.withColumn("r", F.col("r") + F.col("moving") * (1 - damping))
        rank, before = materialize(step, "rank", replaces=rank), reached
        # bounded: one row for each of the two kinds
        left = {x["kind"]: damping * x["left"] for x in rank.groupBy("kind").agg(F.sum("moving").alias("left")).collect()}
        good, bad = left.get(0, 0.0), left.get(1, 0.0)
        t, b = F.col("trust"), F.col("distrust")
        open_ = ~((b + bad <= ratio * t) | (b > ratio * (t + good) * (1 + TIE)))
        hosts = rank.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"), F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count_if(open_).alias("open")).first()
        reached = hosts["n"]
        if reached == before and (hosts["open"] == 0 or max(good, bad) <= residue):
            break
    return rank.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], ratio: float = 1.0, damping: float = 0.85, residue: float = 1e-9) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages (page_id, url, html).

    rules: (allow or block, host/path). A null url, or one without `://`, has empty host and path, fits no rule and is
    allowed, as is a host that neither trust nor distrust reaches. Repeated rows are judged alike and count as pages
    one by one. A null html has no links. trust and distrust are those of the last round, verdicts those of the limit (see
    propagate). No rows, no result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), action.alias("action"))
    seeds = p.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("good"), F.count_if(F.col("action") == "block").alias("bad"))
    targets = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))))
    links = p.where("host <> ''").select(F.col("host").alias("src"), targets.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = materialize(seeds, "hosts")
    names = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    up = names.select(F.col("host").alias("src"), parent.alias("dst")).where("src <> dst and contains(dst, '.')").withColumn("n", F.lit(1).cast("long"))
    edges = materialize(links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")), "hostlinks")
    # written, so that the join with all pages can be broadcast by its size, or a hot host's pages split by AQE
    score = materialize(propagate(edges, hosts, damping, ratio, residue), "scores")
    out = p.drop("html").join(score, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > ratio * trust * (1 + TIE), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
