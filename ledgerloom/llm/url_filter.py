"""URL filter: rules by host and path, and link-graph propagation, in DataFrame functions only.

A url that a rule fits gets the longest one's verdict. For the others, hosts are judged:
trust flows along links from hosts with allowed pages (personalised PageRank), distrust
flows against them from hosts with blocked pages, as who links to bad hosts is suspect.
A host with more distrust than trust is blocked. Pages are first added up to weighted
host edges, so a hot host's pages never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, save, scratch, scratch_path

#: verdict, host, path. A rule fits its host and all subdomains if the path starts with its own.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Share of a rank that follows links; the rest starts again from the seeds.
DAMPING = 0.85
#: Ranks have settled when all that still moves is below this. Each round shrinks it by DAMPING
#: at least, from 2, so some 90 rounds do.
SETTLED = 1e-6
#: A host is blocked if its share of distrust in distrust and trust is above this.
THRESHOLD = 0.5

_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. The list is a parameter, so its size is known."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: how many links lead from pages of one host to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("to"))
    dst = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))
    return links.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, rank: personalised PageRank over (src, dst, links) from (host, seed); with a ``kind`` in both, for each kind.

    What leaves the seeds and follows k links is a table for each k, until all that still
    moves is below SETTLED and reaches no more hosts, at once where no link leaves a seed. A
    rank is the sum of a host's parts, over the sum of all: as ranks of hosts without links
    return to the seeds, only the scale changes by that.
    """
    spark = edges.sparkSession
    if "kind" not in edges.columns:
        return propagated(edges.withColumn("kind", F.lit("")), seeds.withColumn("kind", F.lit(""))).drop("kind")
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))  # a row for each kind
    with scratch(spark):
        parts = [scratch_path(spark, "moved")]
        seeds.join(F.broadcast(total), "kind").where("total > 0").select("kind", "host", (F.col("seed") / F.col("total")).alias("rank")).write.parquet(parts[0])
        schema = "kind string, host string, rank double"
        out = edges.groupBy("kind", "src").agg(F.sum("links").alias("all"))
        ways = save(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (DAMPING * F.col("links") / F.col("all")).alias("share")), "ways")
        while True:
            moved = ways.join(spark.read.schema(schema).parquet(parts[-1]), ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("rank"))
            path = scratch_path(spark, "moved")
            moved.write.parquet(path)
            moved = spark.read.schema(schema).parquet(path)
            moves = moved.agg(F.sum("rank")).first()[0]
            if not moves or moves < SETTLED and moved.join(spark.read.schema(schema).parquet(*parts), ["kind", "host"], "left_anti").isEmpty():
                break
            parts.append(path)
        rank = spark.read.schema(schema).parquet(*parts).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = save(rank, "rank", keep=True)
    whole = rank.groupBy("kind").agg(F.sum("rank").alias("whole"))  # a row for each kind
    return rank.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def host_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame) -> DataFrame:
    """host, trust, distrust, blocked for each host that either reaches."""
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    rule = matched(F.col("host"), F.col("path"), rules)["verdict"]
    seeds = judged.select("host", rule.alias("verdict")).where("verdict is not null")
    seeds = seeds.groupBy("host", F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind")).agg(F.count("*").cast("double").alias("seed"))
    along = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    rank = propagated(along.union(against), save(seeds, "seeds"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    both = rank.groupBy("host").agg(of("trust"), of("distrust"))
    return both.withColumn("blocked", F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, html, any others).

    A url that is null or has no ``://`` has an empty host and path, fits no rule and is
    allowed; so is a host that neither trust nor distrust reaches. Null html has no links.
    Repeated rows are judged alike; an empty table stays empty.
    """
    with scratch(pages.sparkSession):
        edges = save(host_edges(pages), "host_edges")
        hosts = save(host_verdicts(pages, rules, edges).where("blocked").select(F.col("host").alias("_host")), "blocked_hosts", keep=True)
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("found", matched(F.col("host"), F.col("path"), rules)).join(hosts, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("_host").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
