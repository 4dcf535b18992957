"""URL filter: host and path rules first, link-graph propagation where no rule fits.

Trust starts at hosts whose pages rules allow and follows host edges; distrust starts at hosts
whose pages rules block and follows them backwards (who links to the bad is doubted). Both are
personalised PageRanks in DataFrame operations. A host is blocked if its distrust exceeds its
trust and is at least its even share among all hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm import _common as c

#: (verdict, host, path) of the registered query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return c.ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str) -> DataFrame:
    """pages with _host, _path, _rule and _verdict (null where no rule fits); the longest rule that fits wins."""
    out = pages.withColumns({"_host": host_of(F.col(url_col)), "_path": path_of(F.col(url_col))})
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((F.col("_host") == h) | F.endswith("_host", F.lit("." + h))) & F.startswith("_path", F.lit(p)) for _, h, p in longest]
    first = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))
    return out.withColumns({"_rule": first([h + p for _, h, p in longest]), "_verdict": first([v for v, _, _ in longest])})


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """Distinct (src, dst): links to other hosts, and both ways between a host and its parent domain."""
    linked = pages.select(F.col("_host").alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(_LINK), F.lit(1))).alias("dst")).select("src", c.ascii_lower(F.col("dst")).alias("dst"))
    hosts = pages.select("_host").distinct()
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    ups = hosts.withColumn("labels", F.split("_host", r"\.")).filter(F.size("labels") > 2).select(chain.alias("chain"))
    ups = ups.select(F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("low"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("high"))).alias("e")).select("e.low", "e.high").distinct()
    both = ups.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(ups.select("high", "low"))
    return linked.union(both).filter("src <> dst and src <> '' and dst <> ''").distinct()


#: Host edges for each task of an iteration; fewer are gathered in fewer tasks, which write fewer files.
_EDGES = 250_000


def host_ranks(seeds: DataFrame, edges: DataFrame, tolerance: float = 1e-3, damping: float = 0.85, every: int = 6) -> DataFrame:
    """(host, trust, distrust) by power iterations; seeds: (host, allow, block) weights, edges: (src, dst).

    Iterations end when one moves less than ``tolerance`` of the mass, which is looked at every
    ``every`` of them; as one moves at most ``damping`` times what the one before did, they do end.
    """
    edges = c.cut(edges)
    tasks = max(1, -(-edges.count() // _EDGES))
    out = edges.groupBy("src").agg((1 / F.count(F.lit(1))).alias("w"))
    into = edges.groupBy("dst").agg((1 / F.count(F.lit(1))).alias("w"))
    ahead = edges.join(out, "src").select("src", "dst", F.col("w").alias("wt"), F.lit(0.0).alias("wd"))
    back = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("wt"), F.col("w").alias("wd"))
    ways = c.cut(ahead.union(back).coalesce(tasks))
    allow, block = seeds.agg(F.sum("allow"), F.sum("block")).first()
    start = c.cut(seeds.select("host", (F.col("allow") / F.lit(float(allow or 1))).alias("trust"), (F.col("block") / F.lit(float(block or 1))).alias("distrust")))
    base = start.select("host", *[(F.col(x) * (1 - damping)).alias(x) for x in ("trust", "distrust")]).coalesce(tasks)
    ranks = lambda df: df.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    sign = lambda df, s: df.select("host", *[(s * F.col(x)).alias(x) for x in ("trust", "distrust")])
    now = start
    while True:
        for i in range(every):
            before = now = c.cut(now) if i == every - 1 else now
            moved = ways.join(now, ways.src == now.host).select(F.col("dst").alias("host"), (F.col("wt") * F.col("trust") * damping).alias("trust"), (F.col("wd") * F.col("distrust") * damping).alias("distrust"))
            now = ranks(base.union(moved).coalesce(tasks)).coalesce(tasks)
        now = c.cut(now)
        change = ranks(sign(now, 1).union(sign(before, -1)).coalesce(tasks)).coalesce(tasks).agg(F.sum(F.abs("trust") + F.abs("distrust"))).first()[0] or 0.0
        if change < tolerance:
            return now


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, share: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins
    (of equally long ones the first by verdict, host and path). Where none fits, a host is blocked
    whose distrust exceeds its trust and is at least ``share`` / hosts, others are allowed, as are
    pages without a host (null url, or no ``://``), which are in no graph. Rules are few and travel
    in the plan. Null and empty html has no links, html is read whole, whatever its length. Repeated
    rows have a row each and count in their host's seed. An empty table gives no rows; other columns,
    whatever their names, don't matter.
    """
    seen = judged(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), rules, "_url")
    counts = seen.filter("_host <> ''").groupBy("_host").agg(F.count(F.when(F.col("_verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("_verdict") == "block", 1)).alias("block"))
    seeds = c.cut(counts.withColumnRenamed("_host", "host"))
    ranks = host_ranks(seeds, host_edges(seen.filter("_host <> ''"), "_html"), **options)
    least = share / max(1, seeds.count())
    bad = c.cut(ranks.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)).join(seeds, "host", "left_semi").select("host", F.lit(True).alias("bad")))
    by_host = seen.select("_id", "_host", "_path", "_rule", "_verdict").join(c.maybe_broadcast(bad, 96), F.col("_host") == F.col("host"), "left")
    verdict = F.coalesce("_verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return by_host.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"))
