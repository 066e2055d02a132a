"""URL filters: rules on host and path first, then what the link graph says about a host. DataFrame operations only.

Pages give host edges (host of the page -> host of a link in it, with the number of links). Seeds come from the rules: a host's
urls that a rule allows trust it, those that a rule blocks distrust it. Trust is personalised PageRank from the trusted seeds
along the edges; distrust is the same from the blocked seeds along reversed edges (who links to blocked hosts is suspect). Both
run until ranks stand still and reach no new host; a host's rank that has no outgoing edge returns to the seeds. A host is blocked where its share of
distrust exceeds its share of trust by the threshold. A url that a rule fits gets the rule's verdict, others their host's.

Rules fit a host and its subdomains where the url's path begins with the rule's; the longest (host and path together) wins.

Defined results: a null url, one without "://" and one without a host have empty host (and path); the empty host is a host like
others. Relative links, fragments and links without a host are links to the page's own host. Without seeds, or for a host that
nothing reaches, the verdict is allow. Repeated rows count as pages of their own; extra columns are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, table

Rule = tuple[str, str, str]  #: verdict, host, path

RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; null or none: empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null."""
    out = F
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = out.when(fits, value)
    return out if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def link_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """host, to, n: links between hosts; pages: host and the html."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    targets = F.transform(links, lambda u: F.when(F.instr(u, "://") > 0, host_of(u)).when(u.startswith("//"), host_of(F.concat(F.lit("x:"), u))).otherwise(""))
    counted = pages.select("host", F.explode(targets).alias("to"))
    counted = counted.select("host", F.when(F.col("to") == "", F.col("host")).otherwise(F.col("to")).alias("to"))
    return counted.groupBy("host", "to").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """kind, host, rank: personalised PageRank of each kind; edges: kind, host, to, share (1 in all per kind and host); seeds: kind, host, seed (1 in all per kind).

    Rank that hosts without edges hold returns to the seeds. Rounds end when the ranks of all hosts change by less than the
    tolerance in total and no host is new.
    """
    spark = edges.sparkSession
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    old = None
    while True:
        flow = ranks.join(edges, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("flow"))
        mass = flow.groupBy("kind").agg(F.sum("flow").alias("mass"))  # a row for each kind
        back = seeds.join(F.broadcast(mass), "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("mass", F.lit(0.0)))).alias("flow"))
        fresh = flow.unionByName(back).groupBy("kind", "host").agg(F.sum("flow").alias("rank"))
        was = ranks.withColumnRenamed("rank", "was")
        kept = stored(fresh.join(was, ["kind", "host"], "left").select("kind", "host", "rank", "was"), "ranks")
        moved = kept.agg(F.sum(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0)))).alias("change"), F.count_if(F.isnull("was")).alias("new")).first()
        if old is not None:
            dropped(spark, old)
        old, ranks = kept, kept.drop("was")
        if not moved.new and (moved.change or 0.0) < tolerance:
            return ranks


def judge_urls(pages: DataFrame, rules: list[Rule], damping: float = 0.85, threshold: float = 0.0, tolerance: float = 1e-6, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (null where it took no part)."""
    u = F.col(url)
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    ruled = parts.withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules))
    edges = stored(link_edges(pages.select(host_of(u).alias("host"), html), html), "host-edges")
    by_host = stored(ruled.groupBy("host").agg(F.count_if(F.col("ruled.verdict") == "allow").alias("good"), F.count_if(F.col("ruled.verdict") == "block").alias("bad")), "hosts")
    shares = seeds = None
    for name, column, start, end in (("trust", "good", "host", "to"), ("distrust", "bad", "to", "host")):
        kind = F.lit(name).alias("kind")
        whole = edges.groupBy(start).agg(F.sum("n").alias("all"))
        own = edges.join(whole, start).select(kind, F.col(start).alias("host"), F.col(end).alias("to"), (F.col("n") / F.col("all")).alias("share"))
        total = by_host.agg(F.sum(column).alias("total"))  # one row
        first = by_host.where(F.col(column) > 0).crossJoin(F.broadcast(total)).select(kind, "host", (F.col(column) / F.col("total")).alias("seed"))
        shares, seeds = (own, first) if shares is None else (shares.unionByName(own), seeds.unionByName(first))
    ranks = propagate(stored(shares, "shares"), stored(seeds, "seeds"), damping, tolerance)
    of = lambda name: ranks.where(F.col("kind") == name).select("host", F.col("rank").alias(name))
    scores = by_host.select("host").join(of("trust"), "host", "left").join(of("distrust"), "host", "left")
    found = F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold, "block").otherwise("allow")
    verdicts = stored(scores.select("host", "trust", "distrust", found.alias("found")), "verdicts")
    out = ruled.join(verdicts, "host", "left")
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(F.col("ruled.verdict"), "found").alias("verdict"), "trust", "distrust")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by what the link graph says of its host."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _op8_sql(damping: float = 0.85, rounds: int = 120) -> str:
    """So many rounds leave less than damping ** rounds of the mass where it may still move."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    steps = []
    for kind, column, start, end in (("t", "good", "host", "dest"), ("d", "bad", "dest", "host")):
        steps.append(f"{kind}s AS (SELECT host, {column} / (SELECT sum({column}) FROM hosts) AS seed FROM hosts WHERE {column} > 0)")
        steps.append(f"{kind}out AS (SELECT {start} AS host, {end} AS dest, {damping} * n / sum(n) OVER (PARTITION BY {start}) AS w FROM edges)")
        # what an edge doesn't take returns to the seeds
        steps.append(f"{kind}b AS (SELECT h.host, s.host AS dest, s.seed * CASE WHEN h.host IN (SELECT host FROM {kind}out) THEN {1 - damping} ELSE 1 END AS w FROM (SELECT host FROM edges UNION SELECT dest FROM edges UNION SELECT host FROM {kind}s) h, {kind}s s)")
        steps.append(f"{kind}e AS (SELECT host, dest, sum(w) AS w FROM (SELECT * FROM {kind}out UNION ALL SELECT * FROM {kind}b) GROUP BY ALL)")
        steps.append(f"{kind}r AS (SELECT host, CAST(seed AS DOUBLE) AS rank, 0 AS k FROM {kind}s UNION ALL SELECT e.dest, CAST(sum(r.rank * e.w) AS DOUBLE), r.k + 1 FROM {kind}r r JOIN {kind}e e USING (host) WHERE r.k < {rounds} GROUP BY e.dest, r.k + 1)")
    return rf"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES {rules}),
best AS (
    SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM part JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
ruled AS (SELECT part.page_id, part.host, part.path, best.rule, best.verdict FROM part LEFT JOIN best USING (page_id, host, path)),
links AS (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS u FROM part),
edges AS (
    SELECT host, CASE WHEN t = '' THEN host ELSE t END AS dest, count(*) AS n FROM (
        SELECT host, translate(CASE WHEN contains(u, '://') THEN regexp_extract(substr(u, instr(u, '://') + 3), '^([^/?#]*)', 1)
            WHEN starts_with(u, '//') THEN regexp_extract(substr(u, 3), '^([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM links)
    GROUP BY ALL),
hosts AS (SELECT host, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM ruled GROUP BY host),
{", ".join(steps)},
verdicts AS (
    SELECT host, CASE WHEN coalesce(d.rank, 0) - coalesce(t.rank, 0) > 0 THEN 'block' ELSE 'allow' END AS found
    FROM hosts LEFT JOIN (SELECT host, rank FROM tr WHERE k = {rounds}) t USING (host) LEFT JOIN (SELECT host, rank FROM dr WHERE k = {rounds}) d USING (host))
SELECT page_id, host, path, rule, coalesce(verdict, found) AS verdict FROM ruled LEFT JOIN verdicts USING (host)
"""


OP8_SQL = _op8_sql()
