"""URL filters: host and path rules, and link-graph propagation for hosts that no rule decides.

Trust is a personalised PageRank from trusted hosts along links between hosts; distrust is
one from blocked hosts along reversed links. A host whose distrust exceeds its trust by a
factor is blocked. Ranks are joins and sums in Spark, written out every few rounds, until no
host's rank changes by more than a share of TOLERANCE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return f"{self.host}{self.path or '/'}"


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


#: The share of a host's pages that rules of one verdict must decide for it to be a seed.
SEED_SHARE = 0.5
#: Ranks have settled when each host's last change is at most this share of its rank: a host that is newly reached changes by all of it.
TOLERANCE = 1e-6
#: Rounds after which ranks that have not settled are an error. Hosts in cycles take about 85, hosts up a chain its length besides.
MOST_ROUNDS = 1000
#: Rounds of one plan, after which ranks are written.
ROUNDS_WRITTEN = 4


def parts(url):
    """host and path columns of a url column; both empty for a null or a url without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(`url`, instr(`url`, '://') + 3)"))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return host.alias("host"), path.alias("path")


def matched(rules=RULES):
    """The longest rule that fits columns host and path, as a struct of rule and verdict; null if none does.

    Length is that of host and path together; of equals the block rule wins, then the first by name.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))) & F.startswith(F.col("path"), F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts in the html of pages, absolute or with // only."""
    host = parts(F.col("url"))[0]
    links = pages.where("url is not null and html is not null").select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""), F.lit(1)), lower_ascii))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = 8, damping: float = 0.85) -> DataFrame:
    """Personalised PageRank over edges(src, dst, n) from seeds(host, mass): (host, rank).

    A round deals each host's rank over its links by their number and adds the seeds' share
    anew. Rank at hosts without links is not dealt on. A hot host's links are dealt by a join
    that Spark can split, and pre-summed before the shuffle. A number of rounds reaches hosts
    that many links away and leaves up to damping ** rounds of the mass unsettled; with None
    rounds go on until ranks settle within TOLERANCE, and ranks that do not by MOST_ROUNDS raise.
    """
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    start = written(seeds.groupBy("host").agg((F.sum("mass") / F.lit(float(total))).alias("seed")), "seeds")
    degree = written(edges.groupBy("src").agg(F.sum("n").alias("degree")), "degree")
    shares = written(edges.join(degree, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share")), "shares")
    if shares.isEmpty():
        return start.select("host", F.col("seed").alias("rank"))
    again = start.select("host", (F.col("seed") * (1 - damping)).alias("rank"), F.lit(0.0).alias("before"))
    rank, done, most = start.select("host", F.col("seed").alias("rank")), 0, MOST_ROUNDS if rounds is None else rounds
    while done < most:
        for _ in range(min(ROUNDS_WRITTEN, most - done)):
            moved = shares.join(rank, shares["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"), F.lit(0.0).alias("before"))
            last = rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("before"))
            rank = moved.unionByName(again).unionByName(last).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before"))
            done += 1
        rank = written(rank, "rank")
        if rounds is None and rank.where(F.abs(F.col("rank") - F.col("before")) > TOLERANCE * F.col("rank")).isEmpty():
            return rank.select("host", "rank")
    if rounds is None:
        raise RuntimeError(f"ranks of hosts did not settle within {MOST_ROUNDS} rounds")
    return rank.select("host", "rank")


def host_scores(pages: DataFrame, rules=RULES, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) of all hosts that a page, a link or a seed names.

    A host is a seed of trust, or of distrust, if an allow, or a block, rule decides at least
    SEED_SHARE of its pages; that share is its mass. Ranks are settled (see propagate) unless
    a number of rounds is given.
    """
    own = pages.select(*parts(F.col("url"))).where("host <> ''").withColumn("m", matched(rules))
    hosts = written(own.groupBy("host").agg(F.avg(F.when(F.col("m.verdict") == "allow", 1.0).otherwise(0.0)).alias("allow"), F.avg(F.when(F.col("m.verdict") == "block", 1.0).otherwise(0.0)).alias("block")), "hosts")
    edges = written(host_edges(pages), "host-edges")
    trust = propagate(edges, hosts.where(F.col("allow") >= SEED_SHARE).select("host", F.col("allow").alias("mass")), rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, hosts.where(F.col("block") >= SEED_SHARE).select("host", F.col("block").alias("mass")), rounds)
    either = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    return either.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, factor: float = 2.0, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, method_verdict; one row per row of pages.

    A url that a rule fits has the rule's verdict. Else its host is blocked if its distrust is
    over `factor` times its trust, and allowed otherwise, as are empty hosts. Ranks are settled,
    however far from a seed, unless a number of rounds is given (see propagate). A null url or
    html has neither host nor links; repeated rows have a row each, and each counts once for
    its host's links. Very long pages are read whole; an empty table gives no rows, and other
    columns are not read.
    """
    blocked = written(host_scores(pages, rules, rounds).where(F.col("distrust") > factor * F.col("trust")).select("host", F.lit("block").alias("by_graph")), "blocked-hosts")
    rows = pages.select("page_id", *parts(F.col("url"))).withColumn("m", matched(rules)).join(blocked, "host", "left")
    graph = F.coalesce("by_graph", F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", graph).alias("verdict"), graph.alias("method_verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """One row per page; see judge() for null, empty and repeated rows."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_SQL_RANK = """{name} AS (SELECT host, sum(mass) AS rank FROM (
  WITH RECURSIVE walk(k, host, mass) AS (
    SELECT 0, host, {mass} / sum({mass}) OVER () * 0.15 FROM hosts WHERE {mass} >= 0.5
    UNION ALL
    SELECT walk.k + 1, {to}, sum(walk.mass * 0.85 * n / {degree}) FROM walk JOIN degrees ON {at} = walk.host WHERE walk.k < 200 GROUP BY 1, 2)
  SELECT * FROM walk) GROUP BY host)"""
#: The rows of op10_url_filters: ranks are the sums of walks of up to 200 links, which leaves less than the tolerance.
SQL = r"""
WITH rest AS (SELECT page_id, html, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
own AS (
  SELECT page_id, rid, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM own),
judged AS (SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM ruled),
hosts AS (SELECT host, avg((said IS NOT DISTINCT FROM 'allow')::INT) AS allow, avg((said IS NOT DISTINCT FROM 'block')::INT) AS block FROM judged WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1), lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst
  FROM own),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
degrees AS (SELECT src, dst, n, sum(n) OVER (PARTITION BY src) AS out_n, sum(n) OVER (PARTITION BY dst) AS in_n FROM edges),
""" + ",\n".join((_SQL_RANK.format(name="trust", mass="allow", at="src", to="dst", degree="out_n"), _SQL_RANK.format(name="distrust", mass="block", at="dst", to="src", degree="in_n"))) + """
SELECT page_id, j.host, path, rule, coalesce(said, m) AS verdict, m AS method_verdict
FROM (SELECT j.*, CASE WHEN d.rank > 2 * coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END AS m FROM judged j LEFT JOIN trust t ON t.host = j.host LEFT JOIN distrust d ON d.host = j.host) j
"""
