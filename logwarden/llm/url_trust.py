"""URL filters by rules, and by trust that spreads over the link graph.

Hosts are nodes, links between pages of different hosts are edges. Personalised PageRank from the
hosts of allowed pages gives trust, along the links; the same from the hosts of blocked pages,
against the links, gives distrust: who links to a blocked host is suspect. A host whose spread
distrust exceeds its spread trust by more than a threshold is blocked where no rule decides. Both
are measured in seed pages, so that seeds elsewhere in the graph don't change the verdict.
All of it is joins and sums by host; the page table is read once for the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.session import discard, materialize

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The threshold is in seed pages. ``ROUNDS`` are those of the SQL twin; ``judge`` spreads until it has converged.
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 1e-4
#: What all further rounds together may still move, in seed pages and as a share of all seeds.
TOLERANCE, SHARE_TOLERANCE = 1e-6, 1e-10


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, path = rule.split("/", 1)
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and ruled (its verdict).

    A rule ``host/path`` fits the host and all subdomains where the path starts with ``/path``;
    of equally long rules the one that sorts first wins.
    """
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = ruled = None
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        fits = _fits(text)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        ruled = F.when(fits, verdict) if ruled is None else ruled.when(fits, verdict)
    none = F.lit(None).cast("string")
    return rows.withColumns({"rule": none if rule is None else rule, "ruled": none if ruled is None else ruled})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links from pages of one host to another, by the ``href`` attributes of absolute addresses.

    Links within a host say nothing about others and are left out. ``weight`` is each link's
    share of all that leave its host.
    """
    links = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"), 1)
    # Most pages are done with once no link names a host.
    pairs = pages.where(F.col("html").rlike(r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//")).select(
        host_of(F.col("url")).alias("src"), F.explode(links).alias("dst"))
    pairs = pairs.select("src", F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("dst"))
    counts = pairs.where("src <> '' and src <> dst").groupBy("src", "dst").count()
    out = counts.groupBy("src").agg(F.sum("count").alias("all"))
    return counts.join(out, "src").select("src", "dst", (F.col("count") / F.col("all")).alias("weight"), F.col("count").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, mass): what reaches each host from the seeds (host, mass) by PageRank, beyond its own start.

    ``edges`` (src, dst, weight) hand on a share of what the source has. Each round hands on what
    the one before has moved, which shrinks by ``damping`` at least, until all further rounds together
    would move less than ``tolerance``. Each round is written, so that a lost executor costs one round.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and less than 1")
    edge_table = materialize(edges, "edges")
    now = materialize(seeds.select("host", F.lit(0.0).alias("mass"), (F.col("mass") * (1 - damping)).alias("moved")), "mass")
    while True:
        got = now.where("moved > 0").join(edge_table, F.col("host") == edge_table["src"]).groupBy("dst").agg(
            (F.sum(F.col("moved") * F.col("weight")) * damping).alias("moved"))
        both = now.select("host", "mass", F.lit(0.0).alias("moved")).unionByName(got.select(F.col("dst").alias("host"), F.col("moved").alias("mass"), "moved"))
        then = materialize(both.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("moved").alias("moved")), "mass")
        discard(now)
        now = then
        if (now.agg(F.sum("moved")).first()[0] or 0.0) * damping / (1 - damping) <= tolerance:
            return now.select("host", "mass")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, damping: float = DAMPING,
          threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page.

    Where no rule fits, a page is blocked if its host's spread distrust exceeds its spread trust
    by more than ``threshold``, else allowed. Each host starts with its allowed and its blocked pages,
    and ``threshold`` is in such pages; ``trust`` and ``distrust`` are returned as shares of all
    allowed and all blocked pages. Urls that are null or without ``://`` have
    an empty host and path, fit no rule and are allowed. Repeated pages are judged alike and
    each counts; without links or seeds nothing spreads.
    """
    pages = pages.select("page_id", "url", "html")  # other columns may be named like the results
    ruled = with_rules(pages, rules)
    edges = materialize(host_edges(pages), "links")
    by_host = materialize(ruled.where("host <> '' and ruled is not null").groupBy("host", "ruled").count(), "ruled")

    total = {r[0]: float(r[1]) for r in by_host.groupBy("ruled").agg(F.sum("count")).collect()}

    def spread_from(verdict: str, links: DataFrame) -> DataFrame:
        own = by_host.where(F.col("ruled") == verdict).select("host", F.col("count").cast("double").alias("mass"))
        return spread(links, own, damping, min(tolerance, SHARE_TOLERANCE * total.get(verdict, 1.0)))

    incoming = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    against = edges.join(incoming, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("weight"))
    trust = spread_from("allow", edges.select("src", "dst", "weight"))
    distrust = spread_from("block", against)
    masses = trust.select("host", F.col("mass").alias("trust")).join(distrust.select("host", F.col("mass").alias("distrust")), "host", "full")
    zero = F.lit(0.0)
    rows = ruled.join(masses, "host", "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    learned = F.when(F.col("distrust") > F.col("trust") + threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"),
                       *[(F.round(F.col(kind) / total.get(verdict, 1.0), 9) + 0.0).alias(kind) for kind, verdict in (("trust", "allow"), ("distrust", "block"))])


def judge_sql(rules: tuple[tuple[str, str], ...] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """The same as one DuckDB statement over ``pages``, the rounds written out.

    Equal to ``judge`` while no host is more than ``rounds`` links from a seed. It compares shares of
    1, so its threshold means the same only with one allowed and one blocked page.
    """
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        host, path = rule.split("/", 1)
        return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"

    cases = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in order)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in order)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = f"""WITH parsed AS (
SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
       coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {cases} END AS rule FROM parsed),
decided AS (SELECT *, CASE {verdicts} END AS ruled FROM ruled),
linked AS (SELECT host AS src, translate(unnest(regexp_extract_all(html,
    '(?i)href\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#"''\\s>]+)', 1)), '{upper}', '{lower}') AS dst FROM parsed),
edges AS (SELECT src, dst, count(*) AS n FROM linked WHERE src <> '' AND src <> dst GROUP BY ALL),
along AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM edges),
against AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS weight FROM edges),
seeds AS (SELECT ruled AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS mass
          FROM decided WHERE host <> '' AND ruled IS NOT NULL GROUP BY ruled, host),
"""
    for kind, edge in (("allow", "along"), ("block", "against")):
        text += f"{kind}0 AS (SELECT host, mass FROM seeds WHERE kind = '{kind}'),\n"
        for i in range(1, rounds + 1):
            text += f"""{kind}{i} AS (SELECT host, sum(mass) AS mass FROM (
  SELECT host, mass * {1 - damping} AS mass FROM {kind}0 UNION ALL
  SELECT e.dst, {damping} * sum(p.mass * e.weight) FROM {kind}{i - 1} p JOIN {edge} e ON p.host = e.src GROUP BY e.dst) GROUP BY host),\n"""
        text += f"""{kind}_all AS (SELECT host, sum(mass) AS mass FROM (SELECT host, mass FROM {kind}{rounds} UNION ALL
  SELECT host, mass * {damping - 1} FROM {kind}0) GROUP BY host),\n"""
    return text + f"""masses AS (SELECT host, coalesce(a.mass, 0) AS trust, coalesce(b.mass, 0) AS distrust FROM allow_all a FULL JOIN block_all b USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) + {threshold} THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(trust, 0), 9) + 0.0::DOUBLE AS trust, round(coalesce(distrust, 0), 9) + 0.0::DOUBLE AS distrust
FROM decided LEFT JOIN masses USING (host)"""
