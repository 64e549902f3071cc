"""URL filter: rules on host and path, else trust and distrust spread over the link graph.

Seeds are weighted by what the rules say of a host's own pages: the share that
is allowed is its trust, the share that is blocked its distrust; a host that is
only linked to is judged as its root page would be. Trust follows links
forwards, distrust follows them backwards (who links to a blocked host is
suspect), both by personalised PageRank over host edges. A step of either is
weighted by the share of the linking host's links, so distrust is the damped
share of a host's own links that lead to blocked hosts: between 0 and 1 however
many others link there. A host is blocked when the distrust it receives exceeds
its trust by the threshold; what the rules say of some of its own pages does
not count against the others. Only built-in functions; each round passes one
table of hosts through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefolio.llm.text import LOWER, UPPER
from tidefolio.session import cut_lineage

DAMPING = 0.85
TOLERANCE = 1e-3
THRESHOLD = 0.5
URL_PARTS = "://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which less than `tolerance` of a seed's mass is still on its way."""
    n = 0
    while damping**n >= tolerance:
        n += 1
    return n


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that fit each host, the longest first: host, fits. Hosts without one are left out.

    rules: rule_host, rule_path, rule_verdict.
    """
    labels = F.split("host", r"\.")
    names = hosts.select(
        "host",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        ).alias("rule_host"),
    )
    rule = F.concat("rule_host", "rule_path")
    fit = F.struct((-F.length(rule)).alias("order"), rule.alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    return names.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_set(fit)).alias("fits"))


def first_fit(path: Column, fits: Column) -> Column:
    """Longest rule whose path starts the page's path."""
    return F.get(F.filter(fits, lambda r: path.startswith(r["path"])), F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, one row per pair: src, dst, links."""
    links = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst")
    ).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def host_seeds(urls: DataFrame, ends: DataFrame, fits: DataFrame) -> DataFrame:
    """host, trust, distrust: shares of the host's pages that rules allow or block; uncrawled ``ends`` of links count as one page `/`."""
    linked = ends.join(urls.select("host").distinct(), "host", "left_anti").select("host", F.lit("/").alias("path"))
    said = first_fit(F.col("path"), F.col("fits"))["verdict"]
    judged = urls.select("host", "path").unionByName(linked).join(fits, "host").select("host", F.coalesce(said, F.lit("none")).alias("said"))
    shares = [F.avg((F.col("said") == verdict).cast("double")).alias(name) for verdict, name in (("allow", "trust"), ("block", "distrust"))]
    return judged.groupBy("host").agg(*shares)


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust that hosts receive over links, as sums of walks: host, trust, distrust; hosts without either are left out.

    edges: src, dst, links. seeds: host, trust, distrust, each worth its own
    mass rather than a share of one, so that scores do not fade as hosts are
    added. A host's own distrust takes the place of what it would pass on, so
    no distrust exceeds 1. Own masses are not in the result. Ends once nothing
    moves, or after the rounds that leave less than the tolerance on its way.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    parts = edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all_links") * damping).alias("part"))
    forth = parts.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "part", F.lit(1.0).alias("passed"))
    own = seeds.select(F.col("host").alias("src"), F.col("distrust").alias("_own"))
    back = parts.join(own, "src", "left").select(
        F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "part", (1 - F.coalesce("_own", F.lit(0.0))).alias("passed")
    )
    steps = cut_lineage(forth.unionByName(back))
    at = seeds.unpivot("host", ["trust", "distrust"], "kind", "mass").where(F.col("mass") > 0).select("kind", F.col("host").alias("from"), "mass")
    received = None
    for _ in range(1, rounds(damping, tolerance)):
        moved = steps.join(at, ["kind", "from"]).groupBy("kind", "to").agg(F.sum(F.col("part") * F.col("mass")).alias("mass"), F.first("passed").alias("passed"))
        moved = cut_lineage(moved)
        received = moved if received is None else received.unionByName(moved)
        if moved.isEmpty():
            break
        at = moved.select("kind", F.col("to").alias("from"), (F.col("mass") * F.col("passed")).alias("mass")).where("mass > 0")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    return received.groupBy(F.col("to").alias("host")).agg(*sums)


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Verdict per page: page_id, host, path, rule, verdict.

    pages: page_id, url, html. rules: (verdict, host, path). A rule fits its
    host and all subdomains when the path starts with the rule's; the longest
    wins. A url that is null or has no `://` has an empty host and path, fits
    no rule and is allowed. Null html has no links. Repeated rows are judged
    one by one; other columns are ignored; an empty table gives no row.
    """
    if rounds(damping, tolerance) < 2:
        raise ValueError("damping and tolerance leave no round")
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string").distinct()
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = cut_lineage(host_edges(pages))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    known = urls.select("host").where(F.col("host") != "").unionByName(ends).distinct()
    fits = cut_lineage(host_rules(known, table))
    seeds = cut_lineage(host_seeds(urls, ends, fits))
    blocked = (
        spread(edges, seeds, damping, tolerance)
        .join(seeds.select("host", F.col("trust").alias("own")), "host", "left")
        .where(F.round(F.col("distrust") - F.col("trust") - F.coalesce("own", F.lit(0.0)), 9) >= threshold)
        .select("host", F.lit("block").alias("spread_verdict"))
    )
    hosts = cut_lineage(fits.join(blocked, "host", "full"))
    best = first_fit(F.col("path"), F.col("fits"))
    return urls.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.col("spread_verdict"), F.lit("allow")).alias("verdict"),
    )
