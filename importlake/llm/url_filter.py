"""Operator 8: URL filters whose decisions follow redirects and canonical links.

A page's own rule decides first. Pages without a rule take the decision of the pages that are the same page by another
name: redirect and canonical-link edges join URLs into components, and a component's explicit decisions reach its other
members, an explicit allow before a block.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from importlake.llm.common import lower_ascii, stage
from importlake.llm.components import connected_components

TAG = r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"
CANONICAL = r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'>]+)"""
#: Rules up to which their table is broadcast.
MOST_BROADCAST = 10_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(df: DataFrame, url: str) -> DataFrame:
    """With ``root`` (all up to the path), ``host``, ``path``, ``query`` and, after them, ``address`` of a column of URLs.

    The address names a page: host, path and query, without scheme and fragment; null where there is no host. Each part is
    a column that the next step reads, as nested patterns would outgrow a generated method.
    """
    parts = {
        "root": F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1),
        "host": host(F.col(url)),
        "path": path(F.col(url)),
        "query": F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1),
    }
    return df.withColumns(parts).withColumn("address", F.when(F.col("host") != "", F.concat("host", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")), "query")))


def resolve(link: Column) -> Column:
    """A link as an absolute URL, next to ``root`` and ``path`` of the page that has it."""
    folder = F.concat("root", F.when(F.col("path") == "", F.lit("/")).otherwise(F.regexp_extract("path", r"(?s)^(.*/)", 1)))
    return (
        F.when(link == "", F.lit(None))
        .when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat("root", link))
        .when(F.regexp_like(link, F.lit(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)")), F.lit(None))
        .otherwise(F.concat(folder, link))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between the addresses of a page and of what it names as its canonical or its redirect target."""
    tags = pages.select(F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(TAG), F.lit(0))).alias("tag"))
    href = F.concat(*[F.coalesce(F.regexp_extract("tag", HREF, i), F.lit("")) for i in (1, 2, 3)])
    link = (
        F.when(F.regexp_like("tag", F.lit(CANONICAL)), href)
        .when(F.regexp_like("tag", F.lit(REFRESH)), F.regexp_extract("tag", REFRESH_URL, 1))
    )
    links = stage(tags.select("url", F.replace(F.trim(link), F.lit("&amp;"), F.lit("&")).alias("link")).where("link is not null and url is not null"), "links")
    # Few pages have links; what they resolve to is written, so that the filter isn't pushed into the patterns.
    found = stage(parsed(links, "url").select(F.col("address").alias("a"), resolve(F.col("link")).alias("to")).where("a is not null"), "targets")
    return stage(parsed(found, "to").select("a", F.col("address").alias("b")), "named").where("a <> b").distinct()


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules (verdict, host, path) as a table, read from one JSON text. At equal length an allow comes first."""
    rows = [{"rule_host": h, "rule_path": p, "decision": v, "allows": v == "allow", "long": len(h + p)} for v, h, p in rules]
    kind = "array<struct<rule_host: string, rule_path: string, decision: string, allows: boolean, long: int>>"
    return spark.sql(f"select inline(from_json(:rules, '{kind}'))", args={"rules": json.dumps(rows)})


def fitting(places: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule, own): the longest rule of each row of ``places`` (key, host, path) that has one, and its verdict.

    A host meets the rules of all its suffixes by an equality join, so the rules may be many.
    """
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.select(key, "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").where(F.startswith("path", "rule_path"))
    best = met.groupBy(key).agg(F.max(F.struct("long", "allows", F.concat("rule_host", "rule_path").alias("rule"), "decision")).alias("best"))
    return best.select(key, "best.rule", F.col("best.decision").alias("own"))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", otherwise: str = "allow"
) -> DataFrame:
    """Return for each row: page_id, host, path, rule, verdict.

    A page with a rule of its own takes that rule's verdict. Another takes ``allow`` if any address joined to it by
    redirects and canonical links has an allow rule, else ``block`` if any has a block rule, else ``otherwise``. A null URL,
    or one without ``://``, has empty host and path, fits no rule and has no aliases; null HTML has no links. Repeated rows give a row
    each, and a URL or a page may be very long. Of two rules of one length that fit, an allow comes first. ``pages`` may have columns of any
    other name. Targets need not be among the pages. An empty table gives an empty result.
    """
    table = rule_table(pages.sparkSession, rules)
    if len(rules) <= MOST_BROADCAST:
        table = F.broadcast(table)
    named = parsed(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    base = stage(named.select("row", "page_id", "host", "path", "address"), "pages")
    judged = base.join(fitting(base, "row", table), "row", "left")
    edges = stage(alias_edges(pages, url_col, html_col), "aliases")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(otherwise)).alias("verdict"))
    nodes = connected_components(edges)
    placed = parsed(nodes.withColumn("url", F.concat(F.lit("x://"), F.col("node"))), "url").select("node", "component", "host", "path")
    decided = stage(placed.join(fitting(placed, "node", table), "node", "left").select("node", "component", "own"), "nodes")
    whole = decided.groupBy("component").agg(F.min("own").alias("passed_on"))  # allow sorts before block
    passed = stage(decided.join(stage(whole, "whole"), "component").where("passed_on is not null").select("node", "passed_on"), "passed")
    return judged.join(passed, judged.address == passed.node, "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "passed_on", F.lit(otherwise)).alias("verdict")
    )
