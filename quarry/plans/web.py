"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import html
from quarry.operators import crawl
from quarry.sources.tables import table

from .registry import query

HOST = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
ASSETS = "|".join(x.replace(".", "\\.") for x in html.ASSETS)
PRIVATE = "|".join(x.replace("?", "\\?") for x in html.PRIVATE)
LINKS = f"""found AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS base, list_filter(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), lambda h: NOT regexp_matches(lower(h), '{ASSETS}')) AS hs FROM pages),
links AS (SELECT page_id, url, list_filter(list_transform(hs, lambda h: CASE WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '/') THEN base || h ELSE base || '/' || h END), lambda h: {HOST.format('h')} = {HOST.format('url')} AND NOT regexp_matches(lower(h), '{PRIVATE}'))[1:50] AS links FROM found)"""


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query(f"SELECT page_id, {HOST.format('url')} AS domain FROM pages")
def url_domain(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.host(F.col("url")).alias("domain"))


@query(f"SELECT count(DISTINCT {HOST.format('url')}) AS n, list_sort(list(DISTINCT {HOST.format('url')})) AS domains FROM pages")
def distinct_domains(spark, sf_dir):
    """Hosts of all pages."""
    d = pages(spark, sf_dir).select(html.host(F.col("url")).alias("d")).distinct()
    return d.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("d")).alias("domains"))


@query(f"WITH {LINKS} SELECT page_id, links FROM links")
def page_links(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.links(F.col("html"), F.col("url")).alias("links"))


@query(r"""SELECT page_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), lambda h: NOT starts_with(h, 'http')), lambda h: regexp_replace(h, '[?#].*$', '')))) AS files FROM pages""")
def discover_doc_links(spark, sf_dir):
    """Relative links of each page without query and fragment, each once."""
    found = F.filter(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)), lambda h: ~h.startswith("http"))
    return pages(spark, sf_dir).select("page_id", F.array_sort(F.array_distinct(F.transform(found, lambda h: F.regexp_replace(h, r"[?#].*$", "")))).alias("files"))


@query()
def html_sections(spark, sf_dir):
    return html.html_sections(pages(spark, sf_dir))


@query(f"""WITH {LINKS}, edges AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM (SELECT page_id, unnest(list_transform(links, lambda x: regexp_extract(x, '^[^:]*://[^/]*/([^/?#]*)', 1))) AS w FROM links) a JOIN (SELECT page_id, regexp_extract(html, '<h1>([^ <]*)', 1) AS w FROM pages) b ON a.w = b.w),
d0 AS (SELECT page_id, 0 AS depth FROM pages WHERE page_id % 10 = 0),
d1 AS (SELECT DISTINCT b AS page_id, 1 AS depth FROM edges JOIN d0 ON a = page_id WHERE b NOT IN (SELECT page_id FROM d0)),
d2 AS (SELECT DISTINCT b AS page_id, 2 AS depth FROM edges JOIN d1 ON a = page_id WHERE b NOT IN (SELECT page_id FROM d0) AND b NOT IN (SELECT page_id FROM d1))
SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2""")
def crawl_frontier(spark, sf_dir):
    """Breadth-first crawl to depth 2 from every tenth page; a link leads to pages whose heading begins with its word."""
    p = pages(spark, sf_dir)
    word = p.select("page_id", F.explode(html.links(F.col("html"), F.col("url"))).alias("link")).select(F.col("page_id").alias("a"), F.regexp_extract("link", r"^[^:]*://[^/]*/([^/?#]*)", 1).alias("w"))
    to = p.select(F.col("page_id").alias("b"), F.regexp_extract("html", r"<h1>([^ <]*)", 1).alias("w"))
    return crawl.by_words(p.filter("page_id % 10 = 0").select("page_id"), word, to, 2)
