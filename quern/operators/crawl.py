"""Crawl dataflow over tables: content dedup, a bounded breadth-first frontier, and manifest statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import urls
from quern.functions.text import is_blank
from quern.session import cut
from quern.sources import web

#: Where a host's sitemaps usually are.
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")


def first_contents(pages: DataFrame) -> DataFrame:
    """The (site, page_id) of pages whose text is the first of its site, by page_ord; empty texts never count as copies, null as empty.

    Texts meet as hashes, counted before the shuffle.
    """
    rows = pages.select(F.coalesce("site", F.lit("")).alias("site"), "page_ord", "page_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), (F.coalesce("text", F.lit("")) == "").alias("empty"))
    first = rows.where("NOT empty").groupBy("site", "h").agg(F.min(F.struct("page_ord", "page_id")).alias("first")).select("site", "first.page_id")
    return first.unionByName(rows.where("empty").select("site", "page_id"))


def skip_reasons(manifests: DataFrame) -> DataFrame:
    """Skipped urls by reason, over all crawls; attempts count, not distinct urls."""
    rows = manifests.select(F.explode("urls_skipped_by_reason").alias("reason", "n"))
    return rows.groupBy("reason").agg(F.sum("n").alias("n"), F.count("*").alias("crawls"))


def partial_crawls(manifests: DataFrame) -> DataFrame:
    """Each crawl with is_partial (limited, or a page failed) and zoned (its raw time names a zone)."""
    zoned = F.coalesce(F.col("created_at_raw").rlike(r"(?:Z|[+\-]\d{2}:?\d{2})$"), F.lit(False))
    partial = F.coalesce("crawl_limited", F.lit(False)) | (F.coalesce(F.size("page_errors"), F.lit(0)) > 0)
    return manifests.select("manifest_id", "site_name", partial.alias("is_partial"), zoned.alias("zoned"), (F.coalesce("pages_saved", F.lit(0)) / F.greatest(F.coalesce("page_requests_attempted", F.lit(0)), F.lit(1))).alias("yield"))


def last_crawls(manifests: DataFrame) -> DataFrame:
    """The last crawl of each site, the greatest id at ties."""
    return manifests.groupBy("site_name").agg(F.max(F.struct("created_at", "manifest_id", "pages_saved")).alias("m"), F.count("*").alias("crawls")).select("site_name", "m.manifest_id", "m.created_at", "m.pages_saved", "crawls")


def zoned_time(raw: Column) -> Column:
    """The time that an ISO text with a zone names; null without a zone, or if it is no time."""
    return F.when(raw.rlike(r"(?:Z|[+\-]\d{2}:?\d{2})$"), F.try_to_timestamp(raw))


def reusable(manifests: DataFrame, now: Column, hours: float) -> DataFrame:
    """Rows (manifest_id, site_name, reusable): whether a crawl still stands for its site.

    It must be complete, have saved a page, and have a time with a zone that is no more than `hours` ago and not in the future;
    what can't be read counts as no.
    """
    age = (F.unix_micros(now) - F.unix_micros(zoned_time(F.col("created_at_raw")))) / 3.6e9
    ok = F.col("crawl_complete") & (F.col("pages_saved") > 0) & age.between(0.0, float(hours))
    return manifests.select("manifest_id", "site_name", F.coalesce(ok, F.lit(False)).alias("reusable"))


def to_crawl(sites: DataFrame, manifests: DataFrame, now: Column, hours: float) -> DataFrame:
    """The sites (site_name) without a reusable crawl."""
    return sites.join(reusable(manifests, now, hours).where("reusable").select("site_name"), "site_name", "left_anti")


def recovered(pages: DataFrame, manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (site, n_pages, with_text, out_of_scope, valid) of saved pages against their manifests (site, pages_saved) and roots (site, root).

    valid: as many pages as the manifest counts, some text, and no page outside the root's host.
    """
    rows = pages.join(roots, "site").select("site", (~is_blank(F.col("text"))).alias("has"), (~F.coalesce(urls.in_scope(F.col("url"), F.col("root"), True), F.lit(False))).alias("out"))
    sums = rows.groupBy("site").agg(F.count("*").alias("n_pages"), F.count_if("has").alias("with_text"), F.count_if("out").alias("out_of_scope"))
    valid = (F.col("n_pages") == F.col("pages_saved")) & (F.col("with_text") > 0) & (F.col("out_of_scope") == 0)
    return sums.join(manifests.select("site", "pages_saved"), "site").select("site", "n_pages", "with_text", "out_of_scope", valid.alias("valid"))


def seeds_of(roots: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Rows (site, url): the sitemaps to begin with, the three usual ones of a root's host and those a robots file names (site, rules)."""
    origin = F.regexp_extract(urls.canonical(F.col("root")), "^(https?://[^/]+)", 1)
    usual = roots.select("site", F.explode(F.transform(F.array(*map(F.lit, SITEMAPS)), lambda x: F.concat(origin, x))).alias("url")).where("url LIKE 'http%'")
    if robots is None:
        return usual.distinct()
    return usual.unionByName(robots.select("site", F.explode(web.robots_sitemaps(F.col("rules"))).alias("url"))).distinct()


def sitemap_pages(seeds: DataFrame, maps: DataFrame, roots: DataFrame, most: int = 50) -> DataFrame:
    """Rows (site, url) of the pages that a site's sitemaps list, indexes followed; at most `most` sitemaps a site, 0 for all.

    seeds: (site, url); maps: (url, kind, locations), see web.sitemaps. A sitemap is read once, and none outside the root's host.
    """
    level, seen, found = seeds.select("site", "url").distinct(), None, None
    while True:
        level = level.join(roots, "site").where(urls.in_scope(F.col("url"), F.col("root"), True)).select("site", "url")
        if seen is not None:
            level = level.join(seen, ["site", "url"], "left_anti").join(seen.groupBy("site").agg(F.count("*").alias("n")), "site", "left")
        else:
            level = level.withColumn("n", F.lit(0))
        if most:
            rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))
            level = level.withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") + F.coalesce("n", F.lit(0)) <= most)
        level = cut(level.select("site", "url"))
        if level.isEmpty():
            return found.distinct() if found is not None else seeds.select("site", "url").limit(0)
        seen = level if seen is None else seen.unionByName(level)
        read = level.join(maps, "url")
        listed = read.where("kind = 'urlset'").select("site", F.explode("locations").alias("url"))
        found = listed if found is None else found.unionByName(listed)
        level = read.where("kind = 'index'").select("site", F.explode("locations").alias("url")).distinct()


def admitted(targets: DataFrame, subdomains: bool = False) -> DataFrame:
    """targets (site, root, url, ...) with reason: why a link isn't followed, null for one that is."""
    url = F.col("url")
    reason = F.when(url == "", "not_http").when(~urls.in_scope(url, F.col("root"), subdomains), "out_of_scope").when(F.coalesce(urls.is_static(url), F.lit(False)), "static_file").otherwise(urls.trap_reason(url))
    return targets.withColumn("reason", reason)


def frontier(seeds: DataFrame, links: DataFrame, max_pages: int = 400, max_requests: int = 0, max_queue: int = 0, subdomains: bool = False, blocked: DataFrame | None = None) -> DataFrame:
    """Rows (site, url, depth, order, requested) of the pages a bounded breadth-first walk visits; 0 is no limit, and there is none of depth.

    seeds: (site, url), the site's roots; links: (source, target), canonicalised once. Each level joins the frontier with the links and
    keeps targets in the root's scope that are neither static files nor traps nor visited (anti-join). A site takes pages of a
    level by their place in the queue (the level's url order, so a walk is the same in every run) until a limit is
    reached; max_queue bounds what a level may add. Urls in blocked (url) are visited but not requested, as robots rules want it,
    and lead nowhere. Each level is written once, to the shared folder.
    """
    roots = seeds.groupBy("site").agg(F.min("url").alias("root"))
    edges = cut(links.select(urls.canonical(F.col("source")).alias("url"), urls.canonical(F.col("target")).alias("to")).where("url <> '' AND to <> ''").distinct())
    stop = None if blocked is None else blocked.select(urls.canonical(F.col("url")).alias("url"), F.lit(True).alias("blocked")).distinct()
    level = seeds.select("site", urls.canonical(F.col("url")).alias("url")).where("url <> ''").distinct()
    levels: list[DataFrame] = []
    counts = roots.select("site", F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("asked"))
    while True:
        if levels:
            level = level.join(reduce(DataFrame.unionByName, [x.select("site", "url") for x in levels]), ["site", "url"], "left_anti")
        level = level.join(counts, "site")
        level = level.join(stop, "url", "left") if stop is not None else level.withColumn("blocked", F.lit(None).cast("boolean"))
        level = level.withColumn("requested", F.col("blocked").isNull())
        place = Window.partitionBy("site").orderBy("url")
        level = level.withColumn("rank", F.row_number().over(place)).withColumn("asks", F.sum(F.col("requested").cast("long")).over(place))
        if max_queue:
            level = level.where(F.col("rank") <= max_queue)
        if max_pages:
            level = level.where(F.col("seen") + F.col("rank") <= max_pages)
        if max_requests:
            level = level.where(F.col("asked") + F.col("asks") <= max_requests)
        level = cut(level.select("site", "url", F.lit(len(levels)).alias("depth"), (F.col("seen") + F.col("rank")).alias("order"), "requested"))
        if level.isEmpty():
            break
        levels.append(level)
        own = level.groupBy("site").agg(F.count("*").alias("n"), F.count_if("requested").alias("m"))
        counts = cut(counts.join(own, "site", "left").select("site", (F.col("seen") + F.coalesce("n", F.lit(0))).alias("seen"), (F.col("asked") + F.coalesce("m", F.lit(0))).alias("asked")))
        found = level.where("requested").join(edges, "url").join(roots, "site").select("site", "root", F.col("to").alias("url")).distinct()
        level = admitted(found, subdomains).where("reason IS NULL").select("site", "url")
    return reduce(DataFrame.unionByName, levels) if levels else level


def manifests_of(visited: DataFrame, pages: DataFrame, links: DataFrame, seeds: DataFrame, max_pages: int = 400, subdomains: bool = False) -> DataFrame:
    """Rows (site, pages_saved, urls_visited, requests, urls_skipped_by_reason, crawl_complete, limit_reasons) of walks of frontier.

    pages: (url) that gave text. A crawl is complete if no admitted link was left unvisited; else the page limit is its reason.
    """
    roots = seeds.groupBy("site").agg(F.min("url").alias("root"))
    saved = visited.join(pages.select(urls.canonical(F.col("url")).alias("url")).distinct(), "url", "left_semi").groupBy("site").agg(F.count("*").alias("pages_saved"))
    sums = visited.groupBy("site").agg(F.count("*").alias("urls_visited"), F.count_if("requested").alias("requests"))
    edges = links.select(urls.canonical(F.col("source")).alias("from"), urls.canonical(F.col("target")).alias("url"))
    met = visited.where("requested").select("site", F.col("url").alias("from")).join(edges, "from").join(roots, "site").select("site", "root", "url")
    told = admitted(met, subdomains)
    skipped = told.where("reason IS NOT NULL").groupBy("site", "reason").agg(F.count("*").cast("int").alias("n"))
    skipped = skipped.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("urls_skipped_by_reason"))
    left = told.where("reason IS NULL").select("site", "url").distinct().join(visited.select("site", "url"), ["site", "url"], "left_anti").groupBy("site").agg(F.count("*").alias("remaining"))
    rows = sums.join(saved, "site", "left").join(skipped, "site", "left").join(left, "site", "left")
    remaining = F.coalesce("remaining", F.lit(0))
    reasons = F.when(remaining > 0, F.when(F.lit(max_pages > 0) & (F.col("urls_visited") >= max_pages), F.array(F.lit("page_limit"))).otherwise(F.array(F.lit("request_or_queue_limit")))).otherwise(F.array().cast("array<string>"))
    return rows.select("site", F.coalesce("pages_saved", F.lit(0)).alias("pages_saved"), "urls_visited", "requests", F.coalesce("urls_skipped_by_reason", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).alias("urls_skipped_by_reason"), (remaining == 0).alias("crawl_complete"), reasons.alias("limit_reasons"))
