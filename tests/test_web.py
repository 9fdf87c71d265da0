import gzip

import pytest
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import crawl, evaluate, runs, sites
from quern.sources import files, web


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "u string").select(expression(F.col("u")).alias("x")).first().x


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://A.Example//x//y%2fz;p=1?q=1#f", "http://a.example/x/y%2Fz"), ("https://a.test", "https://a.test/"), ("ftp://a.test/x", ""), ("nonsense", ""), (None, None), (" http://a.test/b ", "http://a.test/b"),
])
def test_canonical(spark, url, want):
    assert one(spark, url, urls.canonical) == want


def test_query_is_sorted_and_cleaned(spark):
    assert one(spark, "http://a.test/x?b=2&utm_source=z&a=1&gclid=5", urls.canonical_with_query) == "http://a.test/x?a=1&b=2"


@pytest.mark.parametrize(("url", "want"), [("http://u:p@WWW.A.test:80/x", "a.test"), ("https://www.www.b.test", "www.b.test"), ("//c.test/y", "c.test"), ("", "")])
def test_host(spark, url, want):
    assert one(spark, url, urls.host) == want


@pytest.mark.parametrize(("url", "want"), [("http://a.test/a/b/a/b/A/b", "repeated_path_sequence"), ("http://a.test/a/a/b/a", None), ("http://a.test/" + "x/y/z/q/w/" * 7, "path_too_deep"), ("http://a.test/" + "y" * 2050, "url_too_long"), ("http://a.test/p+/p%2B/p%2b", "repeated_path_sequence")])
def test_traps(spark, url, want):
    assert one(spark, url, urls.trap_reason) == want


def test_resolution(spark):
    df = spark.createDataFrame([("http://a.test/x/", r) for r in ("b.test/y", "page.html", "../z", "//c.test")], "b string, r string")
    assert [r.x for r in df.select(urls.resolved(F.col("b"), F.col("r")).alias("x")).collect()] == ["http://b.test/y", "http://a.test/x/page.html", "http://a.test/z", "http://c.test"]


def test_sites_first_wins_and_aliases(spark):
    rows = [("one", "https://one.test/"), ("one", "https://other.test/"), ("one alias", "http://www.one.test/?utm_source=list"), ("two", "https://two.test/"), ("two", "https://two.test/"), (None, "https://x.test"), ("bad", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ordinal int, name string, url string")
    assert [(r.name, r.n_entries) for r in sites.kept_sites(df).orderBy("ordinal").collect()] == [("one", 3), ("two", 2)]
    assert [r.name for r in sites.select_sites(df, ["one alias", "one"]).collect()] == ["one"]
    with pytest.raises(ValueError, match="none"):
        sites.select_sites(df, ["none"])


def test_frontier_is_bounded(spark):
    seeds = spark.createDataFrame([("s", "http://a.test/")], "site string, url string")
    links = spark.createDataFrame([("http://a.test/", "http://a.test/1"), ("http://a.test/", "http://b.test/"), ("http://a.test/1", "http://a.test/2"), ("http://a.test/1", "http://a.test/x.png"), ("http://a.test/2", "http://a.test/")], "source string, target string")
    assert {(r.url[-2:], r.depth) for r in crawl.frontier(seeds, links).collect()} == {("t/", 0), ("/1", 1), ("/2", 2)}
    assert crawl.frontier(seeds, links, max_pages=2).count() == 2
    assert crawl.frontier(seeds, links, max_pages=0, max_requests=1).count() == 1
    stopped = crawl.frontier(seeds, links, blocked=spark.createDataFrame([("http://a.test/1",)], "url string")).collect()
    assert {(r.url[-2:], r.requested) for r in stopped} == {("t/", True), ("/1", False)}
    told = crawl.manifests_of(crawl.frontier(seeds, links, max_pages=2), spark.createDataFrame([("http://a.test/1",)], "url string"), links, seeds, max_pages=2).first()
    assert (told.pages_saved, told.urls_visited, told.crawl_complete, told.limit_reasons) == (1, 2, False, ["page_limit"])
    assert told.urls_skipped_by_reason == {"out_of_scope": 1, "static_file": 1}
    whole = crawl.manifests_of(crawl.frontier(seeds, links), spark.createDataFrame([("x",)], "url string"), links, seeds).first()
    assert (whole.pages_saved, whole.crawl_complete, whole.limit_reasons) == (0, True, [])


def test_a_deep_walk_is_not_cut_off(spark):
    seeds = spark.createDataFrame([("s", "http://a.test/p0")], "site string, url string")
    links = spark.createDataFrame([(f"http://a.test/p{k}", f"http://a.test/p{k + 1}") for k in range(14)], "source string, target string")
    assert {r.depth for r in crawl.frontier(seeds, links).collect()} == set(range(15))


def test_sitemaps_are_followed(spark):
    roots = spark.createDataFrame([("s", "http://a.test/x")], "site string, root string")
    seeds = crawl.seeds_of(roots, spark.createDataFrame([("s", "Sitemap: http://a.test/own.xml")], "site string, rules string"))
    assert {r.url for r in seeds.collect()} == {"http://a.test" + x for x in (*crawl.SITEMAPS, "/own.xml")}
    maps = spark.createDataFrame([("http://a.test/own.xml", "index", ["http://a.test/sub.xml", "http://a.test/own.xml", "http://b.test/off.xml"]), ("http://a.test/sub.xml", "urlset", ["http://a.test/1", "http://a.test/2"]), ("http://b.test/off.xml", "urlset", ["http://b.test/3"])], "url string, kind string, locations array<string>")
    assert {r.url for r in crawl.sitemap_pages(seeds, maps, roots).collect()} == {"http://a.test/1", "http://a.test/2"}
    assert crawl.sitemap_pages(seeds, maps, roots, most=4).count() == 0


def test_saved_pages_are_checked(spark):
    pages = spark.createDataFrame([("s", "http://a.test/1", "t"), ("s", "http://b.test/2", " "), ("u", "http://u.test/1", "t")], "site string, url string, text string")
    got = {r.site: r for r in crawl.recovered(pages, spark.createDataFrame([("s", 2), ("u", 1)], "site string, pages_saved int"), spark.createDataFrame([("s", "http://a.test"), ("u", "http://u.test")], "site string, root string")).collect()}
    assert (got["s"].n_pages, got["s"].with_text, got["s"].out_of_scope, got["s"].valid) == (2, 1, 1, False) and got["u"].valid


def test_reusable_crawls(spark):
    rows = [(1, "a", "2025-05-31T12:00:00Z", 2, True), (2, "b", "2025-05-31T12:00:00", 2, True), (3, "c", "2025-06-01T12:00:00+00:00", 2, True), (4, "d", "junk Z", 2, True), (5, "e", "2025-05-31T12:00:00Z", 0, True), (6, "f", None, None, None)]
    df = spark.createDataFrame(rows, "manifest_id long, site_name string, created_at_raw string, pages_saved int, crawl_complete boolean")
    now = F.lit("2025-06-01 00:00:00").cast("timestamp")
    assert [r.manifest_id for r in crawl.reusable(df, now, 24).where("reusable").collect()] == [1]
    assert crawl.to_crawl(df.select("site_name"), df, now, 24).count() == 5


def test_directories_of_sites(spark):
    df = spark.createDataFrame([(0, "A b", "http://a.test"), (1, "A-b", "http://b.test")], "ordinal int, name string, url string")
    with pytest.raises(Exception, match="one directory"):
        sites.directories(df).collect()
    assert [r.directory for r in sites.directories(df.limit(1)).collect()] == ["A-b"]
    with pytest.raises(Exception, match="no directory name"):
        spark.createDataFrame([("東",)], "n string").select(text.directory_name(F.col("n"), strict=True)).collect()


def test_html_and_sitemaps(spark):
    html = "<html lang='pt-BR'><head><title> A  b </title><meta name='description' content='desc'><script>no</script></head><body><p>Body &amp; more<a href='/x'>l</a><iframe src='/f'></body>"
    df = spark.createDataFrame([("text/html", html.encode()), ("application/pdf", b"%PDF"), ("text/plain", b"see http://a.test/q now"), (None, None)], "content_type string, content binary")
    got = web.extracted(df).collect()
    assert got[0].text == "A b\ndesc\nA b Body & more l" and got[0].links == ["/f", "/x"] and got[0].lang == "pt-BR"
    assert got[1].text == "" and got[2].links == ["http://a.test/q"] and got[3].text == ""
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://a.test/1</loc></url></urlset>'
    index = '<sitemapindex><sitemap><loc> http://a.test/m.xml </loc></sitemap></sitemapindex>'
    packed = spark.createDataFrame([(0, gzip.compress(xml.encode())), (1, index.encode()), (2, b"\x1f\x8bbroken"), (3, b"<not xml"), (4, None)], "url int, content binary")
    got = {r.url: (r.kind, r.locations) for r in web.sitemaps(packed).collect()}
    assert got == {0: ("urlset", ["http://a.test/1"]), 1: ("index", ["http://a.test/m.xml"]), 2: ("unknown", []), 3: ("unknown", []), 4: ("unknown", [])}
    robots = spark.createDataFrame([("User-agent: *\nSitemap: http://a.test/s.xml\n sitemap:http://a.test/t.xml", ), (None,)], "r string")
    assert [r.x for r in robots.select(web.robots_sitemaps(F.col("r")).alias("x")).collect()] == [["http://a.test/s.xml", "http://a.test/t.xml"], []]
    rules = spark.createDataFrame([("User-agent: *\nDisallow: /no", "http://a.test/no/1"), ("User-agent: *\nDisallow: /no", "http://a.test/yes"), (None, "http://a.test/")], "r string, u string")
    assert [r.x for r in rules.select(web.allowed_udf("bot")("r", "u").alias("x")).collect()] == [False, True, True]
    hints = spark.createDataFrame([("en-US, pt", "de"), ("", "de"), (None, None)], "h string, l string")
    assert [r.x for r in hints.select(web.language_hint(F.col("h"), F.col("l")).alias("x")).collect()] == ["en-US", "de", ""]


def test_text_functions(spark):
    df = spark.createDataFrame([("  a\tb  ",), (None,), (" ",)], "t string")
    assert [r.x for r in df.select(text.strip(F.col("t")).alias("x")).collect()] == ["a\tb", None, ""]
    assert [r.x for r in df.select(text.is_blank(F.col("t")).alias("x")).collect()] == [False, True, True]
    names = spark.createDataFrame([("Côté & Cie.",), ("東",), (None,)], "n string").select(text.directory_name(F.col("n")).alias("x"))
    assert [r.x for r in names.collect()] == ["Cote-Cie", None, None]


def test_files(spark, tmp_path):
    (tmp_path / "sites.json").write_text('[{"name": "a", "url": "http://a.test"}, {"name": "b", "url": "http://b.test"}]')
    assert [(r.ordinal, r.name) for r in files.read_sites(spark, str(tmp_path / "sites.json")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "e.jsonl").write_text('{"url": "u", "text": "t"}\n\n')
    row = files.read_evidence(spark, str(tmp_path / "e.jsonl")).first()
    assert (row.url, row.content_type, row.text) == ("u", "", "t")
    assert files.export_csv(spark.createDataFrame([("a", 1.5), (None, None)], "x string, y double"), str(tmp_path / "o.csv")) == 2
    assert (tmp_path / "o.csv").read_bytes() == "﻿x,y\r\na,1.5\r\n,\r\n".encode()
    assert files.read_scores(spark, str(tmp_path / "o.csv"), ["x"]).columns == ["x", "y"]
    with pytest.raises(ValueError, match="z"):
        files.read_scores(spark, str(tmp_path / "o.csv"), ["z"])
    files.write_pointer({"run": 1}, str(tmp_path / "p.json"))
    with pytest.raises(ValueError):
        files.write_pointer({"run": float("nan")}, str(tmp_path / "p.json"))
    assert (tmp_path / "p.json").read_text() == '{"run": 1}'


def test_failures_stay_beside_their_rows(spark):
    def evaluator(subject, text):
        if text == "bad":
            raise RuntimeError("no")
        return {"a": 0.5}

    df = spark.createDataFrame([("s", 1, "ok"), ("s", 2, "bad"), ("s", 3, None)], "subject string, chunk_no int, text string")
    got = {r.chunk_no: r for r in evaluate.evaluated(df, evaluator).collect()}
    assert got[1].probabilities == {"a": 0.5} and got[2].error_type == "RuntimeError" and got[3].probabilities == {"a": 0.5}


def test_latest_run(spark):
    df = spark.sql("SELECT * FROM VALUES ('s','p','r1','1','completed',TIMESTAMP'2024-01-01'),('s','p','r2','2','completed',TIMESTAMP'2024-01-02'),('s','p','r3','3','failed',NULL) AS t(subject,profile_id,run_id,profile_version,status,completed_at)")
    assert runs.latest_runs(df).first().run_id == "r2"
    assert [r.subject for r in runs.without_run(spark.createDataFrame([("s",), ("t",)], "subject string"), df, "p").collect()] == ["t"]


def test_rounding_is_python_s(spark):
    import random

    rng = random.Random(8)
    values = [2.675, 1.005, 0.125, 0.375, -0.125, 59.5, 1e9 + 0.125, *[rng.uniform(-100, 100) for _ in range(3000)], *[rng.randrange(-10**6, 10**6) / 1000 for _ in range(3000)], *[rng.randrange(-800, 800) / 8 for _ in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 6):
        got = [r.x for r in df.select(text.rounded_even(F.col("v"), digits).alias("x")).collect()]
        assert got == [round(v, digits) for v in values]


def test_translations_and_their_failures(spark):
    page = "struct<url:string,language_hint:string,text:string>"
    df = spark.createDataFrame([("s", 1, [("u", "pt", "olá"), ("v", "en_US", "hi")]), ("s", 2, [("w", "pt", "bad")])], f"site string, request int, pages array<{page}>")

    def translator(value, hint):
        if value == "bad":
            raise RuntimeError("no")
        return value.upper(), len(value)

    got = {r.request: r for r in evaluate.translated(df, translator).collect()}
    assert [p.text for p in got[1].pages] == ["OLÁ", "hi"] and got[1].billed_characters == 3 and [t.status for t in got[1].translations] == ["translated", "kept"]
    assert got[2].stage == "translate" and got[2].pages[0].text == "bad"
    assert evaluate.translated(df, evaluate.identity_translator, "all").where("billed_characters = 5").count() == 1


def test_whole_files_and_streams(spark, tmp_path):
    import io

    (tmp_path / "o.json").write_text('{"a": 1}')
    (tmp_path / "l.json").write_text("[1]")
    assert files.read_object(str(tmp_path / "o.json")) == {"a": 1}
    with pytest.raises(TypeError):
        files.read_object(str(tmp_path / "l.json"))
    assert files.read_stream(spark, io.StringIO("é\n")).first().text == "é\n"
