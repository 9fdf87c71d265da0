"""Queries of the core operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import chunking, crawl, evaluate, reporting, runs, scoring, sites
from quern.session import spark_python_white
from quern.streaming import responses as streams

#: Parameters of the queries: rank weights of the evidence, chunk size, share of chunks.
WEIGHTS = (0.6, 0.25, 0.15)
CHUNK = 5_000
SHARE = 40.0
#: Digits of percentages: as many as ranked scores have, so that no value lies halfway between two results.
DIGITS = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_W = f"[{spark_python_white()}]"
_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^{_W}+', ''), '{_W}+$', '')"
_RECORDS = f"""
asked AS (SELECT profile_id, list(criterion_id) AS ids FROM criteria GROUP BY profile_id),
valid AS (
  SELECT r.*, CASE WHEN {_STRIP("coalesce(evidence_unit, '')")} <> '' THEN 'unit:' || {_STRIP("evidence_unit")}
      WHEN len(list_filter(list_transform(coalesce(urls, []), lambda x: {_STRIP('x')}), lambda x: x IS NOT NULL AND x <> '')) > 0
        THEN 'urls:' || array_to_string(list_sort(list_distinct(list_filter(list_transform(urls, lambda x: {_STRIP('x')}), lambda x: x IS NOT NULL AND x <> ''))), '|')
      ELSE 'record:' || coalesce(CAST(request AS VARCHAR), CAST(record_ord AS VARCHAR)) END AS unit
  FROM responses r JOIN asked a USING (profile_id)
  WHERE len(list_filter(a.ids, lambda c: NOT coalesce(r.probabilities[c] BETWEEN 0 AND 1 AND NOT isnan(r.probabilities[c]), false))) = 0),
records AS (SELECT v.subject, v.profile_id, v.record_ord, v.request, v.unit, c.criterion_id, v.probabilities[c.criterion_id] AS p FROM valid v JOIN criteria c USING (profile_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY subject, profile_id, criterion_id, unit ORDER BY p DESC, record_ord) AS rn,
  min(record_ord) OVER (PARTITION BY subject, profile_id, criterion_id, unit) AS first_ord FROM records),
best AS (SELECT * FROM numbered WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, profile_id, criterion_id ORDER BY p DESC, first_ord, unit) AS rank FROM best)"""
_RANKS = ", ".join(f"({k}, CAST({w} AS DOUBLE))" for k, w in enumerate(WEIGHTS, 1))
_TOP = f"SELECT subject, profile_id, criterion_id, sum(p * w) / sum(w) AS score, count(*) AS n_used FROM ranked JOIN (VALUES {_RANKS}) AS t(rank, w) USING (rank) GROUP BY ALL"
_R = lambda c, n: f"floor(({c}) * 1e{n} + 0.5) / 1e{n}"


def _best(spark: SparkSession, d: str) -> DataFrame:
    return scoring.unit_best(scoring.long_records(_t(spark, d, "responses"), _t(spark, d, "criteria")))


def _scores(spark: SparkSession, d: str, method: str = "top_weighted") -> DataFrame:
    return scoring.criterion_scores(_best(spark, d), method, WEIGHTS)


def _shown(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", text.rounded(F.col("score"), 6))


_add("flt14_invalid_records", lambda s, d: scoring.checked(_t(s, d, "responses"), _t(s, d, "criteria")).where("n_bad > 0").select("subject", "record_ord", "n_bad"), """
    WITH asked AS (SELECT profile_id, list(criterion_id) AS ids FROM criteria GROUP BY profile_id)
    SELECT subject, record_ord, n_bad FROM (SELECT r.*, CAST(len(list_filter(a.ids, lambda c: NOT coalesce(r.probabilities[c] BETWEEN 0 AND 1 AND NOT isnan(r.probabilities[c]), false))) AS INT) AS n_bad
      FROM responses r JOIN asked a USING (profile_id)) WHERE n_bad > 0""")
_add("agg1_evidence_units", lambda s, d: scoring.long_records(_t(s, d, "responses"), _t(s, d, "criteria")).groupBy("subject", "profile_id", "unit").agg(F.count_distinct("record_ord").alias("n_records")),
     f"WITH {_RECORDS} SELECT subject, profile_id, unit, count(DISTINCT record_ord) AS n_records FROM records GROUP BY ALL")
_add("agg2_unit_best", lambda s, d: _best(s, d).select("subject", "profile_id", "criterion_id", "unit", "p", "record_ord", "first_ord"),
     f"WITH {_RECORDS} SELECT subject, profile_id, criterion_id, unit, p, record_ord, first_ord FROM best")
_add("agg3_top_weighted", lambda s, d: _shown(_scores(s, d)), f"WITH {_RECORDS} SELECT subject, profile_id, criterion_id, {_R('score', 6)} AS score, n_used FROM ({_TOP})")
_add("agg4_maximum", lambda s, d: _shown(_scores(s, d, "maximum")).drop("n_used"), f"WITH {_RECORDS} SELECT subject, profile_id, criterion_id, {_R('max(p)', 6)} AS score FROM best GROUP BY ALL")
_add("agg5_mean", lambda s, d: _scores(s, d, "mean").withColumn("score", text.rounded(F.col("score"), 10)), f"WITH {_RECORDS} SELECT subject, profile_id, criterion_id, {_R('avg(p)', 10)} AS score, count(*) AS n_used FROM best GROUP BY ALL")
_add("agg6_supporting_evidence", lambda s, d: scoring.supporting(_best(s, d), WEIGHTS).select("subject", "profile_id", "criterion_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", F.round(e["score"] * 100).cast("long"), F.round(e["weight"] * 1e6).cast("long"), e["request"])), ",").alias("evidence")), f"""
    WITH {_RECORDS}, w AS (SELECT * FROM ranked JOIN (VALUES {_RANKS}) AS t(rank, w) USING (rank)), x AS (SELECT *, sum(w) OVER (PARTITION BY subject, profile_id, criterion_id) AS total FROM w)
    SELECT subject, profile_id, criterion_id, string_agg(concat_ws(':', CAST(round({_R('p * 100', 2)} * 100) AS BIGINT), CAST(round({_R('w / total', 6)} * 1e6) AS BIGINT), request), ',' ORDER BY rank) AS evidence FROM x GROUP BY ALL""")
_add("agg7_unit_counts", lambda s, d: scoring.unit_counts(scoring.long_records(_t(s, d, "responses"), _t(s, d, "criteria"))), f"WITH {_RECORDS} SELECT subject, profile_id, count(DISTINCT unit) AS n_units FROM records GROUP BY ALL")

_COMBINED = {
    "weighted_mean": "sum(w * score) / sum(w)",
    "weighted_geometric": "CASE WHEN min(score) <= 0 THEN 0.0 ELSE exp(sum(w * ln(CASE WHEN score > 0 THEN score END)) / sum(w)) END",
    "minimum": "min(score)",
}
_COMBINED["weighted_geometric_bottleneck"] = f"(0.5 * ({_COMBINED['weighted_geometric']}) + 0.5 * min(score)) / 1.0"


def _fit_sql(method: str) -> str:
    return f"""SELECT subject, profile_id, {_R(f'({_COMBINED[method]}) * 100', DIGITS)} AS fit_score, arg_max(criterion_id, (score, -ord)) AS main_strength, arg_min(criterion_id, (score, ord)) AS main_gap
        FROM (SELECT k.*, c.ord, coalesce(c.weight, 1.0) AS w FROM top k JOIN criteria c USING (profile_id, criterion_id) WHERE c.role = 'core') GROUP BY subject, profile_id"""


def _fits(spark: SparkSession, d: str, method: str = "weighted_geometric_bottleneck") -> DataFrame:
    return scoring.fit_scores(_scores(spark, d), _t(spark, d, "criteria"), method, digits=DIGITS)


for _n, _m in ((8, "weighted_mean"), (9, "weighted_geometric"), (10, "minimum"), (11, "weighted_geometric_bottleneck")):
    _add(f"agg{_n}_{_m}", lambda s, d, m=_m: _fits(s, d, m), f"WITH {_RECORDS}, top AS ({_TOP}) {_fit_sql(_m)}")
_FITS = f"WITH {_RECORDS}, top AS ({_TOP}), fits AS ({_fit_sql('weighted_geometric_bottleneck')})"
_add("agg14_auxiliary_flags", lambda s, d: scoring.auxiliary_flags(_scores(s, d), _t(s, d, "criteria"), DIGITS), f"""WITH {_RECORDS}, top AS ({_TOP})
    SELECT subject, profile_id, criterion_id, {_R('score * 100', DIGITS)} AS score, score >= threshold AS flag FROM top JOIN criteria USING (profile_id, criterion_id) WHERE role = 'auxiliary' AND threshold IS NOT NULL""")
_add("agg15_strength_gap", lambda s, d: _fits(s, d).select("subject", "profile_id", "main_strength", "main_gap"), f"{_FITS} SELECT subject, profile_id, main_strength, main_gap FROM fits")
_add("agg16_overview", lambda s, d: reporting.overview(_fits(s, d), ["profile_id"], "fit_score"), f"""{_FITS} SELECT profile_id, count(*) AS n, {_R('avg(fit_score)', 4)} AS mean, {_R('median(fit_score)', 4)} AS median,
    {_R('stddev_pop(fit_score)', 4)} AS deviation, min(fit_score) AS least, max(fit_score) AS most FROM fits GROUP BY profile_id""")
_add("agg18_gap_histogram", lambda s, d: reporting.gaps(_fits(s, d)), f"{_FITS} SELECT profile_id, main_gap, count(*) AS n FROM fits GROUP BY ALL")
_add("ord2_leaders", lambda s, d: reporting.leaders(_fits(s, d), 5), f"{_FITS} SELECT * FROM fits ORDER BY fit_score DESC, lower(subject), subject, profile_id LIMIT 5")
_add("win1_ranked_units", lambda s, d: scoring.ranked(_best(s, d), 3).select("subject", "profile_id", "criterion_id", "unit", "rank"), f"WITH {_RECORDS} SELECT subject, profile_id, criterion_id, unit, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3")
_IDS = ("cold_chain", "expiry_rotation", "ward_refill", "site_model", "recall_trace", "named_clients", "daily_guidance", "shared_record", "crisis_plan")
_add("prj1_wide_rows", lambda s, d: reporting.wide(_scores(s, d), _IDS, DIGITS), f"WITH {_RECORDS}, top AS ({_TOP}) SELECT subject, profile_id, " + ", ".join(f"{_R('max(score) FILTER (WHERE criterion_id = ' + chr(39) + i + chr(39) + ') * 100', DIGITS)} AS {i}" for i in _IDS) + " FROM top GROUP BY subject, profile_id")
_add("flt1_shortlist_fit", lambda s, d: reporting.shortlist(_fits(s, d), 1, 70.0).select("subject", "fit_score"), f"{_FITS} SELECT subject, fit_score FROM fits WHERE fit_score > 70")
_add("flt2_shortlist_gates", lambda s, d: reporting.shortlist(reporting.wide(_scores(s, d), _IDS, DIGITS).where("profile_id = 'stock_twin'"), 2, 45.0, _IDS[:3]).select("subject", *_IDS[:3]), f"""WITH {_RECORDS}, top AS ({_TOP}),
    wide AS (SELECT subject, profile_id, {", ".join(f"{_R('max(score) FILTER (WHERE criterion_id = ' + chr(39) + i + chr(39) + ') * 100', DIGITS)} AS {i}" for i in _IDS[:3])} FROM top WHERE profile_id = 'stock_twin' GROUP BY subject, profile_id)
    SELECT subject, {", ".join(_IDS[:3])} FROM wide WHERE {" AND ".join(f"{i} >= 45" for i in _IDS[:3])}""")

_PAGES = f"""pages AS (SELECT coalesce(site, '') AS site, page_ord, page_id, language_hint, length({_STRIP('text')}) AS n FROM evidence WHERE text IS NOT NULL AND {_STRIP('text')} <> '')"""
_PACKED = f"""{_PAGES},
pieces AS (SELECT site, page_ord, page_id, language_hint, CAST(j AS INT) AS piece_no, (j - 1) * {CHUNK} AS start, least({CHUNK}, n - (j - 1) * {CHUNK}) AS length FROM (SELECT *, unnest(range(1, (n + {CHUNK} - 1) // {CHUNK} + 1)) AS j FROM pages)),
lined AS (SELECT *, row_number() OVER w AS i, sum(length) OVER w AS total FROM pieces WINDOW w AS (PARTITION BY site ORDER BY page_ord, page_id, piece_no)),
nexts AS (SELECT a.site, a.i, (SELECT min(b.i) FROM lined b WHERE b.site = a.site AND b.i > a.i AND b.total - (a.total - a.length) > {CHUNK}) AS nxt FROM lined a),
orbit AS (SELECT site, CAST(1 AS BIGINT) AS i, 1 AS chunk_no UNION ALL SELECT o.site, n.nxt, o.chunk_no + 1 FROM orbit o JOIN nexts n USING (site, i) WHERE n.nxt IS NOT NULL),
starts AS (SELECT DISTINCT site, i, chunk_no FROM orbit),
packed AS (SELECT l.*, s.chunk_no FROM lined l ASOF JOIN starts s ON l.site = s.site AND l.i >= s.i)"""
_PACKED = _PACKED.replace("orbit AS (SELECT site, CAST(1 AS BIGINT) AS i, 1 AS chunk_no UNION ALL", "orbit AS (SELECT site, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS chunk_no FROM (SELECT DISTINCT site FROM lined) UNION ALL")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.packed_pages(_t(spark, d, "evidence"), CHUNK)


_add("chk1_packed_chunks", _packed, f"WITH RECURSIVE {_PACKED} SELECT site, page_ord, page_id, piece_no, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(chunk_no AS BIGINT) AS chunk_no FROM packed")
_add("chk2_balanced_shares", lambda s, d: chunking.balanced_shares(_t(s, d, "evidence"), CHUNK), f"""
    WITH {_PAGES}, a AS (SELECT *, row_number() OVER up AS k, sum(n) OVER up AS s, count(*) OVER (PARTITION BY site) AS pages, sum(n) OVER (PARTITION BY site) AS chars FROM pages WINDOW up AS (PARTITION BY site ORDER BY n, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    lv AS (SELECT site, min_by((({CHUNK} - (s - n)) // (pages - (k - 1))), n) AS level FROM a WHERE chars > {CHUNK} AND n > (({CHUNK} - (s - n)) // (pages - (k - 1))) GROUP BY site),
    b AS (SELECT p.*, l.level, CASE WHEN l.level IS NULL THEN n ELSE least(n, l.level) END AS base FROM pages p LEFT JOIN lv l USING (site)),
    c AS (SELECT *, {CHUNK} - sum(base) OVER (PARTITION BY site) AS remaining, row_number() OVER (PARTITION BY site, n > level ORDER BY page_ord, page_id) AS r FROM b)
    SELECT * FROM (SELECT site, page_ord, page_id, CAST(n AS BIGINT) AS n_chars, CAST(base + CASE WHEN level IS NOT NULL AND n > level AND r <= remaining THEN 1 ELSE 0 END AS BIGINT) AS taken FROM c) WHERE taken > 0""")
_CHOSEN = f"""totals AS (SELECT site, max(chunk_no) AS total FROM packed GROUP BY site), picks AS (SELECT *, least(total, CAST(ceil(total * {SHARE} / 100) AS BIGINT)) AS selected FROM totals),
named AS (SELECT *, CASE WHEN selected = total THEN 'all_chunks' WHEN selected = 1 THEN 'balanced_across_pages' ELSE 'evenly_spaced_chunks' END AS strategy FROM picks),
chosen AS (SELECT site, strategy, total, unnest(CASE WHEN strategy = 'evenly_spaced_chunks' THEN list_transform(range(0, selected), lambda i: CAST(round_even(i * (total - 1) / (selected - 1), 0) AS BIGINT) + 1) ELSE range(1, total + 1) END) AS chunk_no FROM named)"""
_add("chk4_selected_chunks", lambda s, d: chunking.selected_chunks(_packed(s, d), SHARE), f"WITH RECURSIVE {_PACKED}, {_CHOSEN} SELECT site, chunk_no, strategy, total FROM chosen")
_add("agg20_translation_plan", lambda s, d: chunking.translation_plan(_packed(s, d), _t(s, d, "evidence")), f"""WITH RECURSIVE {_PACKED}, todo AS (SELECT site, chunk_no, sum(length) AS n FROM packed
    WHERE NOT (replace(lower(coalesce(language_hint, '')), '_', '-') = 'en' OR starts_with(replace(lower(coalesce(language_hint, '')), '_', '-'), 'en-')) GROUP BY ALL)
    SELECT site, count(*) AS requests, CAST(sum(n) AS BIGINT) AS characters FROM todo GROUP BY site""")
_add("flt3_nonblank_pages", lambda s, d: _t(s, d, "evidence").where(~text.is_blank(F.col("text"))).select("page_id"), f"WITH {_PAGES} SELECT page_id FROM pages")
_add("flt10_english_hints", lambda s, d: _t(s, d, "evidence").where(text.is_english_hint(F.col("language_hint"))).select("page_id"), "SELECT page_id FROM evidence WHERE replace(lower(language_hint), '_', '-') = 'en' OR starts_with(replace(lower(language_hint), '_', '-'), 'en-')")
_add("set3_first_contents", lambda s, d: crawl.first_contents(_t(s, d, "evidence")), """SELECT site, page_id FROM (SELECT coalesce(site, '') AS site, page_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(site, ''), coalesce(text, '') ORDER BY page_ord, page_id) AS rn FROM evidence) WHERE rn = 1 OR t = ''""")

_PART = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"
_url = lambda c, k: f"regexp_extract({_STRIP(c)}, {_PART}, {k})"
_HOST = lambda c: rf"regexp_replace(regexp_extract(lower({_url(c, 2)}), '^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1), '^www\.', '')"
_CANONICAL = lambda c: rf"""CASE WHEN {c} IS NULL THEN NULL WHEN lower({_url(c, 1)}) IN ('http', 'https') AND lower({_url(c, 2)}) <> '' THEN lower({_url(c, 1)}) || '://' || lower({_url(c, 2)}) ||
    CASE WHEN regexp_replace(regexp_replace({_url(c, 3)}, '/{{2,}}', '/', 'g'), ';[^/]*$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace({_url(c, 3)}, '/{{2,}}', '/', 'g'), ';[^/]*$', '') END ELSE '' END"""  # noqa: E731
_add("url1_canonical", lambda s, d: _t(s, d, "sites_gestoq").select("ordinal", urls.canonical(F.col("url")).alias("form")), f"SELECT ordinal, {_CANONICAL('url')} AS form FROM sites_gestoq")
_add("url2_hosts", lambda s, d: _t(s, d, "evidence").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_distinct("site").alias("n_sites")), f"SELECT {_HOST('url')} AS host, count(*) AS n, count(DISTINCT site) AS n_sites FROM evidence GROUP BY 1")
_DECODED = lambda c: f"coalesce(try(url_decode(replace({c}, '+', ' '))), {c})"
_QUERY = f"""array_to_string(list_transform(list_sort(list_filter(list_transform(list_filter(string_split(coalesce({_url('url', 4)}, ''), '&'), lambda x: x <> ''),
    lambda x: {{'k': {_DECODED("split_part(x, '=', 1)")}, 'v': {_DECODED("regexp_replace(CASE WHEN contains(x, '=') THEN x ELSE '=' END, '^[^=]*=', '')")}}}),
    lambda p: NOT starts_with(lower(p.k), 'utm_') AND lower(p.k) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid'))), lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&')"""
_add("url1_with_query", lambda s, d: _t(s, d, "sites_gestoq").select("ordinal", urls.canonical_with_query(F.col("url")).alias("form")),
     f"SELECT ordinal, CASE WHEN form <> '' AND query <> '' THEN form || '?' || query ELSE form END AS form FROM (SELECT ordinal, {_CANONICAL('url')} AS form, {_QUERY} AS query FROM sites_gestoq)")
_add("flt5_in_scope", lambda s, d: _t(s, d, "evidence").join(_t(s, d, "sites_gestoq").groupBy(urls.host(F.col("url")).alias("root")).agg(F.lit(1)).where("root <> ''"), urls.host(F.col("url")) == F.col("root")).groupBy("root").agg(F.count("*").alias("n")), f"SELECT {_HOST('e.url')} AS root, count(*) AS n FROM evidence e WHERE {_HOST('e.url')} IN (SELECT {_HOST('url')} FROM sites_gestoq WHERE url IS NOT NULL) AND {_HOST('e.url')} <> '' GROUP BY 1")
_add("flt6_url_traps", lambda s, d: _t(s, d, "evidence").withColumn("url", urls.canonical(F.col("url"))).where("url <> ''").select("page_id", urls.trap_reason(F.concat("url", F.when(F.col("page_id") % 3 == 0, "/a/b/a/b/A/b").when(F.col("page_id") % 3 == 1, F.repeat(F.lit("/x%2By/z"), 16)).otherwise(F.lit("/p+q/p%2Bq/end")))).alias("reason")), """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'repeated_path_sequence' WHEN 1 THEN 'path_too_deep' END AS reason FROM evidence WHERE """ + _CANONICAL("url") + " <> ''")
_add("flt4_static_files", lambda s, d: _t(s, d, "evidence").withColumn("url", urls.canonical(F.col("url"))).where("url <> ''").select("page_id", urls.is_static(F.concat("url", F.when(F.col("page_id") % 2 == 0, "/a/photo.JPEG").otherwise("/a/page.html"))).alias("static")), "SELECT page_id, page_id % 2 = 0 AS static FROM evidence WHERE " + _CANONICAL("url") + " <> ''")
_KEYED = f"""rows AS (SELECT ordinal, {_STRIP('name')} AS name, url, {_CANONICAL('url')} AS form FROM sites_gestoq), keyed AS (SELECT ordinal, name, url, {_HOST('form')} AS h, regexp_extract({_url('form', 2)}, ':(\\d+)$', 1) AS port,
    regexp_replace({_url('form', 3)}, '/+$', '') AS path FROM rows WHERE name <> '' AND form <> ''), firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY name ORDER BY ordinal) = 1),
    named AS (SELECT name, min(ordinal) OVER (PARTITION BY h, port, path) AS kept_ordinal FROM firsts), dis AS (SELECT k.ordinal, k.name, k.url, n.kept_ordinal FROM keyed k JOIN named n USING (name))"""
_add("set1_kept_sites", lambda s, d: sites.kept_sites(_t(s, d, "sites_gestoq")), f"WITH {_KEYED}, c AS (SELECT kept_ordinal, count(*) AS n_entries FROM dis GROUP BY 1) SELECT ordinal, name, url, n_entries FROM dis JOIN c USING (kept_ordinal) WHERE ordinal = kept_ordinal")
_add("set1_site_aliases", lambda s, d: sites.distinct_sites(_t(s, d, "sites_gestoq")).where("ordinal <> kept_ordinal").select("ordinal", "kept_ordinal"), f"WITH {_KEYED} SELECT ordinal, kept_ordinal FROM dis WHERE ordinal <> kept_ordinal")
_DIRECTORY = lambda c: rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace({c}, '{_W}', ' ', 'g')), '[^\x00-\x7f]', '', 'g'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+', ''), '[._-]+$', ''), '')"
_add("str1_directory_names", lambda s, d: _t(s, d, "sites_gestoq").select("ordinal", text.directory_name(F.col("name")).alias("directory")), f"SELECT ordinal, {_DIRECTORY('name')} AS directory FROM sites_gestoq")
_add("str2_collapsed_names", lambda s, d: _t(s, d, "sites_gestoq").select("ordinal", text.strip(text.collapse(F.col("name"))).alias("name")), f"SELECT ordinal, {_STRIP(f'regexp_replace(name, {chr(39)}{_W}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} AS name FROM sites_gestoq")

_LAST = "latest AS (SELECT subject, profile_id, max_by(run_id, (completed_at, run_id)) AS run_id, max_by(profile_version, (completed_at, run_id)) AS profile_version, max(completed_at) AS completed_at FROM run_state WHERE status = 'completed' AND completed_at IS NOT NULL GROUP BY ALL)"
_add("ord5_latest_runs", lambda s, d: runs.latest_runs(_t(s, d, "run_state")).select("subject", "profile_id", "run_id", "profile_version"), f"WITH {_LAST} SELECT subject, profile_id, run_id, profile_version FROM latest")
_add("joi3_missing_subjects", lambda s, d: runs.without_run(_t(s, d, "evidence").select(F.col("site").alias("subject")).distinct(), _t(s, d, "run_state"), "care_path"), f"WITH {_LAST} SELECT DISTINCT site AS subject FROM evidence WHERE site NOT IN (SELECT subject FROM latest WHERE profile_id = 'care_path' AND subject IS NOT NULL) OR site IS NULL")
_add("flt13_mismatched_runs", lambda s, d: runs.mismatched(_t(s, d, "responses"), _t(s, d, "run_state")), """
    SELECT run_id, n_records, n_models, n_foreign FROM (SELECT r.run_id, count(DISTINCT (r.subject, r.record_ord)) AS n_records, count(DISTINCT r.model) AS n_models,
      count(*) FILTER (WHERE r.question_set_sha256 <> s.question_set_sha256 OR r.model <> s.model) AS n_foreign, any_value(s.requests_completed) AS done FROM responses r JOIN run_state s USING (run_id) GROUP BY r.run_id)
    WHERE n_models > 1 OR n_foreign > 0 OR n_records <> done""")
_add("sta9_replayed_records", lambda s, d: runs.replayed(_t(s, d, "responses"), _t(s, d, "run_state")).groupBy("subject", "profile_id").agg(F.count("*").alias("n"), F.max("request").alias("last_request")), f"WITH {_LAST} SELECT r.subject, r.profile_id, count(*) AS n, max(request) AS last_request FROM responses r WHERE run_id IN (SELECT run_id FROM latest) GROUP BY ALL")
_add("agg23_run_counts", lambda s, d: runs.run_counts(_t(s, d, "run_state")), "SELECT profile_id, status, count(*) AS n, CAST(sum(requests_planned) AS BIGINT) AS planned, CAST(sum(requests_completed) AS BIGINT) AS completed, count(failed_at) AS failed FROM run_state GROUP BY ALL")
_add("agg21_skip_reasons", lambda s, d: crawl.skip_reasons(_t(s, d, "crawl_manifest")), "SELECT e.key AS reason, CAST(sum(e.value) AS BIGINT) AS n, count(*) AS crawls FROM (SELECT unnest(map_entries(urls_skipped_by_reason)) AS e FROM crawl_manifest) GROUP BY 1")
_add("agg24_partial_crawls", lambda s, d: crawl.partial_crawls(_t(s, d, "crawl_manifest")).select("manifest_id", "site_name", "is_partial", "zoned", text.rounded(F.col("yield"), 6).alias("yield")), f"""
    SELECT manifest_id, site_name, coalesce(crawl_limited, false) OR coalesce(len(page_errors), 0) > 0 AS is_partial, coalesce(regexp_matches(created_at_raw, '(Z|[+-]\\d\\d:?\\d\\d)$'), false) AS zoned,
      {_R('CAST(coalesce(pages_saved, 0) AS DOUBLE) / greatest(coalesce(page_requests_attempted, 0), 1)', 6)} AS yield FROM crawl_manifest""")
_add("crawl_last_manifests", lambda s, d: crawl.last_crawls(_t(s, d, "crawl_manifest")).select("site_name", "manifest_id", "pages_saved", "crawls"), "SELECT site_name, max_by(manifest_id, (created_at, manifest_id)) AS manifest_id, max_by(pages_saved, (created_at, manifest_id)) AS pages_saved, count(*) AS crawls FROM crawl_manifest GROUP BY site_name")
_add("agg17_evidence_counts", lambda s, d: crawl.partial_crawls(_t(s, d, "crawl_manifest")).agg(F.count_if(~F.col("is_partial")).alias("n_full"), F.count_if(F.col("is_partial")).alias("n_partial")), """
    SELECT count(*) FILTER (WHERE NOT p) AS n_full, count(*) FILTER (WHERE p) AS n_partial FROM (SELECT coalesce(crawl_limited, false) OR coalesce(len(page_errors), 0) > 0 AS p FROM crawl_manifest)""")
_add("agg19_plan_totals", lambda s, d: chunking.translation_plan(_packed(s, d), _t(s, d, "evidence")).agg(F.count("*").alias("sites"), F.sum("requests").alias("requests"), F.sum("characters").alias("characters")), f"""WITH RECURSIVE {_PACKED}, todo AS (SELECT site, chunk_no, sum(length) AS n FROM packed
    WHERE NOT (replace(lower(coalesce(language_hint, '')), '_', '-') = 'en' OR starts_with(replace(lower(coalesce(language_hint, '')), '_', '-'), 'en-')) GROUP BY ALL)
    SELECT count(DISTINCT site) AS sites, count(*) AS requests, CAST(sum(n) AS BIGINT) AS characters FROM todo""")
_add("agg25_distinct_urls", lambda s, d: _t(s, d, "responses").where("urls IS NOT NULL").select("subject", "record_ord", F.size(F.array_distinct(F.transform("urls", text.strip))).alias("n_urls")), f"SELECT subject, record_ord, CAST(len(list_distinct(list_transform(urls, lambda x: {_STRIP('x')}))) AS INT) AS n_urls FROM responses WHERE urls IS NOT NULL")
_add("dat2_crawl_ages", lambda s, d: _t(s, d, "crawl_manifest").where("created_at IS NOT NULL").select("manifest_id", F.timestamp_diff("HOUR", F.col("created_at"), F.lit("2025-06-01 00:00:00").cast("timestamp")).between(0, 24 * 120).alias("recent")), "SELECT manifest_id, epoch(TIMESTAMPTZ '2025-06-01 00:00:00+00' - created_at) / 3600 < 24 * 120 + 1 AND created_at <= TIMESTAMPTZ '2025-06-01 00:00:00+00' AS recent FROM crawl_manifest WHERE created_at IS NOT NULL")
_add("hsh1_text_hashes", lambda s, d: _t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256")), "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
_add("udf1_evaluated", lambda s, d: evaluate.evaluated(_t(s, d, "documents").select(F.coalesce("source", F.lit("")).alias("subject"), F.col("doc_id").alias("chunk_no"), "text"), evaluate.hashed_evaluator(_IDS[:4])).select("subject", "chunk_no", *[F.col("probabilities")[i].alias(i) for i in _IDS[:4]]),
     "SELECT coalesce(source, '') AS subject, doc_id AS chunk_no, " + ", ".join(f"(('0x' || substr(sha256('{i}' || chr(10) || coalesce(text, '')), 1, 8))::UBIGINT % 10001) / 10000.0::DOUBLE AS {i}" for i in _IDS[:4]) + " FROM documents")
_E = lambda c, n: f"CAST(printf('%.{n}f', {c}) AS DOUBLE)"
_add("mth1_half_even", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.rounded_even(F.col("l_extendedprice").cast("double") * F.col("l_discount").cast("double"), 2).alias("amount")),
     f"SELECT l_orderkey, l_linenumber, {_E('CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE)', 2)} AS amount FROM lineitem")
_PAGED = f"""bodies AS (SELECT page_id, {_STRIP('text')} AS body, coalesce(url, '') AS url, coalesce(language_hint, '') AS hint FROM evidence WHERE text IS NOT NULL),
cutout AS (SELECT p.*, substr(b.body, CAST(p.start AS INT) + 1, CAST(p.length AS INT)) AS piece, b.url, b.hint FROM packed p JOIN bodies b USING (page_id)),
chunked AS (SELECT site, chunk_no, string_agg(piece, '' ORDER BY page_ord, page_id, piece_no) AS body, count(*) AS n_pages, CAST(sum(length) AS BIGINT) AS n_chars FROM cutout GROUP BY ALL)"""
_shown_chunks = lambda df, *keys: df.select(*keys, F.size("pages").cast("long").alias("n_pages"), "n_chars", F.sha2(evaluate.joined_text(F.col("pages")), 256).alias("sha256"))
_add("chk1_chunk_texts", lambda s, d: _shown_chunks(chunking.chunk_texts(_packed(s, d), _t(s, d, "evidence")), "site", "chunk_no"), f"WITH RECURSIVE {_PACKED}, {_PAGED} SELECT site, CAST(chunk_no AS BIGINT) AS chunk_no, n_pages, n_chars, sha256(body) AS sha256 FROM chunked")
_SHARES = ORACLES["chk2_balanced_shares"]
_add("chk2_balanced_texts", lambda s, d: _shown_chunks(chunking.balanced_texts(_t(s, d, "evidence"), CHUNK), "site"), f"""WITH shares AS ({_SHARES}), bodies AS (SELECT page_id, {_STRIP('text')} AS body FROM evidence WHERE text IS NOT NULL)
    SELECT site, count(*) AS n_pages, CAST(sum(taken) AS BIGINT) AS n_chars, sha256(string_agg(substr(body, 1, CAST(taken AS INT)), '' ORDER BY page_ord, page_id)) AS sha256 FROM shares JOIN bodies USING (page_id) GROUP BY site""")
_add("chk5_plans", lambda s, d: chunking.plans(chunking.selected_texts(_t(s, d, "evidence"), CHUNK, SHARE), "auto").select("site", "strategy", F.col("total_chunks").cast("long").alias("total_chunks"), "requests", "translation_requests", "translation_characters"), f"""WITH RECURSIVE {_PACKED}, {_CHOSEN}, shares AS ({_SHARES}),
    hints AS (SELECT page_id, NOT (replace(lower(coalesce(language_hint, '')), '_', '-') = 'en' OR starts_with(replace(lower(coalesce(language_hint, '')), '_', '-'), 'en-')) AS todo FROM evidence),
    spaced AS (SELECT c.site, c.strategy, c.total, c.chunk_no, coalesce(sum(p.length) FILTER (WHERE h.todo), 0) AS n FROM chosen c JOIN packed p USING (site, chunk_no) JOIN hints h USING (page_id) WHERE c.strategy <> 'balanced_across_pages' GROUP BY ALL),
    one AS (SELECT c.site, c.strategy, c.total, 0 AS chunk_no, coalesce(sum(s.taken) FILTER (WHERE h.todo), 0) AS n FROM (SELECT DISTINCT site, strategy, total FROM chosen WHERE strategy = 'balanced_across_pages') c JOIN shares s USING (site) JOIN hints h USING (page_id) GROUP BY ALL)
    SELECT site, strategy, CAST(total AS BIGINT) AS total_chunks, count(*) AS requests, count(*) FILTER (WHERE n > 0) AS translation_requests, CAST(sum(n) AS BIGINT) AS translation_characters FROM (FROM spaced UNION ALL FROM one) GROUP BY ALL""")
_add("sta11_evidence_identity", lambda s, d: chunking.evidence_identity(_t(s, d, "evidence")), """SELECT coalesce(site, '') AS site, count(*) AS n_pages,
    CAST(sum(('0x' || substr(sha256(concat_ws(chr(10), coalesce(CAST(page_ord AS VARCHAR), ''), coalesce(url, ''), coalesce(language_hint, ''), coalesce(text, ''))), 1, 15))::HUGEINT) AS VARCHAR) AS identity FROM evidence GROUP BY 1""")
_add("api5_classified", lambda s, d: evaluate.evaluated(chunking.selected_texts(_t(s, d, "evidence"), CHUNK, SHARE).where("source_chunk IS NOT NULL").select(F.col("site").alias("subject"), F.col("source_chunk").alias("chunk_no"), evaluate.joined_text(F.col("pages")).alias("text")), evaluate.hashed_evaluator(_IDS[:2])).select("subject", "chunk_no", *[F.col("probabilities")[i].alias(i) for i in _IDS[:2]]),
     f"WITH RECURSIVE {_PACKED}, {_PAGED}, {_CHOSEN} SELECT c.site AS subject, CAST(c.chunk_no AS BIGINT) AS chunk_no, " + ", ".join(f"(('0x' || substr(sha256('{i}' || chr(10) || body), 1, 8))::UBIGINT % 10001) / 10000.0::DOUBLE AS {i}" for i in _IDS[:2]) + " FROM chosen c JOIN chunked USING (site, chunk_no) WHERE strategy <> 'balanced_across_pages'")
_entries = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e4).cast("long").cast("string"))), ",")


def _results(spark: SparkSession, d: str) -> DataFrame:
    records = scoring.long_records(_t(spark, d, "responses"), _t(spark, d, "criteria"))
    return scoring.results(records, _t(spark, d, "criteria"), ("top_weighted", WEIGHTS), ("weighted_geometric_bottleneck", 0.5, 0.5), DIGITS)


_TOLD = f"""told AS (SELECT k.*, c.ord, c.role, c.threshold FROM top k JOIN criteria c USING (profile_id, criterion_id)),
maps AS (SELECT subject, profile_id, coalesce(string_agg(criterion_id || '=' || CAST(round({_E('score * 100', DIGITS)} * 1e4) AS BIGINT), ',' ORDER BY ord) FILTER (WHERE role = 'core'), '') AS core,
  coalesce(string_agg(criterion_id || '=' || CAST(round({_E('score * 100', DIGITS)} * 1e4) AS BIGINT), ',' ORDER BY ord) FILTER (WHERE role = 'auxiliary'), '') AS aux,
  count(*) FILTER (WHERE role = 'auxiliary' AND threshold IS NOT NULL AND score >= threshold) AS n_flags FROM told GROUP BY ALL)"""
_add("agg13_results", lambda s, d: _results(s, d).select("subject", "profile_id", "fit_score", "main_strength", "main_gap", "evidence_units", _entries(F.col("criterion_scores")).alias("core"), _entries(F.col("auxiliary_scores")).alias("aux"), F.size(F.filter(F.map_values("auxiliary_flags"), lambda x: x)).cast("long").alias("n_flags")),
     f"{_FITS}, {_TOLD}, units AS (SELECT subject, profile_id, count(DISTINCT unit) AS evidence_units FROM records GROUP BY ALL) SELECT subject, profile_id, fit_score, main_strength, main_gap, evidence_units, core, aux, n_flags FROM fits JOIN maps USING (subject, profile_id) JOIN units USING (subject, profile_id)")

_STOCK = (("cold_chain", "core", False), ("expiry_rotation", "core", False), ("ward_refill", "core", False), ("site_model", "core", False), ("recall_trace", "auxiliary", True), ("named_clients", "auxiliary", True))


def _exported(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "sites_gestoq").where("name IS NOT NULL").withColumn("subject", text.directory_name(F.col("name")))
    return reporting.export_rows(rows, _results(spark, d).where("profile_id = 'stock_twin'"), _STOCK, "1", "0")


_add("prj2_export_rows", _exported, f"""{_FITS}, told AS (SELECT k.*, c.threshold FROM top k JOIN criteria c USING (profile_id, criterion_id) WHERE profile_id = 'stock_twin'),
    wide AS (SELECT subject, """ + ", ".join(f"max({_E('score * 100', DIGITS)}) FILTER (WHERE criterion_id = '{i}') AS {'core' if r == 'core' else 'aux'}__{i}" + (f", bool_or(score >= threshold) FILTER (WHERE criterion_id = '{i}') AS aux__{i}__flag" if flag else "") for i, r, flag in _STOCK) + f""" FROM told GROUP BY subject)
    SELECT s.name AS site_name, s.url AS site_url, f.profile_id, '1' AS profile_version, '0' AS profile_sha256, '' AS run_id, f.fit_score, w.* EXCLUDE (subject), true AS evidence_is_partial, '' AS evidence_chunks_available, '' AS evidence_chunks_sent, f.main_strength, f.main_gap
    FROM sites_gestoq s JOIN fits f ON f.subject = {_DIRECTORY('s.name')} AND f.profile_id = 'stock_twin' JOIN wide w ON w.subject = f.subject""")
_add("joi8_checked_runs", lambda s, d: runs.checked_runs(_t(s, d, "responses"), _t(s, d, "run_state")), f"""WITH {_LAST}, sums AS (SELECT run_id, count(DISTINCT request) AS n, count(DISTINCT model) AS k, min(model) AS m, min(question_set_sha256) AS q1, max(question_set_sha256) AS q2 FROM responses GROUP BY run_id)
    SELECT l.subject, l.profile_id, l.run_id, coalesce(n, 0) AS n_requests, coalesce(n = requests_planned, false) AS complete, coalesce(k = 1 AND m = r.model, false) AS one_model, coalesce(q1 = r.question_set_sha256 AND q2 = r.question_set_sha256, false) AS own_questions
    FROM latest l JOIN run_state r USING (run_id) LEFT JOIN sums USING (run_id)""")
_add("ord5_latest_by_questions", lambda s, d: runs.latest_by_questions(_t(s, d, "run_state")), "SELECT subject, question_set_sha256, max_by(run_id, (completed_at, run_id)) AS run_id FROM run_state WHERE status = 'completed' AND completed_at IS NOT NULL GROUP BY ALL")
_add("agg23_summary", lambda s, d: runs.summary(_t(s, d, "evidence").select(F.col("site").alias("subject")), _t(s, d, "run_state"), "care_path"), """WITH st AS (SELECT subject, bool_or(status = 'completed' AND completed_at IS NOT NULL) AS done, bool_or(status = 'failed') AS bad FROM run_state WHERE profile_id = 'care_path' GROUP BY 1),
    x AS (SELECT DISTINCT site AS subject FROM evidence), j AS (SELECT coalesce(done, false) AS done, coalesce(bad, false) AS bad FROM x LEFT JOIN st USING (subject))
    SELECT count(*) AS selected, count(*) FILTER (WHERE done) AS completed, count(*) FILTER (WHERE NOT done AND bad) AS failed, count(*) FILTER (WHERE NOT done AND NOT bad) AS missing FROM j""")
_NOW = "2025-06-01 00:00:00"
_add("flt11_reusable_crawls", lambda s, d: crawl.reusable(_t(s, d, "crawl_manifest"), F.lit(_NOW).cast("timestamp"), 24.0 * 120), rf"""SELECT manifest_id, site_name, coalesce(crawl_complete AND pages_saved > 0 AND
    (epoch_us(TIMESTAMPTZ '{_NOW}+00') - epoch_us(CASE WHEN regexp_matches(created_at_raw, '(Z|[+-]\d\d:?\d\d)$') THEN TRY_CAST(created_at_raw AS TIMESTAMPTZ) END)) / 3.6e9 BETWEEN 0 AND {24.0 * 120}, false) AS reusable FROM crawl_manifest""")
_add("set6_sitemap_seeds", lambda s, d: crawl.seeds_of(_t(s, d, "sites_gestoq").where("url IS NOT NULL").select(F.col("ordinal").alias("site"), F.col("url").alias("root"))), f"""SELECT ordinal AS site, regexp_extract({_CANONICAL('url')}, '^(https?://[^/]+)', 1) || x AS url
    FROM sites_gestoq, (VALUES ('/sitemap.xml'), ('/sitemap_index.xml'), ('/sitemap-index.xml')) AS t(x) WHERE url IS NOT NULL AND {_CANONICAL('url')} <> ''""")


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Seeds and links among the pages of a site: page k leads to pages 2k and 2k + 1."""
    pages = _t(spark, d, "evidence").where("site IS NOT NULL AND url IS NOT NULL").groupBy("site", "page_ord").agg(F.min("url").alias("url"))
    seeds = pages.groupBy("site").agg(F.min_by("url", "page_ord").alias("url"))
    child = pages.select("site", F.floor(F.col("page_ord") / 2).cast("int").alias("parent"), F.col("url").alias("target"), F.col("page_ord").alias("child"))
    links = child.join(pages.select("site", F.col("page_ord").alias("parent"), F.col("url").alias("source")), ["site", "parent"]).where("child <> parent")
    return seeds, links.select("source", "target")


_TREE = f"""pages AS (SELECT site, page_ord, min(url) AS url FROM evidence WHERE site IS NOT NULL AND url IS NOT NULL GROUP BY ALL), forms AS (SELECT site, page_ord, url, {_CANONICAL('url')} AS form FROM pages),
links AS (SELECT DISTINCT p.form AS source, c.form AS target, {_HOST('c.form')} AS h FROM forms c JOIN forms p ON c.site = p.site AND p.page_ord = c.page_ord // 2 AND c.page_ord <> p.page_ord WHERE p.form <> '' AND c.form <> ''),
roots AS (SELECT site, min_by(url, page_ord) AS root FROM pages GROUP BY site), walk AS (SELECT site, {_CANONICAL('root')} AS url, 0 AS depth, {_HOST('root')} AS h FROM roots WHERE {_CANONICAL('root')} <> ''
  UNION SELECT w.site, l.target, w.depth + 1, w.h FROM walk w JOIN links l ON l.source = w.url AND l.h = w.h WHERE w.depth < 40)"""
_add("sta1_frontier", lambda s, d: crawl.frontier(*_tree(s, d), max_pages=0).select("site", "url", "depth"), f"WITH RECURSIVE {_TREE} SELECT site, url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY ALL")
_add("flt5_in_scope_pages", lambda s, d: _t(s, d, "evidence").join(_t(s, d, "sites_gestoq").where("url IS NOT NULL AND name IS NOT NULL").groupBy(text.directory_name(F.col("name")).alias("site")).agg(F.min("url").alias("root")), "site").where("url IS NOT NULL").select("page_id", urls.in_scope(F.col("url"), F.col("root"), True).alias("inside")),
     f"WITH r AS (SELECT {_DIRECTORY('name')} AS site, min(url) AS root FROM sites_gestoq WHERE url IS NOT NULL AND name IS NOT NULL GROUP BY 1) SELECT page_id, {_HOST('e.url')} = {_HOST('root')} OR ends_with({_HOST('e.url')}, '.' || {_HOST('root')}) AS inside FROM evidence e JOIN r USING (site) WHERE url IS NOT NULL")
_add("url3_resolved", lambda s, d: _t(s, d, "evidence").where("url LIKE 'http%'").select("page_id", urls.resolved(F.col("url"), F.concat(F.lit("../x/./y"), (F.col("page_id") % 7).cast("string"), F.lit("?q=1#f"))).alias("target")),
     rf"SELECT page_id, lower(regexp_extract({_STRIP('url')}, '^([A-Za-z]+):', 1)) || '://' || {_url('url', 2)} || regexp_replace(regexp_replace(CASE WHEN {_url('url', 3)} = '' THEN '/' ELSE {_url('url', 3)} END, '[^/]*$', ''), '[^/]*/$', '') || CASE WHEN regexp_replace(regexp_replace(CASE WHEN {_url('url', 3)} = '' THEN '/' ELSE {_url('url', 3)} END, '[^/]*$', ''), '[^/]*/$', '') = '' THEN '/' ELSE '' END || 'x/y' || (page_id % 7) || '?q=1#f' AS target FROM evidence WHERE url LIKE 'http%'")
_add("stream1_windowed_counts", lambda s, d: streams.windowed_counts(_t(s, d, "responses")), "SELECT date_trunc('day', recorded_at) AS start, subject, count(*) AS n FROM responses WHERE recorded_at IS NOT NULL GROUP BY ALL")
_add("entry_events", lambda s, d: events_fit(s, d), f"""
    WITH criteria(criterion_id, weight, prime) AS (VALUES ('a', 1.0, 37), ('b', 2.0, 53), ('c', 1.0, 71)),
    r AS (SELECT user_id, event_type, event_id, criterion_id, CAST((event_id * prime) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS p FROM events, criteria),
    u AS (SELECT user_id, criterion_id, event_type, max(p) AS p, min(event_id) AS first_ord FROM r GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, criterion_id ORDER BY p DESC, first_ord, event_type) AS rank FROM u),
    s AS (SELECT user_id, criterion_id, sum(p * w) / sum(w) AS score FROM k JOIN (VALUES {_RANKS}) AS t(rank, w) USING (rank) GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS subject, {_R("(sum(weight * score) / sum(weight)) * 100", 6)} AS fit_score FROM s JOIN criteria USING (criterion_id) GROUP BY user_id""")


def events_fit(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: events as a response log, from units over ranks to fit scores."""
    criteria = spark.createDataFrame([("e", k, c, "core", w, None) for k, (c, w) in enumerate((("a", 1.0), ("b", 2.0), ("c", 1.0)))], "profile_id string, ord int, criterion_id string, role string, weight double, threshold double")
    p = lambda prime: (F.col("event_id") * prime) % 101 / F.lit(100.0)
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("subject"), F.lit("e").alias("profile_id"), F.col("event_id").alias("record_ord"), F.col("event_id").cast("int").alias("request"), F.col("event_type").alias("evidence_unit"), F.array().cast("array<string>").alias("urls"), F.create_map(F.lit("a"), p(37), F.lit("b"), p(53), F.lit("c"), p(71)).alias("probabilities"))
    scores = scoring.criterion_scores(scoring.unit_best(scoring.long_records(rows, criteria)), "top_weighted", WEIGHTS)
    return scoring.fit_scores(scores, criteria, "weighted_mean", digits=6).select("subject", "fit_score")
