"""The pN_ queries of the training-data problems and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import dedup, language, leaks, lines, mojibake, pages, quality, residue, split, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(_table(spark, sf_dir, "evidence"), "page_id", "text", 6000)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(_table(spark, sf_dir, "evidence"), "page_id", "text", 6000, 200)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.duplicates(_table(spark, sf_dir, "sites_gestoq"), "ordinal", ["name", "url"])
    return found.select(F.col("first_id").alias("first_ordinal"), F.col("copy_id").alias("copy_ordinal"))


def p3_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.collapsed(_table(spark, sf_dir, "sites_gestoq"), "ordinal", ["name", "url"]).select("ordinal", "name", "url", "n_copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_table(spark, sf_dir, "evidence"), least=8, near=False)


def p7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "evidence")
    return lines.without_lines(pages, lines.repeated_lines(pages, least=8, near=True)).select("page_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode(p8_ids(spark, sf_dir), "doc_id", "ids")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), least=10)


def p9_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.near_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_with_offsets(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(_table(spark, sf_dir, "evidence"), "page_id", "text")


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(_table(spark, sf_dir, "evidence").select("page_id", "text"), "page_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.furniture_lines(_table(spark, sf_dir, "evidence"), "page_id", "text")


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_body(_table(spark, sf_dir, "evidence"), "page_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.page_languages(_table(spark, sf_dir, "evidence"), "page_id", "text", "language_hint")
    return found.where("NOT hint_is_right").select("page_id", "lang")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(_table(spark, sf_dir, "evidence"), "page_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(_table(spark, sf_dir, "evidence"), "page_id", "text")


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(_table(spark, sf_dir, "evidence"), "page_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(_table(spark, sf_dir, "documents"), "doc_id", "text")


_ALL = (p1_found, p1_pieces, p2_found, p2_pages, p3_found, p3_sites, p4_found, p4_bodies, p5_found, p5_segments, p6_found, p6_texts, p7_found, p7_pages, p8_ids, p8_offsets, p8_round_trip, p9_edits, p9_found, p10_found, p10_statistics)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DROP = r"[^\p{L}\p{Nd}]+"


def _canonical(c: str) -> str:
    plain = lambda x: f"regexp_replace(lower({x}), '{_DROP}', '', 'g')"
    after = f"CASE WHEN instr({c}, '?') > 0 THEN substr({c}, instr({c}, '?') + 1) ELSE '' END"
    parts = f"list_sort(list_filter(list_transform(string_split({after}, '&'), lambda x: {plain('x')}), lambda x: x <> ''))"
    return f"{plain(f'split_part({c}, chr(63), 1)')} || array_to_string({parts}, '')"


_GROUPS = f"""
WITH forms AS (SELECT ordinal, {_canonical('name')} AS a, {_canonical('url')} AS b FROM sites_gestoq WHERE name IS NOT NULL AND url IS NOT NULL),
groups AS (SELECT ordinal, min(ordinal) OVER w AS first_ordinal, count(*) OVER w AS n FROM forms WINDOW w AS (PARTITION BY least(a, b), greatest(a, b)))"""

ORACLES: dict[str, str] = {
    "p1_found": f"SELECT page_id FROM evidence WHERE length(regexp_replace(regexp_replace(text, '^{_WHITE}+', ''), '{_WHITE}+$', '')) > 6000",
    "p3_found": f"{_GROUPS} SELECT first_ordinal, ordinal AS copy_ordinal FROM groups WHERE ordinal <> first_ordinal",
    "p3_sites": f"""{_GROUPS} SELECT s.ordinal, s.name, s.url, coalesce(g.n, 1) AS n_copies FROM sites_gestoq s LEFT JOIN groups g USING (ordinal)
        WHERE g.ordinal IS NULL OR g.ordinal = g.first_ordinal""",
    "p7_found": rf"""
        WITH pages AS (SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]*)', 1), '^www\.', '') AS host, string_split(text, chr(10)) AS parts
                       FROM evidence WHERE trim(coalesce(url, '')) <> '' AND text IS NOT NULL),
        raw AS (SELECT page_id, host, unnest(parts) AS part, generate_subscripts(parts, 1) AS line_no FROM pages),
        lines AS (SELECT page_id, host, CAST(line_no AS INT) AS line_no, regexp_replace(lower(trim(regexp_replace(part, '{_WHITE}+', ' ', 'g'))), '[0-9]+', '0', 'g') AS line FROM raw),
        often AS (SELECT host, line FROM lines WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT page_id) >= 8)
        SELECT page_id, line_no FROM lines JOIN often USING (host, line)""",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": r"""
        WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL),
        v AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS words FROM eval_items),
        g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(words) - 8), lambda i: array_to_string(list_slice(words, i, i + 9), ' '))) AS gram FROM v WHERE len(words) >= 10),
        d AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 8), lambda i: array_to_string(list_slice(words, i, i + 9), ' '))) AS gram FROM w WHERE len(words) >= 10)
        SELECT DISTINCT doc_id, item_id FROM d JOIN g USING (gram)""",
}
