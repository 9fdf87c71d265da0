"""Site lists: first-wins selection over names and urls, aliases, requested subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import urls
from quern.functions.text import directory_name, strip


def distinct_sites(sites: DataFrame) -> DataFrame:
    """Rows (ordinal, name, url, kept_ordinal) of the entries with a name and a canonical url.

    An entry is dropped if an earlier entry has its name, or an earlier kept entry its url key; kept_ordinal is the entry that
    stands for it (its own for a kept one). As every earlier entry hands on its name but only kept ones their url, the kept
    entries are the first of each key among the first of each name, which takes two aggregations and no fold.
    """
    rows = sites.select("ordinal", strip(F.col("name")).alias("name"), F.col("url"), urls.key(F.col("url")).alias("key"))
    rows = rows.where((F.col("name") != "") & (F.col("key.host") != ""))
    first = rows.groupBy("name").agg(F.min(F.struct("ordinal", "key")).alias("first")).select("name", "first.*")
    kept = first.groupBy("key").agg(F.min("ordinal").alias("kept_ordinal"))
    names = first.join(kept, "key").select("name", "kept_ordinal")
    return rows.drop("key").join(names, "name").select("ordinal", "name", "url", "kept_ordinal")


def kept_sites(sites: DataFrame) -> DataFrame:
    """The kept entries with the number of entries each stands for."""
    rows = distinct_sites(sites)
    counts = rows.groupBy("kept_ordinal").agg(F.count("*").alias("n_entries"))
    return rows.where("ordinal = kept_ordinal").join(counts, "kept_ordinal").select("ordinal", "name", "url", "n_entries")


def select_sites(sites: DataFrame, names: Sequence[str] = ("all",)) -> DataFrame:
    """The kept sites that the names, or aliases, ask for, in list order; all without names. Unknown names are an error."""
    kept = kept_sites(sites)
    if not names or "all" in names:
        return kept.orderBy("ordinal")
    rows = distinct_sites(sites).where(F.col("name").isin(*names))
    known = {r.name for r in rows.select("name").distinct().collect()}
    if missing := sorted(set(names) - known):
        raise ValueError(f"unknown sites: {', '.join(missing)}")
    return kept.join(rows.select(F.col("kept_ordinal").alias("ordinal")), "ordinal", "left_semi").orderBy("ordinal")


def directories(sites: DataFrame) -> DataFrame:
    """Rows (ordinal, name, directory) of the kept sites; two sites of one directory, or a name of which nothing is left, are an error."""
    rows = kept_sites(sites).select("ordinal", "name", directory_name(F.col("name"), strict=True).alias("directory"))
    names = rows.groupBy(F.lower("directory").alias("low")).agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b"))
    checked = names.withColumn("ok", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("one directory for "), F.col("a"), F.lit(" and "), F.col("b")))).otherwise(F.lit(True)))
    return rows.join(checked.select("low", "ok"), F.lower("directory") == F.col("low")).where("ok").drop("low", "ok")
