"""Reports over fit scores: statistics, rankings, wide rows, shortlists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import rounded


def overview(long: DataFrame, by: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """count, mean, median (midpoint of two), population deviation, least and most of value for each group, nulls left out.

    The median is found on the counts of each value, which are added up before the shuffle; rounded scores have few values.
    """
    rows = long.where(F.col(value).isNotNull() & reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by]))
    v = F.col(value)
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), rounded(F.avg(v), digits).alias("mean"), rounded(F.stddev_pop(v), digits).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"))
    counts = rows.groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__m"))
    through = counts.withColumn("__through", F.sum("__m").over(Window.partitionBy(*by).orderBy("__v"))).join(stats.select(*by, F.col("n").alias("__n")), list(by))
    low = F.min(F.when(F.col("__through") >= F.floor((F.col("__n") + 1) / 2), F.col("__v")))
    high = F.min(F.when(F.col("__through") >= F.floor(F.col("__n") / 2) + 1, F.col("__v")))
    middle = through.groupBy(*by).agg(rounded((low + high) / 2, digits).alias("median"))
    return stats.join(middle, list(by)).select(*by, "n", "mean", "median", "deviation", "least", "most")


def gaps(fits: DataFrame) -> DataFrame:
    """How often each criterion is the main gap."""
    return fits.groupBy("profile_id", "main_gap").agg(F.count("*").alias("n"))


def leaders(fits: DataFrame, k: int) -> DataFrame:
    """The k best fits, names in any case at ties."""
    return fits.orderBy(F.col("fit_score").desc(), F.lower("subject"), "subject", "profile_id").limit(k)


def wide(scores: DataFrame, criteria_ids: Sequence[str], digits: int = 2) -> DataFrame:
    """One row for each subject and profile, one column for each criterion, in percent; the list of columns is given, so nothing is collected."""
    return scores.groupBy("subject", "profile_id").pivot("criterion_id", list(criteria_ids)).agg(rounded(F.first("score") * 100, digits))


def _number_or_error(value: Column, name: str) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit(f"{name} is no finite number"))).otherwise(value)


def shortlist(rows: DataFrame, mode: int, threshold: float, gates: Sequence[str] = ()) -> DataFrame:
    """Mode 1: fit_score above the threshold; mode 2: every gate at or above it. A null or non-finite value is an error."""
    if mode == 1:
        return rows.where(_number_or_error(F.col("fit_score"), "fit_score") > threshold)
    if mode == 2 and gates:
        out = rows
        for g in gates:
            out = out.where(_number_or_error(F.col(g), g) >= threshold)
        return out
    raise ValueError("mode must be 1, or 2 with gates")


def columns(criteria: Sequence[tuple[str, str, bool]]) -> list[str]:
    """The export's columns: head, core criteria in declared order, auxiliary ones with their flags where they have one, tail.

    criteria: (id, role, has a threshold) in declared order.
    """
    core = [f"core__{i}" for i, role, _ in criteria if role == "core"]
    aux = [c for i, role, flagged in criteria if role == "auxiliary" for c in ([f"aux__{i}", f"aux__{i}__flag"] if flagged else [f"aux__{i}"])]
    head = ["site_name", "site_url", "profile_id", "profile_version", "profile_sha256", "run_id", "fit_score"]
    return [*head, *core, *aux, "evidence_is_partial", "evidence_chunks_available", "evidence_chunks_sent", "main_strength", "main_gap"]


def export_rows(sites: DataFrame, results: DataFrame, criteria: Sequence[tuple[str, str, bool]], version: str, sha256: str) -> DataFrame:
    """sites (ordinal, name, url, subject) with their results as rows of columns(criteria) in list order; sites without one are left out.

    results has the columns of scoring.results and may have run_id, evidence_is_partial, chunks_available, chunks_sent and
    profile_sha256; what is missing or null is the empty text, and true for evidence_is_partial. A fit outside 0 to 100, or of
    another profile than sha256, is an error.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in results.columns else F.lit(None).cast(kind)
    fit = F.col("fit_score")
    checked = F.when(fit.isNull() | F.isnan(fit) | ~fit.between(0, 100), F.raise_error(F.concat(F.lit("invalid score of "), F.col("name"))))
    checked = checked.when(F.coalesce(has("profile_sha256", "string"), F.lit(sha256)) != sha256, F.raise_error(F.concat(F.lit("another profile scored "), F.col("name")))).otherwise(fit)
    values = {
        "site_name": F.col("name"), "site_url": F.col("url"), "profile_id": F.col("profile_id"), "profile_version": F.lit(version), "profile_sha256": F.lit(sha256), "run_id": F.coalesce(has("run_id", "string"), F.lit("")), "fit_score": checked,
        "evidence_is_partial": F.coalesce(has("evidence_is_partial", "boolean"), F.lit(True)), "evidence_chunks_available": F.coalesce(has("chunks_available", "string"), F.lit("")), "evidence_chunks_sent": F.coalesce(has("chunks_sent", "string"), F.lit("")),
        "main_strength": F.col("main_strength"), "main_gap": F.col("main_gap"),
    }
    for i, role, flagged in criteria:
        values[f"{'core' if role == 'core' else 'aux'}__{i}"] = F.try_element_at("criterion_scores" if role == "core" else "auxiliary_scores", F.lit(i))
        if flagged:
            values[f"aux__{i}__flag"] = F.try_element_at("auxiliary_flags", F.lit(i))
    rows = sites.join(results, "subject")
    return rows.select(F.col("ordinal").alias("__ordinal"), *[values[c].alias(c) for c in columns(criteria)]).orderBy("__ordinal").drop("__ordinal")


def gap_lines(fits: DataFrame) -> DataFrame:
    """gaps, the most frequent first, by name at ties."""
    return gaps(fits).orderBy("profile_id", F.col("n").desc(), "main_gap")


def overview_text(metrics: DataFrame, gap_counts: DataFrame, best: DataFrame) -> str:
    """A report as text: statistics by metric, gaps, the best fits. All three are small: rows by criterion, and a top list."""
    out = [f"{'metric':<32}{'n':>8}{'mean':>10}{'median':>10}{'stdev':>10}{'min':>10}{'max':>10}"]
    out += [f"{r.metric:<32}{r.n:>8}{r.mean:>10.2f}{r.median:>10.2f}{r.deviation:>10.2f}{r.least:>10.2f}{r.most:>10.2f}" for r in metrics.orderBy("metric").collect()]
    out += [f"{r.main_gap}: {r.n}" for r in gap_counts.collect()]
    out += [f"{k}. {r.subject}: {r.fit_score:.2f}" for k, r in enumerate(best.collect(), 1)]
    return "\n".join(out)
