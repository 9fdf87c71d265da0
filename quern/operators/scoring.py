"""Evidence aggregation and score combination, on long data: one row for each subject, record and criterion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import is_probability, rounded, rounded_even, strip

EVIDENCE_METHODS = ("top_weighted", "mean", "maximum")
SCORE_METHODS = ("weighted_mean", "weighted_geometric", "minimum", "weighted_geometric_bottleneck")


def unit_key() -> Column:
    """The evidence unit of a record: its stripped name, else its distinct sorted urls, else the request itself; the kind stands first."""
    name = strip(F.coalesce("evidence_unit", F.lit("")))
    urls = F.array_sort(F.array_distinct(F.filter(F.transform("urls", strip), lambda x: x.isNotNull() & (x != ""))))
    return (
        F.when(name != "", F.concat(F.lit("unit:"), name))
        .when(F.coalesce(F.size(urls), F.lit(0)) > 0, F.concat(F.lit("urls:"), F.array_join(urls, "|")))
        .otherwise(F.concat(F.lit("record:"), F.coalesce(F.col("request").cast("string"), F.col("record_ord").cast("string"))))
    )


def checked(responses: DataFrame, criteria: DataFrame) -> DataFrame:
    """Responses with column n_bad: how many criteria of their profile lack a finite probability in [0, 1].

    Criteria are few (a profile's questions) and are turned to one array for each profile, so responses aren't exploded.
    """
    asked = criteria.groupBy("profile_id").agg(F.array_sort(F.collect_set("criterion_id")).alias("asked"))
    bad = F.size(F.filter("asked", lambda c: ~is_probability(F.try_element_at("probabilities", c))))
    return responses.join(asked, "profile_id").withColumn("n_bad", bad).drop("asked")


def long_records(responses: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row (subject, profile_id, record_ord, request, unit, urls, criterion_id, p) for each criterion of each valid record."""
    valid = checked(responses, criteria).where("n_bad = 0").withColumn("unit", unit_key())
    rows = valid.select("subject", "profile_id", "record_ord", "request", "unit", "urls", F.explode("probabilities").alias("criterion_id", "p"))
    return rows.join(criteria.select("profile_id", "criterion_id"), ["profile_id", "criterion_id"], "left_semi")


def unit_best(records: DataFrame) -> DataFrame:
    """Each unit's record of the highest probability for each criterion, the first record at ties, and the unit's first record.

    One aggregation, combined before the shuffle: a subject may hold any share of the records.
    """
    best = F.min_by(F.struct("p", "record_ord", "request", "urls"), F.struct((-F.col("p")).alias("down"), "record_ord"))
    out = records.groupBy("subject", "profile_id", "criterion_id", "unit").agg(best.alias("best"), F.min("record_ord").alias("first_ord"))
    return out.select("subject", "profile_id", "criterion_id", "unit", "best.*", "first_ord")


def criterion_scores(best: DataFrame, method: str = "top_weighted", weights: Sequence[float] = (1.0,)) -> DataFrame:
    """Rows (subject, profile_id, criterion_id, score, n_used) of the units' probabilities.

    top_weighted takes the k best units (ties: the unit seen first) with the weights actually used; the rank filter keeps k
    rows of a group in each task before the shuffle.
    """
    keys = ["subject", "profile_id", "criterion_id"]
    if method == "maximum":
        return best.groupBy(*keys).agg(F.max("p").alias("score"), F.lit(1).cast("long").alias("n_used"))
    if method == "mean":
        return best.groupBy(*keys).agg(F.avg("p").alias("score"), F.count("*").alias("n_used"))
    if method != "top_weighted" or not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError(f"no such evidence method or weights: {method} {weights}")
    top = ranked(best, len(weights)).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank")))
    return top.groupBy(*keys).agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("score"), F.count("*").alias("n_used"))


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best units of each criterion with their rank; ties go to the unit seen first."""
    order = Window.partitionBy("subject", "profile_id", "criterion_id").orderBy(F.col("p").desc(), "first_ord", "unit")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def supporting(best: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Rows (subject, profile_id, criterion_id, evidence): the used units in rank order with score, weight share, request and sources."""
    shares = F.array(*[F.lit(float(w)) for w in weights])
    top = ranked(best, len(weights)).withColumn("w", F.element_at(shares, F.col("rank")))
    rows = top.groupBy("subject", "profile_id", "criterion_id").agg(F.sum("w").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "p", "w", "request", "urls"))).alias("units"))
    evidence = F.transform("units", lambda u: F.struct(rounded(u["p"] * 100, 2).alias("score"), rounded(u["w"] / F.col("total"), 6).alias("weight"), u["request"].alias("request"), u["urls"].alias("sources")))
    return rows.select("subject", "profile_id", "criterion_id", evidence.alias("evidence"))


def combine(method: str, score: Column, weight: Column, geometric: float = 0.5, bottleneck: float = 0.5) -> Column:
    """The aggregate of core scores by a method; a zero makes the geometric mean zero."""
    mean = F.sum(weight * score) / F.sum(weight)
    product = F.when(F.min(score) <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(weight * F.ln(F.when(score > 0, score))) / F.sum(weight)))
    if method == "weighted_mean":
        return mean
    if method == "weighted_geometric":
        return product
    if method == "minimum":
        return F.min(score)
    if method == "weighted_geometric_bottleneck":
        return (geometric * product + bottleneck * F.min(score)) / (geometric + bottleneck)
    raise ValueError(f"no such score method: {method}")


def fit_scores(scores: DataFrame, criteria: DataFrame, method: str = "weighted_mean", geometric: float = 0.5, bottleneck: float = 0.5, digits: int | None = 2) -> DataFrame:
    """Rows (subject, profile_id, fit_score, main_strength, main_gap): core scores combined, in percent.

    Strength and gap are the best and the worst core criterion, the first declared at ties; auxiliary criteria never take part. Without digits
    the score is not rounded.
    """
    core = scores.join(criteria.where("role = 'core'").select("profile_id", "criterion_id", "ord", "weight"), ["profile_id", "criterion_id"])
    weight = F.coalesce("weight", F.lit(1.0))
    shown = combine(method, F.col("score"), weight, geometric, bottleneck) * 100
    return core.groupBy("subject", "profile_id").agg(
        (rounded(shown, digits) if digits is not None else shown).alias("fit_score"),
        F.max_by("criterion_id", F.struct(F.col("score"), -F.col("ord"))).alias("main_strength"),
        F.min_by("criterion_id", F.struct("score", "ord")).alias("main_gap"),
    )


def auxiliary_flags(scores: DataFrame, criteria: DataFrame, digits: int = 2) -> DataFrame:
    """Rows (subject, profile_id, criterion_id, score, flag) of auxiliary criteria with a threshold; the unrounded score decides."""
    aux = criteria.where("role = 'auxiliary' AND threshold IS NOT NULL").select("profile_id", "criterion_id", "threshold")
    return scores.join(aux, ["profile_id", "criterion_id"]).select("subject", "profile_id", "criterion_id", rounded(F.col("score") * 100, digits).alias("score"), (F.col("score") >= F.col("threshold")).alias("flag"))


def unit_counts(records: DataFrame) -> DataFrame:
    """Distinct evidence units of each subject and profile."""
    return records.groupBy("subject", "profile_id", "unit").agg(F.lit(1)).groupBy("subject", "profile_id").agg(F.count("*").alias("n_units"))


def results(records: DataFrame, criteria: DataFrame, evidence: tuple = ("top_weighted", (1.0,)), combination: tuple = ("weighted_mean", 0.5, 0.5), digits: int = 2) -> DataFrame:
    """One row for each subject and profile: the full fit result.

    (subject, profile_id, fit_score, criterion_scores and auxiliary_scores map<string,double>, auxiliary_flags map<string,boolean>,
    main_strength, main_gap, evidence_units, criterion_evidence map<string,array>). Scores are rounded from what is unrounded, true
    halves to the even digit; flags hold the criteria with a threshold alone. A profile has few criteria, so its maps are small.
    """
    best = unit_best(records)
    method, weights = evidence
    scores = criterion_scores(best, method, weights)
    told = scores.join(criteria.select("profile_id", "criterion_id", "ord", "role", "threshold"), ["profile_id", "criterion_id"])
    entry = F.struct("ord", "role", "criterion_id", rounded_even(F.col("score") * 100, digits).alias("shown"), (F.col("score") >= F.col("threshold")).alias("flag"))
    rows = told.groupBy("subject", "profile_id").agg(F.array_sort(F.collect_list(entry)).alias("told"))

    def of(role: str, value: str) -> Column:
        own = F.filter("told", lambda x: (x["role"] == role) & x[value].isNotNull())
        return F.map_from_entries(F.transform(own, lambda x: F.struct(x["criterion_id"], x[value])))

    shown = rows.select("subject", "profile_id", of("core", "shown").alias("criterion_scores"), of("auxiliary", "shown").alias("auxiliary_scores"), of("auxiliary", "flag").alias("auxiliary_flags"))
    fits = fit_scores(scores, criteria, *combination, digits=None)
    fits = fits.withColumn("fit_score", rounded_even(F.col("fit_score"), digits))
    support = supporting(best, weights if method == "top_weighted" else (1.0,))
    support = support.groupBy("subject", "profile_id").agg(F.map_from_entries(F.collect_list(F.struct("criterion_id", "evidence"))).alias("criterion_evidence"))
    units = unit_counts(records).withColumnRenamed("n_units", "evidence_units")
    keys = ["subject", "profile_id"]
    return fits.join(shown, keys).join(units, keys).join(support, keys)
