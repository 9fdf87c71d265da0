import math

import pytest
from pyspark.sql import functions as F

from quern.operators import reporting, scoring

CRITERIA = "profile_id string, ord int, criterion_id string, role string, weight double, threshold double"
RECORDS = "subject string, profile_id string, record_ord long, request int, evidence_unit string, urls array<string>, probabilities map<string,double>, extra string"


def criteria(spark, *rows):
    return spark.createDataFrame([("p", k, *r) for k, r in enumerate(rows)], CRITERIA)


def responses(spark, *rows):
    return spark.createDataFrame([("s", "p", k, k, unit, urls, probs, "x") for k, (unit, urls, probs) in enumerate(rows)], RECORDS)


def test_one_url_is_one_unit_and_keeps_the_best(spark):
    c = criteria(spark, ("a", "core", 1.0, None))
    r = responses(spark, *[(None, [" http://u ", "http://u"], {"a": p}) for p in (0.2, 0.9, 0.6)])
    records = scoring.long_records(r, c)
    assert scoring.unit_counts(records).first().n_units == 1
    fit = scoring.fit_scores(scoring.criterion_scores(scoring.unit_best(records)), c).first()
    assert fit.fit_score == 90.0


@pytest.mark.parametrize("aux", [0.0, 1.0])
def test_auxiliaries_never_move_the_fit(spark, aux):
    c = criteria(spark, ("a", "core", 1.0, None), ("b", "core", 2.0, None), ("x", "auxiliary", None, 0.5))
    r = responses(spark, (None, None, {"a": 0.7, "b": 0.7, "x": aux}))
    scores = scoring.criterion_scores(scoring.unit_best(scoring.long_records(r, c)))
    assert scoring.fit_scores(scores, c).first().fit_score == 70.0
    assert scoring.auxiliary_flags(scores, c).first().flag == (aux >= 0.5)


def test_methods_against_plain_python(spark):
    c = criteria(spark, *[(n, "core", w, None) for n, w in (("a", 1.0), ("b", 2.0), ("c", 0.5))])
    r = responses(spark, (None, ["u"], {"a": 0.9, "b": 0.4, "c": 0.8}))
    scores = scoring.criterion_scores(scoring.unit_best(scoring.long_records(r, c)))
    v, w = [0.9, 0.4, 0.8], [1.0, 2.0, 0.5]
    geo = math.exp(sum(a * math.log(b) for a, b in zip(w, v, strict=True)) / sum(w))
    want = {"weighted_mean": sum(a * b for a, b in zip(w, v, strict=True)) / sum(w), "weighted_geometric": geo, "minimum": 0.4, "weighted_geometric_bottleneck": (geo + 0.4) / 2}
    for method, value in want.items():
        row = scoring.fit_scores(scores, c, method).first()
        assert row.fit_score == pytest.approx(100 * value, abs=0.006)
        assert (row.main_strength, row.main_gap) == ("a", "b")
    with pytest.raises(ValueError):
        scoring.fit_scores(scores, c, "median")


def test_a_zero_makes_the_geometric_mean_zero(spark):
    c = criteria(spark, ("a", "core", 1.0, None), ("b", "core", 1.0, None))
    r = responses(spark, (None, None, {"a": 0.0, "b": 1.0}))
    scores = scoring.criterion_scores(scoring.unit_best(scoring.long_records(r, c)))
    assert scoring.fit_scores(scores, c, "weighted_geometric").first().fit_score == 0.0


def test_ties_go_to_the_first(spark):
    c = criteria(spark, ("a", "core", 1.0, None), ("b", "core", 1.0, None))
    r = responses(spark, ("u1", None, {"a": 0.5, "b": 0.5}), ("u1", None, {"a": 0.5, "b": 0.5}), ("u2", None, {"a": 0.5, "b": 0.5}))
    best = scoring.unit_best(scoring.long_records(r, c))
    assert {x.record_ord for x in best.where("unit = 'unit:u1'").collect()} == {0}
    assert [x.unit for x in scoring.ranked(best, 2).where("criterion_id = 'a'").orderBy("rank").collect()] == ["unit:u1", "unit:u2"]
    fit = scoring.fit_scores(scoring.criterion_scores(best), c).first()
    assert (fit.main_strength, fit.main_gap) == ("a", "a")


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), -0.1, 1.1])
def test_bad_probabilities_are_no_records(spark, bad):
    c = criteria(spark, ("a", "core", 1.0, None))
    r = responses(spark, (None, None, {"a": bad}), (None, None, {"b": 0.5}), (None, None, {"a": 0.5}))
    assert [x.n_bad for x in scoring.checked(r, c).orderBy("record_ord").collect()] == [1, 1, 0]
    assert scoring.long_records(r, c).count() == 1


def test_top_weights_use_what_there_is(spark):
    c = criteria(spark, ("a", "core", 1.0, None))
    r = responses(spark, ("x", None, {"a": 0.8}), ("y", None, {"a": 0.4}))
    best = scoring.unit_best(scoring.long_records(r, c))
    assert scoring.criterion_scores(best, "top_weighted", (0.6, 0.25, 0.15)).first().score == pytest.approx((0.8 * 0.6 + 0.4 * 0.25) / 0.85)
    assert scoring.criterion_scores(best, "mean").first().score == pytest.approx(0.6)
    evidence = scoring.supporting(best, (0.6, 0.25, 0.15)).first().evidence
    assert [(e.score, e.weight) for e in evidence] == [(80.0, round(0.6 / 0.85, 6)), (40.0, round(0.25 / 0.85, 6))]
    assert scoring.criterion_scores(best.limit(0)).count() == 0


def test_shortlists_and_overview(spark):
    rows = spark.createDataFrame([("a", 70.0, 30.0, 45.0), ("b", 71.0, 29.0, 50.0), ("c", float("nan"), 60.0, 60.0), ("d", None, None, 99.0)], "subject string, fit_score double, g1 double, g2 double")
    assert [r.subject for r in reporting.shortlist(rows.where("subject < 'c'"), 1, 70.0).collect()] == ["b"]
    assert {r.subject for r in reporting.shortlist(rows.where("subject < 'd'"), 2, 30.0, ["g1", "g2"]).collect()} == {"a", "c"}
    for mode, gates in ((1, []), (2, ["g1"])):
        with pytest.raises(Exception, match="finite"):
            reporting.shortlist(rows, mode, 30.0, gates).collect()
    got = reporting.overview(rows.where("subject IN ('a', 'b')").withColumn("k", F.lit("k")), ["k"], "fit_score").first()
    assert (got.n, got["mean"], got.median, got.deviation) == (2, 70.5, 70.5, 0.5)
