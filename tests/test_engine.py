import copy

import pytest

import __spark_entry__ as entry
from quern.plans import profile as contract
from quern.plans.engine import Engine
from quern.session import salted_lookup
from quern.streaming import responses as streams

PROFILE = {
    "profile_schema_version": 1, "id": "demo", "version": "1.0.0", "name": "Demo", "instruction": "Judge.",
    "criteria": [{"id": "a", "role": "core", "weight": 2.0, "instructions": "A?"}, {"id": "b", "role": "core", "instructions": "B?"}, {"id": "x", "role": "auxiliary", "threshold": 0.7, "instructions": "X?"}],
    "evidence_aggregation": {"method": "top_weighted", "top_weights": [0.6, 0.4]}, "score_aggregation": {"method": "weighted_mean"},
}
RECORDS = "subject string, profile_id string, record_ord long, request int, evidence_unit string, urls array<string>, probabilities map<string,double>"


def rows(spark, n=3):
    return spark.createDataFrame([(f"s{k % 2}", "demo", k, k, None, [f"u{k}"], {"a": 0.9, "b": 0.3 * (k % 3), "x": 0.8}) for k in range(n)], RECORDS)


def test_profile_contract():
    assert contract.problems(PROFILE) == []
    for change in ({"id": "No"}, {"version": "../x"}, {"extra": 1}, {"criteria": [{"id": "x", "role": "auxiliary", "instructions": "?"}]}, {"score_aggregation": {"method": "sum"}}, {"evidence_aggregation": {"method": "mean", "top_weights": []}}):
        assert contract.problems(PROFILE | change)
    for change in ({"name": " "}, {"instruction": ""}, {"criteria": None}, {"criteria": [*PROFILE["criteria"], {"id": "y", "role": "core", "instructions": "?", "colour": 1}]}):
        assert contract.problems(PROFILE | change)
    assert contract.problems(contract.packaged()) == []
    assert contract.criterion_ids(PROFILE, "auxiliary") == ["x"]
    heavier = copy.deepcopy(PROFILE)
    heavier["criteria"][0]["weight"] = 5
    assert contract.profile_hash(heavier) != contract.profile_hash(PROFILE)
    assert contract.question_hash(heavier) == contract.question_hash(PROFILE)


def test_engine_scores_and_exports(spark, tmp_path):
    engine = Engine(spark, PROFILE)
    assert engine.score(rows(spark)).count() == 2
    assert engine.wide(rows(spark)).columns == ["subject", "profile_id", "fit_score", "main_strength", "main_gap", "a", "b", "x"]
    assert engine.export(rows(spark), str(tmp_path / "out.csv")) == 2
    bad = rows(spark).unionByName(spark.createDataFrame([("s", "demo", 9, 9, None, None, {"a": 2.0, "b": 0.1, "x": 0.1})], RECORDS))
    with pytest.raises(ValueError):
        engine.export(bad, str(tmp_path / "bad.csv"))
    assert not (tmp_path / "bad.csv").exists()
    assert engine.overview(rows(spark)).count() == 3


def test_engine_plans_and_classifies(spark):
    engine = Engine(spark, PROFILE)
    pages = spark.createDataFrame([("s", 0, 1, "u", "en", "x" * 30), ("t", 0, 2, "w", None, " ")], "site string, page_ord int, page_id long, url string, language_hint string, text string")
    plan = engine.plan(pages, 10, most=2)
    assert {(r.request, r.source_chunk, r.n_chars) for r in plan.collect()} == {(1, 1, 10), (2, 3, 10)}
    assert engine.classify(plan).where("probabilities IS NOT NULL").count() == 2
    assert engine.smoke(pages, 10).first().strategy == "balanced_across_pages"
    with pytest.raises(ValueError):
        engine.plan(pages, 0)
    got = engine.classify(spark.createDataFrame([("s", 1, "t")], "subject string, chunk_no int, text string")).first()
    assert set(got.probabilities) == {"a", "b", "x"} and all(0 <= p <= 1 for p in got.probabilities.values())


def test_salted_lookup_is_a_join_with_hot_keys(spark):
    left = spark.range(50_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END AS k")
    lookup = left.where("k IS NOT NULL AND k % 3 = 1").groupBy("k").count().withColumnRenamed("count", "n_rows").selectExpr("k", "n_rows", "k * 2 AS v")
    got = salted_lookup(left, lookup, ["k"])
    assert got.columns == ["k", "id", "v"]
    assert got.count() == left.where("k % 3 = 1").count() and got.where("v <> 2 * k").count() == 0


def test_stream_rescoring_follows_the_log(spark, tmp_path):
    source, seen = str(tmp_path / "in"), {}
    rows(spark, 2).write.parquet(source)
    criteria = contract.criteria_frame(spark, PROFILE)
    sink = lambda df, n: seen.__setitem__(n, df.count())
    for _ in range(2):
        streams.rescored(spark.readStream.schema(RECORDS).parquet(source), criteria, str(tmp_path / "log"), str(tmp_path / "ck"), sink).awaitTermination()
        rows(spark, 4).where("record_ord > 1").write.mode("append").parquet(source)
    assert len(seen) == 2 and seen[0] == 6 and seen[1] == 6


def test_contract(spark):
    assert entry.entry(spark).columns == ["subject", "fit_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def pages_of(spark, text="The first text."):
    rows = [("s", 0, 1, "http://s.test/1", "en", text), ("s", 1, 2, "http://s.test/2", "pt", "y" * 25), ("t", 0, 3, "http://t.test/1", None, "z" * 12)]
    return spark.createDataFrame(rows, "site string, page_ord int, page_id long, url string, language_hint string, text string")


def test_runs_are_saved_replayed_and_guarded(spark, tmp_path):
    from quern.operators import chunking
    from quern.operators.evaluate import hashed_evaluator
    from quern.plans.runstore import RunStore, metadata

    store = RunStore(spark, str(tmp_path), PROFILE)
    planned = chunking.evidence_identity(pages_of(spark))
    with pytest.raises(ValueError, match="changed"):
        store.classify(pages_of(spark, "Another text."), hashed_evaluator("abx"), "m", 10, expected=planned)
    states = store.classify(pages_of(spark), hashed_evaluator("abx"), "m", 10, expected=planned, unit_prefix="chunk").collect()
    assert {(r.subject, r.status, r.requests_completed) for r in states} == {("s", "completed", 5), ("t", "completed", 2)}
    first = store.responses().where("subject = 's' AND request = 1").first()
    assert first.urls == ["http://s.test/1"] and first.evidence_unit == "chunk_1" and first.source_chunk == 1
    results = store.replay().cache()
    assert results.count() == 2 and store.current_results().count() == 2
    assert metadata(results).columns == ["subject", "run_id", "model", "evidence_sha256", "chunks_sent", "offline_rescore"]
    heavier = copy.deepcopy(PROFILE)
    heavier["criteria"][0]["weight"] = 5
    again = RunStore(spark, str(tmp_path), heavier)
    with pytest.raises(ValueError, match="replay"):
        again.current_results()
    assert again.replay().count() == 2 and again.current_results().count() == 2

    def failing(subject, text):
        if subject == "t":
            raise RuntimeError("no answer")
        return hashed_evaluator("abx")(subject, text)

    late = {r.subject: r for r in store.classify(pages_of(spark), failing, "m", 10).collect()}
    assert (late["t"].status, late["t"].failed_stage) == ("failed", "evaluate") and "no answer" in late["t"].error and late["s"].status == "completed"
    assert {r.subject for r in store.replay().select("subject").collect()} == {"s", "t"}


def test_export_rows_and_errors(spark):
    from pyspark.sql import functions as F

    from quern.operators import reporting, scoring

    criteria = contract.criteria_frame(spark, PROFILE)
    results = scoring.results(scoring.long_records(rows(spark), criteria), criteria, ("top_weighted", (0.6, 0.4)), ("weighted_mean",))
    first = results.where("subject = 's0'").first()
    assert first.criterion_scores == {"a": 90.0, "b": 36.0} and first.auxiliary_flags == {"x": True} and first.evidence_units == 2
    assert [e.weight for e in first.criterion_evidence["a"]] == [0.6, 0.4]
    sites = spark.createDataFrame([(1, "S zero", "http://s0.test", "s0"), (2, "none", "http://n.test", "n")], "ordinal int, name string, url string, subject string")
    out = reporting.export_rows(sites, results, contract.exported(PROFILE), "1.0.0", "h")
    assert out.columns == reporting.columns(contract.exported(PROFILE))
    row = out.first()
    assert (row.site_name, row.core__a, row.aux__x__flag, row.run_id, row.evidence_is_partial, row.evidence_chunks_sent) == ("S zero", 90.0, True, "", True, "") and out.count() == 1
    for bad in (results.withColumn("fit_score", F.lit(101.0)), results.withColumn("profile_sha256", F.lit("other"))):
        with pytest.raises(Exception, match="score"):
            reporting.export_rows(sites, bad, contract.exported(PROFILE), "1.0.0", "h").collect()
    with pytest.raises(Exception, match="finite"):
        reporting.shortlist(results.withColumn("fit_score", F.lit(float("nan"))), 1, 70.0).collect()
    told = reporting.overview_text(reporting.overview(results.select(F.lit("fit").alias("metric"), "fit_score"), ["metric"], "fit_score"), reporting.gap_lines(results), reporting.leaders(results, 5))
    assert "fit" in told and "1. s" in told


def test_texts_and_raw_answers(spark):
    from pyspark.sql import functions as F

    from quern.operators.evaluate import hashed_evaluator
    from quern.plans.runstore import score_text

    row = score_text(spark, "  one text  ", "name", PROFILE, hashed_evaluator("abx")).first()
    assert 0 <= row.fit_score <= 100 and row.path.startswith("name/") and len(row.path) == 21
    raw = spark.createDataFrame([('{"answers": {"a": {"noul": 0.5}, "b": {"noul": 0.1}, "x": {"noul": 1.0}, "more": {}}}',), (None,)], "r string")
    assert [r.p for r in raw.select(contract.answers(F.col("r"), PROFILE).alias("p")).collect()] == [{"a": 0.5, "b": 0.1, "x": 1.0}, None]
    with pytest.raises(Exception, match="incomplete"):
        spark.createDataFrame([('{"answers": {"a": {"noul": 0.5}}}',)], "r string").select(contract.answers(F.col("r"), PROFILE)).collect()


def test_late_rows_of_a_stream_are_left_out(spark, tmp_path):
    """A watermark over three batches: a row later than it is dropped, one within it counts."""
    schema = "subject string, recorded_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    counted = streams.windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    for times in (["2024-01-01 10:00:00"], ["2024-01-20 10:00:00"], ["2024-01-01 11:00:00", "2024-01-19 09:00:00"], ["2024-02-20 00:00:00"], ["2024-02-20 01:00:00"]):
        spark.sql(" UNION ALL ".join(f"SELECT 's' AS subject, TIMESTAMP'{t}' AS recorded_at" for t in times)).coalesce(1).write.mode("append").parquet(source)
        counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.start)[:10], r.n) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01", 1), ("2024-01-19", 1), ("2024-01-20", 1)}
