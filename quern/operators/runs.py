"""Run tables: the latest completed run, what is missing, and whether saved responses belong to their run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame, question_hash: str | None = None) -> DataFrame:
    """Rows (subject, profile_id, run_id, profile_version, completed_at): the completed run that ended last, the greatest id at ties.

    With question_hash only runs that asked these questions count, whatever their profile's version.
    """
    done = runs.where("status = 'completed' AND completed_at IS NOT NULL")
    if question_hash is not None:
        done = done.where(F.col("question_set_sha256") == question_hash)
    last = F.max(F.struct("completed_at", "run_id", "profile_version")).alias("last")
    return done.groupBy("subject", "profile_id").agg(last).select("subject", "profile_id", "last.run_id", "last.profile_version", "last.completed_at")


def latest_by_questions(runs: DataFrame) -> DataFrame:
    """Rows (subject, question_set_sha256, run_id): the latest completed run of each question set, over profile versions."""
    done = runs.where("status = 'completed' AND completed_at IS NOT NULL")
    return done.groupBy("subject", "question_set_sha256").agg(F.max(F.struct("completed_at", "run_id")).alias("last")).select("subject", "question_set_sha256", "last.run_id")


def without_run(subjects: DataFrame, runs: DataFrame, profile_id: str, question_hash: str | None = None) -> DataFrame:
    """The subjects that have no completed run of the profile with these questions."""
    return subjects.join(latest_runs(runs, question_hash).where(F.col("profile_id") == profile_id), "subject", "left_anti")


def checked_runs(responses: DataFrame, runs: DataFrame) -> DataFrame:
    """Each subject's latest run with what a replay needs: (subject, profile_id, run_id, n_requests, complete, one_model, own_questions).

    complete: as many distinct requests as planned; repeated records count once.
    """
    rows = responses.select("run_id", "request", "model", "question_set_sha256")
    sums = rows.groupBy("run_id").agg(F.count_distinct("request").alias("n_requests"), F.count_distinct("model").alias("n_models"), F.min("model").alias("m"), F.min("question_set_sha256").alias("q1"), F.max("question_set_sha256").alias("q2"))
    of = latest_runs(runs).select("subject", "profile_id", "run_id").join(runs.select("run_id", "requests_planned", "model", F.col("question_set_sha256").alias("q")), "run_id")
    out = of.join(sums, "run_id", "left")
    no = F.lit(False)
    return out.select(
        "subject", "profile_id", "run_id", F.coalesce("n_requests", F.lit(0)).cast("long").alias("n_requests"),
        F.coalesce(F.col("n_requests") == F.col("requests_planned"), no).alias("complete"),
        F.coalesce((F.col("n_models") == 1) & (F.col("m") == F.col("model")), no).alias("one_model"),
        F.coalesce((F.col("q1") == F.col("q")) & (F.col("q2") == F.col("q")), no).alias("own_questions"),
    )


def summary(selected: DataFrame, runs: DataFrame, profile_id: str) -> DataFrame:
    """One row (selected, completed, failed, missing) over the selected subjects: failed have a failed run and no completed one."""
    state = runs.where(F.col("profile_id") == profile_id).groupBy("subject").agg(F.max((F.col("status") == "completed") & F.col("completed_at").isNotNull()).alias("done"), F.max(F.col("status") == "failed").alias("bad"))
    rows = selected.select("subject").distinct().join(state, "subject", "left")
    done, bad = F.coalesce("done", F.lit(False)), F.coalesce("bad", F.lit(False))
    return rows.agg(F.count("*").alias("selected"), F.count_if(done).alias("completed"), F.count_if(~done & bad).alias("failed"), F.count_if(~done & ~bad).alias("missing"))


def mismatched(responses: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (run_id, n_records, n_models, n_foreign) of runs whose saved responses differ from the run: more than one model,
    another question set or model than the run's, or another number of distinct requests than completed."""
    of = runs.select("run_id", F.col("question_set_sha256").alias("q"), F.col("model").alias("m"), "requests_completed")
    rows = responses.select("run_id", "record_ord", "subject", "question_set_sha256", "model").join(of, "run_id")
    foreign = (F.col("question_set_sha256") != F.col("q")) | (F.col("model") != F.col("m"))
    sums = rows.groupBy("run_id").agg(F.count_distinct("subject", "record_ord").alias("n_records"), F.count_distinct("model").alias("n_models"), F.count_if(foreign).alias("n_foreign"), F.first("requests_completed").alias("n_completed"))
    return sums.where("n_models > 1 OR n_foreign > 0 OR n_records <> n_completed").select("run_id", "n_records", "n_models", "n_foreign")


def replayed(responses: DataFrame, runs: DataFrame) -> DataFrame:
    """The responses of each subject's and profile's latest completed run."""
    return responses.join(latest_runs(runs).select("run_id"), "run_id", "left_semi")


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs by profile and status, with planned and completed requests."""
    return runs.groupBy("profile_id", "status").agg(F.count("*").alias("n"), F.sum("requests_planned").alias("planned"), F.sum("requests_completed").alias("completed"), F.count_if(F.col("failed_at").isNotNull()).alias("failed"))
