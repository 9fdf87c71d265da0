"""Runs over saved chunks: responses are written before anything is aggregated, and a run counts once it is complete.

A store is a folder with append-only tables: responses (partitioned by run_id), runs (one row when a run begins, one when it ends) and
results (by run_id and profile hash). The latest state of a run is a view over its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking, evaluate, runs, scoring
from quern.plans import profile as contract

SCHEMA_VERSION = 1
_STATE = "run_id string, subject string, schema_version int, status string, profile_id string, profile_version string, profile_sha256 string, question_set_sha256 string, evidence_sha256 string, model string, requests_planned int, requests_completed int, created_at timestamp, completed_at timestamp, failed_at timestamp, failed_stage string, error string"


class RunStore:
    def __init__(self, spark: SparkSession, folder: str, profile: dict) -> None:
        self.spark, self.folder, self.profile = spark, folder, profile
        self.criteria = contract.criteria_frame(spark, profile)

    def _append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{table}")

    def states(self) -> DataFrame:
        """The latest row of each run."""
        rows = self.spark.read.schema(_STATE).parquet(f"{self.folder}/runs")
        late = F.greatest(F.coalesce("completed_at", "created_at"), F.coalesce("failed_at", "created_at"))
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns), F.struct(late, F.col("status") != "running")).alias("r")).select("r.*")

    def responses(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/responses")

    def classify(self, pages: DataFrame, evaluator: evaluate.Evaluator, model: str, size: int = 20_000, percentage: float | None = None, most: int = 0, expected: DataFrame | None = None, unit_prefix: str | None = None) -> DataFrame:
        """Plan, evaluate and save; returns the runs' states. Each site is one run.

        expected (site, identity), from chunking.evidence_identity when the plan was made: sites whose pages changed since are an
        error before anything is asked. Responses are written first; a site with a failed chunk ends as failed, with its stage.
        """
        own = chunking.evidence_identity(pages)
        if expected is not None:
            changed = own.join(expected.select("site", F.col("identity").alias("planned")), "site").where(F.col("identity") != F.col("planned"))
            if names := [r.site for r in changed.select("site").limit(5).collect()]:
                raise ValueError(f"evidence changed since it was planned: {', '.join(names)}")
        chunks = chunking.selected_texts(pages, size, percentage, most)
        batch = uuid.uuid4().hex
        run = F.sha2(F.concat(F.lit(batch), F.col("site")), 256).substr(1, 32)
        profile = self.profile
        begun = chunks.groupBy("site").agg(F.count("*").cast("int").alias("n")).join(own, "site")
        empty = lambda kind: F.lit(None).cast(kind)
        self._append(begun.select(run.alias("run_id"), F.col("site").alias("subject"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("running").alias("status"), F.lit(profile["id"]).alias("profile_id"), F.lit(profile["version"]).alias("profile_version"), F.lit(contract.profile_hash(profile)).alias("profile_sha256"), F.lit(contract.question_hash(profile)).alias("question_set_sha256"), F.col("identity").alias("evidence_sha256"), F.lit(model).alias("model"), F.col("n").alias("requests_planned"), F.lit(0).alias("requests_completed"), F.current_timestamp().alias("created_at"), empty("timestamp").alias("completed_at"), empty("timestamp").alias("failed_at"), empty("string").alias("failed_stage"), empty("string").alias("error")), "runs")
        text = evaluate.joined_text(F.col("pages"))
        answered = evaluate.evaluated(chunks.select(F.col("site").alias("subject"), F.col("request").alias("chunk_no"), text.alias("text")), evaluator)
        digest = F.sha2(F.to_json(F.struct("pages")), 256)
        unit = F.lit(None).cast("string") if unit_prefix is None else F.concat(F.lit(f"{unit_prefix}_"), F.col("request").cast("string"))
        records = chunks.select("site", "request", "source_chunk", "urls", digest.alias("chunk_sha256")).join(answered.select(F.col("subject").alias("site"), F.col("chunk_no").alias("request"), "probabilities", "stage", "error_type", "message"), ["site", "request"])
        record = records.select(run.alias("run_id"), F.col("site").alias("subject"), F.col("request").cast("long").alias("record_ord"), F.col("request").cast("int").alias("request"), F.col("source_chunk").cast("int").alias("source_chunk"), "urls", unit.alias("evidence_unit"), "chunk_sha256", F.lit(profile["id"]).alias("profile_id"), F.lit(profile["version"]).alias("profile_version"), F.lit(contract.question_hash(profile)).alias("question_set_sha256"), F.lit(model).alias("model"), "probabilities", "stage", F.concat_ws(": ", "error_type", "message").alias("error"))
        record.write.mode("append").partitionBy("run_id").parquet(f"{self.folder}/responses")
        mine = self.states().join(begun.select(run.alias("run_id")), "run_id", "left_semi")
        sums = self.responses().groupBy("run_id").agg(F.count_if(F.col("stage").isNull()).cast("int").alias("ok"), F.min("stage").alias("bad_stage"), F.min(F.when(F.col("stage").isNotNull(), F.col("error"))).alias("why"))
        good = (F.col("ok") == F.col("requests_planned")) & F.col("bad_stage").isNull()
        now = F.current_timestamp()
        ended = mine.join(sums, "run_id")
        changes = {"status": F.when(good, "completed").otherwise("failed"), "requests_completed": F.col("ok"), "completed_at": F.when(good, now), "failed_at": F.when(~good, now), "failed_stage": F.when(~good, F.coalesce("bad_stage", F.lit("classification"))), "error": F.when(~good, F.col("why"))}
        self._append(ended.select(*[changes.get(c, F.col(c)).alias(c) for c in mine.columns]), "runs")
        return self.states().join(begun.select(run.alias("run_id")), "run_id", "left_semi")

    def replay(self) -> DataFrame:
        """Fit results of each subject's latest completed run, aggregated under this store's profile, and written to results.

        The questions must be those of the run: others are no runs of this profile. A run with missing or foreign records is an error.
        """
        questions = contract.question_hash(self.profile)
        states = self.states()
        current = runs.latest_runs(states, questions).where(F.col("profile_id") == self.profile["id"])
        own = states.join(current.select("run_id"), "run_id", "left_semi")
        records = self.responses().join(own.select("run_id"), "run_id", "left_semi")
        bad = runs.checked_runs(records, own).where("NOT complete OR NOT one_model OR NOT own_questions")
        if names := [r.subject for r in bad.select("subject").limit(5).collect()]:
            raise ValueError(f"incomplete or foreign responses: {', '.join(names)}")
        evidence, score = self.profile["evidence_aggregation"], self.profile["score_aggregation"]
        rows = scoring.results(
            scoring.long_records(records, self.criteria), self.criteria, (evidence["method"], tuple(evidence.get("top_weights", [1.0]))),
            (score["method"], score.get("geometric_weight", 0.5), score.get("bottleneck_weight", 0.5)),
        )
        hashed = F.lit(contract.profile_hash(self.profile)).alias("profile_sha256")
        out = rows.join(own.select("subject", "run_id", "model", "evidence_sha256", F.col("requests_planned").alias("chunks_sent")), "subject").select("*", hashed)
        self._append(out, "results")
        return out

    def current_results(self) -> DataFrame:
        """The saved results of each latest run under this very profile; a run without one is an error that asks for a replay."""
        current = runs.latest_runs(self.states(), contract.question_hash(self.profile)).where(F.col("profile_id") == self.profile["id"])
        saved = self.spark.read.parquet(f"{self.folder}/results").where(F.col("profile_sha256") == contract.profile_hash(self.profile)).dropDuplicates(["run_id"])
        if not current.join(saved.select("run_id"), "run_id", "left_anti").isEmpty():
            raise ValueError("the scoring changed: replay first")
        return saved.join(current.select("run_id"), "run_id", "left_semi")


def metadata(results: DataFrame) -> DataFrame:
    """What a replay keeps of results: all that isn't computed from responses, marked as rescored offline."""
    computed = ["fit_score", "criterion_scores", "auxiliary_scores", "auxiliary_flags", "main_strength", "main_gap", "evidence_units", "criterion_evidence", "profile_id", "profile_sha256"]
    return results.drop(*computed).withColumn("offline_rescore", F.lit(True))


def score_text(spark: SparkSession, text: str, name: str, profile: dict, evaluator: evaluate.Evaluator, size: int = 20_000) -> DataFrame:
    """The fit result of one text, white space kept; each chunk is an evidence unit of its own. Its path is named by what it holds."""
    page = spark.createDataFrame([(name, text)], "site string, text string").select("site", F.lit(1).alias("page_ord"), F.lit(1).cast("long").alias("page_id"), F.lit("").alias("url"), F.lit("").alias("language_hint"), "text")
    chunks = chunking.selected_texts(page, size, keep_white=True)
    answered = evaluate.evaluated(chunks.select(F.col("site").alias("subject"), F.col("request").alias("chunk_no"), evaluate.joined_text(F.col("pages")).alias("text")), evaluator)
    records = answered.select("subject", F.lit(profile["id"]).alias("profile_id"), F.col("chunk_no").cast("long").alias("record_ord"), F.col("chunk_no").cast("int").alias("request"), F.concat(F.lit("chunk_"), F.col("chunk_no").cast("string")).alias("evidence_unit"), F.array().cast("array<string>").alias("urls"), "probabilities")
    criteria = contract.criteria_frame(spark, profile)
    evidence, score = profile["evidence_aggregation"], profile["score_aggregation"]
    rows = scoring.results(scoring.long_records(records, criteria), criteria, (evidence["method"], tuple(evidence.get("top_weights", [1.0]))), (score["method"], score.get("geometric_weight", 0.5), score.get("bottleneck_weight", 0.5)))
    return rows.withColumn("path", F.concat_ws("/", F.lit(name), F.sha2(F.lit(text), 256).substr(1, 16)))
