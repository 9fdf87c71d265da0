"""The engine's entry points: score, overview, export, plan, classify, crawl, shortlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import chunking, crawl, evaluate, reporting, runs, scoring
from quern.plans import profile as contract
from quern.plans.runstore import RunStore
from quern.session import cut
from quern.sources import files


class Engine:
    """A profile over tables; every method returns a lazy DataFrame unless it says that it writes."""

    def __init__(self, spark: SparkSession, profile: dict) -> None:
        if found := contract.problems(profile):
            raise ValueError("; ".join(found))
        self.spark, self.profile = spark, profile
        self.criteria = contract.criteria_frame(spark, profile)
        evidence, score = profile["evidence_aggregation"], profile["score_aggregation"]
        self.evidence = (evidence["method"], tuple(evidence.get("top_weights", [1.0])))
        self.combination = (score["method"], score.get("geometric_weight", 0.5), score.get("bottleneck_weight", 0.5))

    def criterion_scores(self, responses: DataFrame) -> DataFrame:
        records = scoring.long_records(responses.where(F.col("profile_id") == self.profile["id"]), self.criteria)
        return scoring.criterion_scores(scoring.unit_best(records), *self.evidence)

    def score(self, responses: DataFrame) -> DataFrame:
        """Fit scores of saved responses; they stay valid while the questions do, whatever weights and methods change."""
        return scoring.fit_scores(self.criterion_scores(responses), self.criteria, *self.combination)

    def wide(self, responses: DataFrame) -> DataFrame:
        """One row a subject: the fit and each criterion's score in declared order."""
        scores = cut(self.criterion_scores(responses))
        fits = scoring.fit_scores(scores, self.criteria, *self.combination)
        return fits.join(reporting.wide(scores, [c["id"] for c in self.profile["criteria"]]), ["subject", "profile_id"])

    def overview(self, responses: DataFrame) -> DataFrame:
        scores = self.criterion_scores(responses).select(F.col("criterion_id").alias("metric"), F.col("score"))
        return reporting.overview(scores, ["metric"], "score")

    def export(self, responses: DataFrame, path: str) -> int:
        """Write the ranked wide rows as CSV; nothing is written if a response is invalid."""
        bad = scoring.checked(responses.where(F.col("profile_id") == self.profile["id"]), self.criteria).where("n_bad > 0")
        if not bad.isEmpty():
            raise ValueError("some responses lack a probability in [0, 1]")
        return files.export_csv(self.wide(responses).orderBy(F.col("fit_score").desc(), F.lower("subject")), path)

    def missing(self, subjects: DataFrame, run_table: DataFrame) -> DataFrame:
        return runs.without_run(subjects, run_table, self.profile["id"])

    def plan(self, pages: DataFrame, chunk_chars: int = 20_000, percentage: float | None = None, most: int = 0) -> DataFrame:
        """The chunks to classify with their texts, as classify takes them; plans sums them up."""
        if chunk_chars <= 0 or most < 0:
            raise ValueError("needs a chunk size above 0 and no negative number of chunks")
        return chunking.selected_texts(pages, chunk_chars, percentage, most)

    def smoke(self, pages: DataFrame, chunk_chars: int = 20_000) -> DataFrame:
        """The plan of a trial: five pages and one chunk a site."""
        rank = F.row_number().over(Window.partitionBy("site").orderBy("page_ord", "page_id"))
        return self.plan(pages.withColumn("__rank", rank).where(F.col("__rank") <= 5).drop("__rank"), chunk_chars, most=1)

    def classify(self, chunks: DataFrame, evaluator: evaluate.Evaluator | None = None) -> DataFrame:
        """Rows (subject, chunk_no, probabilities, stage, error_type, message) for the chunks of plan."""
        rows = chunks.select(F.col("site").alias("subject"), F.col("request").alias("chunk_no"), evaluate.joined_text(F.col("pages")).alias("text")) if "pages" in chunks.columns else chunks
        return evaluate.evaluated(rows, evaluator or evaluate.hashed_evaluator(contract.criterion_ids(self.profile)))

    def store(self, folder: str) -> RunStore:
        return RunStore(self.spark, folder, self.profile)

    def crawl(self, seeds: DataFrame, links: DataFrame, **limits: int) -> DataFrame:
        return crawl.frontier(seeds, links, **limits)

    def shortlist(self, rows: DataFrame, mode: int, threshold: float, gates: Sequence[str] = (), name: str = "subject", url: str = "url") -> DataFrame:
        """Rows (Company, URL) in input order of what passes."""
        kept = reporting.shortlist(rows, mode, threshold, gates)
        return kept.select(F.col(name).alias("Company"), (F.col(url) if url in rows.columns else F.lit("")).alias("URL"))
