"""Micro-batch pipelines: submissions end to end, and incremental similarity.

Batches go into a ``DocumentStore``: what a batch computes becomes visible when its manifest is written, a batch that is run again
changes nothing, and a document that arrives again replaces what earlier batches held of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markwell import constants as K
from markwell.functions import scoring
from markwell.functions import style
from markwell.functions import text as T
from markwell.functions.vectors import hashed_words
from markwell.operators import answers as A
from markwell.operators import cleaning, grading, integrity, reports, segmentation, similarity
from markwell.operators.criteria import Catalogue
from markwell.session import spread_by
from markwell.streaming.store import HEADS, DocumentStore

Embed = Callable[[Column], Column]

SUBMISSION_SCHEMA = "doc_id bigint, filename string, content string"


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything that is there now, batch by batch."""
    query: StreamingQuery = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_available(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Append-mode stream into Parquet files."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_updates(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Update-mode stream: the changed rows of each batch in their own folder."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def submission_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """(doc_id, filename, content) from JSON lines; a file holds any number of submissions."""
    reader = spark.readStream.format("json").schema(SUBMISSION_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


@dataclass(frozen=True)
class Assessment:
    """What submissions are assessed by: criteria, answer keys, the key set of a document, and the time that reports name."""

    catalogue: Catalogue
    keys: DataFrame
    report_time: str
    key_set: Column | None = None
    embed: Embed = hashed_words
    top: int = K.TOP_SIMILAR


class SimilarityTable:
    """Vectors as codes and the top lists of all documents, advanced by micro-batches.

    Both are tables of a store. A batch codes its own vectors, compares them with the stored codes once, and writes the lists
    that differ; all other lists stay where they are. What the next batch starts from is read from the store, never kept in
    the driver.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = K.TOP_SIMILAR):
        self.spark, self.k = spark, k
        self.codes = DocumentStore(spark, f"{path}/codes")
        self.lists = DocumentStore(spark, f"{path}/lists")

    def top(self) -> DataFrame:
        """The current lists; ``total_comparisons`` follows the number of documents."""
        total = self.codes.current(HEADS).count() - 1
        return self.lists.current("top").withColumn("total_comparisons", F.lit(total).cast("bigint"))

    def advance(self, vectors: DataFrame, batch_id: int, arrived: DataFrame | None = None) -> None:
        """Take in (doc_id, slot, vec); ``arrived`` names the documents of the batch if some have no vectors (any more).

        Codes are committed after the lists, so a batch that fails between starts over.
        """
        if self.codes.is_committed(batch_id):
            return
        known = self.codes.current("codes")
        dims = similarity.vector_size(vectors) if known is None or known.isEmpty() else similarity.first_size(None, known)
        new = self.codes.stage(batch_id, "codes", similarity.code_rows(similarity.pack_vectors(vectors), dims))
        heads = self.codes.stage(batch_id, HEADS, (new if arrived is None else arrived).select("doc_id"))
        if not self.lists.is_committed(batch_id):
            stored = self.lists.current("top")
            stored = similarity.no_lists(self.spark) if stored is None else stored
            base = new.limit(0) if known is None else known
            changed, covered, _ = similarity.changed_lists(stored, base, new, dims, self.k, heads)
            tables = {"top": self.lists.stage(batch_id, "top", changed), HEADS: self.lists.stage(batch_id, HEADS, covered)}
            self.lists.commit(batch_id, tables)
        self.codes.commit(batch_id, {"codes": new, HEADS: heads})

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        run_available(stream, checkpoint, self.advance)
        return self.top()


class SubmissionPipeline:
    """From raw text to report: segment, clean, embed, compare, measure style, grade, report, batch by batch.

    Tables of the store: ``documents`` (status and message), ``answers`` (cleaned, one row per document), ``evaluation`` (per question),
    ``scores`` (grades and similarity), ``reports``. A stage reads what the last one staged, so a lost executor repeats one stage.
    """

    def __init__(self, spark: SparkSession, path: str, rules: Assessment):
        self.spark, self.rules = spark, rules
        self.store = DocumentStore(spark, f"{path}/store")
        self.similar = SimilarityTable(spark, f"{path}/similar", rules.top)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """The batch function. Of two rows of one document in a batch the greater content counts, so that reruns agree."""
        self.store.write(batch_id, lambda n: self._assess(batch, n))

    def _assess(self, batch: DataFrame, n: int) -> dict[str, DataFrame]:
        stage, rules = self.store.stage, self.rules
        usable = ~T.is_blank("content")
        one = batch.groupBy("doc_id").agg(F.max_by(F.struct("filename", "content"), F.struct("content", "filename")).alias("r"))
        arrived = one.select("doc_id", "r.filename", T.strip("r.content").alias("content"))
        documents = stage(n, "documents", arrived.select(
            "*", F.when(usable, "completed").otherwise("error").alias("status"), F.when(~usable, "Empty file").alias("message"),
        ))
        heads = stage(n, HEADS, documents.select("doc_id"))
        texts = documents.filter("status = 'completed'").select("doc_id", "content")
        cleaned = stage(n, "answers", cleaning.clean_tasks(segmentation.segment_submissions(spread_by(texts, "doc_id")), rules.embed))
        answers = A.unpack(cleaned)
        given = answers.filter(~T.is_blank("content"))
        vectors = given.select("doc_id", F.col("task_number").alias("slot"), rules.embed(F.col("content")).alias("vec")).unionByName(
            texts.select("doc_id", F.lit(0).alias("slot"), rules.embed(F.col("content")).alias("vec"))
        )
        self.similar.advance(vectors, n, heads)
        evaluation = stage(n, "evaluation", grading.evaluate_answers(answers, rules.keys, rules.catalogue, rules.embed, rules.key_set))
        metrics = stage(n, "integrity", integrity.analyze_submission(answers, texts))
        scores = stage(n, "scores", self._scores(cleaned, evaluation, metrics))
        report = self._reports(documents, cleaned, evaluation)
        tables = {"documents": documents, HEADS: heads, "answers": cleaned, "evaluation": evaluation, "integrity": metrics}
        return tables | {"scores": scores, "reports": stage(n, "reports", report)}

    def _scores(self, cleaned: DataFrame, evaluation: DataFrame, metrics: DataFrame) -> DataFrame:
        """Grades of tasks 1 to 3 and their mean, similarity with the key per task, and logic of task 4."""
        near = grading.similarity_from_evaluation(F.col("chosen"), F.col("hr_sim"), F.col("ai_sim"))
        per_task = evaluation.groupBy("doc_id").agg(
            *[F.max(F.when(F.col("task_number") == k, F.col("final_score"))).alias(f"task_{k}_score") for k in (1, 2, 3)],
            *[F.max(F.when(F.col("task_number") == k, near)).alias(f"task_{k}_similarity") for k in K.TASKS],
        )
        fourth = F.col("task_4")
        logic = scoring.logic_score(fourth, F.coalesce("task_4_similarity", F.lit(0.0)), style.llm_likelihood(fourth))
        return (
            cleaned.select("doc_id", "task_4", "tasks_count", "cleaning_status").join(per_task, "doc_id", "left")
            .join(grading.average_score(evaluation), "doc_id", "left").join(metrics, "doc_id", "left")
            .withColumn("task_4_logic_score", F.when(~T.is_blank(fourth), logic)).drop("task_4")
        )

    def _reports(self, documents: DataFrame, cleaned: DataFrame, evaluation: DataFrame) -> DataFrame:
        done = documents.join(cleaned.select("doc_id"), "doc_id", "left_semi")
        organizer = reports.organizer_report(done, evaluation, F.lit(self.rules.report_time))
        candidate = reports.candidate_report(done, evaluation).withColumnRenamed("report", "candidate_report")
        return organizer.join(candidate, "doc_id")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        run_available(stream, checkpoint, self.process)

    def scores(self) -> DataFrame:
        """Scores of all documents, with the best match among all others and the originality of task 4 that follows from it."""
        best = self.similar.top().filter("place = 1").select("doc_id", "other_id", "overall_similarity")
        answers = self.store.current("answers").select("doc_id", "task_4")
        likelihood = style.llm_likelihood("task_4")
        original = scoring.originality_score(F.coalesce("overall_similarity", F.lit(0.0)), likelihood)
        joined = self.store.current("scores").join(best, "doc_id", "left").join(answers, "doc_id")
        return joined.withColumn("task_4_originality_score", F.when(~T.is_blank("task_4"), original)).drop("task_4")
