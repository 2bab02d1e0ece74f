"""Submissions over time: ingest, update, approve, block, delete, queue. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions.text import is_blank
from markwell.operators.skew import skew_join
from markwell.session import broadcast_if_small, cut_lineage

BATCH_ACTIONS = {
    "approve": {"approved": 1},
    "unapprove": {"approved": 0},
    "block": {"processing_status": "error"},
    "unblock": {"processing_status": "completed"},
}


def route_by_type(submissions: DataFrame, decoders: tuple[str, ...] = K.DECODABLE_TYPES) -> DataFrame:
    """Name the decoder of each file; a type without one is rejected with a message."""
    known = F.col("type").isin(*decoders)
    return submissions.withColumns(
        {
            "decoder": F.when(known, F.col("type")),
            "accepted": F.coalesce(known, F.lit(False)),
            "error": F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Unsupported file type: "), F.coalesce("type", F.lit("")))),
        }
    )


def ingest_dedup(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Judge uploads by content hash: 'accepted', or 'duplicate' of a stored or an earlier batch file.

    First rows per hash come from ``min_by`` aggregates (combined map-side), not from a window per hash,
    so a hash shared by a large part of the batch does not end in one task.
    """
    batch = cut_lineage(batch.select("doc_id", "full_filename", "file_hash"))  # texts are hashed once
    stored = existing.groupBy("file_hash").agg(
        F.min("doc_id").alias("_stored_id"), F.min_by("full_filename", "doc_id").alias("_stored_name")
    )
    first = batch.groupBy("file_hash").agg(
        F.min("doc_id").alias("_first_id"), F.min_by("full_filename", "doc_id").alias("_first_name")
    )
    facts = first.join(stored, "file_hash", "left")
    judged = skew_join(batch, facts, "file_hash")
    known = F.col("_stored_id").isNotNull()
    repeat = F.col("doc_id") != F.col("_first_id")
    return judged.select(
        "doc_id", "full_filename", "file_hash",
        F.when(known | repeat, "duplicate").otherwise("accepted").alias("outcome"),
        F.when(known, F.col("_stored_id")).when(repeat, F.col("_first_id")).alias("existing_id"),
        F.when(known, F.col("_stored_name")).when(repeat, F.col("_first_name")).alias("existing_name"),
    )


def import_new_only(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` with an unknown file name, first per name, as completed submissions."""
    columns = [F.struct(*[c for c in incoming.columns if c != "full_filename"]).alias("_row")]
    unique = incoming.select("full_filename", *columns).groupBy("full_filename").agg(F.min("_row").alias("_row"))
    fresh = unique.select("full_filename", "_row.*").join(existing.select("full_filename"), "full_filename", "left_anti")
    return fresh.withColumn("processing_status", F.lit("completed"))


def upsert(base: DataFrame, changes: DataFrame, updated_at: Column, order: str | None = None) -> DataFrame:
    """Update the columns ``changes`` brings along by doc_id.

    A NULL in ``changes`` leaves the stored value; unknown ids are ignored; rows without a change keep
    ``updated_at``. Of several changes to a column the last by ``order`` counts; without an order, the greatest value.
    """
    fields = [c for c in changes.columns if c not in ("doc_id", order) and c in base.columns]
    if not fields:
        return base

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)

    latest = changes.groupBy("doc_id").agg(*[newest(c).alias(f"_new_{c}") for c in fields])
    merged = base.join(latest, "doc_id", "left")
    touched = F.coalesce(*[F.col(f"_new_{c}").cast("string") for c in fields]).isNotNull()
    out = merged.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields})
    if "updated_at" in base.columns:
        out = out.withColumn("updated_at", F.when(touched, updated_at).otherwise(F.col("updated_at")))
    return out.select(*base.columns)


def approve_gated(submissions: DataFrame, ids: DataFrame) -> DataFrame:
    """Approve the ids that have an overall impression; adds ``approval`` (approved, rejected or NULL)."""
    wanted = ids.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    joined = submissions.join(broadcast_if_small(wanted), "doc_id", "left")
    ready = ~is_blank("overall_impression")
    return joined.withColumns(
        {
            "approved": F.when(F.col("_asked") & ready, 1).otherwise(F.col("approved")),
            "approval": F.when(F.col("_asked") & ready, "approved").when(F.col("_asked"), "rejected"),
        }
    ).drop("_asked")


def batch_set_status(submissions: DataFrame, ids: DataFrame, action: str, gated: bool = False) -> DataFrame:
    """Apply an action to a list of ids; ``changed`` marks the rows it reached."""
    if action not in BATCH_ACTIONS:
        raise ValueError(f"unknown action {action!r}; known: {sorted(BATCH_ACTIONS)}")
    wanted = ids.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    joined = submissions.join(broadcast_if_small(wanted), "doc_id", "left")
    hit = F.coalesce(F.col("_asked"), F.lit(False))
    if gated and action == "approve":
        hit = hit & ~is_blank("overall_impression")
    out = joined.withColumn("changed", hit)
    for column, value in BATCH_ACTIONS[action].items():
        out = out.withColumn(column, F.when(F.col("changed"), F.lit(value)).otherwise(F.col(column)))
    if "blocked" in submissions.columns and action in ("block", "unblock"):
        out = out.withColumn("blocked", F.when(F.col("changed"), action == "block").otherwise(F.col("blocked")))
    return out.drop("_asked")


def batch_delete(submissions: DataFrame, ids: DataFrame) -> DataFrame:
    return submissions.join(broadcast_if_small(ids.select("doc_id").distinct()), "doc_id", "left_anti")


def lookup(submissions: DataFrame, column: str, value) -> DataFrame:
    """The first row (smallest id) with ``column = value``; 'name' tries both file name columns."""
    hit = (
        (F.col("full_filename") == value) | (F.col("filename") == value) if column == "name" else F.col(column) == value
    )
    return submissions.filter(hit).orderBy("doc_id").limit(1)


def lookup_many(submissions: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``lookup`` for a whole table of values: (value, doc_id), NULL where nothing is found."""
    found = submissions.groupBy(F.col(column).alias("value")).agg(F.min("doc_id").alias("doc_id"))
    return wanted.select("value").distinct().join(found, "value", "left")


def list_documents(submissions: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first, id as tie-break; the limit is a distributed top-k."""
    out = submissions.orderBy(F.desc_nulls_last("created_at"), F.asc("doc_id"))
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def reprocess_queue(submissions: DataFrame) -> DataFrame:
    """Pending and failed submissions; one that lacks hash or type gets an error instead of a place."""
    queued = submissions.filter(F.col("processing_status").isin("pending", "error"))
    complete = (F.length("file_hash") > 0) & (F.length("type") > 0)
    return queued.select(
        "doc_id", "full_filename", "processing_status",
        F.when(F.coalesce(complete, F.lit(False)), "queued").otherwise("error").alias("outcome"),
        F.when(~F.coalesce(complete, F.lit(False)), "File hash or type is missing").alias("error"),
    )


def selection_state(submissions: DataFrame, ids: DataFrame) -> DataFrame:
    chosen = submissions.join(broadcast_if_small(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    approved, blocked = F.col("approved") == 1, F.col("processing_status") == "error"
    return chosen.agg(
        F.count("*").alias("selected"),
        F.count_if(approved).alias("approved"),
        F.count_if(~approved).alias("unapproved"),
        F.count_if(blocked).alias("blocked"),
        F.count_if(~blocked).alias("unblocked"),
    )


def add_missing_columns(base: DataFrame, newer: DataFrame) -> DataFrame:
    """Additive schema change: rows of both, missing columns NULL."""
    return base.unionByName(newer, allowMissingColumns=True)


def question_set_union(candidate: DataFrame, hr: DataFrame, ai: DataFrame) -> DataFrame:
    """Question numbers of three sources with presence flags, in numeric order."""
    sides = [("in_candidate", candidate), ("in_hr", hr), ("in_ai", ai)]
    flags = [name for name, _ in sides]
    stacked = None
    for name, df in sides:
        part = df.select("task_number").distinct().select("task_number", *[F.lit(name == f).alias(f) for f in flags])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("task_number").agg(*[F.bool_or(f).alias(f) for f in flags]).orderBy("task_number")


CONTEST_SCHEMA = (
    "struct<name:string,description:string,is_active:int,tasks:map<string,struct<task_text:string,"
    "reference_answer:string,criteria:array<struct<criterion_number:int,criterion_text:string,weight:double>>>>>"
)


def parse_contests(configs: DataFrame, id_col: str = "contest_id", json_col: str = "config") -> DataFrame:
    """Typed contest with the first reason for rejection, if any."""
    parsed = configs.select(id_col, F.from_json(json_col, CONTEST_SCHEMA).alias("c"))
    tasks = F.map_values("c.tasks")
    bad_number = F.exists(F.map_keys("c.tasks"), lambda n: ~F.coalesce(n.try_cast("int").between(1, 4), F.lit(False)))
    no_text = F.exists(tasks, lambda t: is_blank(t["task_text"]))
    return parsed.withColumn(
        "error",
        F.when(F.col("c").isNull() | is_blank("c.name"), "Contest name is required")
        .when(bad_number, "Task number must be between 1 and 4")
        .when(no_text, "Task text is required"),
    )


def contest_tasks(parsed: DataFrame, id_col: str = "contest_id") -> DataFrame:
    rows = parsed.filter("error IS NULL").select(id_col, F.explode("c.tasks").alias("task_number", "t"))
    return rows.select(
        id_col, F.col("task_number").cast("int").alias("task_number"), F.trim("t.task_text").alias("task_text"),
        F.coalesce(F.trim("t.reference_answer"), F.lit("")).alias("reference_answer"), "t.criteria",
    )


def contest_criteria(parsed: DataFrame, id_col: str = "contest_id") -> DataFrame:
    """Complete criteria only; a missing or zero weight counts as 1."""
    rows = contest_tasks(parsed, id_col).select(id_col, "task_number", F.inline("criteria"))
    complete = rows.filter((F.coalesce("criterion_number", F.lit(0)) != 0) & ~is_blank("criterion_text"))
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return complete.select(id_col, "task_number", "criterion_number", F.trim("criterion_text").alias("criterion_text"), weight.alias("weight"))
