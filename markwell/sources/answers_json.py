"""Answers, answer keys and stored columns as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell.functions import text as T
from markwell.session import cut_lineage

ITEMS = "array<struct<task_number:string,content:string>>"
OBJECT = f"struct<filename:string,file_type:string,content:string,tasks:{ITEMS},parsed_at:string>"


def task_number(raw: Column) -> Column:
    """First digit run of the value, NULL without one."""
    return F.regexp_extract(raw, r"(\d+)", 1).try_cast("int")


def read_answer_keys(docs: DataFrame, id_col: str = "kind", json_col: str = "json", nested: bool = False) -> DataFrame:
    """(id, task_number, content) of JSON lists; unreadable or non-list text gives no rows.

    With ``nested`` a content that is an object or list becomes indented lines.
    """
    rows = docs.select(id_col, F.posexplode_outer(F.from_json(json_col, ITEMS)).alias("i", "e"))
    content = F.coalesce("e.content", F.lit(""))
    picked = rows.select(id_col, "i", task_number(F.col("e.task_number")).alias("task_number"), content.alias("content"))
    picked = picked.filter("task_number IS NOT NULL")
    if nested:
        picked = flatten_nested(picked, "content")
    return picked.groupBy(id_col, "task_number").agg(F.max_by("content", "i").alias("content"))


def _is_nested(value: Column) -> Column:
    """Whether the text is a well-formed JSON object or list, not only a text that begins with a bracket."""
    wrapped = F.concat(F.lit("["), value, F.lit("]"))  # parsers ignore what follows a value, but not inside a list
    alone = F.try_parse_json(wrapped).isNotNull() & (F.size(F.from_json(wrapped, "array<string>")) == 1)
    return F.coalesce(value.rlike(r"^\s*[\[{]") & alone, F.lit(False))


def flatten_nested(df: DataFrame, column: str) -> DataFrame:
    """Turn JSON objects and lists in ``column`` into "key: value" lines and "- " items, to any depth; other text stays as it is.

    A string value that is itself a JSON object or list counts as nested. Values are walked as rows: each round takes one level off
    all values that are still nested, whose lines and inner values keep the path that says where they stand, until none is
    left. The lines of one answer are finally put in the order of their paths.
    """
    tagged = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    open_values = tagged.filter(_is_nested(F.col(column))).select(
        "_row", F.array().cast("array<int>").alias("path"), F.lit("").alias("prefix"), F.col(column).alias("value")
    )
    lines = []
    while True:
        level = cut_lineage(open_values.select("_row", "path", F.inline(_children(F.col("value"), F.col("prefix")))))
        level = level.select("_row", F.concat("path", F.array("at")).alias("path"), "line", "prefix", "value")
        lines.append(level.filter("line IS NOT NULL").select("_row", "path", "line"))
        open_values = level.filter("value IS NOT NULL").select("_row", "path", "prefix", "value")
        if open_values.isEmpty():
            break
    texts = reduce(DataFrame.unionByName, lines).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("l"))
    flat = texts.select("_row", T.strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("_flat"))
    nested = F.coalesce("_flat", F.when(_is_nested(F.col(column)), F.lit("")), F.col(column))
    return tagged.join(flat, "_row", "left").withColumn(column, nested).select(*df.columns)


def _python_scalar(value: Column) -> Column:
    return F.when(value == "true", "True").when(value == "false", "False").otherwise(T.strip(value))


def _children(value: Column, prefix: Column) -> Column:
    """One level of a nested value: (at, line, prefix, value) per item or entry, with the inner value where it is nested."""
    def item(x: Column, i: Column) -> Column:
        inner, mark = _is_nested(x), F.concat(prefix, F.lit("- "))
        line = F.when(~inner & ~T.is_blank(x), F.concat(mark, _python_scalar(x)))
        return F.struct(i.alias("at"), line.alias("line"), mark.alias("prefix"), F.when(inner, x).alias("value"))

    def entry(e: Column, i: Column) -> Column:
        inner, key = _is_nested(e["value"]), F.concat(e["key"], F.lit(":"))
        line = F.when(inner | T.is_blank(e["value"]), key).otherwise(F.concat(key, F.lit(" "), _python_scalar(e["value"])))
        return F.struct(i.alias("at"), line.alias("line"), F.lit(" ").alias("prefix"), F.when(inner, e["value"]).alias("value"))

    entries = F.transform(F.map_entries(F.from_json(value, "map<string,string>")), entry)
    return F.when(value.rlike(r"^\s*\{"), entries).otherwise(F.transform(F.from_json(value, "array<string>"), item))


def read_candidate_json(docs: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """List form or object form of a candidate's answers.

    (id, candidate_format, filename, source_content_len, task_number, content, error); malformed text gives
    one row with the error.
    """
    as_list = F.from_json(json_col, ITEMS)
    as_object = F.from_json(json_col, OBJECT)
    is_list = F.col(json_col).rlike(r"^\s*\[")
    parsed = docs.select(id_col, is_list.alias("is_list"), as_list.alias("l"), as_object.alias("o")).select(
        id_col,
        F.when(F.col("is_list"), F.col("l")).otherwise(F.col("o.tasks")).alias("items"),
        F.when(F.col("is_list"), "list").otherwise("dict_with_tasks").alias("candidate_format"),
        F.col("o.filename").alias("filename"),
        F.length("o.content").alias("source_content_len"),
    )
    meta = parsed.withColumn("error", F.when(F.col("items").isNull(), "Expected a list of answers or an object with tasks"))
    rows = meta.select(id_col, "candidate_format", "filename", "source_content_len", "error", F.inline_outer("items"))
    return rows.select(
        id_col, F.when(F.col("error").isNull(), F.col("candidate_format")).alias("candidate_format"), "filename",
        "source_content_len", task_number(F.col("task_number")).alias("task_number"),
        F.when(F.col("error").isNull(), F.coalesce("content", F.lit(""))).alias("content"), "error",
    )


def candidate_json(documents: DataFrame, packed: DataFrame) -> DataFrame:
    """The object form built from stored answers (doc_id, json)."""
    tasks = F.array(
        *[
            F.struct(F.lit(k).alias("task_number"), T.strip(F.coalesce(F.col(f"task_{k}"), F.lit(""))).alias("content"))
            for k in (1, 2, 3, 4)
        ]
    )
    joined = documents.join(packed, "doc_id")
    body = F.struct(F.col("full_filename").alias("filename"), F.col("type").alias("file_type"), tasks.alias("tasks"))
    return joined.select("doc_id", F.to_json(body).alias("json"))


def parse_or_default(text: Column, schema: str, default: Column) -> Column:
    """Typed value of a JSON column; bad or missing text gives the default."""
    # a malformed text would give a struct of NULLs, so well-formedness is tested first
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)), default)


def to_text(value: Column) -> Column:
    """JSON text of a typed column, '' for NULL."""
    return F.coalesce(F.to_json(value), F.lit(""))
