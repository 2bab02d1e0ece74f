"""Layout operators: text tables, images between text parts, automatic list numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import text as T
from markwell.operators.generate import numbered
from markwell.operators.running import running_sums
from markwell.operators.skew import skew_join

IMAGE_MARKER = r"\[Изображение[^\]]*\]"


def pipe_table_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of pipe-separated tables: (id, table_no, row_no, is_header, cells). Row-local, no shuffle.

    Splitting at the lines without a pipe leaves exactly the runs of table lines.
    """
    runs = F.filter(
        F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n[^|\n]*(?=\n|$)"), lambda r: F.length(r) > 0
    )

    def cells_of(line):
        cells = F.transform(F.split(T.strip(line), r"\|"), T.strip)
        joined = F.regexp_replace(F.array_join(cells, "\x1f"), r"^\x1f+|\x1f+$", "")
        return F.when(F.length(joined) > 0, F.split(joined, "\x1f"))

    def rows_of(run):
        lines = F.filter(
            F.split(run, "\n"), lambda ln: ln.contains("|") & ~T.strip(ln).rlike(r"^[-|: ]*$")
        )
        return F.filter(F.transform(lines, cells_of), lambda c: c.isNotNull())

    tables = F.filter(F.transform(runs, rows_of), lambda rows: F.size(rows) > 0)
    words = "|".join(K.TABLE_HEADER_WORDS)
    found = numbered(df, [id_col], tables, "t", "rows")
    rows = numbered(found, [id_col, "t"], "rows", "r", "cells")
    return rows.select(
        id_col,
        (F.col("t") + 1).cast("bigint").alias("table_no"),
        (F.col("r") + 1).cast("bigint").alias("row_no"),
        ((F.col("r") == 0) & F.lower(F.array_join("cells", " ")).rlike(words)).alias("is_header"),
        "cells",
    )


def interleave_images(texts: DataFrame, images: DataFrame) -> DataFrame:
    """Put the n-th image at the n-th image marker: (doc_id, seq, kind, content, image_path).

    Text parts and images meet on (doc_id, slot), so nothing is collected per document. The
    ordinal of an image is a running count over buckets of positions.
    """
    parts = numbered(texts, ["doc_id"], F.split("content", IMAGE_MARKER), "slot", "content")
    has_marker = texts.select("doc_id", F.col("content").rlike(IMAGE_MARKER).alias("marked"))
    parts = parts.join(has_marker, "doc_id").select(
        "doc_id", "slot", F.lit(0).alias("rank"), F.lit("text").alias("kind"),
        F.when(F.col("marked"), T.strip("content")).otherwise(F.col("content")).alias("content"),
        F.lit(None).cast("string").alias("image_path"),
    ).filter(~T.is_blank("content"))
    ordered = running_sums(images.filter("position IS NOT NULL"), ["doc_id"], "position", {"n": F.lit(1)})
    pictures = skew_join(ordered, texts.select("doc_id"), "doc_id").select(
        "doc_id", (F.col("n") - 1).cast("int").alias("slot"), F.lit(1).alias("rank"), F.lit("image").alias("kind"),
        F.lit(None).cast("string").alias("content"), "image_path",
    )
    merged = parts.unionByName(pictures).withColumn("order_key", F.col("slot").cast("bigint") * 2 + F.col("rank"))
    placed = running_sums(merged, ["doc_id"], "order_key", {"seq": F.lit(1)})
    return placed.select("doc_id", "seq", "kind", "content", "image_path")


def list_numbering(paragraphs: DataFrame) -> DataFrame:
    """Rebuild automatic list numbers of (doc_id, pos, list_id, level, text) paragraphs.

    A counter belongs to (doc, list, level) and restarts after any shallower item of the list;
    paragraphs that already start with a marker, or belong to no list, neither count nor get a number: their prefix is
    empty. Every paragraph is returned.
    """
    sp = K.SPACE_CLASS
    marked = F.col("text").rlike(rf"^[{sp}]*(\d+[.):]|[IVX]{{1,6}}[).:])") | F.col("text").rlike(rf"^[{sp}]*[-–—•][{sp}]+")
    level = F.greatest(F.lit(0), F.least(F.lit(8), F.coalesce(F.col("level"), F.lit(0))))
    paragraphs = paragraphs.withColumn("level", level)
    counts = F.col("list_id").isNotNull() & ~F.coalesce(marked, F.lit(False))
    items, others = paragraphs.filter(counts), paragraphs.filter(~counts)
    shallower = {f"_s{k}": (F.col("level") < k).cast("int") for k in range(1, 9)}
    seen = running_sums(items, ["doc_id", "list_id"], "pos", shallower)
    restart = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_s{k}")) for k in range(1, 9)], F.lit(0))
    grouped = seen.select(*items.columns, restart.alias("_restart"))
    counted = running_sums(grouped, ["doc_id", "list_id", "level", "_restart"], "pos", {"number": F.lit(1)})
    prefix = F.concat(F.repeat(F.lit("  "), F.col("level")), F.col("number"), F.lit(". "))
    numbered = counted.select(*items.columns, "number", prefix.alias("prefix"))
    return numbered.unionByName(others.withColumn("number", F.lit(None).cast("bigint")).withColumn("prefix", F.lit("")))
