"""What a preview shows: the first chunks, the text that they cover, and highlighted segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(n: Column, total: Column) -> Column:
    """A limit between 1 and the total; not a number counts as 1."""
    return F.greatest(F.lit(1), F.least(F.coalesce(F.nanvl(n.cast("double"), F.lit(1.0)), F.lit(1.0)).cast("int"), total))


def preview_chunks(chunks: DataFrame, limit: int | float | None = 10, id_col: str = "doc_id", with_total: bool = True) -> DataFrame:
    """The first `limit` chunks of each document, with total_chunks unless that is not wanted.

    The limit is clamped between 1 and the document's total; none and not a number count as 1.
    """
    shown = F.lit(limit).cast("double")
    if with_total:
        totals = chunks.groupBy(id_col).agg(F.count("*").alias("total_chunks"))
        return chunks.join(totals, id_col).where(F.col("chunk_index") < clamp(shown, F.col("total_chunks")))
    return chunks.where(F.col("chunk_index") < clamp(shown, F.lit(2147483647)))


def source_preview(docs: DataFrame, shown: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source_preview): the text up to 200 characters past the shown chunks.

    Without chunks it is the first 2000 characters; with chunks that have no places, the whole text.
    """
    ends = shown.groupBy(F.col(id_col).alias("_id")).agg(F.max("char_end").alias("_end"))
    text = F.col(text_col)
    part = F.when(F.col("_end").isNull(), F.substring(text, 1, 2000)).when(F.col("_end") == 0, text).otherwise(F.substring(text, F.lit(1), F.col("_end") + 200))
    return docs.join(ends, F.col(id_col) == F.col("_id"), "left").select(id_col, part.alias("source_preview"))


def highlight(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seg_start, seg_end, chunk_index, colour): gaps and chunks one after another.

    Chunks sort by place; one that overlaps those before it begins where they end, and one that they
    cover is left out. Gaps have no chunk_index and no colour; colours repeat after eight.
    """
    order = Window.partitionBy(id_col).orderBy("char_start", "char_end", "chunk_index")
    reached = F.coalesce(F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.select(id_col, "char_start", "char_end", "chunk_index", reached.alias("_at"))
    begin = F.greatest("char_start", "_at")
    segment = lambda a, b, k: F.struct(a.cast("int").alias("seg_start"), b.cast("int").alias("seg_end"), k.cast("int").alias("chunk_index"))
    own = F.array(segment(F.col("_at"), F.col("char_start"), F.lit(None)), segment(begin, F.col("char_end"), F.col("chunk_index")))
    parts = rows.select(id_col, F.explode(F.filter(own, lambda s: s["seg_end"] > s["seg_start"])).alias("s")).select(id_col, "s.*")
    ends = chunks.groupBy(F.col(id_col).alias("_id")).agg(F.max("char_end").alias("_end"))
    tails = docs.join(ends, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("_end", F.lit(0)).cast("int").alias("seg_start"), F.length(text_col).alias("seg_end"), F.lit(None).cast("int").alias("chunk_index"))
    return parts.union(tails.where("seg_end > seg_start")).withColumn("colour", F.col("chunk_index") % 8)
