"""Semantic and dialogue chunks: ordered rows of a document, cut where neighbours differ.

Sentences and exchanges become rows; windows over one document find their neighbours and running
counts of breaks name the chunks, so no document is held in one Python call. Where the provider of the
vectors is known, semantic chunks are cut in one pass over the documents instead (semantic_cuts.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkfall.functions.text import LINES, SPACE, SPACES, cosine, strip
from inkfall.operators import semantic_cuts
from inkfall.operators.retrieval import Embedding

#: Given a DataFrame and the name of a text column, adds an array<float> column "vector".
Embedder = Callable[[DataFrame, str], DataFrame]

_SENTENCE = rf"(?<=[。！？.!?\n]){SPACE}*"
_SPEAKER = rf"{LINES}^([\x{{4e00}}-\x{{9fff}}\w{SPACES}]{{1,20}})[：:]{SPACE}*"


def _places(parts: Column, gap: int = 0) -> Column:
    """array<struct<text, at>>: parts with the number of code points before each, `gap` between them."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<text: string, at: int>>)").alias("out"))
    add = lambda s, p: F.struct((s["at"] + F.length(p) + gap).alias("at"), F.array_append(s["out"], F.struct(p.alias("text"), s["at"].alias("at"))).alias("out"))
    return F.aggregate(parts, start, add, lambda s: s["out"])


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, sentence, start, end) of sentences without the white space around them, blanks left out.

    Places are running sums of the lengths of the parts and of the white space that the split takes.
    """
    parts, gaps = F.split(text_col, _SENTENCE, -1), F.regexp_extract_all(text_col, F.lit(_SENTENCE), F.lit(0))
    sized = F.zip_with(parts, gaps, lambda p, g: F.struct(p.alias("part"), (F.length(p) + F.coalesce(F.length(g), F.lit(0))).alias("n")))
    rows = df.select(F.col(id_col), F.posexplode(sized).alias("k", "s"))
    order = Window.partitionBy(id_col).orderBy("k")
    before = F.coalesce(F.sum("s.n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.length("s.part") - F.length(F.regexp_replace("s.part", rf"\A{SPACE}+", ""))
    found = rows.select(id_col, "k", strip(F.col("s.part")).alias("sentence"), (before + lead).cast("int").alias("start")).where("sentence <> ''")
    return found.select(id_col, (F.row_number().over(order) - 1).alias("i"), "sentence", "start", (F.col("start") + F.length("sentence")).alias("end"))


def _locate(text: Column, part: Column, start: Column) -> Column:
    """Code points before the part from `start` on, `start` if it isn't there."""
    at = F.call_function("locate", part, text, start + 1)
    return F.when(at > 0, at - 1).otherwise(start)


def windows(sents: DataFrame, buffer_size: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Each sentence with its neighbours, joined by spaces, as `combined`."""
    near = Window.partitionBy(id_col).orderBy("i").rowsBetween(-buffer_size, buffer_size)
    return sents.withColumn("combined", F.array_join(F.collect_list("sentence").over(near), " "))


def distances(rows: DataFrame, id_col: str = "doc_id", order_col: str = "i", vector_col: str = "vector") -> DataFrame:
    """Rows with the cosine distance to the next one of the document, null for the last."""
    after = Window.partitionBy(id_col).orderBy(order_col)
    return rows.withColumn("distance", 1.0 - cosine(F.col(vector_col), F.lead(vector_col).over(after)))


def threshold(method: str, amount: float, over: WindowSpec) -> Column:
    """The `distance` above which a document, the rows of a window, breaks."""
    if method not in ("percentile", "standard_deviation", "interquartile"):
        raise ValueError(f"不支持的断点类型: {method}")
    share = lambda q: F.percentile("distance", F.lit(q)).over(over)
    if method == "percentile":
        return share(amount / 100)
    mean = F.avg("distance").over(over)
    if method == "standard_deviation":
        return mean + amount * F.stddev_pop("distance").over(over)
    return mean + amount * (share(0.75) - share(0.25))


def breakpoints(rows: DataFrame, method: str = "percentile", amount: float = 95.0, id_col: str = "doc_id", order_col: str = "i") -> DataFrame:
    """Rows of distances() with the threshold, whether a break follows, and the segment's number."""
    whole, before = Window.partitionBy(id_col), Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("threshold", threshold(method, amount, whole))
    out = out.withColumn("break_after", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))
    return out.withColumn("segment", F.coalesce(F.sum(F.col("break_after").cast("int")).over(before), F.lit(0)).cast("int"))


def semantic(df: DataFrame, params: dict | None = None, embed: Embedder | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks between sentences whose contexts differ more than the document's threshold.

    A text of three sentences or fewer is one chunk. Chunks are slices of the text, so white space
    between sentences begins the next one. With an Embedding nothing is shuffled, each row is a document,
    and a document's text is held by one task; any other embedder makes rows of sentences, and an id
    must then name one document.
    """
    p = {"breakpoint_threshold": 95.0, "breakpoint_type": "percentile", "buffer_size": 1} | (params or {})
    if embed is None:
        raise RuntimeError("语义分块需要 Embedding：请提供 embed")
    amount, method = float(p["breakpoint_threshold"]), p["breakpoint_type"]
    threshold(method, amount, Window.partitionBy(id_col))
    docs = df.select(F.col(id_col), F.col(text_col).alias("_whole"))
    meta = F.to_json(F.struct(F.lit(amount).alias("breakpoint_threshold"), F.lit(method).alias("breakpoint_type")))
    if isinstance(embed, Embedding):
        out = semantic_cuts.cut(docs, embed, method, amount, int(p["buffer_size"]))
        return out.select(id_col, "chunk_index", "text", meta.alias("metadata"), "char_start", "char_end")
    sents = windows(sentences(docs, id_col, "_whole"), int(p["buffer_size"]), id_col)
    count = F.count("*").over(Window.partitionBy(id_col))
    many = sents.withColumn("_n", count).where("_n > 3")
    cut = breakpoints(distances(embed(many, "combined"), id_col), method, amount, id_col).where("break_after")
    ends = cut.groupBy(id_col).agg(F.array_sort(F.collect_list("end")).alias("_ends"))
    ends = ends.withColumnRenamed(id_col, "_id")
    joined = docs.join(ends, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce("_ends", F.array().cast("array<int>")), F.array(F.length("_whole"))))
    spans = F.transform(F.slice(bounds, 1, F.greatest(F.size(bounds) - 1, F.lit(1))), lambda b, i: F.struct(b.alias("a"), F.coalesce(F.get(bounds, i + 1), b).alias("b")))
    out = joined.select(id_col, "_whole", F.posexplode(spans).alias("chunk_index", "s"))
    return out.select(id_col, "chunk_index", F.substring(F.col("_whole"), F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("text"), meta.alias("metadata"), F.col("s.a").alias("char_start"), F.col("s.b").alias("char_end"))


def rounds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, speaker, said, full_text, start, end): what stands from one speaker's mark to the next.

    What comes before the first mark goes; a text without a mark is one round of no speaker.
    """
    text = F.col(text_col)
    marks, gaps = F.regexp_extract_all(text, F.lit(_SPEAKER), F.lit(0)), F.split(text, _SPEAKER, -1)
    bodies = F.slice(gaps, 2, F.greatest(F.size(marks), F.lit(1)))
    full = F.zip_with(marks, bodies, lambda m, b: F.concat(m, b))
    placed = _places(F.concat(F.slice(gaps, 1, 1), full))
    found = F.transform(F.slice(placed, 2, F.greatest(F.size(marks), F.lit(1))), lambda t, i: F.struct(t["text"].alias("raw"), t["at"].alias("start"), F.get(marks, i).alias("mark"), F.get(bodies, i).alias("body")))
    alone = F.array(F.struct(text.alias("raw"), F.lit(0).alias("start"), F.lit("").alias("mark"), text.alias("body")))
    rows = df.select(F.col(id_col), F.posexplode(F.when(F.size(marks) > 0, found).otherwise(alone)).alias("i", "r"))
    speaker = strip(F.regexp_replace("r.mark", rf"[：:]{SPACE}*\z", ""))
    marked = F.col("r.mark") != ""
    return rows.select(id_col, "i", speaker.alias("speaker"), F.when(marked, strip(F.col("r.body"))).otherwise(F.col("r.body")).alias("said"), F.when(marked, strip(F.col("r.raw"))).otherwise(F.col("r.raw")).alias("full_text"), F.col("r.start").alias("start"), (F.col("r.start") + F.length("r.raw")).alias("end"))


def _in_order(column: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda s: s[column])


def exchanges(turns: DataFrame, exchange_size: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Every `exchange_size` rounds together: (id, i, full_text, speakers, start, end, round_count)."""
    keyed = turns.withColumn("_e", F.floor(F.col("i") / exchange_size).cast("int"))
    out = keyed.groupBy(id_col, "_e").agg(F.array_join(_in_order("full_text", "i"), "\n\n").alias("full_text"), F.array_distinct(F.filter(_in_order("speaker", "i"), lambda s: s != "")).alias("speakers"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").cast("int").alias("round_count"))
    return out.withColumnRenamed("_e", "i")


def topics(rows: DataFrame, similarity_threshold: float = 0.75, id_col: str = "doc_id", order_col: str = "i", vector_col: str = "vector") -> DataFrame:
    """Rows with the similarity to the next one and the number of their topic; a break is strictly below."""
    order = Window.partitionBy(id_col).orderBy(order_col)
    out = rows.withColumn("similarity", cosine(F.col(vector_col), F.lead(vector_col).over(order)))
    cut = F.coalesce(F.col("similarity") < similarity_threshold, F.lit(False)).cast("int")
    return out.withColumn("topic", F.coalesce(F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))


def dialogue(df: DataFrame, params: dict | None = None, embed: Embedder | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of exchanges on one topic. Without an embedder each document is one chunk of all its rounds.

    A text of one round is a chunk as it is. Offsets are where a chunk stands in the text from the
    end of the one before it, or that end where it doesn't stand as joined.
    """
    p = {"similarity_threshold": 0.75, "exchange_size": 2} | (params or {})
    limit, size = float(p["similarity_threshold"]), int(p["exchange_size"])
    docs = df.select(F.col(id_col), F.col(text_col).alias("_whole"))
    turns = rounds(docs, id_col, "_whole").withColumn("_n", F.count("*").over(Window.partitionBy(id_col)))
    some = exchanges(turns.where("_n > 1"), size, id_col)
    some = topics(embed(some, "full_text"), limit, id_col) if embed else some.withColumn("topic", F.lit(0))
    parts = some.groupBy(id_col, "topic").agg(F.array_join(_in_order("full_text", "i"), "\n\n").alias("text"), F.count("*").cast("int").alias("exchange_count"), F.sum("round_count").cast("int").alias("round_count"), F.array_distinct(F.flatten(_in_order("speakers", "i"))).alias("speakers"))
    parts = parts.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("topic", "text", "exchange_count", "round_count", "speakers"))).alias("_parts"))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def walk(state: Column, part: Column) -> Column:
        start = _locate(F.col("_whole"), part["text"], state["at"])
        end = start + F.length(part["text"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    placed = F.aggregate("_parts", F.struct(F.lit(0).alias("at"), none.alias("out")), walk, lambda s: s["out"])
    meta = lambda q: F.to_json(F.struct(F.lit("dialogue_aware").alias("strategy"), q["exchange_count"].alias("exchange_count"), q["round_count"].alias("round_count"), q["speakers"].alias("speakers"), F.lit(limit).alias("similarity_threshold")))
    chunk = lambda text, metadata, start, end: F.struct(text.alias("text"), metadata.alias("metadata"), start.alias("char_start"), end.alias("char_end"))
    many = F.zip_with("_parts", placed, lambda q, at: chunk(q["text"], meta(q), at["start"], at["end"]))
    one = F.array(chunk(F.col("_whole"), F.lit('{"strategy":"dialogue_aware","rounds":1}'), F.lit(0), F.length("_whole")))
    joined = docs.join(parts, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return joined.select(id_col, F.posexplode(F.when(F.col("_parts").isNotNull(), many).otherwise(one)).alias("chunk_index", "c")).select(id_col, "chunk_index", "c.*")
