"""Chunking strategies as table functions of SQL.

register(spark) makes each strategy callable on any table:

    SELECT * FROM recursive_character(TABLE(documents), chunk_size => 400)
    SELECT * FROM parent_child(TABLE(SELECT id, body FROM t), text_col => 'body')

The result has the table's other columns, then chunk_index, text, metadata, char_start and char_end,
as analyze() finds them from the argument. Rows are those of the DataFrame form. A parameter that a
strategy does not know, a text column that is not there, and a column with the name of a result's are
errors when the query is analysed. A row is chunked where it is; nothing is shuffled.

dialogue_aware is the form without an embedder; semantic compares vectors of neighbours and stays with
the DataFrame form, where an embedder can be given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from inkfall.operators import markdown, row_tables, score_tables, splitting
from inkfall.plans.registry import CATALOGUE

#: (text, metadata as JSON, start, end)
Chunk = tuple[str, str, int, int]
OUTPUT = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])
#: The start of a line up to a colon, of 20 ideographs, word characters and white space at most.
_SPEAKER = re.compile(r"^([一-鿿\w\s]{1,20})[：:]\s*", re.MULTILINE)


def _json(fields: dict) -> str:
    return json.dumps(fields, ensure_ascii=False, separators=(",", ":"))


def _recursive(text: str, p: dict) -> Iterator[Chunk]:
    meta = _json({"chunk_size": int(p["chunk_size"]), "chunk_overlap": int(p["chunk_overlap"])})
    for part, start, end, *_ in splitting.recursive_chunks(text, int(p["chunk_size"]), int(p["chunk_overlap"])):
        yield part, meta, start, end


def _pdf(text: str, p: dict) -> Iterator[Chunk]:
    for part, start, end, *_ in splitting.recursive_chunks(text, int(p["chunk_size"]), int(p["chunk_overlap"])):
        yield part, _json({"chunk_size": int(p["chunk_size"])}), start, end


def _parent_child(text: str, p: dict) -> Iterator[Chunk]:
    parent, child, only = int(p["parent_chunk_size"]), int(p["child_chunk_size"]), bool(p["return_parents_only"])
    for part, start, end, i, k, head in splitting.parent_child_chunks(text, parent, child, int(p["child_chunk_overlap"]), only):
        if only:
            yield part, _json({"granularity": "parent", "parent_index": i, "parent_chunk_size": parent}), start, end
        else:
            yield part, _json({"granularity": "child", "parent_index": i, "child_index": k, "parent_text_preview": head, "child_chunk_size": child}), start, end


def _markdown(text: str, p: dict) -> Iterator[Chunk]:
    for part, start, end, meta in markdown.markdown_chunks(text, list(markdown.HEADERS), bool(p["strip_headers"])):
        yield part, meta, start, end


def _dialogue(text: str, p: dict) -> Iterator[Chunk]:
    marks = list(_SPEAKER.finditer(text))
    if len(marks) < 2:
        yield text, _json({"strategy": "dialogue_aware", "rounds": 1}), 0, len(text)
        return
    ends = [m.start() for m in marks[1:]] + [len(text)]
    whole = "\n\n".join(text[m.start() : end].strip() for m, end in zip(marks, ends, strict=True))
    speakers = list(dict.fromkeys(s for m in marks if (s := m[1].strip())))
    start = max(0, text.find(whole))
    meta = {"strategy": "dialogue_aware", "exchange_count": -(-len(marks) // int(p["exchange_size"])), "round_count": len(marks), "speakers": speakers, "similarity_threshold": float(p["similarity_threshold"])}
    yield whole, _json(meta), start, start + len(whole)


def _html(text: str, p: dict) -> Iterator[Chunk]:
    for part, meta in row_tables.table_chunks(text, bool(p["enable_reference_resolution"]), p["template_style"], bool(p["skip_empty_rows"])) if text else ():
        yield part, meta, 0, 0


def _scores(text: str, p: dict) -> Iterator[Chunk]:
    try:
        found = score_tables.score_chunks(text, p["template_style"], int(p["max_field_length"])) if text else []
    except (IndexError, ValueError):
        if p["strict"]:
            raise
        found = []
    for part, meta in found:
        yield part, meta, 0, 0


#: Name -> chunks of a text, and the parameters that are not in the catalogue.
FUNCTIONS: dict[str, tuple[Callable[[str, dict], Iterator[Chunk]], dict]] = {
    "recursive_character": (_recursive, {}),
    "parent_child": (_parent_child, {"return_parents_only": False}),
    "markdown_structure": (_markdown, {}),
    "pdf_table_layout": (_pdf, {}),
    "dialogue_aware": (_dialogue, {}),
    "html_table": (_html, {}),
    "complex_table": (_scores, {"strict": False}),
}


def table_function(chunks_of: Callable[[str, dict], Iterator[Chunk]], defaults: dict):
    """A table function from the chunks of one text. Give one's own to add a strategy to SQL."""

    class Chunks:
        @staticmethod
        def analyze(docs: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
            if not docs.isTable:
                raise ValueError("the first argument must be a table")
            if unknown := set(given) - set(defaults) - {"text_col"}:
                raise ValueError(f"unknown parameters: {sorted(unknown)}, known are {sorted(defaults)}")
            text_col = given["text_col"].value if "text_col" in given else "text"
            fields = docs.dataType.fields
            if text_col not in [f.name for f in fields]:
                raise ValueError(f"no column {text_col}")
            kept = [f for f in fields if f.name != text_col]
            if clash := {f.name.lower() for f in kept} & {f.name for f in OUTPUT}:
                raise ValueError(f"columns that the result has too: {sorted(clash)}")
            return AnalyzeResult(T.StructType([*kept, *OUTPUT]))

        def eval(self, docs: Row, **given: object) -> Iterator[tuple]:
            params = defaults | {k: v for k, v in given.items() if k != "text_col" and v is not None}
            text_col = given.get("text_col") or "text"
            kept = [docs[f] for f in docs.__fields__ if f != text_col]
            for i, (text, meta, start, end) in enumerate(chunks_of(docs[text_col] or "", params)):
                yield (*kept, i, text, meta, start, end)

    return udtf(Chunks)


def register(spark: SparkSession) -> list[str]:
    """Make every strategy of FUNCTIONS callable from SQL; their names."""
    for name, (chunks_of, more) in FUNCTIONS.items():
        spark.udtf.register(name, table_function(chunks_of, CATALOGUE[name]["default_params"] | more))
    return list(FUNCTIONS)
