"""Splitting of texts into overlapping pieces, in one Arrow batch at a time.

Pieces depend on the ones before them, so a text is split by one Python call; the rows themselves
never wait for each other. Each strategy gives one array of chunks a row, which is exploded once.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfall.operators import folds

SEPARATORS = ("\n\n", "\n", " ", "")
CHUNKS = "array<struct<text: string, char_start: int, char_end: int, part: int, sub: int, head: string>>"


def _parted(text: str, separator: str) -> list[str]:
    """Pieces that begin with the separator, but for the first."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _joined(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbours as long as they fit, each run beginning with the end of the one before it."""
    window: deque[str] = deque()
    total = 0
    for piece in pieces:
        if window and total + len(piece) > size:
            yield "".join(window)
            while total and (total > overlap or total + len(piece) > size):
                total -= len(window.popleft())
        window.append(piece)
        total += len(piece)
    if window:
        yield "".join(window)


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of up to `size` characters, cut at the first separator that the text has."""
    if overlap > size:
        raise ValueError(f"chunk_overlap {overlap} is larger than chunk_size {size}")
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    if separators[level] == "" and size > 1:  # single characters: every run is a slice
        step = max(1, size - overlap)
        return [s for i in range(0, max(len(text) - size, 0) + step, step) if (s := text[i : i + size].strip())]
    out: list[str] = []
    small: list[str] = []

    def flush() -> None:
        out.extend(s for run in _joined(small, size, overlap) if (s := run.strip()))
        small.clear()

    for piece in _parted(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        flush()
        finer = separators[level + 1 :]
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    flush()
    return out


def locate(text: str, chunk: str, start: int = 0) -> tuple[int, int]:
    """Where a chunk stands: as it is, else with any white space between its words, else by length."""
    at = text.find(chunk, start)
    if at >= 0:
        return at, at + len(chunk)
    words = chunk.split()
    if words and (found := re.compile(r"\s+".join(map(re.escape, words))).search(text[start:])):
        return start + found.start(), start + found.end()
    return start, start + len(chunk)


def recursive_chunks(text: str, size: int, overlap: int) -> list[tuple]:
    out, cursor = [], 0
    for chunk in split_text(text, size, overlap):
        start, end = locate(text, chunk, cursor)
        out.append((chunk, start, end, None, None, None))
        cursor = max(0, end - overlap)
    return out


def parent_child_chunks(text: str, parent: int, child: int, overlap: int, parents_only: bool) -> list[tuple]:
    out, cursor = [], 0
    for i, whole in enumerate(split_text(text, parent, 0)):
        start, end = locate(text, whole, cursor)
        cursor = end
        if parents_only:
            out.append((whole, start, end, i, None, None))
        else:
            out += [(t, start + a, start + b, i, k, f"{whole[:100]}...") for k, (t, a, b, *_) in enumerate(recursive_chunks(whole, child, overlap))]
    return out


def _exploded(df: DataFrame, text_col: str, split) -> DataFrame:
    @F.pandas_udf(CHUNKS)
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([split(t or "") for t in texts], dtype=object)

    kept = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    return df.select(*kept, F.posexplode(chunks(F.col(text_col))).alias("chunk_index", "chunk")).select(*[c for c in df.columns if c != text_col], "chunk_index", "chunk.*")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def recursive_character(df: DataFrame, params: dict | None = None, text_col: str = "text", native: bool = False) -> DataFrame:
    """Chunks of text_col: chunk_index, text, metadata, char_start, char_end, beside the other columns.

    `native` splits by folds of column expressions, with the same rows: no Python worker starts, but the
    JVM interprets the folds and takes three times as long or more.
    """
    p = {"chunk_size": 500, "chunk_overlap": 50} | (params or {})
    size, overlap = int(p["chunk_size"]), int(p["chunk_overlap"])
    if native and 1 < size >= overlap:
        kept = [c for c in df.columns if c != text_col]
        parts = F.posexplode(folds.recursive(text_col, size, overlap, SEPARATORS)).alias("chunk_index", "c")
        out = df.select(*[F.col(f"`{c}`") for c in kept], parts).select(*[F.col(f"`{c}`") for c in kept], "chunk_index", "c.*")
    else:
        out = _exploded(df, text_col, lambda t: recursive_chunks(t, size, overlap))
    return _finished(out, _json(chunk_size=F.lit(size), chunk_overlap=F.lit(overlap)))


def parent_child(df: DataFrame, params: dict | None = None, text_col: str = "text") -> DataFrame:
    """Children within their parents, or the parents alone."""
    p = {"parent_chunk_size": 2000, "child_chunk_size": 400, "child_chunk_overlap": 50, "return_parents_only": False} | (params or {})
    parent, child, overlap, only = int(p["parent_chunk_size"]), int(p["child_chunk_size"]), int(p["child_chunk_overlap"]), bool(p["return_parents_only"])
    out = _exploded(df, text_col, lambda t: parent_child_chunks(t, parent, child, overlap, only))
    if only:
        return _finished(out, _json(granularity=F.lit("parent"), parent_index=F.col("part"), parent_chunk_size=F.lit(parent)))
    return _finished(out, _json(granularity=F.lit("child"), parent_index=F.col("part"), child_index=F.col("sub"), parent_text_preview=F.col("head"), child_chunk_size=F.lit(child)))


def pdf_text(df: DataFrame, params: dict | None = None, text_col: str = "text") -> DataFrame:
    """What pdf_table_layout does with a text that has no PDF behind it."""
    p = {"chunk_size": 800, "chunk_overlap": 50} | (params or {})
    size, overlap = int(p["chunk_size"]), int(p["chunk_overlap"])
    return _finished(_exploded(df, text_col, lambda t: recursive_chunks(t, size, overlap)), _json(chunk_size=F.lit(size)))


def pdf_elements(df: DataFrame, params: dict | None = None, elements_col: str = "elements", text_col: str = "text") -> DataFrame:
    """Chunks of layout elements, array<struct<text, type, page_number, parser, page_range>>.

    Tables stay whole and other elements are split. Offsets count the elements one after another;
    a chunk that stands in text_col takes its first place there. Rows without elements are split as text.
    """
    p = {"chunk_size": 800, "chunk_overlap": 50} | (params or {})
    size, overlap = int(p["chunk_size"]), int(p["chunk_overlap"])
    names = ("type", "page_number", "parser", "page_range")

    @F.pandas_udf("array<struct<text: string, char_start: int, char_end: int, metadata: string>>")
    def chunks(elements: pd.Series, texts: pd.Series) -> pd.Series:
        import json

        def of(some, text: str) -> list[tuple]:
            out, offset = [], 0
            for e in some if some is not None else ():
                meta = {k: int(e[k]) if k == "page_number" else e[k] for k in names if e.get(k) is not None}
                if e.get("type") == "table":
                    out.append([e["text"], offset, offset + len(e["text"]), {"element_type": "table", **meta}])
                else:
                    out += [[t, offset + a, offset + b, {"chunk_size": size, "element_type": e.get("type", "text"), **meta}] for t, a, b, *_ in recursive_chunks(e["text"], size, overlap)]
                offset += len(e["text"]) + 1
            if not out:
                out = [[t, a, b, {"chunk_size": size}] for t, a, b, *_ in recursive_chunks(text, size, overlap)]
            for chunk in out:
                at = text.find(chunk[0])
                if some is not None and len(some) and at >= 0:
                    chunk[1:3] = at, at + len(chunk[0])
            return [(t, a, b, json.dumps(m, ensure_ascii=False)) for t, a, b, m in out]

        return pd.Series([of(e, t or "") for e, t in zip(elements, texts, strict=True)], dtype=object)

    kept = [c for c in df.columns if c not in (elements_col, text_col)]
    return df.select(*kept, F.posexplode(chunks(F.col(elements_col), F.col(text_col))).alias("chunk_index", "c")).select(*kept, "chunk_index", "c.text", "c.metadata", "c.char_start", "c.char_end")


def _finished(chunks: DataFrame, metadata: Column) -> DataFrame:
    own = ("chunk_index", "text", "char_start", "char_end", "part", "sub", "head")
    return chunks.select(*[c for c in chunks.columns if c not in own], "chunk_index", "text", metadata.alias("metadata"), "char_start", "char_end")
